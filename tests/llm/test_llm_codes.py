"""Vector codes against plain integer arithmetic over all entries."""

import hashlib

import numpy as np
import pytest

from isohypse.llm import codes, common


def brute(rows):
    """rows: (vec_id, vector, label), kept ones only, in the order of the first codebook."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) for c in v] for _, v, _ in rows], dtype=object).reshape(len(rows), 4, -1)
    books = [[list(x[i][p]) for i in range(min(256, len(rows)))] for p in range(4)]

    def nearest(part, book):
        return min((sum((int(a) - int(b)) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            got = {}
            for row in x:
                got.setdefault(nearest(row[p], books[p])[1], []).append(row[p])
            for e, parts in got.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    out = []
    for (i, _, label), row in zip(rows, x):
        found = [nearest(row[p], books[p]) for p in range(4)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label])
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, part int, v string"


def table(spark, rows):
    common.tune(spark)
    return spark.createDataFrame([(*r, "c", 1, 2, "x") for r in rows], SCHEMA)


def test_codes_are_those_of_all_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 3 % 701, rng.normal(0, 0.3, 8).astype(np.float32).tolist(), [None, 1, 2, 3][i % 4]) for i in range(400)]
    rows += [(9000 + i, [0.25] * 8, 7) for i in range(20)]  # a group of copies
    bad = [(-1, None, 1), (-2, [float("nan")] * 8, 1), (-3, [0.0] * 7 + [None], 1), (-4, [float("inf")] + [0.0] * 7, 1), (-5, [], 1), (9999, [1.0] * 4, 1)]
    want = brute(sorted(rows, key=lambda r: r[0]))
    assert got(codes.compress(table(spark, rows + bad))) == want


def test_few_repeated_and_tied_rows(spark):
    rows = [(5, [0.0, 1.0, -0.0005, 2.0], 1), (5, [0.0, 1.0, -0.0005, 2.0], None), (2, [1.0, 1.0, 1.0, 1.0], None), (3, [0.0, 0.0, 0.0, 0.0], 1)]
    out = got(codes.compress(table(spark, rows)))
    assert out == brute(sorted(rows, key=lambda r: r[0])) and len(out) == 4


def test_no_rows_and_wrong_width(spark):
    assert got(codes.compress(table(spark, []))) == []
    assert codes.compress(table(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(1, [1.0, 2.0, 3.0], 1)]))


def test_pruning_is_exact_and_prunes():
    rng = np.random.default_rng(6)
    centres = rng.integers(-300, 300, (40, 16))
    x = centres[rng.integers(0, 40, 5000)] + rng.integers(-20, 21, (5000, 16))
    book = x[:256].copy()
    book[7] = book[3]
    pivots = codes.far_apart(book, codes.PIVOTS)
    far = codes.distances(x, pivots).astype(np.float32)
    index, best, evaluated = codes.nearest_entries(x, far, book, pivots)
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (best == d.min(1)).all() and (index == d.argmin(1)).all()
    assert evaluated < 0.3 * x.shape[0] * len(book)
