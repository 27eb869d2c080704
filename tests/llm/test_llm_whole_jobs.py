"""Places where an operator once did less than its whole job."""

from fractions import Fraction

import numpy as np
import pytest

from isohypse.llm import components, licenses, lines, ngram_join, vectors


def test_licenses_need_the_whole_template(spark):
    by = licenses.TEMPLATES["CC-BY-4.0"][1]
    long = licenses.TEMPLATES["MIT"][2]
    words = long.split()
    pad = "other words stand here before and after it " * 7
    rows = [(1, pad + by + pad), (2, licenses.TEMPLATES["Apache-2.0"][0]), (3, pad + " ".join(words[:20]) + " " + pad), (4, pad + " ".join([*words[:12], "altered", *words[13:]])), (5, " ".join(words[:15]) + " " + pad * 3 + " ".join(words[15:]))]
    got = {(r["doc_id"], r["license"], r["template"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "CC-BY-4.0", 1), (2, "Apache-2.0", 0), (4, "MIT", 2)}
    n = len(words) - 2
    assert got[1, "CC-BY-4.0", 1]["containment"] == 1 and abs(got[4, "MIT", 2]["containment"] - (n - 3) / n) < 1e-12
    assert 48 <= got[1, "CC-BY-4.0", 1]["first_word"] <= 60 and got[4, "MIT", 2]["n_windows"] > 3


@pytest.mark.parametrize("rows,width,together", [(10**4, 64, 2), (10**6, 64, 3), (10**8, 64, 4), (10**9, 64, 5), (10**6, 256, 3), (10**4, 16, 3)])
def test_vectors_meet_at_every_size_and_width(rows, width, together):
    assert vectors.rotations(rows, width) == together
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(2, 500, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.9**2) * z / np.linalg.norm(z, axis=1)[:, None]
    tables = vectors.tables_for(together, width)
    a, b = (vectors.buckets(v, together, tables) for v in (x, y))
    assert ((a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))).all()


@pytest.mark.parametrize("wide,centres", [(64, 1), (64, 200), (16, 40)])
def test_a_search_visits_a_small_part_of_a_shard(wide, centres):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(centres, wide))[rng.integers(0, centres, 12_000)] * 3 + rng.normal(size=(12_000, wide)) * 0.5
    g = vectors.build(x)
    seen, mark, hits, visited = np.full(len(x), -1, np.int32), 0, 0, []
    for q in range(0, len(x), 120):
        got = vectors.find(g, x[q], 11, seen, mark)
        visited.append(((seen >= mark) & (seen < mark + 16)).sum())
        mark += 16
        hits += len(set(got.tolist()) & set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:11].tolist()))
    assert hits >= 0.95 * 11 * len(visited) and np.mean(visited) < 0.2 * len(x)


def test_thresholds_below_the_methods_are_errors(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for call in (lambda: lines.first_lines(docs, 0.7), lambda: ngram_join.join_components(docs, t=Fraction(2, 3)), lambda: components.cross_by_sketch(docs, docs, lambda ids: ids, 0.4)):
        with pytest.raises(ValueError):
            call()
