"""N-gram Jaccard join (8): size-aware heavy-light self-join of documents' shingle sets, exact.

Documents with equal sets are one class; classes are joined. For a threshold t, two sets of sizes n
and m that link share all but n - ceil(t n) elements of either, so in any common order of the
elements they share one of the first n - ceil(t n) + 1, and two of the first n - ceil(t n) + 2 (from
sizes where two must be shared). Hence

- light sets, of at most `boundary` elements, enumerate the subsets of two of their prefix; light
  pairs meet in a subset;
- heavy sets scan inverted lists of their prefix's single elements. Light sets of at least t *
  boundary elements, which can link with heavy ones, are in these lists too.

The boundary is the size up to which subsets cost less than lists, summed over the measured sizes.

Order: elements by hash, but those that many documents share come last, so that common passages
stay out of the prefixes. Which are common decides only how fast the join is. Every element that a
fraction COMMON of all documents holds is common in some task, so it is found by counting in tasks.

Candidates are thinned without loss before the exact check: two sets' bitmaps of hash parities
differ in at most as many bits as the sets in elements. A set's bitmap has twice as many bits as the set has
elements; of two, the longer one is folded to the shorter one's length.

The exact check is between classes, known by a hash of their set: each class's text goes to its pairs' head
and is cut into shingles there, as text compresses and hashes don't.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batches, drop, materialize, mix64, partitions, text_or_empty, views
from .components import cross_by_sketch, fold, linked, parity, shared_keys, small, star_pairs
from .shingles import shingle_rows

THRESHOLD = Fraction(3, 4)
SHINGLE = 5
#: Documents' part from which an element is common, the least number in a task, and how many may be remembered.
COMMON, COMMON_LEAST, COMMON_MOST = 0.002, 4, 200_000
#: Cost of an element in an inverted list against one of a subset: it is dealt and sorted alike, and its lists are longer.
LIST_COST = 3
#: Bits of a bitmap: the power of two from twice the set's elements on, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Sets that meet a set in one task.
HEAD_PART = 2000


def required(n: int, t: Fraction) -> int:
    """Elements of a set of n that any partner must share."""
    return -(-t.numerator * n // t.denominator)


def _sets(rows, k: int):
    """Each bounded part of the batches of (id, text, ...), and its sets."""
    for batch in rows:
        for part in batches(batch, np.diff(views(batch.column(1))[0]), BATCH_BYTES):
            yield part, shingle_rows(part.column(1), k)


def parity_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * n - 1).bit_length())) if n else LEAST_BITS


def parity_differ(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded."""
    u, v = (np.frombuffer(z, np.uint64)[None, :] for z in (x, y))
    short = min(u.shape[1], v.shape[1])
    return int(np.bitwise_count(fold(u, short) ^ fold(v, short)).sum())


def describe(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """id, h (a hash of the text), n, cls (a hash of the set), parity of each row; and the elements common in a task (e, seen).

    docs: id, text, h.
    """

    def run(rows):
        total, ids_seen = {}, 0
        hashes = []
        waiting = 0

        def fold():
            nonlocal waiting
            if hashes:
                value, n = np.unique(np.concatenate(hashes), return_counts=True)
                hashes.clear()
                waiting = 0
                for v, c in zip(value[n >= COMMON_LEAST].tolist(), n[n >= COMMON_LEAST].tolist()):
                    total[v] = total.get(v, 0) + c

        for part, sets in _sets(rows, k):
            n = np.array([len(x) for x in sets], np.int64)
            ids_seen += len(n)
            cls, bits = [], []
            for x in sets:
                u = x.view(np.uint64)
                whole = u.sum(keepdims=True) + np.uint64(len(x)) + (mix64(u).sum(keepdims=True) << np.uint64(1))
                cls.append(int(mix64(whole).view(np.int64)[0]) if len(x) else 0)
                bits.append(parity(x, parity_bits(len(x))))
            hashes += sets
            waiting += int(n.sum())
            if waiting > 4_000_000:
                fold()
            yield _described(part.column(0), part.column(2), n, cls, bits, [None] * len(n))
        fold()
        least = max(COMMON_LEAST, COMMON * ids_seen)
        found = sorted(((c, v) for v, c in total.items() if c >= least), reverse=True)
        m = len(found)
        yield _described(pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), np.array([c for c, _ in found], np.int64), [None] * m, [None] * m, [v for _, v in found])

    rows = materialize(docs.select("id", "text", "h").mapInArrow(run, "id long, h long, n long, cls long, parity binary, e long"), "sets")
    return rows.where("e is null").select("id", "h", "n", "cls", "parity"), rows.where("e is not null").select("e", F.col("n").alias("seen"))


def _described(ids, h, n, cls, bits, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, h, pa.array(n), pa.array(cls, pa.int64()), pa.array(bits, pa.binary()), pa.array(e, pa.int64())], ["id", "h", "n", "cls", "parity", "e"])


def choose_boundary(sizes: list[tuple[int, int]], t: Fraction) -> int:
    """The largest light size, by least cost over (size, documents); sizes over 4,000 are never light."""
    sizes = sorted(x for x in sizes if x[0] <= 4000)
    n = np.array([x[0] for x in sizes], np.int64)
    count = np.array([x[1] for x in sizes], np.int64)
    p = n - np.array([required(int(x), t) for x in n], np.int64) + 1
    light = np.concatenate(([0], np.cumsum(count * p * (p + 1) // 2)))
    heavy = np.concatenate(([0], np.cumsum(count * p * LIST_COST)))
    choices = np.concatenate(([0], n))
    listed = np.searchsorted(n * t.denominator, choices * t.numerator, "right")  # sizes that need no list
    return int(choices[np.argmin(light[np.arange(len(choices))] + heavy[-1] - heavy[listed])])


def set_keys(row: np.ndarray, common: np.ndarray, boundary: int, t: Fraction) -> np.ndarray:
    """The keys under which a set is put: subsets of two if light, single elements if it may meet a heavy one."""
    n = len(row)
    first = n - required(n, t) + 1
    order = row
    if len(common):
        at = np.searchsorted(common, row)
        at[at == len(common)] = 0
        late = common[at] == row
        if late.any():
            order = np.concatenate((row[~late], row[late]))
    out = []
    if n <= boundary:
        if n < 3:
            out.append(mix64(order[:first].view(np.uint64) + np.uint64(3)))  # links with equal sets only
        else:
            prefix = order[: first + 1].view(np.uint64)
            i, j = np.triu_indices(len(prefix), 1)
            low, high = np.minimum(prefix[i], prefix[j]), np.maximum(prefix[i], prefix[j])
            out.append(mix64(mix64(low) + high * np.uint64(0x9E3779B97F4A7C15)))
    if n > boundary * t:
        out.append(order[:first].view(np.uint64))
    return np.concatenate(out).view(np.int64)


def thin_pairs(pairs: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) without those whose bitmaps differ too much for a Jaccard similarity of t; classes: cls, n, parity."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("parity").alias("pa"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("parity").alias("pb"))

    def thin(rows):
        for batch in rows:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            differ = np.array([parity_differ(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            # with u = |A or B| and i = |A and B|: n + m = u + i, the difference is u - i, and i >= t u
            keep = differ * (t.numerator + t.denominator) <= (n + m) * (t.denominator - t.numerator)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "pa", "pb").mapInArrow(thin, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (id, h, ...) with its document's text; documents that repeat id and text come again."""
    return docs.join(small(wanted), ["id", "h"])


def verify_pairs(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, t: Fraction) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose sets' Jaccard similarity is at least t; `pairs` is a written table.

    No pair comes twice. b's text goes to its a, in parts of HEAD_PART where an a has more; a's text goes to each part before them.
    """
    parts = pairs.groupBy("a").agg(F.count("*").alias("m"), F.min("b").alias("lead")).selectExpr("a", f"cast(ceil(m / {HEAD_PART}) as int) as parts", "lead")
    own = "array(struct(b as cls, cast(pmod(xxhash64(b), parts) as int) as part))"
    heads = "if(b = lead, transform(sequence(0, parts - 1), x -> struct(a as cls, x as part)), array())"
    put = pairs.join(parts, "a").selectExpr("a as head", f"explode(concat({own}, {heads})) as x").selectExpr("x.cls", "head", "x.part")
    wanted = materialize(put.join(small(classes.select("cls", "id", "h")), "cls"), "to-check")
    read = texts_of(docs, wanted).selectExpr("cls", "head", "part", "text")

    def exact(rows):
        head, own = None, None
        for batch in rows:
            for piece in batches(batch, np.diff(views(batch.column(3))[0]), BATCH_BYTES):
                found: tuple[list[int], list[int]] = ([], [])
                sets = shingle_rows(piece.column(3), k)
                for x, h, s in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), sets):
                    if x == h:
                        head, own = h, s.copy()
                    elif h == head:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if both * t.denominator >= t.numerator * (len(own) + len(s) - both):
                            found[0].append(h)
                            found[1].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    dealt = read.repartition(partitions(docs.sparkSession), "head", "part").sortWithinPartitions("head", "part", F.col("cls") != F.col("head"))
    found = materialize(dealt.mapInArrow(exact, "a long, b long"), "links")
    drop(wanted)
    return found


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, t: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of `docs`.

    Two documents link when their sets' Jaccard similarity is at least t; component_id is the least
    doc_id reachable by links. A null, empty or blank text has no shingles and links with nothing. Rows
    that repeat a doc_id are a document each with that id, in any order; a null doc_id takes no part in links,
    and its component is null. Other columns are ignored. No documents give no rows. Sets of two elements
    are put where only equal ones meet them, so t is over two thirds; else an error is raised.
    """
    return joined_rows(docs, doc_id, text, k, t).drop("h")


def joined_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, t: Fraction = THRESHOLD) -> DataFrame:
    """The rows of `join_components` with h, the 64-bit hash of their text (null: empty): rows of one doc_id may have several texts."""
    if 3 * t <= 2:
        raise ValueError("a threshold over two thirds is needed")
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    described, seen = describe(docs, k)
    common = seen.groupBy("e").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "e").limit(COMMON_MOST)
    common = np.sort(np.array([r["e"] for r in common.select("e").collect()], np.int64))
    sizes = described.where("n > 0 and n <= 4000").groupBy("n").count().collect()
    boundary = choose_boundary([(r["n"], r["count"]) for r in sizes], t)
    # documents of equal sets are one class: known by cls, read from the row of the least id
    real = described.where("n > 0 and id is not null")
    classes = materialize(real.groupBy("cls").agg(F.min(F.struct("id", "h", "n", "parity")).alias("x")).selectExpr("cls", "x.*"), "classes")
    shared_common = spark.sparkContext.broadcast(common)

    def keys(rows):
        for part, sets in _sets(rows, k):
            each = [set_keys(x, shared_common.value, boundary, t) if len(x) else x for x in sets]
            size = np.array([len(x) for x in each], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(each)), pa.array(np.repeat(part.column(0).to_numpy(), size)), pa.array(np.repeat([len(x) for x in sets], size).astype(np.int64))],
                ["key", "id", "n"],
            )

    put = texts_of(docs, classes.select("cls", "id", "h")).select("cls", "text").mapInArrow(keys, "key long, id long, n long")
    shared = shared_keys(put)

    def cross(best: bool):
        return lambda mixed, tried: cross_by_sketch(mixed, tried, lambda ids: classes.selectExpr("cls as id", "n", "parity").join(ids, "id", "left_semi"), float(t), best)

    labels = linked(shared, thin_pairs(star_pairs(shared, float(t)), classes, t), lambda pairs: verify_pairs(pairs, docs, classes, k, t), [cross(True), cross(False)])
    # a component's id is the least id of its classes' documents
    least = classes.select("cls", "id").join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = least.join(least.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("cls", "component_id")
    out = described.join(named, "cls", "left")
    return out.select(F.col("id").alias("doc_id"), "h", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))
