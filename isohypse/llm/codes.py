"""Vector code compression (11): vectors as four bytes, each the nearest entry of its part's codebook.

All arithmetic is on integers. A part's distances to a few fixed pivots are computed once and written
with it (LAESA). Each round computes the pivots' distances to the codebook's entries, too; the largest
difference of the two over the pivots bounds the distance of part and entry from below. Entries are
tried in the order of that bound, and those whose bound exceeds the best exact distance so far are
never evaluated.

A round is one pass over the written parts: each task returns a count and sums for each entry, which
Spark adds up; the codebook, 4 x 256 entries, is what the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialize
from .vectors import matrix

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Fixed pivots of each part position; entries tried first, in two steps, before the rest is pruned.
PIVOTS, FIRST, SECOND = 8, 4, 24
#: Parts whose bounds are held at a time.
CHUNK = 2048
#: Rows of a label's errors are joined in so many groups.
SALTS = 64


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id long, label, v array<int>: floor(1024 * x) of each component, without null and empty vectors
    and those with null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    big = F.exists(v, lambda x: F.abs(x) >= 2.0**18)
    ints = F.when(big, F.raise_error(F.lit("a component of 2^18 or more: distances wouldn't fit in 64 bits"))).otherwise(F.transform(v, lambda x: F.floor(x * SCALE).cast("int")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), ints.cast("array<int>").alias("v"))


def far_apart(book: np.ndarray, pivots: int) -> np.ndarray:
    """Entries that lie far from each other: each the one furthest from those before, ties to the lower index."""
    chosen = [0]
    least = ((book - book[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(book)):
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((book - book[chosen[-1]]) ** 2).sum(1))
    return book[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) Euclidean distances, rounded."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1).astype(np.float64))


def nearest_entries(x: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each part's nearest entry, ties to the lower index, and the exact
    evaluations that took."""
    entry_pivots = distances(book, pivots)
    index, best, evaluated = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    for at in range(0, len(x), CHUNK):
        own, far = x[at : at + CHUNK], to_pivots[at : at + CHUNK].astype(np.float64)
        n = len(own)
        bound = np.zeros((n, len(book)))
        for k in range(len(pivots)):
            a, b = far[:, k, None], entry_pivots[None, :, k]
            # rounding of both distances, which are kept as 32-bit floats
            np.maximum(bound, np.abs(a - b) - 3e-7 * (a + b), out=bound)
        bound *= bound
        low, entry = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        tried = np.zeros((n, len(book)), bool)
        for step in (FIRST, SECOND, len(book)):
            if step < len(book):
                some = np.argpartition(bound, step, axis=1)[:, :step]
                open_ = np.zeros_like(tried)
                np.put_along_axis(open_, some, True, 1)
                open_ &= ~tried & (bound <= low[:, None])
            else:
                open_ = ~tried & (bound <= low[:, None])
            rows, cols = np.nonzero(open_)
            if not len(rows):
                continue
            tried |= open_
            evaluated += len(rows)
            d = ((own[rows] - book[cols]) ** 2).sum(1)
            starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            owner = rows[starts]
            least = np.minimum.reduceat(d, starts)
            # the first column of the least distance; columns ascend within a row
            hit = np.flatnonzero(d == np.repeat(least, np.diff(np.append(starts, len(rows)))))
            first = cols[hit[np.concatenate(([True], rows[hit][1:] != rows[hit][:-1]))]]
            better = (least < low[owner]) | ((least == low[owner]) & (first < entry[owner]))
            low[owner[better]], entry[owner[better]] = least[better], first[better]
        index[at : at + n], best[at : at + n] = entry, low
    return index, best, evaluated


class Books:
    """The codebooks of all part positions (parts, entries, width) and their fixed pivots."""

    def __init__(self, start: np.ndarray):
        self.books = start
        self.pivots = [far_apart(b, PIVOTS) for b in start]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _split(v: pa.Array) -> np.ndarray:
    """(parts, rows, width) of a list column."""
    x = matrix(v).astype(np.int64)
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))


def _assign(batch: pa.RecordBatch, of: Books) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    x = _split(batch.column(2))
    far = matrix(batch.column(3)).reshape(len(batch), PARTS, -1)
    index, error = [], np.zeros(len(batch), np.int64)
    for p in range(PARTS):
        i, d, _ = nearest_entries(x[p], far[:, p], of.books[p], of.pivots[p])
        index.append(i)
        error += d
    return x, index, error


def with_pivots(rows: DataFrame, start: Books) -> DataFrame:
    """`far` array<float>: each part's distances to its position's pivots, computed once."""
    shared = rows.sparkSession.sparkContext.broadcast(start.pivots)

    def run(batches):
        for batch in batches:
            x = _split(batch.column(2))
            far = np.concatenate([distances(x[p], q) for p, q in enumerate(shared.value)], 1).astype(np.float32)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * far.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(far.ravel()))], ["vec_id", "label", "v", "far"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, StructType([*rows.select("vec_id", "label", "v").schema.fields, *rows.sparkSession.createDataFrame([], "far array<float>").schema.fields]))


def refine(rows: DataFrame, books: Books) -> np.ndarray:
    """The entries after one round: means of their parts, floored; an unused entry stays."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.books.shape

    def run(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x, index, _ = _assign(batch, shared.value)
            for p, i in enumerate(index):
                order = np.argsort(i, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], np.diff(i[order]) > 0))) if len(i) else np.empty(0, np.int64)
                if len(starts):
                    sums[p, i[order][starts]] += np.add.reduceat(x[p][order], starts, axis=0)
                n[p] += np.bincount(i, minlength=entries)
        p, e = np.nonzero(n)
        ends = np.arange(len(p) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[p, e].ravel()))], ["part", "entry", "n", "sums"])

    partial = rows.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    out = books.books.copy()
    for r in total.collect():  # a row for each entry at most
        out[r[0], r[1]] = [s // r[2] for s in r[3:]]
    shared.unpersist()
    return out


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error of each row under the given codebooks."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)], dtype=object)

    def run(batches):
        for batch in batches:
            _, index, error = _assign(batch, shared.value)
            code = hexes[index[0]]
            for i in index[1:]:
                code = code + hexes[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    fields = [*rows.select("vec_id", "label").schema.fields, StructField("code", StringType()), StructField("error", LongType())]
    return rows.mapInArrow(run, StructType(fields))


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each vector that takes part.

    Null and empty vectors and those with null or non-finite components take no part, nor do vectors of
    another width than that of the least vec_id that does. The width is a multiple of 4, components are
    under 2^18 in size; else an error is raised. Rows that repeat a vec_id each get a row; ties for the
    first codebook go by vec_id, nulls last, then by components. With fewer than 256 vectors the
    codebooks have as many entries. Null labels are one label. No vectors give no rows. Other columns
    are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ints = materialize(whole_numbers(vectors, vec_id, embedding, label), "whole-numbers")
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = ints.select("vec_id", "v").orderBy(*order).limit(1).collect()
    if not first:
        return ints.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = len(first[0]["v"])
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    ints = ints.where(F.size("v") == width)
    start = np.array([r["v"] for r in ints.select("vec_id", "v").orderBy(*order).limit(ENTRIES).collect()], np.int64)
    books = Books(start.reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy())
    rows = materialize(with_pivots(ints, books), "parts")
    for _ in range(rounds):
        books.books = refine(rows, books)
    coded = materialize(encode(rows, books), "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("own"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = coded.withColumn("place", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, (F.col("place") == F.col("salt")) & F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
