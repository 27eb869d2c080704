"""Fuzzy line dedup (7): MinHash over character shingles, exact check, distributed union-find.

A line's set is its shingles of CHARS consecutive characters (a shorter line is one shingle). Its
signature has HASHES least values under as many multiplications of the shingles' hashes by odd numbers;
BANDS bands join ROWS of them each, no value in two bands, and lines that agree on a band are candidates. Two lines
of similarity s meet with probability 1 - (1 - s^ROWS)^BANDS: 0.998 at the threshold, 0.9998 at 0.8, 0.64 at 0.5 and 1e-8
at 0.005, where unrelated lines are.
Candidates' Jaccard similarity is then computed exactly, and of each component of similar lines the first
by (doc_id, line_no) stays.

Equal lines are one from the start, under a 64-bit hash of the line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batches, drop, flat, materialize, mix64, partitions, small_files, text_or_empty, views
from .components import cross_by_sketch, linked, parities, star_pairs

CHARS, ROWS, BANDS, THRESHOLD = 8, 4, 16, 0.75
HASHES = ROWS * BANDS
#: Bytes of lines that are hashed at a time, so that the arrays stay in a core's cache; decides speed only.
PIECE_BYTES = 64 << 10
#: Rows of ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 400_000
#: Buckets of band keys for each shuffle partition, of which a task holds one at a time, and the keys dealt out together.
BUCKETS_A_PARTITION, KEYS_AT_ONCE = 8, 1 << 20

_RNG = np.random.default_rng(4099)
_A = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_hashes(lines: pa.Array, k: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all character shingles of the lines in a row, and how many each has; none for an empty line."""
    n = np.asarray(pc.utf8_length(lines)).astype(np.int64)
    data = bytes(memoryview(np.ascontiguousarray(views(lines)[1]))).decode()
    c = np.frombuffer(data.encode("utf-32-le"), np.uint32).astype(np.uint64)
    factor = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]
    h, have = c + np.uint64(1), 1  # a sum over `have` characters, each with its own product of factors
    for f in factor:
        step = min(have, k - have)
        if step <= 0:
            break
        after = h * f
        after[: max(0, len(h) - step)] += h[step:]
        h, have = after, have + step
    ends = np.cumsum(n)
    starts = ends - n
    size = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begins = np.ones(len(h), bool)  # whether a shingle begins here; a short line has its one at its start
    for j in range(1, k):
        begins[ends[n > j] - j] = False
    out = mix64(h[begins])
    short = np.flatnonzero((n < k) & (n > 0))
    at = (np.cumsum(size) - size)[short]
    for i, j in zip(short.tolist(), at.tolist()):
        own = c[starts[i] : ends[i]]
        out[j] = mix64(np.array([np.append((own + np.uint64(7)) * _POWERS[: len(own)], np.uint64(len(own))).sum()], np.uint64))[0]
    return out, size


_POWERS = mix64(np.arange(1, 64, dtype=np.uint64))


def band_keys(lines: pa.Array) -> np.ndarray:
    """(lines, BANDS) keys; lines aren't empty."""
    hashes, size = shingle_hashes(lines)
    starts = np.cumsum(size) - size
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    product, least = np.empty_like(low), np.empty((HASHES, len(size)), np.uint64)
    for h in range(HASHES):
        least[h] = np.minimum.reduceat(np.multiply(low, _A[h], out=product), starts)
    rows = (least.reshape(BANDS, ROWS, -1) * _POWERS[:ROWS, None]).sum(1) + _POWERS[ROWS : ROWS + BANDS, None]
    return np.ascontiguousarray(mix64(rows).T).view(np.int64)


def all_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, id (the line's hash) of lines that aren't blank; docs: doc_id, text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "").withColumn("id", F.xxhash64("line"))


def _small(ids: DataFrame) -> DataFrame:
    """The side of a join, to be broadcast if it is small; a written table."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def dealt_keys(keys: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """bucket, keys, ids: rows of equal length with all keys of a bucket and their ids."""
    own = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.uint32 if buckets > 1 << 16 else np.uint16)
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=buckets)
    there = np.flatnonzero(count)
    ends = pa.array(np.concatenate(([0], np.cumsum(count[there]))), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (keys, ids))], ["bucket", "keys", "ids"])


def shared_in(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, id) whose key has several ids, and c, the key's rows before they were made distinct."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    c = np.diff(np.append(np.flatnonzero(first), len(keys)))
    c = np.repeat(c, c)
    several = c > 1
    keys, ids, c = keys[several], ids[order[several]], c[several]
    order = np.lexsort((ids, keys))
    keys, ids, c = keys[order], ids[order], c[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, c = keys[new], ids[new], c[new]
    meets = keys[1:] == keys[:-1]
    keep = np.zeros(len(keys), bool)
    keep[1:] |= meets
    keep[:-1] |= meets
    return keys[keep], ids[keep], c[keep]


def dealt_bands(lines: DataFrame) -> DataFrame:
    """bucket, keys, ids: the BANDS keys of each line (id, line), many in a row, as few of them are shared."""
    buckets = BUCKETS_A_PARTITION * partitions(lines.sparkSession)

    def deal(rows):
        keys, own, have = [], [], 0
        for batch in rows:
            for part in batches(batch, np.diff(views(batch.column(1))[0]), BATCH_BYTES):
                ids, first = np.unique(part.column(0).to_numpy(), return_index=True)
                part = pa.RecordBatch.from_arrays([pa.array(ids), flat(part.column(1).take(pa.array(first)))], ["id", "line"])
                keys += [band_keys(piece.column(1)).ravel() for piece in batches(part, np.diff(views(part.column(1))[0]), PIECE_BYTES)]
                own.append(np.repeat(ids, BANDS))
                have += len(own[-1])
                if have >= KEYS_AT_ONCE:
                    yield dealt_keys(np.concatenate(keys), np.concatenate(own), buckets)
                    keys, own, have = [], [], 0
        if have:
            yield dealt_keys(np.concatenate(keys), np.concatenate(own), buckets)

    return lines.select("id", "line").mapInArrow(deal, "bucket int, keys array<long>, ids array<long>")


def shared_bands(lines: DataFrame) -> DataFrame:
    """key, id, c of the bands that several lines (id, line) have, as of `components.shared_keys`; a written table."""

    def share(table):
        keys, ids = (table.column(x).combine_chunks().flatten().to_numpy() for x in ("keys", "ids"))
        return pa.table([pa.array(x) for x in shared_in(keys, ids)], ["key", "id", "c"])

    return materialize(dealt_bands(lines).groupBy("bucket").applyInArrow(share, "key long, id long, c long"), "shared-keys")


def distinct_shingles(lines: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of lines of a batch, each once a line: ascending by (line, hash) and the line's number of each.

    The line's number takes the place of the hash's top bits; a batch of at most 4,096 lines leaves 52.
    """
    hashes, size = shingle_hashes(lines, k)
    bits = np.uint64(max(1, int(len(size) - 1).bit_length()))
    packed = np.sort((hashes >> bits) | (np.repeat(np.arange(len(size), dtype=np.uint64), size) << (np.uint64(64) - bits)))
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    return packed, (packed >> (np.uint64(64) - bits)).astype(np.int64)


def similar(x: pa.Array, y: pa.Array, k: int, threshold: float) -> np.ndarray:
    """Of each two lines whether their Jaccard similarity is at least the threshold."""
    (p, i), (q, j) = distinct_shingles(x, k), distinct_shingles(y, k)
    n, m = np.bincount(i, minlength=len(x)), np.bincount(j, minlength=len(x))
    together = np.sort(np.concatenate((p, q)), kind="stable")
    bits = np.uint64(max(1, int(len(x) - 1).bit_length()))
    both = np.bincount((together[1:][together[1:] == together[:-1]] >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(x))
    return both >= threshold * (n + m - both)


def candidate_lines(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, line of the lines whose hash is in ids (id); a written table."""
    ids = materialize(ids.distinct(), "line-ids")
    found = all_lines(docs).select("id", "line").join(_small(ids), "id", "left_semi")
    lines = materialize(found.groupBy("id").agg(F.first("line").alias("line")), "lines")
    drop(ids)
    return lines


def _similar(pairs: DataFrame, lines: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of line hashes, those of Jaccard similarity >= threshold; lines: id, line."""

    def run(rows):
        for batch in rows:
            for part in batches(batch, np.diff(views(batch.column(2))[0]) + np.diff(views(batch.column(3))[0]), PIECE_BYTES):
                keep = similar(part.column(2), part.column(3), k, threshold)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in part.columns[:2]], ["a", "b"])

    full = pairs.join(lines.selectExpr("id as a", "line as x"), "a").join(lines.selectExpr("id as b", "line as y"), "b")
    return materialize(full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "line-links")


def _sketches(ids: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """id, n, parity of the ids' lines."""

    def run(rows):
        for batch in rows:
            for part in batches(batch, np.diff(views(batch.column(1))[0]), PIECE_BYTES):
                packed, line = distinct_shingles(part.column(1), k)
                n = np.bincount(line, minlength=len(part))
                packed = packed << np.uint64(max(1, int(len(part) - 1).bit_length()))  # the hash again, but for its last bits, which no sketch looks at
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(parities(packed, line, len(part)), pa.binary())], ["id", "n", "parity"])

    return lines.join(ids, "id", "left_semi").select("id", "line").mapInArrow(run, "id long, n long, parity binary")


def first_lines(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, keeper_doc_id, keeper_line_no, kept: a row for each line that isn't blank.

    The keeper is the first line by (doc_id, line_no) of the component of similar lines; kept: whether
    the line is its own keeper. Lines end at \\n; blank ones (white space only) take no part. A null
    text has no lines; rows with a null doc_id come first in the order. Rows that repeat a doc_id count
    as the same document: their lines of one number are at one place, kept or dropped together. The bands
    are made for THRESHOLD: a lower one is an error.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"bands meet at similarities from {THRESHOLD} on")
    with small_files(docs.sparkSession):
        return _first_lines(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")), threshold)


def _first_lines(docs: DataFrame, threshold: float) -> DataFrame:
    shared = shared_bands(all_lines(docs))
    texts = candidate_lines(docs, shared.select("id"))
    own: list[DataFrame] = []

    def sketches(ids: DataFrame) -> DataFrame:
        if not own:  # later ids are among the first ones, as components only grow together
            own.append(materialize(_sketches(ids, texts, CHARS), "sketches"))
        return own[0]

    labels = linked(
        shared,
        star_pairs(shared),
        lambda pairs: _similar(pairs, texts, CHARS, threshold),
        [lambda mixed, tried, best=best: cross_by_sketch(mixed, tried, sketches, threshold, best) for best in (True, False)],
    )
    for x in (texts, *own):
        drop(x)
    labels = labels.where("id <> component")
    lines = all_lines(docs).select("doc_id", "line_no", "id").join(_small(labels), "id", "left")
    lines = materialize(lines.select("doc_id", "line_no", F.coalesce("component", "id").alias("group")), "line-groups")
    keepers = lines.groupBy("group").agg(F.min(F.struct("doc_id", "line_no")).alias("k"), F.count("*").alias("c"))
    keepers = materialize(keepers.where("c > 1").select("group", "k"), "keepers")  # a line alone is its own keeper
    own_place = F.struct("doc_id", "line_no")
    out = lines.join(_small(keepers), "group", "left").select("doc_id", "line_no", F.when(F.col("k").isNull(), own_place).otherwise(F.col("k")).alias("k"))
    out = out.selectExpr("doc_id", "line_no", "k.doc_id as keeper_doc_id", "k.line_no as keeper_line_no")
    return out.withColumn("kept", F.expr("doc_id <=> keeper_doc_id and line_no = keeper_line_no"))


def drop_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the dropped lines taken out of text, and n_chars, if there, set to the new length.

    A document of which no line is left goes, unless it had none but blank lines; others stay, as do
    blank lines and a document with a null doc_id. Columns stay as they are otherwise.
    """
    kept = first_lines(docs, threshold).where("kept and doc_id is not null").groupBy("doc_id").agg(F.collect_set("line_no").alias("kept"))
    own = max((x for x in docs.columns), key=len) + "_kept"  # no column of docs has that name
    one, two = docs.alias("one"), kept.withColumnRenamed("kept", own).alias("two")
    joined = one.join(two, F.col("one.doc_id") == F.col("two.doc_id"), "left").select("one.*", own)
    columns, schema = docs.columns, docs.schema
    at, where = columns.index("text"), columns.index("doc_id")
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def run(rows):
        for batch in rows:
            texts, stay = [], []
            for t, i, k in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist(), batch.column(len(columns)).to_pylist()):
                if t is None or i is None or not t.strip(" \t\n\r\x0b\x0c"):
                    texts.append(t)
                    stay.append(True)
                    continue
                k = set(k or ())
                texts.append("\n".join(x for n, x in enumerate(t.split("\n")) if n in k or not x.strip(" \t\r\x0b\x0c")))
                stay.append(bool(k))
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(texts, out[at].type)
            if chars is not None:
                out[chars] = pa.array([None if x is None else len(x) for x in texts], out[chars].type)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(stay, pa.bool_())) for c in out], columns)

    return joined.mapInArrow(run, schema)
