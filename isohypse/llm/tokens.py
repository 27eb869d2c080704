"""BPE encoding and decoding (5), and token ids in ORC files (6)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import BATCH_BYTES, batches, new_path, partitions, text_or_empty, views

END_ID = 1


def token_batches(rows, path: str, forms, text: str = "text"):
    """For each Arrow batch, in parts of bounded bytes: the part and its texts' forms."""
    for batch in rows:
        at = batch.schema.get_field_index(text)
        for part in batches(batch, np.diff(views(batch.column(at))[0]), BATCH_BYTES):
            yield part, bpe.encode_texts(path, part.column(at), forms)


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's ids by segment-tree BPE, as their number and digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A row for each row of `docs`, repeated rows included; a null text counts as empty (no ids, both
    digests those of nothing); a null id stays null. Other columns are ignored, whatever their names.
    """

    def run(rows):
        for part, (decimal, tokens) in token_batches(rows, path, (bpe.ids_decimal, bpe.ids_tokens)):
            out = []
            for d, t in zip(decimal, tokens):
                d, t = memoryview(d.as_buffer()), memoryview(t.as_buffer())
                out.append((hashlib.sha256(d[1:]).hexdigest(), hashlib.sha256(t[1:]).hexdigest()))
            offsets, data = views(decimal)
            blanks = np.concatenate(([0], np.cumsum(data == 32)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(blanks[offsets])), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = None) -> DataFrame:
    """doc_id, ids array<int>: the ids themselves, `end_id` behind each text's if given."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(rows):
        for part, (ids,) in token_batches(rows, path, (bpe.ids_bytes,)):
            yield pa.RecordBatch.from_arrays([part.column(0), _with_end(ids, end)], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def _with_end(ids: pa.Array, end: bytes) -> pa.Array:
    """A list of ids for each value of a binary array, with the end id behind it."""
    offsets, data = views(ids)
    size = np.diff(offsets) // 4
    values = np.frombuffer(np.ascontiguousarray(data), "<i4")
    if end:
        at = offsets[1:] // 4
        values = np.insert(values, at, np.frombuffer(end, "<i4")[0])
        size = size + 1
    ends = np.concatenate(([0], np.cumsum(size)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: decoding of `encode_ids`' rows; special tokens are kept, and unknown ids raise."""

    def run(rows):
        tok = bpe.tokenizer(path)
        for batch in rows:
            lists = batch.column(1)
            text = [" ".join([tok.tokens[i] for i in x]) if x is not None else None for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def write_ids(docs: DataFrame, path: str, out: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Write each document's ids to ORC files below `out`, in ascending doc_id order over all files.

    The rows are dealt by ranges of doc_id and sorted (null ids first, equal ids by text), so file
    `part` precedes file `part + 1`. ORC keeps the ids by integer run-length encoding, an index entry
    for each 1,000 rows with the least and largest doc_id, and a Bloom filter on doc_id; stripes are
    read in parallel. Columns: doc_id, ids, n_tokens, part, start_in_part (ids of the same file before).
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(rows):
        from pyspark import TaskContext

        part_no, total = TaskContext.get().partitionId(), 0
        for part, (ids,) in token_batches(rows, path, (bpe.ids_bytes,)):
            lists = _with_end(ids, end)
            size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            start = total + np.cumsum(size) - size
            total += int(size.sum())
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(size), pa.array(np.full(len(size), part_no, np.int32)), pa.array(start)], ["doc_id", "ids", "n_tokens", "part", "start_in_part"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, part int, start_in_part long")
        .write.option("compression", "zstd").option("orc.stripe.size", str(8 << 20)).option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(out)
    )


IDS_SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, start_in_part long"


def read_ids(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of `write_ids`' files; `doc_ids` reaches the row indexes and Bloom filters."""
    rows = spark.read.schema(IDS_SCHEMA).orc(out)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def stored_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: `start` counts the ids of all documents before.

    The files' totals are one row a file; only they are summed in one task.
    """
    files = read_ids(spark, out).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    files = files.select("part", F.expr("coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("base"))

    def run(rows):
        for batch in rows:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets).astype(np.int64)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
            data = memoryview(values).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], ["doc_id", "n_tokens", "ids_crc32", "part", "start_in_part"])

    rows = read_ids(spark, out).select("doc_id", "ids", "part", "start_in_part").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, part int, start_in_part long")
    return rows.join(F.broadcast(files), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """`write_ids` to the shared folder, then `stored_digests` of what was written.

    No documents give no rows. Repeated rows are written as often as they come.
    """
    out = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, out)
    return stored_digests(docs.sparkSession, out)
