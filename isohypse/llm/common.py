"""Reading tables, scratch tables in the shared folder, and numpy helpers for Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to a Python worker: keeps a batch of long texts small.
BATCH_ROWS, BATCH_BYTES = 1000, 3 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of `sf_dir`, by Spark's reader only."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes; whole texts differ a thousandfold in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of fewer rows while a table is written, where single rows are large."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_files(spark: SparkSession):
    """Scratch tables' small files are read several in a task, as each task costs a file for each shuffle partition."""
    return _set(spark, "spark.sql.files.openCostInBytes", str(128 << 10))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset: below the warehouse, which executors
    share, or with a local master, as in tests, a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            local = spark.sparkContext.master.split("[")[0] == "local"
            base = tempfile.mkdtemp(prefix="isohypse-") if local else spark.conf.get("spark.sql.warehouse.dir")
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/isohypse-{app}"
        atexit.register(cleanup, spark)
    return _scratch[app]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete this application's scratch tables; DataFrames that read them can't be used any more."""
    try:
        path = _scratch.pop(spark.sparkContext.applicationId, None)
        if path:
            remove(spark, path)
    except Exception:  # the session has ended, and with it the means to reach the folder
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the write's shuffle files go when it ends; nothing else reads them
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._isohypse_path = path
    return out


def written(df: DataFrame) -> bool:
    """Whether `df` is a table that `materialize` made."""
    return hasattr(df, "_isohypse_path")


def drop(df: DataFrame) -> None:
    """Delete a table that `materialize` made and nothing will read again."""
    if path := getattr(df, "_isohypse_path", None):
        remove(df.sparkSession, path)


class PackedTexts:
    """A bounded sample of texts on the driver, each compressed; a slice or a list of places gives a list."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    @staticmethod
    def pack(text: str) -> bytes:
        return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self[i] for i in range(*at.indices(len(self)))]
        return zlib.decompress(self.packed[at]).decode("utf-8", "surrogatepass")

    def take(self, places: list[int]) -> "PackedTexts":
        return PackedTexts([self.packed[i] for i in places])


def give_back() -> None:
    """Return the memory of a fit that has ended, as the driver is small."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def text_or_empty(name: str = "text") -> "F.Column":
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, in place where it can."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One chunk, without an offset into a larger buffer's slice being an issue for `views`."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def views(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a string or binary array without nulls."""
    wide = array.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    return offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64), data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_POWER = np.ones(1 << 12, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, len(_POWER)):
        _POWER[_i] = _POWER[_i - 1] * np.uint64(0x9E3779B97F4A7C15)


def hash_strings(array: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of each string; equal strings have equal hashes everywhere."""
    offsets, data = views(array)
    n = len(array)
    if not n:
        return np.empty(0, np.uint64)
    size = np.diff(offsets)
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    terms = _BYTE[data] * _POWER[inside & (len(_POWER) - 1)]
    far = inside >= len(_POWER)
    if far.any():
        terms[far] = mix64(terms[far] + (inside[far] >> 12).astype(np.uint64))
    sums = np.zeros(n, np.uint64)
    full = size > 0
    if full.any():
        sums[full] = np.add.reduceat(terms, offsets[:-1][full])
    return mix64(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def batches(rows, weight, limit: int):
    """Slices of a record batch of at most `limit` of the summed `weight`, a heavier row alone."""
    total = np.cumsum(weight)
    at = 0
    while at < len(total):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right"))
        end = max(end, at + 1)
        yield rows.slice(at, end - at)
        at = end
