"""Source divergence audit (13): how the sources of a language differ in their words, by run-length columns.

1. Terms are counted by document in the tasks that read them, and summed by (lang, source, term); a
   language keeps the terms of at least three of its documents.
2. The vocabulary is reordered so that terms of equal counts in all sources lie together: such a run is
   one row with its length, and rows are sorted by their counts. Few rows stand for many terms, as most are rare.
3. A source's column over that order is run-length encoded, block by block. For each two sources the
   boundaries of their runs are intersected; f is taken once for each common run and multiplied by its length.
   The blocks' sums are added up.

A block is a bounded stretch of the order, so no task holds a language. All arithmetic is on whole
numbers of 64 bits (128 where a product needs it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, materialize, partitions, text_or_empty, views

#: Documents that a kept term needs; ranks reported of a source's terms.
LEAST_DOCUMENTS, RANKS = 3, 200
#: Rows a task gathers before it sums them; counts of a block of the vocabulary, over all sources; parts of a source's ranking.
GATHERED, BLOCK_CELLS, SALTS = 400_000, 1 << 17, 64

#: Bytes of terms, lower-cased: letters, and all of characters beyond ASCII. Others count as blanks.
_TERM = np.full(256, 32, np.uint8)
_TERM[128:] = np.arange(128, 256)
_TERM[97:123] = np.arange(97, 123)
_TERM[65:91] = np.arange(97, 123)


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, dictionary-encoded, and the text of each."""
    offsets, data = views(flat(texts).cast(pa.large_string()))
    mapped = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(_TERM[data])])
    split = pc.ascii_split_whitespace(mapped)
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)))
    found = split.flatten()
    real = pc.greater(pc.binary_length(found), 0)
    return pc.dictionary_encode(found.filter(real)), owner[real.to_numpy(zero_copy_only=False)]


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, docs of a batch, and a row of a null term for each group."""
    groups = pa.table({"lang": batch.column(0), "source": batch.column(1)}).group_by(["lang", "source"]).aggregate([])
    key = pc.binary_join_element_wise(pc.cast(pc.binary_length(batch.column(0)), pa.string()), batch.column(0), batch.column(1), "\x00")
    coded_groups = pc.dictionary_encode(key)
    group = coded_groups.indices.to_numpy()
    first = np.unique(group, return_index=True)[1]
    coded, owner = terms(batch.column(2))
    size = max(1, len(coded.dictionary))
    of_doc, n = np.unique(owner * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    in_group = group[of_doc // size] * size + of_doc % size
    cells, back = np.unique(in_group, return_inverse=True)
    row = pa.array(first[cells // size])
    out = pa.table({
        "lang": batch.column(0).take(row), "source": batch.column(1).take(row), "term": coded.dictionary.take(pa.array(cells % size)).cast(pa.string()),
        "n": np.bincount(back, n, len(cells)).astype(np.int64), "docs": np.bincount(back, minlength=len(cells)).astype(np.int64),
    })
    marks = pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.nulls(len(groups), pa.string()), "n": np.zeros(len(groups), np.int64), "docs": np.zeros(len(groups), np.int64)})
    return pa.concat_tables([out, marks])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts, and a null term for each (lang, source) that occurs."""

    def run(batches):
        held, size = [], 0

        def summed():
            table = pa.concat_tables(held).combine_chunks()
            table = table.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

        for batch in batches:
            if len(batch):
                held.append(_counted(batch))
                size += len(held[-1])
            if size > GATHERED:
                held = [summed()]
                size = len(held[0])
                if size > GATHERED // 2:
                    yield from held[0].to_batches(max_chunksize=20_000)
                    held, size = [], 0
        if held:
            yield from summed().to_batches(max_chunksize=20_000)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text_or_empty())
    return texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total) by long division, three digits at a time: nothing exceeds 1000 * total."""
    rest = count.astype(np.int64) + 1
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so the square fits."""
    return (p - q) * (p - q) // q


def _p(count, total):
    """`scaled` as a column, in decimals of 38 digits."""
    product = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), total.cast("decimal(20,0)")) + 1


def runs_of(column: np.ndarray) -> np.ndarray:
    """Where a column's runs begin."""
    return np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))


def block_sums(counts: np.ndarray, lengths: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """(sources, sources) sums of f(p of the row, q of the column) over a block of the reordered vocabulary.

    counts: (rows, sources), a row standing for lengths[row] terms; totals: N + V of each source.
    """
    k = counts.shape[1]
    before = np.concatenate(([0], np.cumsum(lengths)))
    begins = [runs_of(counts[:, s]) for s in range(k)]
    values = [scaled(counts[b, s], int(totals[s])) for s, b in enumerate(begins)]
    out = np.zeros((k, k), np.int64)
    for a in range(k):
        for b in range(a + 1, k):
            cut = np.union1d(begins[a], begins[b])
            length = before[np.append(cut[1:], len(lengths))] - before[cut]
            p = values[a][np.searchsorted(begins[a], cut, "right") - 1]
            q = values[b][np.searchsorted(begins[b], cut, "right") - 1]
            out[a, b] = (gain(p, q) * length).sum()
            out[b, a] = (gain(q, p) * length).sum()
    return out


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each two sources of a language, and of each source's terms from the language.

    p of a term in a source, or in the whole language, is 1 + floor(10^9 * (count + 1) / (N + V)), N being
    the count of all V kept terms there; f = floor((p - q)^2 / q). Part `pair`: the sum of f over all
    kept terms, q being the other source's. Part `term`: the `ranks` terms of largest f that the source has
    and has more of than the language does. Ranks are by value, descending, then by the item's bytes.

    Null texts, langs and sources count as empty strings. Each row is a document, repeated rows too. A
    language without kept terms has pairs of value 0; one with one source has no pairs; no documents
    give no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    partial = term_counts(docs).repartition(partitions(spark), "lang", "term")
    by_source = materialize(partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    occurring = by_source.where("term is null").select("lang", "source").distinct()
    # one row a term: its counts by source, in the sources' order
    entry = F.struct("source", "n")
    term_rows = by_source.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("counts"))
    kept = materialize(term_rows.where(F.col("docs") >= least).select("lang", "term", "n", "counts"), "kept-terms")

    flat_counts = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("counts").alias("source", "n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    of_source = flat_counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("lang_total", "v", "total")))
    groups = materialize(groups, "source-totals")

    # part `term`
    own = flat_counts.join(groups, ["lang", "source"])
    own = own.select("lang", "source", "term", _p(F.col("n"), F.col("total") + F.col("v")).alias("p"), _p(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q"))
    own = own.where("p > q").selectExpr("lang", "source", "term as item", "(p - q) * (p - q) div q as value", f"pmod(xxhash64(term), {SALTS}) as salt")
    order = "order by value desc, item"
    own = own.withColumn("rank", F.expr(f"row_number() over (partition by lang, source, salt {order})")).where(f"rank <= {ranks}")
    own = own.withColumn("rank", F.expr(f"row_number() over (partition by lang, source {order})")).where(f"rank <= {ranks}")

    # part `pair`: equal rows of counts as one, in order, in blocks
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    rows = kept.groupBy("lang", "counts").agg(F.count("*").alias("length"))
    rows = rows.repartitionByRange(partitions(spark), "lang", "counts").sortWithinPartitions("lang", "counts")
    rows = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.expr(f"place div {max(16, BLOCK_CELLS // most)}"))
    rows = materialize(rows, "count-runs")
    columns = rows.select("lang", "block").distinct().join(groups, "lang").select("lang", "block", "source", (F.col("total") + F.col("v")).alias("total"))
    columns = columns.toDF("lang", "block", "source", "total")  # columns of its own: `rows` is on the other side

    def compare(key, rows_of, sources_of):
        rows_of, sources = rows_of.sort_by("place"), sources_of["source"].combine_chunks()
        lists = rows_of["counts"].combine_chunks()
        cells = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        counts = np.zeros((len(lists), len(sources)), np.int64)
        counts[row, pc.index_in(cells.field("source"), sources).to_numpy()] = cells.field("n").to_numpy()
        sums = block_sums(counts, rows_of["length"].to_numpy(), sources_of["total"].to_numpy())
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "source": sources.take(pa.array(a)), "item": sources.take(pa.array(b)), "value": sums[a, b]})

    sums = rows.groupBy("lang", "block").cogroup(columns.groupBy("lang", "block")).applyInArrow(compare, "lang string, source string, item string, value long")
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.select("lang", "source", "item", F.lit(0).cast("long").alias("value")).unionByName(sums)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.expr(f"row_number() over (partition by lang, source {order})"))

    def shown(part: DataFrame, name: str) -> DataFrame:
        return part.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))

    return shown(pairs, "pair").unionByName(shown(own, "term"))
