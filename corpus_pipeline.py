"""From raw documents to packed sequences, in stages that each write a table.

1. toxicity: documents whose text is predicted toxic go (operator 4, learnt from `labels`);
2. quality classifier: documents rated as the lowest grade go (operator 10, learnt from `labels`);
3. line dedup: of similar lines of all documents the first stays (operator 7);
4. n-gram Jaccard join: of each group of near copies the document of the least doc_id stays (operator 8);
5. best-fit packing: the pieces of all documents in sequences of 4096 ids (operator 3).

All but the last return the columns of their input. No part of it can be said in SQL: the models are
fitted, and signatures and ids come from hashes and a tokenizer. The tests hold the near-copy stage against
all pairs, the packing against plain counting, and the others against their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohypse.llm import lines, ngram_join, packing, quality, queries, toxicity
from isohypse.llm.common import drop, materialize, read, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality.keep_selected(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return lines.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a null doc_id or no words stay; rows that repeat a doc_id are decided by their texts."""
    tune(spark)
    groups = ngram_join.joined_rows(docs)
    kept = groups.where("doc_id = component_id").select("doc_id", "h").distinct().withColumn("kept", F.lit(True))
    one, two = docs.alias("one"), kept.alias("two")
    same = (F.col("one.doc_id") == F.col("two.doc_id")) & (F.xxhash64(F.coalesce(F.col("one.text"), F.lit(""))) == F.col("two.h"))
    return one.join(two, same, "left").where("two.kept or one.doc_id is null").select("one.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack),
]

#: Models, hashes and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's table is written to the shared folder and read as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
