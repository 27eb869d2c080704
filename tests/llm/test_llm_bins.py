"""Vector bin packing: every id in one piece, all three limits kept, no padding."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isohypse.llm import bins, common, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def check(rows, examples, limits, key="doc_id"):
    """rows of pieces; examples: key -> list of (ids, loss flags), one for each row of that key."""
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r[key], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert {k: sum(len(x) for x, _ in v) for k, v in examples.items() if sum(len(x) for x, _ in v)} == {k: sum(r["length"] for r in v) for k, v in by.items()}
    for k, v in examples.items():
        if len(v) == 1:
            at, (ids, loss) = 0, v[0]
            for n, r in enumerate(sorted(by.get(k, []), key=lambda r: r["start"])):
                part = slice(at, at + r["length"])
                assert (r["piece"], r["start"], r["doc_tokens"], r["loss_tokens"]) == (n, at, len(ids), sum(loss[part]))
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[part], "<u4").tobytes())
                at += r["length"]
    for v in sequences.values():
        v.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in v)
        assert [r["offset"] for r in v] == [sum(r["length"] for r in v[:i]) for i in range(len(v))] and [r["segment"] for r in v] == list(range(len(v)))
        assert len(v) <= limits.segments and sum(r["loss_tokens"] for r in v) <= limits.loss
        assert total == limits.tokens or total <= limits.tokens and total & (total - 1) == 0
    return sequences


def test_documents_whole(spark, library):
    rows = bins.pack_documents(common.read(spark, DATA, "documents"), queries.vocabulary()).collect()
    docs = common.read(spark, DATA, "documents").collect()
    examples = {}
    for d in docs:
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        examples.setdefault(d["doc_id"], []).append((ids, [1] * len(ids)))
    sequences = check(rows, examples, bins.Limits())
    tokens = sum(len(x) for v in examples.values() for x, _ in v)
    assert len(sequences) <= tokens // 2048 + 12 * 4  # short ones only where a task ends
    assert len(rows) <= len(docs) + 2 * len(sequences)


def test_null_empty_repeated_and_clashing(spark, library):
    common.tune(spark)
    table = [(1, None, 5), (2, "", 5), (3, "a b c", 5), (3, "a b c", 5), (None, "no id", 5), (4, "word " * 5000, 5)]
    docs = spark.createDataFrame(table, "doc_id long, text string, segment int").repartition(1)
    examples = {}
    for i, x, _ in table:
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 1]
        examples.setdefault(i, []).append((ids, [1] * len(ids)))
    check(bins.pack_documents(docs, queries.vocabulary()).collect(), examples, bins.Limits())
    assert bins.pack_documents(docs.where("false"), queries.vocabulary()).count() == 0


def test_conversations_under_three_limits(spark, library):
    turns = common.read(spark, DATA, "conversations")
    span = F.struct("turn", F.col("text"), (F.col("role") == "assistant").alias("bears_loss"))
    examples = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).selectExpr("conv_id", "transform(spans, s -> struct(s.text as text, s.bears_loss as bears_loss)) as spans")
    examples = examples.unionByName(spark.createDataFrame([(-1, None), (-2, [])], "conv_id long, spans array<struct<text: string, bears_loss: boolean>>"))
    want = {}
    for r in examples.collect():
        ids, loss = [], []
        for s in r["spans"] or []:
            own = [*library.encode(s["text"] or "", add_special_tokens=False).ids, 1]
            ids, loss = ids + own, loss + [int(bool(s["bears_loss"]))] * len(own)
        want[r["conv_id"]] = [(ids, loss)]
    for limits in (bins.Limits(256, 4, 100), bins.Limits(512, 2, 512), bins.Limits(64, 1, 5)):
        check(bins.pack_examples(examples, queries.vocabulary(), limits, key="conv_id").collect(), want, limits, key="conv_id")


def test_dot_product_takes_what_the_room_calls_for():
    # loss is scarce: with much of it left, the example that bears loss goes first, then the one without
    pieces = bins.pack_block(np.array([40, 40, 60, 60]), lambda e, place: place if e < 2 else 0, bins.Limits(100, 4, 40))
    groups = {}
    for example, _, _, _, sequence, *_ in pieces:
        groups.setdefault(sequence, set()).add(example < 2)
    assert sorted(map(sorted, groups.values())) == [[False, True], [False, True]]
