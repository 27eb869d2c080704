"""BPE, ORC ids and packing against the tokenizers library and plain counting."""

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from isohypse.llm import bpe, common, packing, queries, tokens

ODD = [
    "", " ", "Hello, it's <|endoftext|>we'LL x", "a b \x1c\x1d z\x85y", "ΑΣΣ ΣΟΦΟΣ İstanbul W̊ ẘ", "ab" * 400 + " " + "xyz" * 30, "!!!'s ?!.'s don't end.'s",
    "日本語 テキスト 123 4٣", "é ́x  q　r", "a<|startoftext|>b<|endoftext|><|endoftext|>", "🙂🙂 flﬁ ﷺ", "\n\n\tx", "'s 's'T", "\x00 a\x00b", "Straße, ÉTÉ! ×÷ ñ;:", "z" * 5000,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_are_the_librarys(library):
    want = [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(queries.vocabulary(), pa.array(ODD))[0].to_pylist()]
    assert got == want


def docs_table(spark):
    rows = [(i, x, "clash", 1) for i, x in enumerate(ODD)] + [(50, None, "n", 2), (51, "same text here", "a", 3), (51, "same text here", "a", 3), (None, "no id", "b", 4), (52, "word " * 9000, "c", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, piece int")


def test_digests_decode_and_repeat(spark, library):
    common.tune(spark)
    docs = docs_table(spark)
    got = tokens.encode_digests(docs, queries.vocabulary()).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    for i, x in [*enumerate(ODD), (50, ""), (52, "word " * 9000)]:
        ids = library.encode(x, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (by[i]["n_tokens"], by[i]["ids_sha256"], by[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = tokens.decode_ids(tokens.encode_ids(docs.where("doc_id = 2"), queries.vocabulary()), queries.vocabulary()).first()
    assert back["text"] == library.decode(library.encode(ODD[2], add_special_tokens=False).ids, skip_special_tokens=False)


def test_orc_round_trip_and_pruning(spark, library, tmp_path):
    docs = docs_table(spark)
    got = sorted((r for r in tokens.round_trip(docs, queries.vocabulary()).collect()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))
    at = 0
    texts = {i: x for i, x in enumerate(ODD)} | {50: "", 51: "same text here", None: "no id", 52: "word " * 9000}
    for r in got:
        ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    tokens.write_ids(docs, queries.vocabulary(), str(tmp_path / "ids"))
    assert [r["doc_id"] for r in tokens.read_ids(spark, str(tmp_path / "ids"), [52]).collect()] == [52]
    assert tokens.round_trip(docs.limit(0), queries.vocabulary()).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing_is_whole_and_gapless(spark, library):
    docs = docs_table(spark)
    rows = packing.pack(docs, queries.vocabulary()).collect()
    n = check_packing(rows, packing.CAPACITY)
    total = sum(r["length"] for r in rows)
    assert n == -(-total // packing.CAPACITY)
    ids = np.array([*library.encode("word " * 9000, add_special_tokens=False).ids, 1], "<u4")
    own = sorted((r for r in rows if r["doc_id"] == 52), key=lambda r: r["piece"])
    assert [(r["start"], r["ids_crc32"]) for r in own] == [(s, zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    assert packing.pack(docs.limit(0), queries.vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(np.exp(rng.normal(6, 1.2, 20000)).astype(int) + 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    entries = packing.plan(counts)
    used = np.zeros(4097, np.int64)
    np.add.at(used, entries[:, 0], entries[:, 2])
    assert (used == counts).all()
    assert (entries[:, 3] + entries[:, 2]).max() <= 1.01 * (counts * np.arange(4097)).sum() / 4096 + 2


def test_plan_of_equal_lengths():
    counts = np.zeros(4097, np.int64)
    counts[[4096, 2048, 1]] = [3, 5, 2]
    entries = packing.plan(counts)
    assert (entries[:, 3] + entries[:, 2]).max() == 6


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


@pytest.mark.parametrize("kind", range(5))
def test_plan_needs_no_more_than_best_fit_decreasing(kind):
    rng = np.random.default_rng(kind)
    lengths = [rng.integers(900, 3000, 900), np.exp(rng.normal(6.5, 1.1, 3000)), rng.integers(1, 4097, 1500), rng.choice([1500, 1400, 1250, 700], 2000), np.exp(rng.normal(5, 1.5, 4000))][kind]
    lengths = np.clip(lengths.astype(int), 1, 4096)
    assert packing.sequences_of(packing.plan(np.bincount(lengths, minlength=4097))) <= best_fit_decreasing(lengths.tolist(), 4096)
