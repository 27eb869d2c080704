"""The pipeline's stages on the smallest tables: what each drops is what its operator says."""

import pytest

import corpus_pipeline
from isohypse.llm import common, lines, ngram_join

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = common.read(spark, DATA, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, DATA), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns_and_rows(tables):
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[4] == ids[5] and len(ids[1]) > 0.7 * len(ids[0]) and ids[5]


def test_line_stage_leaves_no_similar_lines(tables):
    assert lines.first_lines(tables[3]).where("not kept").count() == 0
    assert tables[3].where("n_chars <> length(text)").count() == 0


def test_join_stage_leaves_one_of_each_group(tables):
    before = {r["component_id"] for r in ngram_join.join_components(tables[3]).collect()}
    assert {r["doc_id"] for r in tables[4].collect()} == before
    assert ngram_join.join_components(tables[4]).where("doc_id <> component_id").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, kept boolean, line_no int, component_id long"


def test_near_copies_are_decided_by_row(spark):
    words = [f"w{i}" for i in range(60)]
    t, near = " ".join(words), " ".join(words[:-2])
    rows = [(0, t), (1, t), (1, None), (2, ""), (3, near), (None, t), (None, None), (4, "of its own"), (4, "of its own"), (5, "another one by itself"), (5, t)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0, 7, True, 1, 2) for i, x in rows], SCHEMA)
    left = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert got == sorted([(0, t), (1, None), (2, ""), (None, t), (None, None), (4, "of its own"), (4, "of its own"), (5, "another one by itself")], key=str)


def test_near_copies_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    texts = []
    for i in range(120):
        base = texts[int(rng.integers(0, len(texts)))].split() if texts and rng.random() < 0.6 else [f"v{v}" for v in rng.integers(0, 400, int(rng.integers(3, 50)))]
        for _ in range(int(rng.integers(0, 3))):
            base[int(rng.integers(0, len(base)))] = f"x{i}"
        texts.append(" ".join(base))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (x.split() for x in texts)]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    docs = spark.createDataFrame([(i, x, "en", "s", 0, 7, True, 1, 2) for i, x in enumerate(texts)], SCHEMA)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()}
    assert got == {i for i, r in enumerate(root) if i == r} and len(got) < 110


def test_stages_stand_nulls_clashing_columns_and_empty_tables(spark):
    common.tune(spark)
    rows = [(1, "plain words of a document\nand a line", "en", "s", 10, 1, True, 1, 2), (None, None, None, None, None, None, None, None, None), (2, "", "", "", 0, 2, False, 2, 3), (3, "word " * 3000, "de", "t", 5, 3, None, 3, 4), (3, "word " * 3000, "de", "t", 5, 3, None, 3, 4)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialize(stage(spark, docs, DATA), "stage")
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert (packed.count() > 0) == bool(table)
