"""N-gram join, line dedup, near-duplicate and nearest vectors against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from isohypse.llm import common, components, lines, ngram_join, vectors


def groups(links, nodes):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def sample(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 4, 5, 9, 14, 20, 40, 80]))] for _ in range(n // 3)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(2):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append("\n".join([" ".join(own)] * 1))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(10 + 5 * i)) for i in range(8)]
    return [*texts, "", "  \t", "one", "One", None, "UPPER case Text of six words", "upper CASE text OF six WORDS"]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_join_against_all_pairs(spark):
    common.tune(spark)
    texts = sample()
    docs = spark.createDataFrame([(i, x, "x", 7) for i, x in enumerate(texts)], "doc_id long, text string, component_id string, n int").repartition(3)
    sets = [shingles(x) for x in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, range(len(sets)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    assert ngram_join.join_components(docs.limit(0)).count() == 0


def test_light_and_heavy_keys_meet():
    rng = np.random.default_rng(2)
    for boundary in (0, 8, 20, 1000):
        for _ in range(300):
            n = int(rng.integers(1, 60))
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            b = np.sort(np.concatenate((rng.permutation(a)[: len(a) - int(rng.integers(0, len(a) // 6 + 1))], rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, n // 7 + 1))))))
            both = len(np.intersect1d(a, b))
            if both and 4 * both >= 3 * (len(a) + len(b) - both) and not (len(a) < 3 and not np.array_equal(a, b)):
                common_ones = np.sort(rng.choice(a, min(len(a), 3), replace=False))
                k = [set(ngram_join.set_keys(x, common_ones, boundary, ngram_join.THRESHOLD).tolist()) for x in (a, b)]
                assert k[0] & k[1]


def test_lines_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.choice([4, 30, 60, 200]))) for _ in range(25)]
    docs = []
    for i in range(30):
        own = []
        for x in rng.sample(base, 3):
            if len(x) > 40 and rng.random() < 0.5:
                k = rng.randrange(len(x) - 3)
                x = x[:k] + "#" + x[k + 2 :]
            own.append(x)
        docs.append((i, "\n".join([own[0], "", *own[1:]]), i))
    docs += [(100, None, 1), (101, "", 1), (102, "short\nshort\n \nshort", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, line_no int")
    places = [(i, n, x) for i, t, _ in docs for n, x in enumerate((t or "").split("\n")) if x.strip()]
    own = sorted({x for _, _, x in places})
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in own]
    links = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    root = groups(links, range(len(own)))
    first = {}
    for i, n, x in sorted(places):
        first.setdefault(root[own.index(x)], (i, n))
    want = {(i, n): first[root[own.index(x)]] for i, n, x in places}
    got = {(r["doc_id"], r["line_no"]): (r["keeper_doc_id"], r["keeper_line_no"]) for r in lines.first_lines(frame).collect()}
    assert got == want
    left = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(frame.drop("line_no")).collect()}
    assert left[100] is None and left[101] == "" and left[102] == "short\n "
    assert lines.first_lines(frame.limit(0)).count() == 0


def embeddings(spark, n=400, width=16):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, width))
    x[50:120] = x[50] + rng.normal(size=(70, width)) * 0.05
    x[200:203] = x[200]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * width, 0), (902, [float("nan")] + [1.0] * (width - 1), 0), (903, [None] + [1.0] * (width - 1), 0), (904, [float("inf")] * width, 0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_near_vectors_against_all_pairs(spark):
    x, frame = embeddings(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = groups(np.argwhere(np.triu(near)).tolist(), range(len(x)))
    got = {r["vec_id"]: r for r in vectors.near_duplicates(frame).collect()}
    assert len(got) == len(x) + 5
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == [root[i] for i in range(len(x))]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905))


def test_nearest_vectors_have_recall(spark):
    x, frame = embeddings(spark)
    got = {}
    for r in vectors.self_search(frame, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for v, _ in found.values()} & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
        assert all(abs(s - d[v]) < 1e-12 for v, s in found.values()) and sorted(found) == list(range(1, 11))
    assert hits >= 0.95 * 10 * len(got)
    few = vectors.nearest(vectors.build_index(frame.where("vec_id < 4"), 11), frame.where("vec_id = 0"))
    assert few.count() == 3


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 2), (2, 3), (3, 3), (9, 8)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)})])
def test_components(spark, edges, want):
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert {r["id"]: r["component"] for r in components.components(frame).collect()} == want
    # the same when the links come in two parts
    first = components.materialize(components.components(spark.createDataFrame(edges[: len(edges) // 2], "a long, b long")), "labels")
    rest = spark.createDataFrame(edges[len(edges) // 2 :], "a long, b long")
    got = [(r["id"], r["component"]) for r in components.joined(first, rest).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_components_long_path(spark):
    n = 1500
    names = [int(x) for x in np.random.default_rng(8).permutation(n)]
    frame = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long").repartition(7)
    assert {(r["id"], r["component"]) for r in components.components(frame).collect()} == {(i, 0) for i in range(n)}


def test_join_of_repeated_ids_in_either_order(spark):
    words = [f"w{i}" for i in range(60)]
    one, two, near = " ".join(words), " ".join(f"z{i}" for i in range(40)), " ".join([*words[:57], "x", "y", "z"])
    for rows in ([(5, one), (5, two), (9, near)], [(5, two), (5, one), (9, near)]):
        docs = spark.createDataFrame([(i, t, "k", 1) for i, t in [*rows, (None, one), (3, None)]], "doc_id long, text string, kept_id string, cls int")
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or -1) for r in ngram_join.join_components(docs).collect())
        assert got == [(False, 3, 3), (False, 5, 5), (False, 5, 5), (False, 9, 5), (True, 0, -1)]


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**62, int(rng.integers(1, 3000))))
        b = np.unique(np.concatenate((a[: int(len(a) * rng.random())], rng.integers(0, 2**62, int(rng.integers(0, 800))))))
        x, y = (components.parity(v, ngram_join.parity_bits(len(v))) for v in (a, b))
        assert ngram_join.parity_differ(x, y) <= len(np.setxor1d(a, b))


def test_line_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a line of text here", "u", 2), (2, "a line of text here\nother words", "v", 3), (None, "a line of text here", "w", 4)], "doc_id long, text string, kept_id string, kept int")
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs).collect()}
    assert got == {2: "other words", None: "a line of text here"}  # null ids come first; nothing is left of document 1
    assert lines.drop_repeated_lines(docs).columns == docs.columns


def test_band_keys_travel_many_in_a_row(spark):
    common.tune(spark)
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(3000)]
    texts = base + [x[:40] + "#" + x[41:] for x in base[:300]] + [base[0][:79] + chr(200 + i) for i in range(200)] + base[:50]
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, line string").selectExpr("xxhash64(line) as id", "line").repartition(3)
    assert lines.dealt_bands(frame).count() < frame.count() / 4  # it was one for each key: 16 for each line

    rows = frame.collect()
    owners = {}
    for row, keys in zip(rows, lines.band_keys(pa.array([r["line"] for r in rows])).tolist()):
        for k in keys:
            owners.setdefault(k, set()).add(row["id"])
    want = {(k, i) for k, ids in owners.items() if len(ids) > 1 for i in ids}
    got = [(r["key"], r["id"]) for r in lines.shared_bands(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(len(x) for x in owners.values()) > 150
    assert lines.shared_bands(frame.limit(0)).count() == 0


def test_sketches_of_lines_are_their_sets_own(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdéf ") for _ in range(rng.choice([3, 20, 300]))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, line string").coalesce(1)
    got = {r["id"]: (r["n"], bytes(r["parity"])) for r in lines._sketches(frame.select("id"), frame, lines.CHARS).collect()}
    for i, x in enumerate(texts):
        own = np.unique(lines.shingle_hashes(pa.array([x]))[0])
        assert got[i] == (len({x[k : k + 8] for k in range(max(1, len(x) - 7))}), components.parity(own))


def test_bands_meet_as_often_as_stated():
    rng = np.random.default_rng(3)
    for s, least in ((0.75, 0.995), (0.8, 0.999)):
        agree = rng.random((20000, lines.HASHES)) < s
        assert np.mean(np.any(agree.reshape(20000, lines.BANDS, lines.ROWS).all(2), 1)) >= least


def test_long_words_keep_their_place():
    from isohypse.llm import bpe

    tree = bpe.SegmentTree(np.array([5, 3, 9], np.int32))
    assert tree.least() == (3, 1) and (int(bpe.NONE) << bpe.PLACE_BITS) + (1 << 35) < 2**63
    tree.set(1, 7)
    assert tree.least() == (5, 0)


def test_join_equals_its_sql(spark):
    import duckdb

    from isohypse.llm import queries

    d = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(duck.execute(queries.ORACLE_SQL["op8_ngram_jaccard_join"]).fetchall())
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op8_ngram_jaccard_join(spark, d).collect()) == want


def tasks_of(spark, job):
    """Tasks that `job` runs, those of skipped stages not counted."""
    tracker, group = spark.sparkContext.statusTracker(), f"tasks-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    job()
    stages = {i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds}
    return sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)


def test_links_of_few_nodes_need_few_tasks(spark):
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "64k"}
    before = {k: spark.conf.get(k) for k in settings}
    frame = components.materialize(spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long").repartition(3), "edges")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = []
        tasks = tasks_of(spark, lambda: got.extend(components.components(frame).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["id"], r["component"]) for r in got} == {(i, 0) for i in range(41)} and len(got) == 41
    assert tasks < 400, tasks


@pytest.mark.parametrize("few", [True, False])
def test_components_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(components, "BROADCAST_ROWS", 10**6 if few else 0)
    rng = np.random.default_rng(4)
    for n, m in ((300, 200), (400, 420), (50, 1)):
        edges = rng.integers(-n, n, (m, 2)).tolist()
        frame = spark.createDataFrame([tuple(e) for e in edges], "a long, b long").repartition(5)
        ends = {x for e in edges if e[0] != e[1] for x in e}
        got = [(r["id"], r["component"]) for r in components.components(frame).collect()]
        assert sorted(got) == sorted(groups([e for e in edges if e[0] != e[1]], ends).items())


def test_likeliest_partners_say_when_others_are_left():
    def table(ids, label, sets):
        n = len(ids)
        return pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array(label, pa.int64()), "s": [x != 0 for x in label], "t": [True] * n, "n": pa.array([len(x) for x in sets], pa.int64()), "parity": [components.parity(x) for x in sets]})

    base = np.arange(100, dtype=np.int64) << 20
    for others in (components.LIKELY, components.LIKELY + 3):
        sets = [base, *(np.append(base, np.int64(i + 1) << 40) for i in range(others))]
        rows = table(range(others + 1), [1, *[0] * others], sets)
        best, whole = ({(r["a"], r["b"]) for r in components._unlike(rows, np.zeros(1, np.int64), 0.75, x).to_pylist()} for x in (True, False))
        assert whole == {(0, i) for i in range(1, others + 1)}
        assert best == whole if others == components.LIKELY else len(best - {(None, None)}) == components.LIKELY and best - whole == {(None, None)}
