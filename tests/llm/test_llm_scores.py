"""License scans, toxicity and quality on small fixtures and held-out labels."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from isohypse.llm import common, licenses, quality, toxicity


def test_licenses(spark):
    common.tune(spark)
    pad = " ".join(f"w{i}" for i in range(37))
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    rows = [(i, pad + "\n" + " ".join(["x"] * i) + " Released under the MIT License.\n" + pad) for i in range(12)]
    rows += [(20, apache), (21, None), (22, ""), (23, "the MIT License"), (24, pad * 500), (25, "RELEASED UNDER\tTHE MIT LICENSE"), (26, "words of no license at all, released under the moon"), (25, "again: Released under the MIT License.")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert {(i, "MIT") for i in [*range(12), 25]} | {(20, "Apache-2.0")} == got
    assert licenses.scan(docs.limit(0)).count() == 0


def clause_score(kinds, weights):
    return toxicity._TABLE.run(np.array(kinds), np.array(weights, float), np.array([0]), np.array([len(kinds)]))[0]


def test_grammar_of_clauses():
    T, score = toxicity, clause_score
    assert score([T.INSULT], [2.0]) == 2.0
    assert score([T.TARGET, T.OTHER, T.INSULT], [0, 0, 2.0]) == 2.5
    assert score([T.INSULT, T.OTHER, T.TARGET], [2.0, 0, 0]) == 2.5
    assert score([T.TARGET, T.NEGATION, T.OTHER, T.INSULT], [0, 0, 0, 2.0]) < 1
    assert score([T.REPORT, T.OTHER, T.INSULT], [0, 0, 2.0]) == 1.0
    assert score([T.THREAT], [3.0]) == 0
    assert score([T.THREAT, T.TARGET], [3.0, 0]) == 3.0
    assert score([T.TARGET, T.THREAT], [0, 3.0]) == 0


def accepting(machine, kinds):
    """All accepting paths of one transducer: the factors and what is put out at each word."""
    paths = [(s, (), ()) for s in machine.starts]
    for k in kinds:
        paths = [(to, (*f, x), (*out, o)) for s, f, out in paths for to, o, x in machine.arcs.get((s, k), [])]
    return [(f, out) for s, f, out in paths if s in machine.finals]


def test_composed_table_equals_the_parts_in_turn():
    rng = np.random.default_rng(4)
    parts = [toxicity.negation(), toxicity.report(), toxicity.threat(), toxicity.target()]
    for _ in range(300):
        kinds = rng.integers(0, 6, rng.integers(1, 9)).tolist()
        weights = rng.random(len(kinds)).round(3)
        found = [(np.ones(len(kinds)), tuple(kinds))]
        for p in parts:
            found = [(f * np.array(g), out) for f, mid in found for g, out in accepting(p, mid)]
        assert len(found) == 1  # an unambiguous grammar
        assert abs(clause_score(kinds, weights) - float(found[0][0] @ weights)) < 1e-12


def test_learnt_beginnings_are_no_common_words():
    d = "/root/testdata/sf0.1"
    docs, labels = (ds.dataset(f"{d}/{t}.parquet").to_table().to_pandas() for t in ("documents", "labels"))
    m = docs.merge(labels, on="doc_id")
    g = toxicity.fit(m.text.fillna("").tolist(), m.toxic.to_numpy())
    kind, _, _ = g.classify(pa.array(["training", "travel", "translate", "worthy", "stupor", "idiot"], pa.large_string()))
    assert kind.tolist() == [toxicity.OTHER] * 5 + [toxicity.INSULT] and min(len(x) for x in g.beginnings) >= 5


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (ds.dataset(f"{d}/{t}.parquet").to_table().to_pandas() for t in ("documents", "labels"))
    m = docs.merge(labels, on="doc_id")
    held = np.array([toxicity.held_out(i) for i in m.doc_id])
    g = toxicity.fit(m.text[~held].tolist(), m.toxic[~held].to_numpy())
    x = toxicity.document_features(pa.array(m.text[held].tolist()), g)
    b = g.logistic
    p = b[0] + x @ np.array(b[1:]) >= 0
    y = m.toxic[held].to_numpy() == 1
    assert (p & y).sum() >= 0.88 * y.sum() and (p & ~y).sum() <= 0.02 * (~y).sum()


def test_toxicity_rows(spark):
    common.tune(spark)
    docs = spark.createDataFrame([(0, None, 1), (1, "", 2), (None, "you are an idiot, you moron", 3), (1, "", 2), (7, "idiot " * 30000, 4)], "doc_id long, text string, score int")
    g = toxicity.fit([], np.empty(0))
    got = toxicity.score(docs, g).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(docs.limit(0), g).count() == 0
    kept = toxicity.keep_clean(docs, g)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {0, 1}


def test_ordinal_grades():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    grades = rng.integers(0, 4, 1200)
    texts = [" ".join([*rng.choice(words, 30), *["good"] * int(g), *["bad"] * int(3 - g)]) for g in grades]
    m = quality.fit(texts[:900], grades[:900])
    assert (np.diff(m.thresholds) >= 0).all() and len(m.thresholds) == 3
    tails = m.tails(quality.linear(pa.array(texts[900:]), m.weights))
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert np.corrcoef(tails.sum(1), grades[900:])[0, 1] > 0.9


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (ds.dataset(f"{d}/{t}.parquet").to_table().to_pandas() for t in ("documents", "labels"))
    m = docs.merge(labels, on="doc_id")
    cut = len(m) * 3 // 4
    model = quality.fit(m.text[:cut].tolist(), m.quality[:cut].to_numpy())
    keep = model.tails(quality.linear(pa.array(m.text[cut:].tolist()), model.weights))[:, 0] >= 0.5
    assert (keep == (m.quality[cut:] == 1)).mean() > 0.97


def test_quality_rows(spark):
    docs = spark.createDataFrame([(0, None, 1), (1, "", 2), (None, "some words", 3), (1, "", 2), (5, "the the " * 40000, 5)], "doc_id long, text string, tail int")
    m = quality.fit(["a b c d", "x x x x"] * 20, np.array([1, 0] * 20))
    assert quality.rate(docs, m).count() == 5
    assert quality.rate(docs.limit(0), m).count() == 0
    assert quality.rate(docs, quality.fit([], np.empty(0))).where("selected").count() == 5
    assert quality.keep_selected(docs, m).columns == docs.columns


def test_license_windows_meet_as_often_as_stated(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(20000):
        own = rng.integers(-(2**62), 2**62, 9).tolist()
        rows.append((i, own[:7], own[:3]))
    frame = spark.createDataFrame(rows, "i int, window array<long>, notice array<long>")
    one = frame.selectExpr("i", "window as ws").selectExpr("i", f"{licenses._BANDS} as p")
    two = frame.selectExpr("i", "notice as ws").selectExpr("i", f"{licenses._BANDS} as q")
    met = one.join(two, "i").where("exists(zip_with(p, q, (x, y) -> x = y), z -> z)").count()
    assert met >= 19990


@pytest.mark.parametrize("text,want", [
    ("So. This work is licensed under a Creative Commons Attribution 4.0 International License. More", {"CC-BY-4.0"}),
    ("This work is licensed under a Creative approach to contracts.", set()),
    ("gives it without warranty of any kind, express or implied", set()),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"CC-BY-NC-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", set()),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", set()),
    ("This work is licensed under the GNU General Public License, version 2.", set()),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", set()),
    ("Licensed under CC BY-NC-ND 4.0. Licensed under CC BY 3.0. Licensed under CC BY-SA 4.0!", {"CC-BY-SA-4.0"}),
])
def test_license_needs_the_whole_template(spark, text, want):
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "licensed")], "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()} == {(1, x) for x in want}


def test_licenses_are_those_of_all_passages(spark):
    """Every passage of every document is looked at, by words and sets of their own."""
    rng = np.random.default_rng(8)
    plain = [(name, i, text) for name, texts in licenses.TEMPLATES.items() for i, text in enumerate(texts)]
    filler = "the notice was posted under a tree near public license street and commons".split()

    def cut(text):
        return [w for w in re.sub(r"[^\w.]+|\.(?!\w)|(?<!\w)\.", " ", text.lower()).split() if w]

    docs = []
    for d in range(240):
        words = []
        for k in rng.integers(0, len(plain), rng.integers(0, 3)):
            own = cut(plain[k][2])
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(0, len(own)))
                own[at : at + 1] = [[], [own[at], "really"], ["version"], ["2.0"]][rng.integers(0, 4)]
            words += list(rng.choice(filler, rng.integers(0, 12))) + own
        docs.append((d, " ".join(words + list(rng.choice(filler, rng.integers(0, 12))))))

    def shingles(words):
        return [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []

    want = set()
    for d, text in docs:
        own = shingles(cut(text))
        for name, i, template in plain:
            n = len(cut(template))
            ts, must = set(shingles(cut(template))), {x for called in licenses.names(template) for x in shingles(cut(called))}
            span = max(9, -int(-n / 0.8 // 1)) - 2
            if any(len(ts & set(own[a : a + span])) >= 0.8 * len(ts) and must <= set(own[a : a + span]) for a in range(len(own))):
                want.add((d, name, i))
    got = {(r["doc_id"], r["license"], r["template"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and len(want) > 60


def test_threats_and_reports_decide_documents(spark):
    """Documents of the same words, under the seeds alone: a threat counts with its target behind it only, and an insult less where it is reported."""
    rng = np.random.default_rng(13)
    filler = [f"plain{i}" for i in range(80)]
    pairs = []
    for i in range(100):
        a, b, c = (words[int(rng.integers(0, len(words)))] for words in (toxicity.SEED_THREAT, toxicity.SEED_INSULT, toxicity.SEED_REPORT))
        rest = " ".join(rng.choice(filler, 12))
        pairs.append((f"{rest}. the crops. i will {a} you tomorrow.", f"{rest}. i. you will {a} the crops tomorrow.") if i % 2 else (f"{rest}. you are an {b}. somebody {c} that.", f"{rest}. somebody {c} that you are an {b}."))
    g = toxicity.fit([], np.empty(0))
    docs = spark.createDataFrame([(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)], "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, g).collect()}
    for i in range(100):
        (plain, one), (other, two) = got[2 * i], got[2 * i + 1]
        assert plain > other and one == 1 and (two == 0 or i % 2 == 0)
