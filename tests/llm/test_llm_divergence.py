"""The audit against plain counting, and its long division and run intersection by themselves."""

import collections
import re

import numpy as np

from isohypse.llm import common, divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, place int"


def brute(rows):
    docs = [(x[2] or "", x[3] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(x[1] or "")]) for x in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, counts = collections.Counter(), {}
        for g, source, words in docs:
            if g == lang:
                seen.update(set(words))
                counts.setdefault(source, collections.Counter()).update(words)
        kept = [w for w, n in seen.items() if n >= 3]
        total = {s: sum(c[w] for w in kept) for s, c in counts.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (total[s] + len(kept)) for w in kept} for s, c in counts.items()}
        whole = {w: 1 + 10**9 * (sum(c[w] for c in counts.values()) + 1) // (sum(total.values()) + len(kept)) for w in kept}
        for s in counts:
            pair = [(t, sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept)) for t in counts if t != s]
            term = [(w, (p[s][w] - whole[w]) ** 2 // whole[w]) for w in kept if counts[s][w] and p[s][w] > whole[w]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(found if part == "pair" else found[:200])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def table(spark, rows):
    common.tune(spark)
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def test_audit_is_plain_counting(spark):
    rng = np.random.default_rng(3)
    words = ["Äpfel", "apple", "Apple", "ÉTÉ", "été", "x1y", "don't", "日本", "z", "\x00q", "a_b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60) ** 2 // 40)), ["en", "de", None, "fr"][i % 4], f"s{min(int(rng.integers(0, 9)), 4)}") for i in range(160)]
    rows += [(900, None, "en", "none"), (901, "", "xx", "only"), (902, "1 2 3", "yy", "a"), (903, None, "yy", None), (904, "apple " * 50_000, "en", "s1"), (None, "apple pie", None, None)]
    rows += [(905, "copy of the same words", "zz", "a")] * 30 + [(906, "copy of other words", "zz", "b")] * 3
    assert got(divergence.audit(table(spark, rows))) == brute(rows)


def test_no_documents(spark):
    assert got(divergence.audit(table(spark, []))) == []


def test_ranks_end_at_the_limit(spark):
    rows = [(i, " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(260)), "en", "a") for i in range(3)] + [(9, "other", "en", "b")] * 3
    out = got(divergence.audit(table(spark, rows)))
    assert out == brute(rows) and sum(r[2] == "term" and r[1] == "a" for r in out) == 200


def test_long_division_beyond_64_bits():
    count, total = np.array([0, 5, 10**12, 3 * 10**13]), 3 * 10**13 + 7
    assert divergence.scaled(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]


def test_runs_are_intersected():
    rng = np.random.default_rng(4)
    counts = np.sort(rng.integers(0, 3, (50, 3)), axis=0)
    lengths, totals = rng.integers(1, 9, 50), np.array([700, 800, 9])
    sums = divergence.block_sums(counts, lengths, totals)
    p = np.stack([divergence.scaled(counts[:, s], int(totals[s])) for s in range(3)], 1)
    for a in range(3):
        for b in range(3):
            assert sums[a, b] == (divergence.gain(p[:, a], p[:, b]) * lengths).sum() * (a != b)
