"""Toxicity (4): a weighted finite-state grammar over clauses.

Transducers over word classes, composed in this order by `compose`:

1. lexical: a word to its class - INSULT or THREAT with a weight, TARGET, NEGATION, REPORT, OTHER. Insults are
   whole words or word beginnings; seeds are listed below, more are learnt with their weights;
2. negation: an INSULT or THREAT within NEGATION_SPAN words after a NEGATION keeps a part of its weight;
3. reported speech: after a REPORT in the clause, INSULT and THREAT keep a part of their weight;
4. threat: a THREAT counts only with a TARGET behind it in the clause;
5. target: an INSULT with a TARGET before or behind it in the clause counts more.

The lexical one's arcs are the words; it is applied to the distinct words of a batch. The composition of the others
is one table of states by classes, run over all clauses at once by array indexing. 4 and 5 guess whether a TARGET
comes: a path that guesses wrong doesn't accept, so a clause has one accepting path, and its weight is the clause's
score. Clauses end at .,;:!? and line ends. Only clauses with an INSULT or THREAT are run; others score 0 on any
path. A document's score is a logistic function of its clauses' scores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, PackedTexts, batches, flat, give_back, text_or_empty, views

# Fixed seed words of the grammar's classes.
SEED_INSULT = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting dumb fool imbecile depp trottel idiota estúpido imbécil idiote crétin".split()
SEED_THREAT = "kill hurt destroy beat murder shoot stab töten umbringen schlagen matar golpear tuer frapper".split()
SEED_TARGET = "you your yours u ur he she him her they them people du dich dir euch ihr sie tú te usted vosotros ellos tu vous toi ils elles".split()
SEED_NEGATION = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie no nunca jamás pas jamais aucun".split()
SEED_REPORT = "said says wrote called claims quote quoted reported told sagte schrieb nannte dijo escribió llamó dit écrit appelé".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
NEGATION_SPAN, NEGATED, REPORTED, AIMED, SEED_WEIGHT = 3, 0.3, 0.5, 1.25, 3.0
#: Labelled documents that the fit reads, the first by a hash of doc_id, and most learnt patterns.
FIT_DOCUMENTS, FIT_PATTERNS = 16_000, 400
#: Slots in which patterns are counted before they are held.
PATTERN_SLOTS = 1 << 22
#: Log-odds from which a pattern may enter.
LEAST_ODDS = 2.0
#: Lengths of the word beginnings that may become patterns.
BEGINNINGS = (5, 6, 7)
_ENDS = ".,;:!?"


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, class) to (next state, class put out, factor of the word's weight); a class without arc ends the path."""

    starts: tuple
    finals: frozenset
    arcs: dict


def _machine(starts, finals, states, step) -> Transducer:
    """`step(state, class)` lists the arcs, without the class put out, which is the one read."""
    return Transducer(tuple(starts), frozenset(finals), {(s, c): [(to, c, f) for to, f in step(s, c)] for s in states for c in range(6)})


def negation() -> Transducer:
    """States: words since the last negation, at most NEGATION_SPAN + 1; 0 is the negation itself."""
    far = NEGATION_SPAN + 1

    def step(since, kind):
        now = 0 if kind == NEGATION else min(since + 1, far)
        return [(now, NEGATED if kind in (INSULT, THREAT) and now <= NEGATION_SPAN else 1.0)]

    return _machine([far], range(far + 1), range(far + 1), step)


def report() -> Transducer:
    """States: whether speech is reported."""
    return _machine([False], [False, True], [False, True], lambda s, k: [(s or k == REPORT, REPORTED if s and k in (INSULT, THREAT) else 1.0)])


def threat() -> Transducer:
    """States: whether a target is still to come."""

    def step(expects, kind):
        if kind == TARGET:
            return [(True, 1.0), (False, 1.0)] if expects else []
        return [(expects, 0.0 if kind == THREAT and not expects else 1.0)]

    return _machine([True, False], [False], [True, False], step)


def target() -> Transducer:
    """States: no target in the clause, one is to come, one was there."""

    def step(state, kind):
        if kind == TARGET:
            return [] if state == "none" else [("was", 1.0)]
        return [(state, AIMED if kind == INSULT and state != "none" else 1.0)]

    return _machine(["none", "to come"], ["none", "was"], ["none", "to come", "was"], step)


def compose(one: Transducer, two: Transducer) -> Transducer:
    """The transducer that runs `two` on what `one` puts out; only states that can be reached."""
    starts = [(a, b) for a in one.starts for b in two.starts]
    arcs, todo, seen = {}, list(starts), set(starts)
    while todo:
        a, b = todo.pop()
        for kind in range(6):
            found = [((x, y), out, f * g) for x, mid, f in one.arcs.get((a, kind), []) for y, out, g in two.arcs.get((b, mid), [])]
            arcs[(a, b), kind] = found
            for to, _, _ in found:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    return Transducer(tuple(starts), frozenset((a, b) for a, b in seen if a in one.finals and b in two.finals), arcs)


class Table:
    """A transducer as arrays: `to` (class, state, choice) with -1 for no arc, and `factor` (class, state)."""

    def __init__(self, machine: Transducer):
        names = list(dict.fromkeys([*machine.starts, *(to for found in machine.arcs.values() for to, _, _ in found)]))
        at = {x: i for i, x in enumerate(names)}
        choices = max(len(x) for x in machine.arcs.values())
        self.to, self.factor = np.full((6, len(names), choices), -1), np.zeros((6, len(names)))
        for (state, kind), found in machine.arcs.items():
            for c, (to, _, f) in enumerate(found):
                self.to[kind, at[state], c], self.factor[kind, at[state]] = at[to], f
        self.start, self.final = np.full(len(names), -np.inf), np.array([x in machine.finals for x in names])
        self.start[[at[x] for x in machine.starts]] = 0.0

    def run(self, kinds: np.ndarray, weights: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The best accepting path's weight of each clause, the words from a start to its stop."""
        order = np.argsort(starts - stops, kind="stable")  # longest first, so that those still running come first
        size = (stops - starts)[order]
        value = np.tile(self.start, (len(order), 1))
        states, wide = len(self.start), self.to.shape[2]
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))
            word = starts[order[:n]] + t
            kind = kinds[word]
            own = value[:n] + weights[word][:, None] * self.factor[kind]
            after = np.full((n, states + 1), -np.inf)  # the last column takes what has no arc
            flat_ = after.ravel()
            base = np.arange(n)[:, None] * (states + 1)
            for c in range(wide):
                to = self.to[kind, :, c]
                np.maximum.at(flat_, (base + np.where(to < 0, states, to)).ravel(), own.ravel())
            value[:n] = after[:, :states]
        best = np.where(self.final, value, -np.inf).max(1, initial=-np.inf)
        out = np.empty(len(order))
        out[order] = best
        return out


def grammar_machine() -> Transducer:
    return compose(compose(compose(negation(), report()), threat()), target())


_TABLE = Table(grammar_machine())


@dataclass
class Grammar:
    """Patterns with weights, and the logistic function: intercept, weight of the sum, of the best clause, of the density."""

    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    logistic: tuple[float, float, float, float] = (-4.0, 1.0, 1.0, 0.0)

    def classify(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and weight of distinct tokens, and whether a clause ends behind each."""
        ends = pc.match_substring_regex(tokens, r"[.,;:!?]$").to_numpy(zero_copy_only=False)
        bare = pc.utf8_lower(pc.utf8_trim(tokens, characters=_ENDS + "\"'()[]*_-…«»“”„"))
        kind, weight = np.zeros(len(tokens), np.int8), np.zeros(len(tokens))
        for size in sorted({len(x) for x in self.beginnings}):
            own = [x for x in self.beginnings if len(x) == size]
            at = pc.index_in(pc.utf8_slice_codeunits(bare, 0, size), pa.array(own, bare.type)).to_numpy(zero_copy_only=False)
            hit = ~np.isnan(at.astype(float))
            w = np.array([self.beginnings[x] for x in own])[at[hit].astype(int)] if hit.any() else np.empty(0)
            weight[hit] = np.maximum(weight[hit], w)
            kind[hit] = INSULT
        own = list(self.words)
        at = pc.index_in(bare, pa.array(own, bare.type)).to_numpy(zero_copy_only=False).astype(float)
        for i in np.flatnonzero(~np.isnan(at)):
            k, w = self.words[own[int(at[i])]]
            if kind[i] != INSULT or k == INSULT:
                kind[i], weight[i] = k, max(w, weight[i] if kind[i] == INSULT else 0.0)
        return kind, weight, ends


def document_features(texts: pa.Array, grammar: Grammar) -> np.ndarray:
    """(documents, 3): the logarithms of 1 + the clauses' summed scores, the best clause's score, and 1 + the sum a hundred words."""
    text = pc.replace_substring(flat(texts).cast(pa.large_string()), "\n", " . ")
    split = pc.ascii_split_whitespace(text)
    coded = pc.dictionary_encode(split.flatten())
    ends = np.asarray(split.offsets) - split.offsets[0].as_py()
    kind, weight, close = grammar.classify(coded.dictionary)
    code = coded.indices.to_numpy()
    out = np.zeros((len(texts), 3))
    if not len(code):
        return out
    kinds, n = kind[code], np.diff(ends)
    breaks = close[code].copy()
    breaks[ends[1:][n > 0] - 1] = True
    clause = np.cumsum(breaks) - breaks  # a clause's number at each word
    hot = np.unique(clause[(kinds == INSULT) | (kinds == THREAT)])
    owner = np.searchsorted(ends, np.searchsorted(clause, hot), "right") - 1
    # words of the hot clauses; of words without class, a run's first ones are enough to forget a negation
    own = np.isin(clause, hot, assume_unique=False) if len(hot) else np.zeros(len(clause), bool)
    at = np.flatnonzero(own)
    other = np.concatenate(([False] * (NEGATION_SPAN + 1), kinds[at] == OTHER))
    inside = np.logical_and.reduce([other[i : i + len(at)] for i in range(NEGATION_SPAN + 2)]) if len(at) else np.empty(0, bool)
    same = np.concatenate((np.full(min(len(at), NEGATION_SPAN + 1), -1), clause[at][: -NEGATION_SPAN - 1])) == clause[at] if len(at) else inside
    at = at[~(inside & same)]
    scores = _TABLE.run(kinds[at], weight[code[at]], np.searchsorted(clause[at], hot), np.searchsorted(clause[at], hot, "right"))
    np.add.at(out[:, 0], owner, scores)
    np.maximum.at(out[:, 1], owner, scores)
    out[:, 2] = np.log1p(100 * out[:, 0] / np.maximum(n, 1))
    out[:, 0] = np.log1p(out[:, 0])
    return out


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of doc_id as text is divisible by 5; a null id's text is empty."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def fit(texts: list[str] | PackedTexts, toxic: np.ndarray, patterns: int = FIT_PATTERNS) -> Grammar:
    """Learn insults and their weights from labelled texts, then the logistic function.

    Candidates are words and word beginnings. Again and again, the pattern enters that tells most of the
    toxic documents that fewer than two chosen ones match, times its log-odds of being in a toxic document,
    which is its weight. It is in three toxic documents at least. A beginning stands for all words it begins, three in
    toxic documents at least.
    The logistic function is fitted to scores of documents that the scoring patterns weren't learnt from:
    those of either half under the other half's.
    """
    texts = texts if isinstance(texts, PackedTexts) else PackedTexts([PackedTexts.pack(x) for x in texts])
    grammar = _patterns(texts, toxic, patterns)
    half = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % 2 for x in texts], np.int64)
    x = np.zeros((len(texts), 3))
    for side in (0, 1):
        other, own = np.flatnonzero(half != side).tolist(), np.flatnonzero(half == side).tolist()
        g = _patterns(texts.take(other), toxic[other] if other else toxic[:0], patterns)
        for at in range(0, len(own), 500):
            x[own[at : at + 500]] = document_features(pa.array([texts[i] for i in own[at : at + 500]], pa.large_string()), g)
    if (toxic == 1).any() and (toxic != 1).any():
        grammar.logistic = tuple(float(w) for w in _logistic(x, (toxic == 1).astype(float)))
    return grammar


def _patterns(texts: PackedTexts, toxic: np.ndarray, patterns: int) -> Grammar:
    """The grammar with its seeds and what the labelled texts teach, without the logistic function."""
    grammar = Grammar()
    for names, kind in ((SEED_TARGET, TARGET), (SEED_NEGATION, NEGATION), (SEED_REPORT, REPORT)):
        grammar.words.update({x: (kind, 0.0) for x in names})
    grammar.words.update({x: (THREAT, SEED_WEIGHT) for x in SEED_THREAT})
    grammar.words.update({x: (INSULT, SEED_WEIGHT) for x in SEED_INSULT})
    positive, negative = np.flatnonzero(toxic == 1), np.flatnonzero(toxic != 1)
    if len(positive) >= 3 and len(negative) >= 3:
        def found(text: str) -> set[str]:
            words = {w.strip(_ENDS + "\"'()[]*_-…«»“”„") for w in text.lower().split()}
            return {w for w in words if 2 < len(w) < 30 and w.isalpha()} | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k and w.isalpha()}

        # documents by a hash of the pattern, so that only patterns of several documents are held
        slot = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) & (PATTERN_SLOTS - 1)
        seen = np.zeros(PATTERN_SLOTS, np.int32)
        for i in positive.tolist():
            np.add.at(seen, np.array([slot(x) for x in found(texts[i])], np.int64), 1)
        where: dict[str, list[int]] = {}
        begun: dict[str, set[str]] = {}
        for i in positive.tolist():
            for x in found(texts[i]):
                if seen[slot(x)] >= 3:
                    where.setdefault(x, []).append(i)
                if not x.endswith("*"):
                    for k in BEGINNINGS:
                        if seen[slot(x[:k] + "*")] >= 3:
                            begun.setdefault(x[:k] + "*", set()).add(x)
        # a beginning of one or two words says no more than these
        where = {x: own for x, own in where.items() if len(own) >= 3 and (not x.endswith("*") or len(begun.get(x, ())) >= 3)}
        clean: dict[str, int] = dict.fromkeys(where, 0)
        for i in negative.tolist():
            for x in found(texts[i]) & clean.keys():
                clean[x] += 1
        p, q = len(positive), len(negative)
        odds = {x: np.log((len(own) + 0.5) / (p - len(own) + 0.5)) - np.log((clean[x] + 0.5) / (q - clean[x] + 0.5)) for x, own in where.items()}
        odds = {x: v for x, v in odds.items() if v >= LEAST_ODDS}
        for x in [x for x in grammar.words if grammar.words[x][0] == INSULT]:
            if x in where and x not in odds:  # common in clean documents: no insult here
                del grammar.words[x]
        left = {x: set(where[x]) for x in odds}
        uses: dict[int, int] = {}
        for _ in range(patterns):
            # a document is told when two patterns match
            best = max(left, key=lambda x: (len(left[x]) * min(odds[x], 6), not x.endswith("*"), -len(x), x), default=None)
            if best is None or len(left[best]) < 3:
                break
            own = left.pop(best)
            if best.endswith("*"):
                grammar.beginnings[best[:-1]] = float(min(odds[best], 8))
            else:
                grammar.words[best] = (INSULT, float(min(odds[best], 8)))
            for i in own:
                uses[i] = uses.get(i, 0) + 1
            told = {i for i in own if uses[i] >= 2}
            covered = [x for x in left if best.endswith("*") and x.rstrip("*").startswith(best[:-1])]
            for x in covered:
                del left[x]
            if told:
                for x in left:
                    left[x] -= told
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method, weights of the features kept from falling below 0."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def training(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> list:
    """(doc_id, text, toxic) of at most `limit` labelled documents that aren't held out, the first by a hash of doc_id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    return rows.toLocalIterator(prefetchPartitions=True)


def learn(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> Grammar:
    """`fit` on `training`; without labelled documents the grammar has its seeds only."""
    rows = sorted((r["doc_id"], PackedTexts.pack(r["text"]), int(r["toxic"])) for r in training(docs, labels, limit))
    grammar = fit(PackedTexts([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64))
    del rows
    give_back()
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of `docs`.

    A null or empty text scores by the intercept alone. Scores come from the text only; other columns
    are ignored. A null doc_id stays null and counts as held out or not by the empty text.
    """

    def run(rows):
        b0, b1, b2, b3 = grammar.logistic
        for batch in rows:
            for part in batches(batch, np.diff(views(batch.column(1))[0]), BATCH_BYTES):
                x = document_features(part.column(1), grammar)
                p = 1 / (1 + np.exp(-np.clip(b0 + b1 * x[:, 0] + b2 * x[:, 1] + b3 * x[:, 2], -30, 30)))
                out = pa.array([held_out(i) for i in part.column(0).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), out, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of `docs` whose text isn't predicted toxic, with all their columns."""
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    def run(rows):
        b0, b1, b2, b3 = grammar.logistic
        for batch in rows:
            text = pc.fill_null(batch.column(at), "")
            for part, own in ((p, text.slice(i, p.num_rows)) for i, p in _numbered(batches(batch, np.diff(views(text)[0]), BATCH_BYTES))):
                x = document_features(own, grammar)
                stay = b0 + b1 * x[:, 0] + b2 * x[:, 1] + b3 * x[:, 2] < 0
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(stay)) for c in part.columns], columns)

    return docs.mapInArrow(run, schema)


def _numbered(parts):
    at = 0
    for p in parts:
        yield at, p
        at += p.num_rows
