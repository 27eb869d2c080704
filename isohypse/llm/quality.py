"""Quality classifier (10): ordinal cumulative-link regression on hashed text.

P(grade > j) = sigmoid(w x - c_j) with one weight vector w for all grades and ascending thresholds c_j.
x are a text's hashed features: its words, the shapes of its words, how often its words repeat, and its
length. The expected grade is the sum of the tail probabilities. With two grades, as the given labels have, there is
one threshold, and this is logistic regression; tests fit three.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, PackedTexts, batches, flat, give_back, hash_strings, mix64, text_or_empty, views

#: Features' slots; labelled documents that the fit reads, the first by a hash of doc_id; passes over them.
SLOTS, FIT_DOCUMENTS, PASSES = 1 << 16, 12_000, 12


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """(documents, grades - 1): P(grade > j) from the documents' linear scores."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds[None, :], -30, 30)))


def _bucket(x: np.ndarray, steps: int) -> np.ndarray:
    return np.minimum((np.clip(x, 0, 1) * steps).astype(np.int64), steps - 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of all documents in a row, and each document's end in them. Each block of features has length 1."""
    text = flat(texts).cast(pa.large_string())
    split = pc.ascii_split_whitespace(text)
    coded = pc.dictionary_encode(split.flatten())
    words, code = coded.dictionary, coded.indices.to_numpy()
    ends = np.asarray(split.offsets) - split.offsets[0].as_py()
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(texts)), size)
    letters = np.asarray(pc.binary_length(words))
    low = hash_strings(pc.utf8_lower(words)) if len(words) else np.empty(0, np.uint64)
    shape = pc.replace_substring_regex(words, r"\p{Lu}+", "A")
    for pattern, sign in ((r"\p{Ll}+", "a"), (r"\p{N}+", "0"), (r"!+", "!"), (r"([^A a0!])[^Aa0! ]*", r"\1")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    shape = hash_strings(pc.utf8_slice_codeunits(shape, 0, 8)) if len(words) else np.empty(0, np.uint64)
    real = letters[code] > 0 if len(code) else np.empty(0, bool)
    slot, value, at = [], [], []

    def block(who: np.ndarray, what: np.ndarray, salt: int, scale: float = 1.0) -> None:
        """Counted features, damped to 1 + log, each document's to the length `scale`."""
        key = (who.astype(np.uint64) << np.uint64(16)) | (mix64(what + np.uint64(salt)) & np.uint64(SLOTS - 1))
        key, n = np.unique(key, return_counts=True)
        who, v = (key >> np.uint64(16)).astype(np.int64), 1 + np.log(n)
        norm = np.sqrt(np.bincount(who, weights=v * v, minlength=len(texts)))
        slot.append((key & np.uint64(SLOTS - 1)).astype(np.int64))
        value.append(scale * v / norm[who])
        at.append(who)

    block(owner[real], low[code[real]], 1)
    block(owner[real], shape[code[real]], 2)
    # how the words repeat: distinct words to words, words equal to the one before, the commonest word's part
    docs = np.arange(len(texts))
    n = np.bincount(owner[real], minlength=len(texts))
    pair, times = np.unique((owner[real].astype(np.int64) << 32) | code[real], return_counts=True)
    who = pair >> 32
    distinct, most = np.bincount(who, minlength=len(texts)), np.zeros(len(texts), np.int64)
    np.maximum.at(most, who, times)
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner[same], minlength=len(texts))
    chars = np.bincount(owner[real], weights=letters[code[real]], minlength=len(texts)) if len(code) else np.zeros(len(texts))
    m = np.maximum(n, 1)
    kinds = [_bucket(distinct / m, 20), _bucket(again / m, 20), _bucket(most / m, 20), np.minimum(np.log2(n + 1).astype(np.int64), 20), _bucket(chars / m / 20, 20)]
    long = np.minimum(np.log2(n + 1).astype(np.int64), 20)
    for i, k in enumerate(kinds):
        block(docs, (k + 100 * i).astype(np.uint64), 3)
        block(docs, (k + 100 * i + 1000 * (long + 1)).astype(np.uint64), 4, 0.5)
    slot, value, at = np.concatenate(slot), np.concatenate(value), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return slot[order], value[order], np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(texts)))))


def linear(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    slot, value, ends = features(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    return np.bincount(owner, weights=weights[slot] * value, minlength=len(texts))


def fit(texts: list[str] | PackedTexts, grades: np.ndarray, passes: int = PASSES, seed: int = 3) -> Ordinal:
    """Maximum likelihood with a ridge, by AdaGrad over shuffled batches; thresholds stay ascending.

    Without texts, or with one grade only, the model gives every text that grade (0 without any).
    """
    kinds = sorted({int(g) for g in grades})
    weights = np.zeros(SLOTS)
    if len(kinds) < 2:
        return Ordinal(kinds or [0], weights, np.empty(0))
    y = np.searchsorted(kinds, grades)
    k = len(kinds) - 1
    above = np.array([(y > j).mean() for j in range(k)])
    c = -np.log(above / (1 - above))
    parts = (features(pa.array(texts[i : i + 256], pa.large_string())) for i in range(0, len(texts), 256))
    parts = [(s.astype(np.int32), v.astype(np.float32), e) for s, v, e in parts]
    rows = [(s[a:b], v[a:b]) for s, v, e in parts for a, b in zip(e[:-1], e[1:])]
    step_w, step_c = np.full(SLOTS, 1e-6), np.full(k, 1e-6)
    rng = np.random.default_rng(seed)
    for turn in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            own = order[at : at + 32]
            slot = np.concatenate([rows[i][0] for i in own])
            value = np.concatenate([rows[i][1] for i in own])
            who = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
            x = np.bincount(who, weights=weights[slot] * value, minlength=len(own))
            # P(y = j) = F(upper) - F(lower), F the logistic function of threshold - x
            bounds = np.concatenate(([-np.inf], c, [np.inf]))
            hi = 1 / (1 + np.exp(-np.clip(bounds[y[own] + 1] - x, -30, 30)))
            lo = 1 / (1 + np.exp(-np.clip(bounds[y[own]] - x, -30, 30)))
            hi, lo = np.where(y[own] == k, 1.0, hi), np.where(y[own] == 0, 0.0, lo)
            gx = 1 - hi - lo  # of -log P by x
            p = np.maximum(hi - lo, 1e-9)
            gc = np.zeros(k)
            np.add.at(gc, y[own][y[own] < k], -(hi * (1 - hi) / p)[y[own] < k])
            np.add.at(gc, y[own][y[own] > 0] - 1, (lo * (1 - lo) / p)[y[own] > 0])
            where, back = np.unique(slot, return_inverse=True)
            gw = np.bincount(back, weights=gx[who] * value) / len(own) + 1e-5 * weights[where]
            step_w[where] += gw * gw
            weights[where] -= 0.3 * gw / np.sqrt(step_w[where])
            gc /= len(own)
            step_c += gc * gc
            c = np.maximum.accumulate(c - 0.1 * gc / np.sqrt(step_c))
    return Ordinal(kinds, weights, c)


def training(docs: DataFrame, labels: DataFrame, grade: str = "quality", limit: int = FIT_DOCUMENTS):
    """(doc_id, text, grade) of at most `limit` rated documents, the first by a hash of doc_id."""
    known = labels.where(f"{grade} is not null and doc_id is not null").groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    return rows.toLocalIterator(prefetchPartitions=True)


def learn(docs: DataFrame, labels: DataFrame, grade: str = "quality", limit: int = FIT_DOCUMENTS) -> Ordinal:
    rows = sorted((r["doc_id"], PackedTexts.pack(r["text"]), r["grade"]) for r in training(docs, labels, grade, limit))
    model = fit(PackedTexts([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64))
    del rows
    give_back()
    return model


def rate(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_grade, tail (P of the highest grade), selected (P of more than the lowest grade >= 0.5).

    A row for each row of `docs`; a null text counts as empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(rows):
        m = shared.value
        for batch in rows:
            for part in batches(batch, np.diff(views(batch.column(1))[0]), BATCH_BYTES):
                tails = m.tails(linear(part.column(1), m.weights))
                steps = np.diff(np.array(m.grades, float))
                expected = m.grades[0] + tails @ steps
                last = tails[:, -1] if tails.shape[1] else np.ones(len(tails))
                first = tails[:, 0] if tails.shape[1] else np.ones(len(tails))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(last), pa.array(first >= 0.5)], ["doc_id", "expected_grade", "tail", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, "doc_id long, expected_grade double, tail double, selected boolean")


def keep_selected(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of `docs` whose text is selected, with all their columns."""
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        m = shared.value
        for batch in rows:
            text = pc.fill_null(batch.column(at), "")
            begin = 0
            for part in batches(batch, np.diff(views(text)[0]), BATCH_BYTES):
                tails = m.tails(linear(text.slice(begin, part.num_rows), m.weights))
                begin += part.num_rows
                stay = tails[:, 0] >= 0.5 if tails.shape[1] else np.ones(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(stay)) for c in part.columns], columns)

    return docs.mapInArrow(run, schema)
