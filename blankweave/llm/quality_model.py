"""A quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every word has a sparse random index vector; a word's own vector is the sum of the index
vectors around it in the sample. Words that the sample lacks share the vector of their
shape (runs of letters, capitals, digits and each sign). Two markers stand for a word
equal to the one before and for a run of four words seen before in the text, so that the
pooled mean also tells repetition. The network's logits are divided by a temperature and
shifted to the label shares of all labelled rows, both fitted on rows the network hasn't seen.

The model is fitted on at most SAMPLE labelled rows of each label of at most SAMPLE_CHARS
characters, those of least hash of the id; it is then of fixed size and travels with the tasks.
Scores use the text only.

Defined results: null or empty text pools to the zero vector and gets the score of that;
a document labelled twice counts once, with its lower label; without labels of both kinds
every score is 0.5; rows of a repeated doc_id are scored row by row; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SAMPLE, SAMPLE_CHARS = 2500, 50_000
WORDS, SHAPES, WIDTH, HIDDEN = 8192, 1024, 48, 24
THRESHOLD, HELD_OUT = 0.3, 5
_REPEAT, _SEEN = WORDS + SHAPES, WORDS + SHAPES + 1
_SIZE = _SEEN + 1
_SLOTS = 1 << 17
_RUN = 4
_PREFIX = "_quality_"

#: Letters, capitals and digits are one kind each; every other sign is a kind of its own.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and shape number of every word, first word of each text, both markers' counts of each text."""
    data, offsets = shared.text_bytes(column)
    starts, ends, first = shared.word_bounds(data, offsets)
    words = shared.span_hashes(data, starts, ends)
    kinds = _KIND[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[starts] = True
    before = np.concatenate(([0], np.cumsum(turn)))
    shapes = (shared.span_hashes(kinds[turn], before[starts], before[ends]) % np.uint64(SHAPES)).astype(np.int64)
    n = len(offsets) - 1
    repeats, seen = np.zeros(n, np.int64), np.zeros(n, np.int64)
    same = np.concatenate(([0], np.cumsum(np.concatenate(([False], words[1:] == words[:-1]))))) if len(words) else np.zeros(1, np.int64)
    runs = shared.window_hashes(words, _RUN)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a > 1:
            repeats[i] = same[b] - same[a + 1]
        if b - a > _RUN:
            own = np.sort(runs[a : b - _RUN + 1])
            seen[i] = int((own[1:] == own[:-1]).sum())
    return words, shapes, first, repeats, seen


class Model:
    def __init__(self) -> None:
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.vectors = np.zeros((_SIZE, WIDTH), np.float32)
        self.layers: list[np.ndarray] = []
        self.shift, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.temperature, self.bias = 1.0, 0.0

    def ids(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        known = self.slots[(words % np.uint64(_SLOTS)).astype(np.int64)]
        return np.where(known >= 0, known, WORDS + shapes)

    def pooled(self, column: pa.Array) -> np.ndarray:
        words, shapes, first, repeats, seen = _units(column)
        out = np.zeros((len(first) - 1, WIDTH))
        filled = np.flatnonzero(first[1:] > first[:-1])
        if len(filled):
            out[filled] = np.add.reduceat(self.vectors[self.ids(words, shapes)], first[:-1][filled], axis=0)
        out += repeats[:, None] * self.vectors[_REPEAT] + seen[:, None] * self.vectors[_SEEN]
        return out / np.maximum(1, np.diff(first) + repeats + seen)[:, None]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.shift) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.layers:
            return np.full(len(column), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(column)) / self.temperature + self.bias, -40, 40)))


def index_vectors(seed: int = 11) -> np.ndarray:
    """Sparse ternary vectors, one for each word, shape and marker."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 6, (_SIZE, WIDTH)) == 0).astype(np.float32) * rng.choice(np.array([-1, 1], np.float32), (_SIZE, WIDTH))


def _train_vectors(model: Model, texts: pa.Array) -> None:
    # In slices: the work arrays of a slice take many times the bytes of its texts.
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [_units(part.column("text")) for part in shared.slices(iter([batch]))]
    words, shapes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    text_of = np.repeat(np.arange(len(texts)), np.concatenate([np.diff(p[2]) for p in parts]))
    slot = (words % np.uint64(_SLOTS)).astype(np.int64)
    counts = np.bincount(slot, minlength=_SLOTS)
    often = np.argsort(-counts, kind="stable")[:WORDS]
    often = often[counts[often] > 2]
    model.slots[often] = np.arange(len(often))
    ids, index = model.ids(words, shapes), index_vectors()
    total, step = np.zeros((_SIZE, WIDTH)), 1 << 17
    for away in (1, 2):
        for at in range(0, max(0, len(ids) - away), step):
            left, right = ids[at : at + step][: len(ids) - away - at], ids[at + away : at + away + step]
            inside = text_of[at : at + len(left)] == text_of[at + away : at + away + len(right)]
            for word, other in ((left[inside], right[inside]), (right[inside], left[inside])):
                order = np.argsort(word, kind="stable")
                if len(order):
                    own, begins = np.unique(word[order], return_index=True)
                    total[own] += np.add.reduceat(index[other[order]], begins, axis=0)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    own_norm = np.linalg.norm(index, axis=1, keepdims=True)
    # A word keeps part of its own index vector, so that words in like company stay apart.
    model.vectors = (total / np.maximum(norm, 1e-9) + index / np.maximum(own_norm, 1e-9)).astype(np.float32)


def fit(texts: list[str], labels: list[int], share: float | None = None, rounds: int = 800, seed: int = 5) -> Model:
    """``share``: of label 1 among all labelled rows, where the sample's share is another."""
    model, y = Model(), np.array(labels, float)
    if len(set(labels)) < 2:
        return model
    column = pa.array(texts, pa.large_string())
    _train_vectors(model, column)
    x = np.concatenate([model.pooled(column.slice(i, 200)) for i in range(0, len(texts), 200)])
    checked = np.arange(len(y)) % 5 == 4
    if len(set(y[checked])) < 2 or len(set(y[~checked])) < 2:
        checked = np.zeros(len(y), bool)
    a, b = x[~checked], y[~checked]
    model.shift, model.scale = a.mean(axis=0), a.std(axis=0) + 1e-3
    a = (a - model.shift) / model.scale
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for t in range(1, rounds + 1):
        hidden = np.tanh(a @ layers[0] + layers[1])
        error = (1 / (1 + np.exp(-(hidden @ layers[2] + layers[3][0]))) - b) / len(b)
        back = error[:, None] * layers[2] * (1 - hidden**2)
        gradients = [a.T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2], np.array([error.sum()])]
        for w, g, m, v in zip(layers, gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.layers = layers
    held = checked if checked.any() else ~checked
    logits, target = model.logits(x[held]), y[held]
    losses = [(float(np.logaddexp(0, np.where(target == 1, -logits, logits) / t).mean()), t) for t in np.geomspace(1, 8, 31)]
    model.temperature = min(losses)[1]
    if share is not None:
        own = min(max(y.mean(), 1e-6), 1 - 1e-6)
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.bias = math.log(share / (1 - share)) - math.log(own / (1 - own))
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of the labelled rows for which ``learn`` (over doc_id) holds."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(learn)
    shares = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [marks.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    # 2 * sample rows of two numbers, by the limits above.
    chosen = F.broadcast(chosen[0].union(chosen[1]).withColumnRenamed("doc_id", "_id"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text"))
        .where(F.char_length("text") <= sample_chars).join(chosen, F.col("doc_id") == F.col("_id"))
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    )
    share = shares.get(1, 0) / max(1, sum(shares.values()))

    def fitted(sample: list[dict]) -> Model:
        sample.sort(key=lambda r: r["doc_id"])
        return fit([r["text"] for r in sample], [r["quality"] for r in sample], share)

    return shared.learn_in_a_task(rows, fitted)


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``_quality_score`` of every row."""
    source = docs.select(*[F.col(c) for c in keep], shared.text_or_empty(text).alias(f"{_PREFIX}text"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"{_PREFIX}score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, f"{_PREFIX}text"):
            values = sent.value.score(part.column(f"{_PREFIX}text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(values)], names=[*keep, f"{_PREFIX}score"])

    return source.mapInArrow(score, schema)


def learned() -> Column:
    """Rows that may be learned from; the others are held out. A null doc_id has no remainder: it counts as held out."""
    return F.coalesce(shared.remainder("doc_id", HELD_OUT) != 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, learned())
    scored = score_documents(docs, model, ["doc_id"])
    score = F.col(f"{_PREFIX}score")
    return scored.select("doc_id", (~learned()).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents predicted to have label 1, with their own columns; the model learns from ``learn_from`` or from them."""
    model = train(docs if learn_from is None else learn_from, labels, learned())
    return score_documents(docs, model, docs.columns).where(F.col(f"{_PREFIX}score") >= THRESHOLD).select(*docs.columns)
