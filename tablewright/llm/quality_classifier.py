"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader.

Features are word unigrams and bigrams and the same of word shapes (first and
last character class, length, repeats the word before), hashed into a fixed
number of weights. A feature's value is its share among the n-grams of its kind,
so a score is a sparse dot product that is linear in counts. The model is fitted
on a bounded sample of labelled rows (``max_train_rows``); every document is
scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import remainder
from .staging import bounded_batches
from .textcore import buffers, column, gram_hashes, mix64, slices, span_hashes, split_words

WEIGHTS = 1 << 20
KINDS = 4
SCALE = 8.0

_CLASS = np.arange(256, dtype=np.uint64)  # punctuation keeps its own class
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = 0x80


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of n-gram: weight indices of all n-grams, and where each text's begin (one more at the end)."""
    data, offsets = buffers(texts)
    words = split_words(data, offsets)
    h = span_hashes(words.data, words.starts, words.ends)
    n = len(h)
    inside = np.ones(n, dtype=bool)  # has a word before it in its text
    inside[words.first[:-1][words.first[:-1] < n]] = False
    repeats = np.zeros(n, dtype=bool)
    repeats[1:] = h[1:] == h[:-1]
    repeats &= inside
    size = np.minimum(words.ends - words.starts, 15).astype(np.uint64)
    first = _CLASS[words.data[words.starts]] if n else np.empty(0, np.uint64)
    last = _CLASS[words.data[words.ends - 1]] if n else np.empty(0, np.uint64)
    shape = mix64(first | last << np.uint64(8) | size << np.uint64(16) | repeats.astype(np.uint64) << np.uint64(24) | np.uint64(1 << 40))
    counts = np.maximum(words.counts() - 1, 0)  # a text of m words has m - 1 pairs
    pair_first = np.concatenate([[0], np.cumsum(counts)])
    found = []
    for salt, (grams, begin) in enumerate(((h, words.first), (None, pair_first), (shape, words.first), (None, pair_first))):
        if grams is None:
            base = h if salt == 1 else shape
            grams = gram_hashes(base, 2)[inside[1:]] if n > 1 else np.empty(0, np.uint64)
        index = mix64(grams + np.uint64(salt)) >> np.uint64(64 - (WEIGHTS.bit_length() - 1))
        found.append((index.astype(np.int64), begin))
    return found


def dense_scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text."""
    z = np.full(len(texts), bias, dtype=np.float64)
    for index, begin in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
        n = np.diff(begin)
        z += np.where(n > 0, SCALE * (sums[begin[1:]] - sums[begin[:-1]]) / np.maximum(n, 1), 0.0)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """FTRL-proximal logistic regression over sparse rows."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(WEIGHTS + 1)
        self.n = np.zeros(WEIGHTS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        """``index`` has no repeats; the last weight is the bias."""
        w = self.weights(index)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        grown = self.n[index] + g * g
        self.z[index] += g - (np.sqrt(grown) - np.sqrt(self.n[index])) / self.alpha * w
        self.n[index] = grown


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        kinds = features(column(batch, "text"))
        rows: list[list[bytes]] = [[], []]
        for k in range(batch.num_rows):
            index, value = [], []
            for found, begin in kinds:
                mine = found[begin[k] : begin[k + 1]]
                if len(mine):
                    one, n = np.unique(mine, return_counts=True)
                    index.append(one)
                    value.append(SCALE * n / len(mine))
            index, value = np.concatenate([*index, [WEIGHTS]]), np.concatenate([*value, [1.0]])
            one, at = np.unique(index, return_inverse=True)  # kinds may share a weight
            rows[0].append(one.astype("<i4").tobytes())
            rows[1].append(np.bincount(at, value).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([column(batch, "draw"), column(batch, "label"), *[pa.array(r, pa.binary()) for r in rows]], ["draw", "label", "index", "value"])


def train(docs: DataFrame, labels: DataFrame, *, max_train_rows: int = 6000, epochs: int = 3, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias from docs (doc_id, text) and labels (doc_id, label), at most ``max_train_rows`` of them, drawn by hash."""
    drawn = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64(F.lit(seed), "doc_id").alias("draw"))
    sample = drawn.orderBy("draw", "doc_id", "label").limit(max_train_rows)
    rows = docs.join(F.broadcast(sample), "doc_id").select("draw", "label", "text").mapInArrow(_examples, "draw long, label int, index binary, value binary")
    found = sorted(rows.toArrow().to_pylist(), key=lambda r: (r["draw"], r["label"], r["index"], r["value"]))
    model = Ftrl()
    for _ in range(epochs):
        for r in found:
            model.learn(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4").astype(np.float64), r["label"])
    w = model.weights(slice(None))
    return w[:-1].astype(np.float32), float(w[-1])


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every whole text. Null and empty texts score by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB
    names = ["doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(dense_scores(column(batch, "text"), shared.value, bias))], names)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    found = own.mapInArrow(run, f"doc_id {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_classifier(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    folds: int = 5, held_out: int = 0, threshold: float = 0.3, **options,
) -> DataFrame:
    """Train outside the held-out fold and score all documents.

    Returns doc_id, held_out, score, predicted; one row per input row. Labels that
    are null or neither 0 nor 1 are not learned from, nor labels of null ids; a
    document labelled twice counts twice. Without any label all scores are 0.5.
    Repeated rows get equal scores. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    known = known.where(remainder(F.col("doc_id"), folds) != held_out)
    weights, bias = train(own, known, **options)
    found = score_quality(own, weights, bias, threshold=threshold)
    fold = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", fold.alias("held_out"), "score", "predicted")
