"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scores.

Null texts are empty ones; an empty text has no feature and gets the score of the bias. Repeated rows get one
score each. Without any labelled row every weight is zero and every score is 0.5. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import held_out, keep_rows, labelled_sample, map_rows

#: Words and runs of marks; both tell junk from prose.
TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS, SAMPLE_ROWS, EPOCHS, MEMO = 18, 6_000, 3, 200_000
#: Mixes two word hashes to that of a pair.
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Of any word that follows itself: one feature for all of them.
SAME = np.uint64(0xD1B54A32D192ED03)


class Hasher(dict):
    """Word to 64-bit hash; the memo is emptied when full, which bounds its memory and changes no value."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def features(text: str, hasher: Hasher, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Bucket of each unigram and bigram (repeats kept) and the scale that makes the vector's mean step one."""
    words = TOKEN.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64), 0.0
    h = np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * PAIR) ^ (h[1:] >> np.uint64(7))
    pairs *= PAIR
    pairs[h[:-1] == h[1:]] = SAME
    idx = (np.concatenate((h, pairs)) >> np.uint64(64 - bits)).astype(np.int64)
    return idx, 1.0 / np.sqrt(len(idx))


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))


class FTRL:
    """Per-coordinate FTRL-proximal with L1 and L2; ``z`` and ``n`` are its whole state."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int, importance: float = 1.0) -> float:
        w = self.weights(at)
        p = sigmoid(float(w @ x))
        g = (p - y) * importance * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        return p


def train(sample: DataFrame, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights and, last, the bias. ``sample`` is bounded by its maker; only its sparse features reach the driver."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        hasher = Hasher()
        for r in source:
            idx, scale = features(r["text"], hasher, bits)
            at, count = np.unique(idx, return_counts=True)
            yield (r["doc_id"], r["label"], at.astype("<i4").tobytes(), (count * scale).astype("<f4").tobytes())

    found = map_rows(sample, "doc_id long, label int, at binary, x binary", rows).collect()
    model, bias = FTRL(bits), 1 << bits
    data = []
    for r in sorted(found, key=lambda r: (xxhash.xxh64_intdigest(str(r.doc_id)), r.at)):
        at = np.append(np.frombuffer(r.at, "<i4").astype(np.int64), bias)
        data.append((at, np.append(np.frombuffer(r.x, "<f4").astype(float), 1.0), int(r.label > 0)))
    ones = sum(y for _, _, y in data)
    weigh = {y: len(data) / (2.0 * max(1, n)) for y, n in ((1, ones), (0, len(data) - ones))}
    for _ in range(epochs):
        for at, x, y in data:
            model.update(at, x, y, weigh[y])
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, columns: str, keep: list[str], bits: int = BITS, name: str = "score") -> DataFrame:
    """``keep`` of each row (typed by ``columns``) and its score; the weights are 2^bits floats, a fixed size."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        hasher = Hasher()
        for r in source:
            idx, scale = features(r["text"] or "", hasher, bits)
            x = float(weights[idx].sum(dtype=np.float64)) * scale + float(weights[-1])
            yield (*(r[c] for c in keep), sigmoid(x))

    return map_rows(docs.select(*dict.fromkeys([*keep, "text"])), f"{columns}, {name} double", rows)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; learns from ``labels.quality``."""
    weights = train(labelled_sample(docs, labels, "quality", sample_rows))
    scored = score(docs, weights, "doc_id long", ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, least: float = 0.5, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""
    memo: list[Hasher] = []

    def keeps(text: str) -> bool:
        if not memo:
            memo.append(Hasher())
        idx, scale = features(text, memo[0], bits)
        return sigmoid(float(weights[idx].sum(dtype=np.float64)) * scale + float(weights[-1])) >= least

    return keep_rows(docs, keeps)
