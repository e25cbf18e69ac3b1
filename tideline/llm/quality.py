"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits, or of other signs. Features are their
one- and two-grams in lower case and the one- to three-grams of their shapes
(case, digits, the signs themselves), so that words never seen still tell;
counts are dampened and each text's vector has length 1.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, pick
from .toxicity import labelled_sample

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 18
MAX_SAMPLE = 6000
MEMO = 400_000


def shape(word: str) -> str:
    if word.isdigit():
        return "9"
    if word[0].isalnum():
        return "A" if len(word) > 1 and word.isupper() else "T" if word[0].isupper() else "a"
    return word[:3]


class Hashes(dict):
    """Word -> hash of its lower case in the high half, of its shape in the low half; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = zlib.crc32(word.lower().encode("utf-8", "replace")) << 32 | zlib.crc32(shape(word).encode("utf-8", "replace"), 77)
        return h


def mixed(*parts: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(parts[0]), seed, dtype=np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h >> np.uint64(64 - BITS)


def features(text: str, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text's sparse vector, of length 1; both empty without a word."""
    both = np.array(list(map(memo.__getitem__, TOKEN.findall(text))), dtype=np.uint64)
    if not len(both):
        return np.zeros(0, np.int64), np.zeros(0)
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    grams = [mixed(w, seed=1), mixed(w[:-1], w[1:], seed=2), mixed(s, seed=3), mixed(s[:-1], s[1:], seed=4), mixed(s[:-2], s[1:-1], s[2:], seed=5)]
    index, counts = np.unique(np.concatenate(grams).astype(np.int32), return_counts=True)
    value = np.sqrt(counts)
    return index, value / np.linalg.norm(value)


class Ftrl:
    """Logistic regression; per-coordinate steps and an L1 penalty that keeps rare features at zero."""

    def __init__(self, size: int = 1 << BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n, self.bias = np.zeros(size), np.zeros(size), 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index=slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, y: int) -> None:
        w = self.weights(index)
        p = sigmoid(float(w @ value) + self.bias)
        g = (p - y) * value
        n = self.n[index]
        grown = n + g * g
        self.z[index] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[index] = grown
        self.bias -= 0.02 * (p - y)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fit(sample: list[tuple[str, int]], epochs: int = 4) -> tuple[np.ndarray, float]:
    model, memo = Ftrl(), Hashes()
    rows = []
    for text, label in sample:
        index, value = features(text or "", memo)
        rows.append((index.astype(np.int32), value.astype(np.float32), label))
    for _ in range(epochs):
        for index, value, label in rows:
            model.learn(index, value, label)
    return model.weights(), model.bias


def scorer(held, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, memo = held.value, Hashes()
        for batch in batches:
            scores = []
            for text in batch.column(1):
                index, value = features(text.as_py() or "", memo)
                scores.append(sigmoid(float(weights[index] @ value) + bias))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out_fold: int = 2, threshold: float = 0.7, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted.

    Only labels of rows outside the held-out fold are learned from, on at most
    ``max_sample`` of them, and the sample's bytes are bounded too. A null or
    empty text has no feature: its score is that of the bias. Very long texts are
    scored whole; a score at the threshold counts as above it. A null doc_id is not held out. Repeated rows score each on
    their own; an empty table gives no rows. Columns other than doc_id and text
    are not read.
    """
    sample = labelled_sample(docs, labels, "quality", crc_remainder(F.col("doc_id"), folds) != held_out_fold, max_sample)
    weights, bias = fit([(r["text"], r["quality"]) for r in sample])
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS numbers, whatever the corpus
    scored = docs.select(pick(docs, "doc_id", "long"), pick(docs, "text", "string")).mapInArrow(scorer(held, bias), "doc_id long, score double")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
