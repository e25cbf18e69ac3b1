"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is 1 - exp(-h), where h
sums non-negative weights of its distinct words, and a document's score combines
its sentences, and a leak for what no word explains, by noisy-or:
1 - exp(-leak) * product(1 - sentence score). Weights and leak are fitted to
document labels alone; the sentence scores then say where the fault is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_remainder, pick, pieces

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Rows that a model is fitted on at most, drawn by a hash of the id, and bytes of their texts.
MAX_SAMPLE, MAX_SAMPLE_BYTES = 4000, 128 << 20


def sentences(text: str) -> Iterator[tuple[int, int, set]]:
    """(start, end, distinct words) of each sentence that has a word."""
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m[0].lower()))
        if words:
            yield m.start(), m.end(), words


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int, most_bytes: int = MAX_SAMPLE_BYTES) -> list:
    """(doc_id, text, label) of at most ``limit`` rows and about ``most_bytes`` of text that ``train`` admits, in an order set by the id.

    Both bounds hold what reaches the driver. Repeated labels of a document count once, as the largest; null labels and ids do not count.
    """
    chosen = labels.select(pick(labels, "doc_id", "long"), pick(labels, label, "int")).where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.max(label).alias(label))
    texts = docs.select(pick(docs, "doc_id", "long"), pick(docs, "text", "string"))
    # Labels are narrow: the sample is drawn from those whose document exists, before any text moves.
    chosen = chosen.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))  # at most ``limit`` rows
    with Scratch(docs.sparkSession, "sample") as scratch:
        rows = scratch.save(rows, "rows")
        before, kept = 0, []
        for r in rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
            if before <= most_bytes - r["n"]:
                kept.append(r["doc_id"])
                before += r["n"]
        ids = docs.sparkSession.createDataFrame([(k,) for k in kept], "doc_id long")
        return rows.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()


def fit(sample: list[tuple[str, int]], min_sentences: int = 8, l1: float = 2.0, rounds: int = 200, rate: float = 0.1) -> tuple[dict[str, float], float]:
    """(weight of each word that has one, leak), from (text, label) pairs.

    log(1 - P) of a document is -(leak + sum over sentences and their words of
    the weights): the likelihood is convex, and non-negative weights with an L1
    penalty leave only words that raise the score. Equal texts count once, with
    the largest label, and a word needs ``min_sentences`` different sentences:
    copies of one mislabelled text are no evidence. Without both labels the leak
    alone remains.
    """
    once: dict[str, int] = {}
    for text, label in sample:
        once[text or ""] = max(label, once.get(text or "", 0))
    y = np.array(list(once.values()), dtype=float)
    share = float(y.mean()) if len(y) else 0.0
    leak = -np.log1p(-min(max(share, 1e-4), 0.99))
    if not len(y) or share in (0.0, 1.0):
        return {}, float(leak)
    ids: dict[str, int] = {}
    seen: set[int] = set()
    in_sentences: Counter = Counter()
    bags = []  # of each text: its words as numbers, and in how many of its sentences they are
    for text in once:
        found = [[ids.setdefault(w, len(ids)) for w in words] for _, _, words in sentences(text)]
        for words in found:
            if (h := hash(frozenset(words))) not in seen:
                seen.add(h)
                in_sentences.update(words)
        bags.append(np.unique(np.array([w for words in found for w in words], dtype=np.int32), return_counts=True))
    names = list(ids)
    often = sorted((w for w, n in in_sentences.items() if n >= min_sentences), key=lambda w: (-in_sentences[w], names[w]))
    column = np.full(len(ids), -1)
    column[often] = np.arange(len(often))
    vocabulary = [names[w] for w in often]
    doc = np.repeat(np.arange(len(bags)), [len(w) for w, _ in bags])
    word = column[np.concatenate([w for w, _ in bags])]
    count = np.concatenate([n for _, n in bags])
    doc, word, count = doc[word >= 0], word[word >= 0], count[word >= 0]
    theta, m, v = (np.zeros(len(vocabulary) + 1) for _ in range(3))
    theta[-1] = leak
    for t in range(1, rounds + 1):
        hazard = np.bincount(doc, theta[word] * count, len(y)) + theta[-1]
        pull = 1 - y / np.maximum(-np.expm1(-hazard), 1e-6)  # d loss / d hazard: 1 for label 0, 1 - 1/P for label 1
        g = np.append(np.bincount(word, pull[doc] * count, len(vocabulary)) + l1, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = np.maximum(theta - rate / (1 + 3 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8), 0)
        theta[-1] = max(theta[-1], 1e-4)
    return {w: float(t) for w, t in zip(vocabulary, theta) if t > 0.05}, float(theta[-1])


def document_score(text: str, weights: dict[str, float], known: frozenset, leak: float, least: float) -> tuple[float, list]:
    """(score, offending sentences) of one text."""
    if known.isdisjoint(WORD.findall(text.lower())):
        return float(-np.expm1(-leak)) if text else 0.0, []
    total, found = leak, []
    for start, end, words in sentences(text):
        h = sum(weights[w] for w in words & known)
        total += h
        if (p := -np.expm1(-h)) >= least:
            found.append({"start": start, "end": end, "score": float(p)})
    return float(-np.expm1(-total)), found


SCORES = "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>"


def scorer(weights: dict[str, float], leak: float, least: float):
    known = frozenset(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in pieces(batches):
            scored = [document_score(t.as_py() or "", weights, known, leak, least) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([s for s, _ in scored], pa.float64()), pa.array([f for _, f in scored], kind)], names=["doc_id", "score", "offending"])

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, threshold: float = 0.5, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, and offending: the sentences whose own score reaches the threshold, as code point spans.

    Only labels of rows outside the held-out fold are learned from, on at most
    ``max_sample`` of them and MAX_SAMPLE_BYTES of their texts. A null or empty
    text has no sentence and scores 0; very long texts are scored whole; a null
    doc_id is not held out. A score at the threshold counts as above it. Repeated rows score each on their own; an
    empty table gives no rows. Columns other than doc_id and text are not read.
    """
    sample = labelled_sample(docs, labels, "toxic", crc_remainder(F.col("doc_id"), folds) != held_out_fold, max_sample)
    weights, leak = fit([(r["text"], r["toxic"]) for r in sample])
    scored = docs.select(pick(docs, "doc_id", "long"), pick(docs, "text", "string")).mapInArrow(scorer(weights, leak, threshold), SCORES)
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """The documents that score under the threshold, with all their columns; all labels are learned from.

    A null or empty text scores 0 and stays; very long texts are scored whole; a
    score at the threshold goes; of repeated rows all stay or all go; an empty
    table gives no rows; other columns are kept and not read, whatever their names.
    """
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), max_sample)
    weights, leak = fit([(r["text"], r["toxic"]) for r in sample])
    known, place = frozenset(weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array([document_score(t.as_py() or "", weights, known, leak, threshold)[0] < threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
