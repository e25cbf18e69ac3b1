"""Bloom filters of 64-bit keys: made by Spark, of bounded size, tested within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most, as a power of two: beyond that it lets more through, and the join behind it does the rest.
MOST_BITS = 29
#: Odd factors, one for each bit that a key sets.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
#: Words of 64 bits in a row of the filter.
SEGMENT = 1 << 12


def bloom_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h * np.uint64(f)) >> np.uint64(64 - bits) for f in FACTORS]


def bloom_words(bits: int):
    """The filter's words that the keys of a batch set, by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(bloom_places(batch.column(0).to_numpy().view(np.uint64), bits))
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            held = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(held, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.record_batch([pa.array(word.astype(np.int64) // SEGMENT), pa.array(word.astype(np.int64) % SEGMENT), pa.array(held.view(np.int64))], names=["segment", "word", "bits"])

    return run


def segment(words: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(SEGMENT, dtype=np.int64)
    out[words.word.to_numpy()] = words.bits.to_numpy()
    return pd.DataFrame({"segment": words.segment.iloc[:1], "held": [out.tobytes()]})


def bloom_filter(keys: DataFrame, bits_a_key: int) -> np.ndarray:
    """The filter of the distinct keys in the one column of ``keys``, of 2**MOST_BITS bits at most: its size is bounded whatever their number."""
    bits = min(MOST_BITS, max(18, (bits_a_key * keys.count()).bit_length()))
    words = keys.mapInArrow(bloom_words(bits), "segment long, word long, bits long").groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    held = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in words.groupBy("segment").applyInPandas(segment, "segment long, held binary").toLocalIterator():
        held[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["held"], np.uint64)
    return held


def may_hold(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys ``h`` the filter lets through: all that it was made of, and a few others."""
    bits, at = (len(held) * 64).bit_length() - 1, np.arange(len(h))
    for f in FACTORS:
        places = (h[at] * np.uint64(f)) >> np.uint64(64 - bits)
        at = at[(held[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1]
    ok = np.zeros(len(h), dtype=bool)
    ok[at] = True
    return ok
