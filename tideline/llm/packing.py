"""Best-fit packing planned on a histogram of lengths.

The plan is made over counts: at most ``capacity`` different lengths, whatever
the number of documents. Classes of equal sequences are filled best-fit, longest
length first, and split only when fewer pieces are left than a class has
sequences. Pieces then take their planned slots by joining on their rank within
their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, pieces

#: Texts made of these characters only: there the rank-file reader of the same vocabulary splits as the tokenizer does.
PLAIN = re.compile(r"[\x20-\x7e\nÀ-ÖØ-öø-ſ]*")
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, task_rank long"
_loaded: dict = {}


def tokenizers(name: str = "byte_bpe_50k") -> tuple:
    """(tokenizer, rank-file reader of the same vocabulary, pattern of its added tokens), loaded once a worker."""
    if name not in _loaded:
        import base64
        import os

        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        whole = Tokenizer.from_file(public.path(f"{name}.json"))
        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = "|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or r"(?!)"
        _loaded[name] = whole, tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), re.compile(added)
    return _loaded[name]


def token_ids(text: str, name: str = "byte_bpe_50k") -> np.ndarray:
    """The tokenizer's ids of the whole text. Plain texts without an added token go through the faster reader of the same vocabulary."""
    whole, fast, added = tokenizers(name)
    if PLAIN.fullmatch(text) and not added.search(text):
        return np.array(fast.encode_ordinary(text), dtype="<u4")
    return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, but for the first piece."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(capacity: int, end_id: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in pieces(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(token_ids(text.as_py() or "", name), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])

    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): where the pieces of each length go.

    ``classes`` groups equal sequences: room left -> list of [sequences, contents].
    """
    classes: dict[int, list] = {}
    done: list = []
    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r in classes if r >= length), default=None)
            if room is None:
                # Open as many as whole fills need, each filled with this length alone at first.
                per = min(capacity // length, left)
                count = left // per
                put(classes, done, capacity - per * length, count, [length] * per)
                left -= count * per
                continue
            count, held = classes[room].pop()
            if not classes[room]:
                del classes[room]
            per = min(room // length, max(1, left // count))
            used = min(count, left // per)
            if used < count:
                classes.setdefault(room, []).append([count - used, held])
            put(classes, done, room - per * length, used, held + [length] * per)
            left -= used * per
    for room, entries in classes.items():
        done += entries
    rows, at, sequence = [], dict.fromkeys(histogram, 0), 0
    for count, held in sorted(done, key=lambda x: x[1], reverse=True):
        offset = 0
        for length in held:
            rows.append((length, at[length], at[length] + count, sequence, offset))
            at[length] += count
            offset += length
        sequence += count
    return rows


def put(classes: dict, done: list, room: int, count: int, held: list) -> None:
    if room:
        classes.setdefault(room, []).append([count, held])
    else:
        done.append([count, held])


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, name: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is one piece of the end id alone. Very long
    texts are cut into pieces, all of which are packed. Repeated rows and equal
    texts are packed each on their own; pieces of equal length take their slots
    in the order of their tasks; an empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    spark: SparkSession = docs.sparkSession
    pieces = Scratch(spark, "packing").save(docs.select(pick(docs, "doc_id", "long"), pick(docs, "text", "string")).mapInArrow(pieces_of(capacity, end_id, name), PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("task_pieces"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("task_pieces").alias("n")).collect()}  # a row for each length
    slots = spark.createDataFrame(plan(histogram, capacity), "length int, first_rank long, end_rank long, first_sequence long, offset long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("task_pieces").over(before), F.lit(0)).alias("task_start"))
    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("task_start") + F.col("task_rank"))
    p, s = ranked.alias("p"), F.broadcast(slots).alias("s")  # bounded by the lengths and the splits of classes, not by documents
    placed = p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    return placed.select("doc_id", "piece", "start", F.col("p.length").cast("long").alias("length"), "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), F.col("offset"))
