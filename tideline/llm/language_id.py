"""Language by interpolated Kneser-Ney character models.

Texts are read as symbols: a boundary for every run of signs that are not
letters, the letters a to z, and 37 classes of all other letters (lower case,
by code point, so that the letters of one alphabet rarely share a class). Four
symbols are 24 binary digits, so a model has at most 2^24 grams of its highest
order however large the corpus. Spark counts the grams of all documents that
may be learned from; lower orders follow from them by Kneser and Ney's
continuation counts. The models of all languages share sorted arrays of grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_remainder, pick, pieces

ORDER, BITS = 4, 6
UNKNOWN = "und"
#: Code points that are read at once; texts of more are read in several parts.
PART = 1 << 20
#: Grams that a task holds before it hands on what it has counted.
HELD = 1 << 21
#: Of the rows that may be learned from, one in so many calibrates and isn't counted.
CALIBRATION = 16
TEMPERATURES = tuple(2.0**k for k in range(11))
#: Deviations within which no text is rejected.
LEAST_LIMIT = 3.0


def symbol(point: int) -> int:
    """0 where the code point isn't a letter, 1 to 26 for a to z, else 27 to 63."""
    letter = chr(point)
    if not letter.isalpha():
        return 0
    low = ord(letter.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low % 37


class Symbols:
    """The symbols of texts, from a table of the first plane; other planes are looked up by value."""

    def __init__(self):
        self.table = np.array([0 if 0xD800 <= p < 0xE000 else symbol(p) for p in range(0x10000)], dtype=np.int32)

    def of(self, points: np.ndarray) -> np.ndarray:
        if not len(points) or points.max() < 0x10000:
            return self.table[points]
        values, where = np.unique(points, return_inverse=True)
        return np.array([self.table[v] if v < 0x10000 else symbol(int(v)) for v in values], dtype=np.int32)[where]

    def grams(self, text: str) -> Iterator[np.ndarray]:
        """The keys of a text's grams, part by part: one for each letter and each boundary after letters. None without letters."""
        tail = np.zeros(ORDER - 1, dtype=np.int32)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for at in range(0, len(points) + 1, PART):
            s = self.of(points[at : at + PART])
            if at + PART > len(points):
                s = np.append(s, np.int32(0))
            # Of a run of boundaries the first stays; none stands before the first letter, where the tail begins.
            before = np.concatenate([tail[-1:], s[:-1]])
            s = s[(s != 0) | (before != 0)]
            if len(s):
                whole = np.concatenate([tail, s])
                keys = whole[ORDER - 1 :].copy()
                for k in range(1, ORDER):
                    keys |= whole[ORDER - 1 - k : len(whole) - k] << (BITS * k)
                tail = whole[len(whole) - ORDER + 1 :]
                yield keys


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task, in bounded memory: what it holds is handed on when it grows large."""
    read = Symbols()
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in pieces(batches):
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for keys in read.grams(text.as_py() or ""):
                texts.setdefault(lang, []).append(keys)
        for lang, keys in texts.items():
            values, n = np.unique(np.concatenate(keys), return_counts=True)
            held.setdefault(lang, []).append((values, n))
            size += len(values)
        if size > HELD:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > HELD // 2:
                yield from handed()
                held, size = {}, 0
    yield from handed()


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Order by order, from one symbol up: sorted keys with log probabilities, and sorted contexts with the logs of what they leave to the order below; a column for each language.

    ``grams`` are sorted keys of the highest order, ``counts`` [gram, language].
    Every order takes one discount, n1 / (n1 + 2 n2) of its own counts, or 1/2
    where no count is 1.
    """
    orders = [(grams.astype(np.int64), counts.astype(np.float64))]
    while len(orders) < ORDER:
        above, n = orders[-1]
        digits = BITS * (ORDER - len(orders))
        keys, where = np.unique(above & ((1 << digits) - 1), return_inverse=True)
        continued = np.zeros((len(keys), n.shape[1]))
        np.add.at(continued, where, (n > 0).astype(np.float64))
        orders.append((keys, continued))
    model: list[dict[str, np.ndarray]] = []
    for order, (keys, n) in enumerate(reversed(orders), 1):
        ones, twos = (n == 1).sum(axis=0), (n == 2).sum(axis=0)
        discount = np.where(ones > 0, ones / np.maximum(1, ones + 2 * twos), 0.5)
        contexts, starts = np.unique(keys >> BITS, return_index=True)
        total, types = np.add.reduceat(n, starts, axis=0), np.add.reduceat((n > 0).astype(np.float64), starts, axis=0)
        left = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        of = np.searchsorted(contexts, keys >> BITS)
        lower = np.exp(log_probability(model, keys & ((1 << BITS * (order - 1)) - 1), order - 1)) if order > 1 else np.full(n.shape, 1 / (1 << BITS))
        p = np.where(total[of] > 0, np.maximum(n - discount, 0) / np.maximum(total[of], 1), 0) + left[of] * lower
        model.append({"keys": keys.astype(np.int32), "logs": np.log(p), "contexts": contexts.astype(np.int32), "left": np.log(left)})
    return model


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def log_probability(model: list[dict[str, np.ndarray]], keys: np.ndarray, order: int) -> np.ndarray:
    """[key, language]: by the longest gram that any language knows, with what its contexts leave to it."""
    out = np.zeros((len(keys), model[0]["logs"].shape[1]), dtype=model[0]["logs"].dtype)
    rest, keys = np.arange(len(keys)), keys.astype(np.int32)
    for k in range(order, 0, -1):
        table = model[k - 1]
        keys = keys & np.int32((1 << BITS * k) - 1)
        at, known = found_in(table["keys"], keys)
        out[rest[known]] += table["logs"][at[known]]
        rest, keys = rest[~known], keys[~known]
        if not len(rest):
            return out
        at, known = found_in(table["contexts"], keys >> BITS)
        out[rest[known]] += table["left"][at[known]]
    out[rest] += -BITS * np.log(2)  # a symbol that no language knows
    return out


def judged(held):
    """Of each text: symbols, and bits a symbol under every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, read = held.value, Symbols()
        for batch in pieces(batches):
            sizes, bits = [], []
            for text in batch.column(2):
                n, logs = 0, 0.0
                for keys in read.grams(text.as_py() or ""):
                    n += len(keys)
                    logs = logs + log_probability(model, keys, ORDER).sum(axis=0, dtype=np.float64)
                sizes.append(n)
                bits.append((-logs / n / np.log(2)).tolist() if n else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.float64()))], names=["doc_id", "lang", "symbols", "bits"])

    return run


SCORED = "doc_id long, lang string, symbols long, bits array<double>"


class Model:
    """Languages by name, their grams on every executor, and what calibration has told."""

    def __init__(self, languages: list[str], held):
        self.languages, self.held = languages, held
        self.temperature, self.mean, self.unit, self.limit = 1.0, {}, {}, {}

    def least(self) -> Column:
        return F.array_min("bits")

    def best(self) -> Column:
        """Place of the language with the fewest bits, from 0."""
        return F.array_position("bits", self.least()).cast("int") - 1

    def guess(self) -> Column:
        return F.get(F.array(*[F.lit(name) for name in self.languages]), self.best())

    def share(self, temperature: float) -> Column:
        """The part of the best among all languages, from the bits each needs for the whole text."""
        return 1 / F.aggregate("bits", F.lit(0.0), lambda total, b: total + F.pow(F.lit(2.0), -F.least(F.lit(1000.0), (b - self.least()) * F.col("symbols") / temperature)))

    def _of(self, values: dict[str, float], rest: float) -> Column:
        return F.get(F.array(*[F.lit(float(values.get(name, rest))) for name in self.languages]), self.best())

    def deviation(self) -> Column:
        """Bits a symbol over the language's mean, in deviations of texts as long: their spread falls with the root of the length, down to a floor."""
        return (self.least() - self._of(self.mean, float("inf"))) / (self._of(self.unit, 1.0) * F.sqrt(1 / F.col("symbols") + F.lit(1e-4)))

    def rejects(self) -> Column:
        return self.deviation() > self._of(self.limit, float("inf"))

    def calibrate(self, known: DataFrame, kept: float) -> None:
        """Temperature of the shares by their likelihood; means, units and limits of each language. A row for each language reaches the driver."""
        right = self.guess() == F.col("lang")
        losses = [F.avg(-F.log(F.greatest(F.lit(1e-12), F.when(right, self.share(t)).otherwise(1 - self.share(t))))).alias(str(t)) for t in TEMPERATURES]
        told = known.agg(*losses).first().asDict()
        self.temperature = min(((loss, t) for t in TEMPERATURES if (loss := told[str(t)]) is not None), default=(0, 1.0))[1]
        fitting = known.where(right).withColumn("guess", self.guess())
        for r in fitting.groupBy("guess").agg(F.avg(self.least()).alias("mean"), F.var_pop(self.least()).alias("spread"), F.avg(1 / F.col("symbols")).alias("inverse")).collect():
            self.mean[r["guess"]], self.unit[r["guess"]] = r["mean"], max(1e-6, r["spread"] / r["inverse"]) ** 0.5
        self.limit = {r["guess"]: max(LEAST_LIMIT, r["limit"]) for r in fitting.groupBy("guess").agg(F.percentile(self.deviation(), kept).alias("limit")).collect()}


def learn(rows: DataFrame, kept: float = 0.999) -> Model | None:
    """The models of all languages in (doc_id, lang, text), none of them null; None without rows.

    All rows but one in ``CALIBRATION``, drawn by a hash of the id, are counted
    by Spark; at most 2^24 grams, with a count for each language, reach the driver.
    """
    spark = rows.sparkSession
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION)) == 0
    with Scratch(spark, "language") as scratch:
        counts = rows.where(~calibrates).select("lang", "text").mapInArrow(count_grams, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts = scratch.save(counts, "grams")
        languages = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
        if not languages:
            return None
        by_language = [F.coalesce(F.max(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, name in enumerate(languages)]
        found = counts.groupBy("gram").agg(*by_language).orderBy("gram").toArrow()
        tables = kneser_ney(found.column("gram").to_numpy(), np.stack([found.column(f"n{k}").to_numpy() for k in range(len(languages))], axis=1))
        held = spark.sparkContext.broadcast([{k: v if v.dtype == np.int32 else v.astype(np.float32) for k, v in table.items()} for table in tables])
        model = Model(languages, held)
        model.calibrate(scratch.save(rows.where(calibrates).select("doc_id", "lang", "text").mapInArrow(judged(held), SCORED).where("symbols > 0"), "calibration"), kept)
    return model


def predict(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, kept: float = 0.999) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected.

    ``lang_pred`` is the language whose model gives the text the fewest bits a
    symbol, the first by name of equals; ``und`` for texts that are null, empty
    or without letters, and for all where nothing could be learned. ``score``
    is its share among all languages, by bits of the whole text over a
    temperature; 0 with ``und``. ``rejected`` marks ``und`` and texts that fit
    no language: more bits a symbol, for their length, than all but a share
    ``kept`` of the calibrating documents of the best one.

    Learned from are text and non-null lang of the documents outside the
    held-out fold. Null ids are not held out. Very long texts are read whole,
    in parts. Repeated rows are counted and predicted each. Columns other than
    doc_id, text and lang are not read; an empty table gives none.
    """
    rows = docs.select(pick(docs, "doc_id", "long"), pick(docs, "lang", "string"), pick(docs, "text", "string"))
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), folds) == held_out_fold, F.lit(False))
    model = learn(rows.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), kept)
    if model is None:
        return rows.select("doc_id", held_out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    some = F.col("symbols") > 0
    told = rows.select("doc_id", F.lit(None).cast("string").alias("lang"), "text").mapInArrow(judged(model.held), SCORED)
    return told.select(
        "doc_id",
        held_out.alias("held_out"),
        F.when(some, model.guess()).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(some, model.share(model.temperature)).otherwise(F.lit(0.0)).alias("score"),
        model.least().alias("bits"),
        (~some | F.coalesce(model.rejects(), F.lit(False))).alias("rejected"),
    )
