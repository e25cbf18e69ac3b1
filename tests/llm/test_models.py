"""Toxicity, quality and personal data: held-out accuracy, brute force, and odd inputs."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, MID, SMALL, docs_of, odd_documents, tables
from tideline.llm import pii, quality, toxicity


def test_noisy_or_finds_the_word_and_the_sentence():
    clean = ["The sky is blue. Birds fly over the hill number %d." % k for k in range(40)]
    bad = ["The sky is blue. You are a rotten apple number %d! Birds fly." % k for k in range(20)]
    weights, leak = toxicity.fit([(t, 0) for t in clean] + [(t, 1) for t in bad], min_sentences=5)
    assert {"rotten", "apple"} & set(weights) and not {"sky", "birds", "the"} & set(weights)
    p, found = toxicity.document_score(bad[0], weights, frozenset(weights), leak, 0.5)
    assert p > 0.9 and [bad[0][s["start"] : s["end"]].strip() for s in found] == ["You are a rotten apple number 0"]
    assert toxicity.document_score(clean[0], weights, frozenset(weights), leak, 0.5)[0] < 0.2
    assert toxicity.fit([]) == ({}, pytest.approx(1e-4, rel=0.1)) and toxicity.fit([("a", 1)])[0] == {}


def test_a_toxic_word_rarer_than_twenty_thousand_others_has_a_weight():
    clean = [". ".join(" ".join(f"w{k}" for k in range(at, at + 100)) + f" only{at}x{turn}" for turn in range(12)) for at in range(0, 20_100, 100)]
    bad = [f"You are a rotten one number{k}." for k in range(10)]
    weights, _ = toxicity.fit([(t, 0) for t in clean] + [(t, 1) for t in bad])
    assert "rotten" in weights and "w5" not in weights


@pytest.mark.parametrize("op, label, fold, rest, cut, least", [(toxicity, "toxic", 5, 0, 0.5, 0.95), (quality, "quality", 4, 2, 0.7, 0.96)])
def test_held_out_accuracy(spark, op, label, fold, rest, cut, least):
    docs, labels = tables(spark, MID, "documents", "labels")
    out = op.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % fold == rest and r["predicted"] == (r["score"] >= cut) for r in out)
    assert len(out) > 500 and sum(r["predicted"] == r[label] for r in out) / len(out) > least


@pytest.mark.parametrize("op", [toxicity, quality])
def test_scores_of_odd_documents(spark, op):
    docs, labels = tables(spark, SMALL, "documents", "labels")
    odd = odd_documents(spark)
    out = op.score(odd, labels.drop("extra")).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert op.score(docs.limit(0), labels).count() == 0
    assert len({r["held_out"] for r in out if r["doc_id"] is None} - {False}) == 0


def test_labels_of_held_out_rows_are_not_learned_from(spark):
    docs, labels = tables(spark, SMALL, "documents", "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_rejecting_toxic_documents_keeps_columns(spark):
    docs, labels = tables(spark, SMALL, "documents", "labels")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


HARD = [
    "a@b.c_d@e.f, x@y@z.example.com. q@w. @x.y a.b@c-d.e.f.",
    "1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.0255 1.2.3.256 9.9.9",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-1 12 34 5500005555555559",
    "+1 (017) 555-7713 call +49.30.1234567890 +12 + 3 +1((((((2 +1 234 567 890 123 456",
    "😀 mail me: ü.x@ä.de or a@b.de 😀 10.0.0.1 😀",
    "\ufdd0 a@b.de \ufdd1\ufdd0 +49 30 1234567 \ufdd0c@d.com\ufdd0",
    "5" * 4000 + " " + "a" * 6000 + "@" + "b." * 3000 + "c",
    "",
]


def test_base_spans_against_brute_force(spark):
    documents = DOCS(spark, SMALL).select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in documents] + [(10_000 + k, t) for k, t in enumerate(HARD)]
    out = {r["doc_id"]: r for r in pii.digest(docs_of(spark, rows)).collect()}
    for doc_id, text in rows:
        want = base_spans(text)
        joined = ",".join("%s:%d:%d" % s for s in want)
        assert out[doc_id]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (doc_id, joined, out[doc_id]["spans"])
        assert set(filter(None, joined.split(","))) <= set(out[doc_id]["spans"].split(","))
        assert [out[doc_id][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]


def test_the_method_adds_secrets_and_redaction_takes_all(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(k, f'Zeile {k}. token = "{key}" mail a{k}@b.de, geht.') for k in range(30)] + [(100, "nothing here"), (101, None)]
    docs = docs_of(spark, rows, extra=True)
    out = {r["doc_id"]: r["spans"] for r in pii.digest(docs).collect()}
    assert "secret" in out[3] and "email" in out[3] and out[100] == out[101] == ""
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert clean[3]["text"] == 'Zeile 3. token = "<SECRET>" mail <EMAIL>, geht.' and clean[3]["n_chars"] == len(clean[3]["text"])
    assert clean[100]["text"] == "nothing here" and clean[101]["text"] is None and pii.redact(docs).columns == docs.columns


def test_many_spans_in_one_text_take_linear_time(spark):
    import time

    n = 20_000
    text = " ".join(f"mail a{k}@b{k}.de, von Anna Meyer{'x' * (k % 3)}." for k in range(n))
    docs = docs_of(spark, [(1, text), (2, "nothing")])
    began = time.time()
    row = pii.digest(docs).where("doc_id = 1").first()
    assert row["n_email"] == n
    clean = pii.redact(docs).where("doc_id = 1").first()["text"]
    assert clean.count("<EMAIL>") == n and "@" not in clean and time.time() - began < 120


def test_no_cap_hides_a_span(spark):
    key, local = "Q" * 41 + "9f8e7d6c5b4a39281706", "b" * 90
    dots = "".join(f" [dot] part{k}" for k in range(12))
    rows = [(k, f'token = "{key}" and {local} [at] host{dots} or Dr. Anna {"A" + "b" * 45} here.') for k in range(30)]
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(docs_of(spark, rows)).collect()}[3]
    text = rows[3][1]
    found = {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in spans.split(","))}
    assert key in found and f"{local} [at] host{dots}" in found and "Dr. Anna A" + "b" * 45 in found


def test_redaction_whatever_the_columns_are_called(spark):
    docs = docs_of(spark, [(1, "write to a@b.de now"), (2, None), (3, "")])
    for c in ("pii_text", "pii_candidates", "pii_all", "pii_raw_email", "pii_changed", "pii_base_spans", "row", "spans", "parts", "pieces", "clean", "order", "all", "base", "start"):
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    out = pii.redact(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and rows[1]["text"] == "write to <EMAIL> now" and rows[2]["text"] is None and rows[3]["text"] == ""
    assert all(r[c] == f"mine {c}" for r in rows.values() for c in docs.columns[5:])


def test_pieces_put_long_texts_together(spark):
    import random

    r = random.Random(3)
    text = "".join(r.choice("aé😀\n ") for _ in range(5000))
    cuts = [(0, 0), (0, 1), (1023, 1025), (1024, 2048), (1024, 1024), (5, 4999), (4096, 5000), (0, 5000), (5000, 5000)] + [tuple(sorted((r.randint(0, 5000), r.randint(0, 5000)))) for _ in range(40)]
    rows = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a int, b int").withColumn("pieces", F.regexp_extract_all("text", F.lit(r"(?s).{1,1024}"), F.lit(0)))
    assert [x["p"] for x in rows.select(pii.piece(F.col("a"), F.col("b")).alias("p")).collect()] == [text[a:b] for a, b in cuts]


def test_scans_are_running_sums_and_maxima(spark):
    import random
    from itertools import accumulate

    r = random.Random(4)
    lists = [[r.randint(0, 99) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1500)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    got = pii.scanned(pii.scanned(df, "x", "sums", lambda a, b: a + b), "x", "tops", lambda a, b: F.greatest(a, b)).collect()
    for g in got:
        assert g["sums"] == list(accumulate(g["x"], initial=0))[:-1] and g["tops"] == list(accumulate(g["x"], max, initial=0))[:-1]


def test_personal_data_of_odd_documents(spark):
    odd = odd_documents(spark)
    assert pii.digest(odd).count() == odd.count() and pii.digest(odd.limit(0)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["base_sha256"] for r in pii.digest(odd).where("doc_id = 1").collect()} == {empty}


def test_reliabilities_follow_the_better_labeler():
    counts = {("card", (1, 1, 0, 0)): 50.0, ("card", (1, -1, 0, 0)): 30.0, ("card", (1, 1, 1, 0)): 10.0, ("card", (1, -1, 0, -1)): 10.0}
    p = pii.reliabilities(counts)
    assert p["card", (1, 1, 1, 0)] > 0.9 > 0.5 > p["card", (1, -1, 0, -1)] and pii.reliabilities({}) == {}
