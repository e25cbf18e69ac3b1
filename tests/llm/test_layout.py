"""Sharding, packing, top-k and page text."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, MID, SMALL, docs_of, odd_documents, tables
from tideline.llm import bitsliced, hilbert, html_text, packing


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 4)])
def test_the_curve_visits_every_cell_and_steps_to_neighbours(dims, bits):
    cells = np.indices([1 << bits] * dims).reshape(dims, -1)
    index = hilbert.hilbert_index(cells, bits)
    path = cells[:, np.argsort(index)]
    assert sorted(index.tolist()) == list(range(1 << (bits * dims)))
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def check_shards(rows, n, docs):
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    sizes = [len(by[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(16))
    for k, rs in by.items():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    places = [r["hilbert"] for k in range(16) for r in sorted(by[k], key=lambda r: r["slot"])]
    assert places == sorted(places)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        if r["doc_id"] in docs:
            data = (docs[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def test_shards(spark):
    docs = DOCS(spark, SMALL)
    check_shards(hilbert.shard(docs).collect(), docs.count(), {r["doc_id"]: r["text"] for r in docs.collect()})
    odd = odd_documents(spark)
    check_shards(hilbert.shard(odd).collect(), odd.count(), {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]})
    assert hilbert.shard(docs.limit(0)).count() == 0


def test_shards_prune_every_dimension(spark):
    rows = hilbert.shard(DOCS(spark, MID)).collect()
    for c, most in (("lang_cell", 0.75), ("source_cell", 0.75), ("size_cell", 0.75)):
        values = {r[c] for r in rows}
        shares = [len({r["shard"] for r in rows if r[c] == v}) / 16 for v in values]
        assert sum(shares) / len(shares) < most, c


def test_planned_sequences_hold_everything():
    r = random.Random(5)
    for capacity in (16, 100):
        histogram = defaultdict(int)
        for _ in range(3000):
            histogram[min(capacity, max(1, int(r.expovariate(4 / capacity))))] += 1
        rows = packing.plan(dict(histogram), capacity)
        room, ranks = defaultdict(list), defaultdict(list)
        for length, first, end, sequence, offset in rows:
            for k in range(first, end):
                ranks[length].append(k)
                room[sequence + k - first].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
        for items in room.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        need = -(-sum(k * n for k, n in histogram.items()) // capacity)
        assert len(room) <= need * 1.02 + 1
    assert packing.plan({}, 8) == []


def test_both_readers_of_the_vocabulary_agree():
    whole, _, added = packing.tokenizers()
    tokens = [t.content for t in whole.get_added_tokens_decoder().values()]
    assert tokens and all(added.search(f"x{t}y") for t in tokens)
    texts = ["It's  what\nwe've   done; 12345 ÄÖ ßuœ, _x_ ", "a" * 500, " ", "\n\n x", "d'accord l'été", "hello <|endoftext|> world", *tokens]
    r, signs = random.Random(11), ["a", "Bc", "'s", "'re", " ", "  ", "\n", "12", "7", "é", "ß", "œ", ".", ",", "_", "<|", "|>", "endoftext", "€", "中", "\t", "\u00a0", *tokens]
    texts += ["".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(4000)]
    for text in texts:
        assert packing.token_ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, docs):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    whole, _, _ = packing.tokenizers()
    for doc_id, text in docs.items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and (len(ids) > 1024 or len(pieces) == 1)
        at = 0
        for r in pieces:
            assert r["start"] == at and (r["length"] == 1024 or r["piece"] == 0) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(by_sequence)


def whole_ids(text):
    return packing.tokenizers()[0].encode(text, add_special_tokens=False).ids


def test_packing(spark):
    docs = DOCS(spark, SMALL)
    rows = packing.pack(docs).collect()
    n = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert n <= -(-sum(r["length"] for r in rows) // 1024) * 1.02 + 1
    assert packing.pack(docs.limit(0)).count() == 0
    odd = odd_documents(spark).where("doc_id <> 3")
    check_packing(packing.pack(odd).collect(), {r["doc_id"]: r["text"] for r in odd.collect()})
    special = docs_of(spark, [(1, "hello <|endoftext|> world")])
    assert packing.pack(special).first()["length"] == len(whole_ids("hello <|endoftext|> world")) + 1
    twice = docs_of(spark, [(3, "word"), (3, "word"), (None, None)])
    assert len({(r["sequence_id"], r["offset"]) for r in packing.pack(twice).collect()}) == 3


def brute_top(rows, every, k):
    q = [(i, np.floor(256 * np.array(v, dtype=float)).astype(int)) for i, v in rows]
    out = []
    for a, (i, x) in enumerate(q):
        if i % every == 0:
            scored = sorted((-int(x @ y), j) for b, (j, y) in enumerate(q) if a != b)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_top_k_with_ties_and_few_candidates(spark):
    r = np.random.default_rng(2)
    rows = [(k, [float(x) for x in np.round(r.normal(size=5), 1)]) for k in range(130)]
    rows += [(200 + k, rows[7][1]) for k in range(20)] + [(300, [0.0] * 5), (350, [-3.0, 2.5, 0.0, 1e3, -1e3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(x) for x in bitsliced.top_k(df, rows_a_block=64, queries_a_block=2).collect())
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_top(exact, 50, 5)
    few = df.where("vec_id in (0, 1, 2)")
    assert [x[2] for x in sorted(tuple(x) for x in bitsliced.top_k(few).collect())] == [x[2] for x in brute_top(exact[:3], 50, 5)]


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(x) for x in bitsliced.top_k(df).orderBy("rank").collect()] == [(0, 1, 5, 3 * 256 * 256), (0, 2, 7, 128 * 256), (0, 3, 6, 0)]
    assert bitsliced.top_k(df.limit(0)).count() == 0
    assert bitsliced.top_k(df.where("vec_id = 0")).count() == 0
    again = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(x["vec_id"] for x in bitsliced.top_k(again).collect()) == [50, 50, 51, 51]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>%s
<aside>Aside text that is long enough to look like content, surely.</aside><div id="comments"><p>Nice post!</div><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    "html, text",
    [
        (PAGE % "<article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text<br>on.<p>Short.<form>Mail: <input></form><ul><li>x<li>y</ul></article>", "A & B\nFirst bold text on.\nShort.\nx\ny"),
        (PAGE % "<div class=post><h2>Title</h2><p>A long first paragraph with many words in it, as pages have.</p><p>And a second one, which is also long enough.</p></div>", "Title\nA long first paragraph with many words in it, as pages have.\nAnd a second one, which is also long enough."),
        ("", ""),
        ("<p>unclosed &#228; &eacute <i>it", "unclosed ä é it"),
        ("just text &lt;b&gt;", "just text <b>"),
        ("<script>only()</script><nav>menu</nav>", ""),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


SENTENCE = "This is sentence %d of a text that is long enough to count as content of the page."


def test_content_beside_the_largest_region_stays():
    p = [SENTENCE % k for k in range(10)]
    inner = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in p[:3]) + "<div>" + "".join(f"<p>{x}</p>" for x in p[3:]) + "</div>"
    assert html_text.main_text(PAGE % f'<div id="content">{inner}</div>') == "\n".join(["Title", *p])
    for tag in ("section", "article"):
        both = "".join(f"<{tag}>" + "".join(f"<p>{x}</p>" for x in part) + f"</{tag}>" for part in (p[:7], p[7:]))
        assert html_text.main_text(PAGE % both) == "\n".join(p)
    teaser = "<div>" + "".join(f"<p>{x}</p>" for x in p[:9]) + f"</div><article><p>{p[9]}</p></article>"
    assert html_text.main_text(PAGE % teaser) == "\n".join(p)


def test_a_class_word_never_takes_the_article():
    p = [SENTENCE % k for k in range(4)]
    body = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in p)
    for open_, close in (("<div class='search'>", "</div>"), ("<form id=aspnetForm>", "</form>"), ("<div class=widget><div id=comments-area>", "</div></div>")):
        assert html_text.main_text(PAGE % f"{open_}<article>{body}</article>{close}") == "\n".join(["Title", *p])
        assert html_text.main_text(PAGE % f"{open_}{body}{close}") == "\n".join(["Title", *p])
    inside = f"<article>{body}<p class='related'>Related results show the same, as {p[0]}</p><p class='share'>Share</p></article>"
    assert html_text.main_text(PAGE % inside) == "\n".join(["Title", *p, f"Related results show the same, as {p[0]}"])


def test_suspects_beside_the_article_go():
    p = [SENTENCE % k for k in range(4)]
    ad = "<div class='ad'>" + "".join(f"<p>{x} Buy now.</p>" for x in p * 9) + "</div>"
    comments = "<div id='comments'>" + "".join(f"<article class='comment'><p>{x} I agree.</p></article>" for x in p * 9) + "</div>"
    assert html_text.main_text(PAGE % f"{ad}<article><p>Short.</p></article>{comments}") == "Short."
    assert html_text.main_text(PAGE % f"<article><p>{p[0]}</p><p class='ad'>{p[1]}</p><form><p>{p[2]}</p></form></article>") == p[0]


def test_stray_tags_and_depth_take_linear_time():
    import time

    began = time.time()
    for html in ("<div>" * 50_000 + "</i>" * 50_000 + "text", "<div>" * 50_000 + "</section>" * 50_000 + "text", "<b>" * 50_000 + "<hr>" * 50_000 + "text", "<i><p>" * 30_000 + "</i>" * 50_000 + "text", "<div class=search>" * 50_000 + "text"):
        assert html_text.main_text(html) in ("text", "")
    for unit in ("<a ", "<a b='", '<a b="', "<a b=' c=\"", "<a b=", "<a =", "<!--", "<!-- -", "<![", "<!x", "<?", "</a ", "</", "<", "&", "&#", "&amp", "<a/", "<script>", "</script ", "<p class='", "<![CDATA["):
        html_text.main_text("<p>text</p>" + unit * 200_000)
        html_text.main_text(unit * 200_000 + ">")
    assert time.time() - began < 60


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a</p><![ x ]><p>b", "a\nb"),
        ("<p>a</p><![%x[ y>b", "a\nb"),
        ("<p>a<!-->b<!--->c<!-- > -->d<!--e--!>f", "abcdf"),
        ("<p>a</p><!-- never closed <p>b</p>", "a"),
        ("<p>a</p><p title='it>b</p>", "a\nb"),
        ("<p>a</p><p title='x>y'>b</p>", "a\nb"),
        ("<p>a</p><a href=x", "a"),
        ("a < b &lt; c <3 d", "a < b < c <3 d"),
        ("<p>a<script/>x < y</script><p>b", "a\nb"),
        ("<p>Take the <span class='alert'>red</span> pill and the <a class='related'>blue one</a>.", "Take the red pill and the blue one."),
        ("<article><p>One.</p><table><tr><td class='header'>Cell</td><td class=ad>2</td></tr></table></article>", "One.\nCell\n2"),
    ],
)
def test_odd_markup_loses_nothing(html, text):
    assert html_text.main_text(html) == text


def test_an_article_inside_which_a_form_holds_the_text():
    p = [SENTENCE % k for k in range(8)]
    body = "".join(f"<p>{x}</p>" for x in p)
    for open_, close in (("<form>", "</form>"), ("<div class='notice'>", "</div>"), ("<div class='widget'><form>", "</form></div>")):
        assert html_text.main_text(PAGE % f"<article><h1>Title</h1>{open_}{body}{close}</article>") == "\n".join(["Title", *p])
    assert html_text.main_text(PAGE % f"<article><h1>Title</h1>{body}<div class='notice'><p>{p[0]}</p></div></article>") == "\n".join(["Title", *p])


def test_broken_pages_never_fail():
    r = random.Random(12)
    parts = ["<p>", "</p>", "<div class='ad'>", "<div", "</div", "<a href='", '"', "'", ">", "<", "<!", "<!--", "-->", "--", "<![", "]]>", "<!DOCTYPE ", "[", "%", "<?", "?>", "&", "&#", "&#x", "&#xD800;", "&#1114112;", ";", "&amp", "<script>", "</script>", "<style", "<article>", "</article>", "<form>", "<h1>", "<table><td>", "text ", "é😀 ", "\n", "\x00", "=", "/", "</", "<br/", "<svg/>", "role=menu ", "hidden "]
    page = PAGE % "<article><h1>A</h1><p>text</p></article>"
    for k in range(10_000):
        html = "".join(r.choices(parts, k=r.randint(1, 25)))
        if k % 3 == 0:
            at = r.randint(0, len(page))
            html = page[:at] + html + page[at + r.randint(0, 20) :]
        text = html_text.main_text(html)
        assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and "\n\n" not in text


def soup(r, lines):
    """A page without class words or sections: bars of links around paragraphs, some of them short; and its text."""
    link = lambda: f"<a href=/{r.random()}><b>{r.choice(['Home', 'News', 'All posts', 'About us', 'Archive 2020'])}</b></a>"
    bar = lambda: "<div>" + "".join(f"<div>{link()} | {link()}</div>" for _ in range(r.randint(3, 8))) + "</div>"
    text = [SENTENCE % r.randint(0, 99) if r.random() < 0.8 else r.choice(["Short.", "So it goes."]) for _ in range(lines)]
    text[0], text[-1] = SENTENCE % 0, SENTENCE % 1
    return f"<body>{bar()}{bar()}<div>{''.join(f'<p>{x}</p>' for x in text)}</div>{bar()}</body>", "\n".join(text)


def test_ratios_smoothing_and_threshold_find_the_content(monkeypatch):
    """Of pages whose elements say nothing, the lines' ratios tell content from bars of links: with ratios that are all one, the bars come too."""
    r = random.Random(3)
    pages = [soup(r, r.randint(5, 30)) for _ in range(200)]
    right = lambda: sum(html_text.main_text(html) == text for html, text in pages)
    assert right() >= 170
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: np.ones_like(ratios))
    assert right() == 0


def test_pages(spark):
    (pages,) = tables(spark, SMALL, "pages")
    rows = html_text.extract(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    long = "<p>" + "word " * 200_000
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>a"), (2, "u", long), (2, "u", long)], "page_id long, url string, html string")
    for c in ("text", "n_chars", "lines"):
        odd = odd.withColumn(c, F.lit("x"))
    assert sorted(len(r["text"]) for r in html_text.extract(odd).collect()) == [0, 0, 1, 999_999, 999_999] and html_text.extract(odd.limit(0)).count() == 0
