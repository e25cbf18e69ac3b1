"""Main text of web pages from streaming parser events.

The parser's events are folded into lines, one for each block. Each line has a
text-to-tag ratio; the ratios are smoothed by a Gaussian and cut at a threshold,
and the lines above it vote for the elements that hold them. The region is the
smallest element that keeps all of the votes. What is boilerplate by its own
element (menus, scripts and the like) never makes a line. Class words and forms
only make an element suspect: it goes while what lies outside it holds the
page's content, and stays where it holds that content itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, pieces

# Element names and class words of the HTML standard and common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style head title nav footer aside noscript template iframe object svg math canvas button select textarea input dialog menu audio video map datalist".split())
REGIONS = frozenset("html body main article section div table tbody tr td center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMED = re.compile(
    r"(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo|banner|sidebar|comments?|commentlist|respond|disqus|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notice|notification|alert|newsletter|subscribe|signup|popup|modal|overlay|related|recommended|share|sharing|social|widget|toolbar|pagination|pager|login|search|skip|header)"
    r"(?:[-_](?:bar|box|area|block|list|section|wrap|wrapper|container|content|item|links?|form|banner|notice|menu|nav|unit|slot|text|inner|\d+))*",
    re.I,
)
#: Of these, words that a paragraph of the article can have too: there they only halve its ratio.
WEAK = re.compile(r"(?:related|recommended|share|sharing|social|search|skip|header|respond|widget|promo)(?:[-_].*)?", re.I)
TEXTUAL = frozenset("p h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th".split())
PREFIXED = re.compile(r".+[-_](?:ads?|advert|sidebar|comments?|menu|nav|footer|cookie|banner)", re.I)


#: Parts of tables: a class word on these says what a cell is for, not that it is boilerplate.
CELLS = frozenset("table tbody thead tfoot tr td th caption".split())

COMMENT_END = re.compile(r"--!?>|(?<=<!-)->|(?<=<!--)>")
TAG_NAME = re.compile(r"[^\s/>]*")
BETWEEN = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")


DROP, SUSPECT, HALVE, KEEP = range(4)


class Lines(HTMLParser):
    """Blocks of text with the tags inside them, and the region and suspect elements around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int, bool]] = []  # name, whether it is dropped, its region, its suspect, whether its ratio is halved
        self.open: Counter = Counter()  # open block elements by name
        self.levels: list[tuple[int, Counter]] = [(-1, Counter())]  # the innermost open block's place, and the inline elements open in it
        self.dropping = 0
        self.parents, self.names = [-1], ["root"]
        self.suspects: list[int] = []  # the suspect around each suspect
        self.suspect_in: list[int] = []  # the region around each suspect
        self.headed: set[int] = set()  # suspects with a top heading
        self.texts: list[str] = []
        self.tags, self.where, self.suspect, self.halved = [], [], [], []
        self.text: list[str] = []
        self.inside = 0

    # Markup that is never closed takes the rest of the page with it, as in browsers; so each character is looked at a bounded number of times.

    def feed(self, html: str) -> None:
        self.last = {sign: html.rfind(sign) for sign in (">", '"', "'")}
        super().feed(html)

    def parse_starttag(self, i: int) -> int:
        html, attrs = self.rawdata, []
        name = TAG_NAME.match(html, i + 1)
        at = BETWEEN.match(html, name.end()).end()
        while at < len(html) and html[at] != ">":
            found = ATTRIBUTE.match(html, at)
            at, value = found.end(), None
            if equals := EQUALS.match(html, at):
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote and self.last[quote] > at:
                    close = html.index(quote, at + 1)
                    value, at = html[at + 1 : close], close + 1
                else:  # a quote that nothing closes is a sign like any other
                    value = UNQUOTED.match(html, at)[0]
                    at += len(value)
            attrs.append((found[0].lower(), unescape(value) if value else value))
            at = BETWEEN.match(html, at).end()
        if at >= len(html):
            return at
        self.lasttag = tag = name[0].lower()
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return at + 1

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.last[">"] > i else len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return 1 + (self.rawdata.find(">", i) if self.last[">"] > i else len(self.rawdata) - 1)

    parse_pi = parse_html_declaration

    def flush(self) -> None:
        if self.text:
            if line := " ".join("".join(self.text).split()):
                top = self.stack[self.levels[-1][0]] if self.levels[-1][0] >= 0 else ("", False, 0, -1, False)
                self.texts.append(line)
                self.tags.append(self.inside)
                self.where.append(top[2])
                self.suspect.append(top[3])
                self.halved.append(top[4])
            self.text = []
        self.inside = 0

    def judge(self, tag: str, attrs: list) -> int:
        if tag in DROPPED:
            return DROP
        if tag == "header":
            return KEEP if self.open["article"] or self.open["main"] else DROP
        if tag == "form":
            return SUSPECT
        if not attrs or tag in ("html", "body", "main", "article", "h1"):
            return KEEP
        a = dict(attrs)
        if "hidden" in a or (a.get("role") or "").lower() in ROLES or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style") or ""):
            return DROP
        words = [w for k in ("class", "id") for w in (a.get(k) or "").split() if NAMED.fullmatch(w) or PREFIXED.fullmatch(w)]
        if not words or tag in INLINE or tag in CELLS:
            return KEEP
        return HALVE if tag in TEXTUAL and all(WEAK.fullmatch(w) for w in words) else SUSPECT

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            if not self.dropping:
                self.flush()
            at = self.levels[-1][0]
            if at >= 0 and ((name := self.stack[at][0]) == "p" or (tag == name and tag in ("li", "dt", "dd", "option", "tr", "td"))):
                self.leave(at)  # a block ends an open paragraph, an item the item before it
        self.inside += 1
        if tag in VOID:
            if tag in ("br", "hr", "img") and not self.dropping:
                self.text.append(" ")
            return
        what = self.judge(tag, attrs)
        _, _, region, suspect, halved = self.stack[-1] if self.stack else ("", False, 0, -1, False)
        if tag in REGIONS and not self.dropping and what != DROP:
            self.parents.append(region)
            self.names.append(tag)
            region = len(self.parents) - 1
        if what == SUSPECT and not self.dropping:
            self.suspects.append(suspect)
            self.suspect_in.append(region)
            suspect = len(self.suspects) - 1
        if tag == "h1":
            self.headed.add(suspect)
        self.dropping += what == DROP
        if tag in INLINE:
            self.levels[-1][1][tag] += 1
        else:
            self.open[tag] += 1
            self.levels.append((len(self.stack), Counter()))
        self.stack.append((tag, what == DROP, region, suspect, halved or what == HALVE))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing

    def leave(self, at: int) -> None:
        while len(self.stack) > at:
            tag, dropped, *_ = self.stack.pop()
            self.dropping -= dropped
            if tag in INLINE:
                self.levels[-1][1][tag] -= 1
            else:
                self.open[tag] -= 1
                self.levels.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE and not self.dropping:
            self.flush()
        self.inside += 1
        # An element is sought only where one of its name is open, so all that is passed over is left.
        if (self.levels[-1][1] if tag in INLINE else self.open)[tag]:
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self.leave(at)

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def scores(page: Lines, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(length, smoothed ratio, threshold) of some of the page's lines."""
    length = np.array([len(page.texts[k]) for k in lines], dtype=float)
    ratio = smoothed(length / np.maximum(np.array([page.tags[k] for k in lines]), 1))
    return length, ratio, float(ratio.std())


def marked_regions(page: Lines) -> np.ndarray:
    """Whether each region is, or lies in, an article or main element."""
    out = np.zeros(len(page.parents), dtype=bool)
    for i, name in enumerate(page.names):
        out[i] = name in ("article", "main") or (i > 0 and out[page.parents[i]])
    return out


def unsuspected(page: Lines) -> np.ndarray:
    """The lines outside suspect elements, and in those that hold the content themselves.

    The suspect with most votes is taken in if its votes are five times those
    outside, and it has an article, a top heading or three lines of content;
    then the suspects inside it are judged in turn. Where there is an article
    outside the suspects, only those within it are asked, and against it alone.
    """
    every, suspect = np.arange(len(page.texts)), np.array(page.suspect, dtype=np.int64)
    if not page.suspects or not len(every):
        return every
    length, ratio, least = scores(page, every)
    regions = marked_regions(page)
    good, in_article = ratio >= least, regions[np.array(page.where)]
    n = len(page.suspects) + 1  # the last entry is what lies outside all suspects
    if in_article[suspect < 0].any():
        good &= in_article
    votes, lines, marked = (np.bincount(suspect % n, w, n) for w in (np.where(good, length, 0), good, in_article))
    held = [votes.copy(), lines.copy(), marked.copy()]
    for k in range(n - 2, -1, -1):  # elements open after those around them
        if page.suspects[k] >= 0:
            for h in held:
                h[page.suspects[k]] += h[k]
    inner: dict[int, list[int]] = {}
    for k, around in enumerate(page.suspects):
        inner.setdefault(around, []).append(k)
    taken, outside, at = {-1}, votes[-1], -1
    article = marked[-1] > 0
    while (choice := max((k for k in inner.get(at, []) if not article or at >= 0 or regions[page.suspect_in[k]]), key=lambda k: held[0][k], default=None)) is not None:
        if outside * 5 > held[0][choice] or not (held[2][choice] or held[1][choice] >= 3 or choice in page.headed):
            break
        taken.add(choice)
        outside, article, at = outside + votes[choice], article or marked[choice] > 0, choice
    return every[np.isin(suspect, list(taken))]


def content(page: Lines, where: np.ndarray, votes_of_lines: np.ndarray) -> int:
    """The outermost article or main element, or else the smallest region element, outside which no content line lies."""
    votes = np.bincount(where, votes_of_lines, len(page.parents))
    for i in range(len(votes) - 1, 0, -1):  # elements open after their parents
        votes[page.parents[i]] += votes[i]
    marked = [i for i, n in enumerate(page.names) if n in ("article", "main") and votes[i]]
    at = max(marked, key=lambda i: (votes[i], -i)) if marked else 0
    if at and votes[at] == votes[0]:
        return at
    at = 0  # several articles, or content beside one: the element around all
    only: dict[int, int] = {}
    for i in range(len(votes) - 1, 0, -1):
        if votes[i] and votes[i] == votes[page.parents[i]]:
            only[page.parents[i]] = i
    while at in only and page.names[only[at]] not in ("table", "tbody", "tr", "td"):
        at = only[at]
    return at


def main_text(html: str) -> str:
    page = Lines()
    page.feed(html)
    page.close()
    lines = unsuspected(page)
    if not len(lines):
        return ""
    length, ratio, least = scores(page, lines)
    where = np.array(page.where)[lines]
    at = content(page, where, np.where(ratio >= least, length, 0))
    kept = np.zeros(len(page.parents), dtype=bool)
    kept[at] = True
    for i in range(at + 1, len(kept)):
        kept[i] = kept[page.parents[i]]
    stays = kept[where] & ~(np.array(page.halved)[lines] & (ratio / 2 < least))
    return "\n".join(page.texts[k] for k in lines[stays])


def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [main_text(h.as_py() or "") for h in batch.column(2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page.

    Null or empty html, or html without any text outside boilerplate, gives an
    empty text. Very long pages are read whole, in linear time, whatever their
    markup; a tag, comment or declaration that is never closed takes the rest
    of the page. Of regions with
    equal votes the outermost article, or else the innermost element, counts.
    Repeated rows are kept; an empty table gives no rows; other columns are not
    read.
    """
    return pages.select(pick(pages, "page_id", "long"), pick(pages, "url", "string"), pick(pages, "html", "string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
