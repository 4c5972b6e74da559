"""Main text of web pages by text-to-tag ratios (operator 3).

The standard library's streaming parser turns a page into lines: one line per
block-level run of text, with its tags and how much of it is link text.  The
text-to-tag ratios of the lines (link text not counted) are smoothed with a
Gaussian kernel; lines whose smoothed ratio exceeds a threshold form the content
clusters.  They decide

* which part of the page is the content region: the article element that holds
  most of the clusters' text, or failing one the deepest element that holds
  nearly all of it.  There, link lists before the first and after the last
  cluster are left out, as nothing else tells them from text;
* whether a mark holds.  Elements that carry no article text (menus, footers,
  forms, notices, adverts, reader comments and so on) are marked by their tag,
  role, class or id.  A mark on an element that holds most of the page's cluster
  text, and a title, article or paragraphs that stand nowhere else, is void: a
  form around the page, a menu that is never closed;
* names that only contain such a word (``share-price``, ``no-sidebar``) mark an
  element only if it is mostly links.

Every line of the region without a mark that holds is kept, short ones too.

Defined cases: a null, empty or tag-only page has the empty text; pages cut off
anywhere are parsed as far as they go; whole pages are read; equal rows give
equal rows; null ids and addresses stay null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import textvec as tv
from memspark.llm.common import small_batches

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
#: Elements that are followed on the stack; others open and close without effect on the region.
NESTED = frozenset(
    "html body div section article main aside nav header footer form figure ul ol dl table blockquote details dialog menu center td "
    "script style head title noscript template iframe svg math select button textarea object canvas audio video fieldset span li a".split()
)
#: Elements whose content is never text of the page.
SILENT = frozenset("head title script style noscript template iframe svg select textarea canvas audio video object".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: Marked, wherever they are.
DROPPED = frozenset("nav aside footer form button menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar widget related recommended recommendations "
    "comment comments disqus replies respond nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer toolbar paywall login".split()
)
#: Marked outside the article only: an article's own header holds its title.
OUTER_TAGS, OUTER_NAMES = frozenset(["header"]), frozenset("header masthead topbar".split())
#: Parts of a name that say where or in what shape something stands.
PLACES = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop fixed form global group heading holder icons inline inner "
    "item items js large left link links list main mobile outer page panel primary region right row secondary section site slot small sticky "
    "text title top unit wrap wrapper".split()
)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ARTICLES = frozenset(["article", "main"])
#: A tag that the end of the page cuts off is no text.
CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")
#: Marks: none, only if mostly links, always.
NONE, WEAK, STRONG = 0, 1, 2
#: Share of link text from which a part is mostly links; of the cluster text that makes a mark void; bytes per batch of results.
LINKS, MOST, OUT_BYTES = 0.5, 0.5, 4_000_000


def named(value: str, names: frozenset[str]) -> int:
    """The mark of a class or id: strong if one of its names consists of the words
    in ``names`` and of places only, weak if one contains such a word."""
    best = NONE
    for token in value.split():
        pieces = {p.lower() for p in PIECES.findall(token)}
        if pieces & names:
            best = max(best, STRONG if pieces <= names | PLACES else WEAK)
    return best


class Line:
    __slots__ = ("links", "path", "tags", "text", "titled")

    def __init__(self, text: str, tags: int, links: int, path: tuple[int, ...], titled: bool) -> None:
        self.text, self.tags, self.links, self.path, self.titled = text, tags, links, path, titled


class Lines(HTMLParser):
    """Collects the lines of a page; ``tag_of`` and ``mark_of`` tell of its elements by number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, number, silent, in an article
        self.tag_of: list[str] = [""]
        self.mark_of: list[int] = [NONE]
        self.parts: list[str] = []
        self.tags = self.links = self.anchors = 0
        self.titled = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append(Line(text, self.tags, self.links, tuple(e[1] for e in self.stack), self.titled))
                self.tags = 0
        self.links, self.titled = 0, False

    def pop(self, i: int) -> None:
        self.anchors -= sum(e[0] == "a" for e in self.stack[i:])
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack and tag not in IN_HEAD and any(e[0] == "head" for e in self.stack):
            self.close_element("head")  # what stands in a head only by a missing end tag
        if tag in BLOCKS or tag in SILENT or tag == "button":
            self.flush()
        elif tag == "br" or tag in ("td", "th", "option"):
            self.parts.append(" ")
        self.tags += 1
        if tag == "h1":
            self.titled = True
        if tag not in NESTED:
            return
        if tag == "li":
            self.close_element("li", ("ul", "ol", "menu", "nav"))
        elif tag in ("a", "td"):
            self.close_element(tag, ("table",))
        outer = self.stack[-1] if self.stack else ("", 0, False, False)
        inside = outer[3] or tag in ARTICLES
        mark = self.marked(tag, dict(attrs), inside) if not outer[2] else NONE
        if mark:
            self.flush()
        self.tag_of.append(tag)
        self.mark_of.append(mark)
        self.stack.append((tag, len(self.tag_of) - 1, outer[2] or tag in SILENT, inside))
        self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # in HTML a slash closes nothing but void elements
        self.handle_starttag(tag, attrs)

    def close_element(self, tag: str, bounds: tuple[str, ...] = ()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if any(self.mark_of[e[1]] for e in self.stack[i:]) or self.stack[-1][2]:
                    self.flush()
                self.pop(i)
                return
            if self.stack[i][0] in bounds:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in NESTED:
            self.close_element(tag)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.parts.append(data)
            if self.anchors:
                self.links += len(data.strip())

    @staticmethod
    def marked(tag: str, attrs: dict[str, str | None], inside: bool) -> int:
        if tag in ("html", "body", "article", "main"):
            return NONE
        if tag in DROPPED or (tag in OUTER_TAGS and not inside):
            return STRONG
        if "hidden" in attrs or HIDDEN.search(attrs.get("style") or "") or (attrs.get("role") or "").lower() in DROPPED_ROLES:
            return STRONG
        names = DROPPED_NAMES if inside else DROPPED_NAMES | OUTER_NAMES
        return max(named(attrs.get(k) or "", names) for k in ("class", "id"))


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[radius : radius + len(x)]
    return np.convolve(x, kernel)[radius : radius + len(x)] / weight


def held(lines: list[Line], amount: list[float]) -> dict[int, float]:
    """The sum of ``amount`` over the lines in each element."""
    out: dict[int, float] = {}
    for line, n in zip(lines, amount, strict=True):
        if n:
            for number in line.path:
                out[number] = out.get(number, 0.0) + n
    return out


def holding_marks(page: Lines, cluster: list[float]) -> set[int]:
    """The marked elements whose mark holds."""
    lines = page.lines
    size, links = held(lines, [float(len(x.text)) for x in lines]), held(lines, [float(x.links) for x in lines])
    marks = {k for k, m in enumerate(page.mark_of) if k in size and (m == STRONG or (m == WEAK and links.get(k, 0.0) >= LINKS * size[k]))}
    content = held(lines, cluster)
    total = sum(cluster)

    def told(x: Line) -> bool:
        """Whether a line says by itself that it belongs to an article."""
        return x.titled or any(page.tag_of[k] in ARTICLES for k in x.path)

    while True:
        free = [x for x in lines if not marks.intersection(x.path)]
        if any(map(told, free)):
            return marks
        wrappers = []
        for k in marks:
            inside = [(x, n) for x, n in zip(lines, cluster, strict=True) if k in x.path]
            dense = sum(n > 0 and x.links < LINKS * len(x.text) for x, n in inside)
            if content.get(k, 0.0) > MOST * total and (any(told(x) for x, _ in inside) or dense >= 2):
                wrappers.append(k)
        if not wrappers:
            return marks
        marks.remove(min(wrappers))  # the outermost


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.5) -> str:
    """``threshold`` is in units of the mean smoothed ratio."""
    if not html:
        return ""
    page = Lines()
    page.feed(CUT_TAG.sub("", html))
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    size = np.array([len(x.text) for x in lines], dtype=np.float64)
    raw = np.maximum(size - [x.links for x in lines], 0.0) / np.maximum(1, [x.tags for x in lines])
    ratio = smoothed(raw, sigma)
    level = threshold * ratio.mean()
    cluster = [n if r >= level else 0.0 for n, r in zip(size.tolist(), ratio.tolist(), strict=True)]
    marks = holding_marks(page, cluster)
    free = [not marks.intersection(x.path) for x in lines]
    weight = held(lines, [n if f else 0.0 for n, f in zip(cluster, free, strict=True)])
    articles = [(w, -k) for k, w in weight.items() if page.tag_of[k] in ARTICLES]
    if articles:
        # of nested articles with the same text the outermost
        region = -max(articles)[1]
        return "\n".join(x.text for x, f in zip(lines, free, strict=True) if f and region in x.path)
    total = sum(n for n, f in zip(cluster, free, strict=True) if f)
    holds = [k for k, w in weight.items() if w >= 0.9 * total and page.tag_of[k] not in ("span", "li", "a")]
    region = max(holds) if holds else 0
    kept = [i for i, x in enumerate(lines) if free[i] and (not region or region in x.path)]
    core = [i for i in kept if raw[i] >= level or lines[i].titled]
    first, last = (core[0], core[-1]) if core else (0, len(lines))
    return "\n".join(lines[i].text for i in kept if first <= i <= last or lines[i].links < LINKS * len(lines[i].text))


def extract(df: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""

    def result(rows: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = zip(*rows, strict=True)
        size = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), size], ["page_id", "url", "text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held_bytes = [], 0
        for batch in batches:
            # one page at a time, so that a task holds a batch and one page's lines
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                text = main_text(html.as_py())
                rows.append((page_id.as_py(), url.as_py(), text))
                held_bytes += len(text)
                if held_bytes > OUT_BYTES:
                    yield result(rows)
                    rows, held_bytes = [], 0
        if rows:
            yield result(rows)
        tv.release()

    small_batches(df.sparkSession)
    rows = df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
