"""Main text of web pages by line-block distribution.

Strip. One pass over the markup with a stack of open elements gives lines: each block
element is a line, inline markup and line breaks stay inside one. Scripts, styles, HTML
comments and the head vanish. A line's weight is its number of characters outside
links; lines of menus, page footers, sidebars, adverts, forms, reader comments and the
like have no weight. Such an element is known by its name or role, or by a class or id:
a word of ``SURE`` that is a whole class settles it, a word that is only a part of a
class (``has-sidebar``, ``social-science-post``) is a hint. In an article it is none unless all parts
are such words (``social-share``, not ``legal-history``). A hint is void for an element that
holds most of the text of its article, or of a page without one.

Sum. The weights of ``window`` neighbouring lines are summed. A run of text begins at a
surge point, the first line whose window reaches ``surge`` characters (half the page's
largest window where that is less), and ends at the dive point, the first line whose
window falls below ``dive``. Leading lines that are neither paragraphs, headings nor of
``LINE`` characters, and lines without weight at both ends, aren't part of it, unless they are
headings just above it, or follow a heading that ends it in the same element (a linked title,
a list of linked references). Short lines outside of articles that begin like a notice have no
weight. The start and end of an article or main element are surge and dive points that
are known.

Keep. Articles and main elements are the main text, all of them, if they hold ``LINE``
characters; else the largest run, joined with the runs of the same parent element, and of
sibling elements of its name and attributes. All lines are kept except those of boilerplate
elements.

Pages are handled where they lie (``mapInArrow``), with no shuffle; time is in proportion
to a page's length however its elements are nested.

Defined results: null and empty html, pages without text, and pages of links and
boilerplate only give an empty text; markup that is cut off or not closed ends with the
page, or at the next article or main heading for an element of boilerplate; a quote that
isn't closed ends with its tag; pages of any length are read whole; of equal weights the
first run is taken; repeated rows are each extracted; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Lines whose weights are summed, and the characters of a window at a surge and a dive point.
WINDOW, SURGE, DIVE = 3, 80, 10
#: Characters that make a line text whatever its element.
LINE = 25
_RAW = frozenset("script style noscript template svg iframe textarea title canvas head".split())
_DROP = frozenset("nav aside footer form header button select dialog menu".split())
#: Elements of ``_DROP`` that may hold the whole page.
_WRAPS = frozenset(("form", "header", "dialog"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTUAL = _HEADINGS | {"p", "blockquote", "pre"}
_MAIN = frozenset(("article", "main"))
#: Which elements a start tag ends when one is the innermost.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead"}}
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Class words of boilerplate when they are a whole class.
SURE = _COMMENTS | frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs footer newsletter subscribe pagination pager masthead topbar".split())
#: Class words that are a hint.
HINTS = SURE | frozenset("notice alert popup modal overlay side aside foot share sharing social related recommended recommendations subscription signup login search toolbar widget skip legal copyright".split())
#: Parts before a class word that turn it.
_TURNED = frozenset("has no with without hide show is not".split())
#: How short lines outside of articles begin that are notices, not text.
NOTICE = re.compile(r"(?:we use cookies|this (?:site|website) uses cookies|subscribe to (?:our|the|this)|sign up (?:for|to)|log in\b|sign in\b|privacy policy|terms of (?:use|service)|all rights reserved|copyright\W*(?:\(c\)|\d{4})|©|advertisement$|share this|follow us|skip to)", re.I)
NOTICE_LENGTH = 160
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)(?=>)|[^>]*)>?",
    re.S,
)
_CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?" if n != "head" else r"</head\s*>|(?=<body[\s>])|(?=<article[\s>])", re.I) for n in _RAW}
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[^-_]+")
NO, HINT, YES, COMMENT = range(4)


def suspicion(name: str, attributes: str, in_article: bool) -> int:
    """How surely an element is boilerplate."""
    found = NO
    if name in _DROP and not (name == "header" and in_article):
        found = HINT if name in _WRAPS else YES
    if "=" not in attributes:
        return found
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = (values[0] or values[1] or values[2]).lower()
        if key.lower() == "role":
            found = max(found, YES if value in _ROLES and name not in ("html", "body") else NO)
            continue
        for word in value.split():
            parts = _PARTS.findall(word)
            if not parts or parts[0] in _TURNED:
                continue
            if name in ("html", "body", *_MAIN):
                found = max(found, COMMENT if name == "article" and parts[-1] in _COMMENTS else NO)
            elif parts[-1] in _COMMENTS:
                found = COMMENT
            elif word in SURE:
                found = max(found, YES)
            elif HINTS.issuperset(parts) if in_article else not HINTS.isdisjoint(parts):
                found = max(found, HINT)
    return found


@dataclass
class Line:
    text: str
    weight: int
    mark: int  # of the boilerplate elements around it
    parent: int  # number of the element around it
    kin: tuple[int, str, str]  # number of the element around that, and what the parent has in common with its like
    textual: bool
    heading: bool


class Page:
    """Lines, boilerplate elements and articles of one page, read in one pass."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        #: boilerplate elements: (suspicion, first line, mark around, mark around that holds in articles)
        self.marks: list[tuple[int, int, int, int]] = [(NO, 0, 0, 0)]
        #: mark -> (line where it ended, whether by an end tag)
        self.ends: dict[int, tuple[int, bool]] = {}
        self.articles: list[tuple[int, int]] = []
        self._titles: list[int] = []
        self._stack: list[tuple[str, int, int, int, str]] = []  # (name, mark before, own mark, number, attributes)
        self._scopes: list[Counter] = [Counter()]
        self._mains: Counter = Counter()
        self._mark = self._number = self._depth = self._start = self._linked = 0
        self._parts: list[str] = []
        self._in_link = False
        self._read(page)

    def _line(self) -> None:
        text = " ".join(html.unescape("".join(self._parts)).split())
        if text:
            name, n = self._stack[-1][0] if self._stack else "", len(self._stack)
            at = next((k for k in range(n - 1, max(-1, n - 4), -1) if self._stack[k][0] not in _TEXTUAL and self._stack[k][0] not in ("li", "ul", "ol")), -1)
            outer = self._stack[at] if at >= 0 else ("", 0, 0, 0, "")
            around = self._stack[at - 1][3] if at > 0 else 0
            self.lines.append(Line(text, max(0, len(text) - self._linked), self._mark, outer[3], (around, outer[0], outer[4]), name in _TEXTUAL, name in _HEADINGS))
        self._parts.clear()
        self._linked = 0

    def _say(self, text: str) -> None:
        self._parts.append(text)
        if self._in_link:
            self._linked += len(text.strip())

    def _open(self, name: str, attributes: str) -> None:
        doubt = suspicion(name, attributes, self._depth > 0)
        before, own = self._mark, 0
        article = name in _MAIN and doubt == NO
        if article:
            self._mark = self.marks[self._mark][3]  # only comments, menus and the like reach into an article
        elif doubt:
            self.marks.append((doubt, len(self.lines), self._mark, 0))
            own = self._mark = len(self.marks) - 1
            kept = own if doubt == COMMENT or name in ("nav", "aside", "footer", "menu") else self.marks[before][3]
            self.marks[own] = (doubt, len(self.lines), before, kept)
        self._number += 1
        self._stack.append((name, before, own, self._number, " ".join(attributes.split())))
        self._scopes[-1][name] += 1
        if name in _MAIN:
            self._mains[name] += 1
            self._scopes.append(Counter())
            if article and self._mark == 0:
                self._depth += 1
                if self._depth == 1:
                    self._start = len(self.lines)

    def _pop(self, closed: bool) -> None:
        name, before, own, *_ = self._stack.pop()
        if name in _MAIN:
            self._mains[name] -= 1
            self._scopes.pop()
            if not own and self._mark == 0 and self._depth:
                self._depth -= 1
                if not self._depth:
                    self.articles.append((self._start, len(self.lines)))
        self._scopes[-1][name] -= 1
        self._mark = before
        if own:
            self.ends[own] = (len(self.lines), closed)

    def _end(self, name: str) -> None:
        """End the innermost such element and what is open in it; an article's edge is only crossed by its like."""
        if self._mains[name] if name in _MAIN else self._scopes[-1][name]:
            while self._stack[-1][0] != name:
                self._pop(self._stack[-1][0] in _TEXTUAL or self._stack[-1][0] in _ENDS)
            self._pop(True)

    def _read(self, page: str) -> None:
        at = 0
        while m := _TAG.search(page, at):
            if m.start() > at:
                self._say(page[at : m.start()])
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == "a":
                    self._in_link = False
                elif name not in _INLINE:
                    self._line()
                    self._end(name)
            elif name in _RAW:
                self._line()
                found = _CLOSE[name].search(page, at)
                at = found.end() if found else len(page)
            elif name == "a":
                self._in_link = True
            elif name == "br" or name == "wbr":
                self._parts.append(" " if name == "br" else "")
            elif name not in _INLINE:
                self._line()
                self._in_link = False
                if self._stack and self._stack[-1][0] in ("p", *_HEADINGS):
                    self._pop(True)
                while self._stack and self._stack[-1][0] in _ENDS.get(name, ()):
                    self._pop(True)
                if name == "h1":
                    self._titles.append(len(self.lines))
                if name not in _VOID and not m[3].endswith("/"):
                    self._open(name, m[3])
        self._say(page[at:])
        self._line()
        while self._stack:
            self._pop(False)

    def boilerplate(self) -> list[bool]:
        """Whether each line is one of boilerplate."""
        chars = [0, *accumulate(x.weight for x in self.lines)]
        upto = [-1] * len(self.marks)
        starts = [a for a, _ in self.articles]
        for k, (doubt, start, around, _) in enumerate(self.marks[1:], 1):
            end, closed = self.ends[k]
            if not closed:
                later = bisect_left(self._titles, start)
                after = bisect_left(starts, start)
                end = min([end, *starts[after : after + 1], *self._titles[later : later + 1]])
            held = chars[end] - chars[start]
            nth = bisect_right(starts, start) - 1
            inside = nth >= 0 and start < self.articles[nth][1]
            most = chars[self.articles[nth][1]] - chars[self.articles[nth][0]] if inside else chars[-1]
            void = doubt == HINT and (inside or not self.articles) and held >= SURGE and 2 * held > most
            upto[k] = max(upto[around] if around else -1, -1 if void else end)
        return [k < upto[x.mark] for k, x in enumerate(self.lines)]


def _runs(weights: list[int], window: int, surge: float, dive: float) -> list[tuple[int, int]]:
    """Ranges of lines between surge and dive points."""
    total = [0, *accumulate(weights)]
    n = len(weights)
    sums = [total[min(n, k + window)] - total[k] for k in range(n)]
    surge = min(surge, max(sums, default=0) / 2)
    runs, start = [], None
    for k, s in enumerate(sums):
        if start is None and s >= surge > 0:
            start = k
        elif start is not None and s < min(dive, surge):
            runs.append((start, k))
            start = None
    return runs if start is None else [*runs, (start, n)]


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> str:
    """The lines of the page's articles, or between the surge and the dive point of its largest run."""
    read = Page(page or "")
    lines, left_out = read.lines, read.boilerplate()
    kept = lambda spans: "\n".join(lines[k].text for a, b in spans for k in range(a, b) if not left_out[k])
    inside = [False] * len(lines)
    for a, b in read.articles:
        inside[a:b] = [True] * (b - a)
    weights = [0 if out or not known and len(x.text) < NOTICE_LENGTH and NOTICE.match(x.text) else x.weight for x, out, known in zip(lines, left_out, inside, strict=True)]
    held = [0, *accumulate(weights)]
    weight = lambda r: held[r[1]] - held[r[0]]
    least = min(LINE, max(weights, default=0) / 2)
    told = sum(map(weight, read.articles))
    if told >= LINE:
        return kept(read.articles)
    runs = []
    for a, b in _runs(weights, window, surge, dive):
        while a < b and not (weights[a] and (lines[a].textual or weights[a] >= least)):
            a += 1
        while b > a and not weights[b - 1]:
            b -= 1
        if a < b:
            runs.append((a, b))
    best = max(runs, key=lambda r: (weight(r), -r[0]), default=(0, 0))
    if told and 2 * told >= weight(best):
        return kept(read.articles)
    if not weight(best):
        return ""
    home = lambda r: lines[_home(lines, weights, r)]
    own = home(best)
    same = [best, *(r for r in runs if home(r).parent == own.parent or own.kin[1] and home(r).kin == own.kin)]
    first, last = min(a for a, _ in same), max(b for _, b in same)
    parents = {home(r).parent for r in same}
    while first and not left_out[first - 1] and (lines[first - 1].heading or lines[first - 1].textual and lines[first - 1].parent in parents):
        first -= 1
    if lines[last - 1].heading:
        while last < len(lines) and not left_out[last] and not weights[last] and lines[last].parent in parents:
            last += 1
    return kept([(first, last)])


def _home(lines: list[Line], weights: list[int], run: tuple[int, int]) -> int:
    """A line of the parent that holds most of a run."""
    shares: Counter = Counter()
    for k in range(*run):
        shares[lines[k].parent] += weights[k]
    parent = shares.most_common(1)[0][0]
    return next(k for k in range(*run) if lines[k].parent == parent)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` of every page."""
    source = only(pages, id=id_col, url=url_col, html=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, url string, text string").withColumnRenamed("id", id_col)


def digests(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("bigint"))
