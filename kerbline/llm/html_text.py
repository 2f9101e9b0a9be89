"""Main text of HTML pages by the distribution of line blocks.

A page becomes lines: one per block-level element, in page order, without markup, scripts and styles, with character
references decoded and white space folded.  Lines of menus, headers, footers, sidebars, notices, adverts, forms and
comments are left out where the page names them: by element, role, or a class or id whose words say so.  A name that
would take nearly all of the text is that of a wrapper and does not count.

Each line weighs its length outside links, nothing if it is mostly links.  Weights are summed over a sliding window of
`SPAN` lines.  Text surges where the sums rise over `SURGE` and dives where they fall to nothing.  The content is the
innermost element with most of the heaviest such stretch and several of its lines, and the main text reaches from the first surge to the last
dive inside it; between these every line is kept, however short and however linked.  Where a page marks its text by
article or main elements, the distribution has nothing left to decide, and all lines inside them are kept.

Defined results: a null page, and one without any text, have an empty text; if nothing surges all lines that the page
does not name as something else are kept; an element that is never closed ends with its parent, and an article or main
element ends menus and adverts left open before it; each input row gives one result row, and its other columns stay
(columns named `text` and `n_chars` are replaced, any other name is free).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 3
SURGE = 40
#: The share of the heaviest stretch that its content element has, and of all text that makes a name a wrapper's.
MOST = 0.7
WRAPS = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title noscript template svg math canvas iframe object audio video select option textarea button datalist".split())
#: Elements that are boilerplate by their name.
ASIDE = frozenset("nav footer aside form menu dialog header".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ENDS = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}
#: Words of class names and ids that name boilerplate; COMMENTS are so whatever holds them.
COMMENTS = frozenset("comment comments reply replies respond respondent discussion disqus".split())
NAMED = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail widget widgets menu navigation nav navbar breadcrumb breadcrumbs topbar toolbar masthead "
    "header footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations trending "
    "popular pagination pager copyright disclaimer skip toc teaser card".split()
)
#: What may follow such a word without changing what it names, what before it speaks of a wrapper, and whose header is a title.
HOLDERS = frozenset("box block bar area wrap wrapper container inner outer section list item items link links panel slot unit row column left right top bottom main text body form thread message messages".split())
SPEAKS_OF = frozenset("has no with without is not show hide js".split())
TITLED = frozenset("article entry post content story section page".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


def named_as(names: str) -> str | None:
    """The boilerplate that one of the class names or ids names: its last word does, or its first with a mere holder behind."""
    for name in names.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts or parts[0] in SPEAKS_OF:
            continue
        if parts[-1] in NAMED and not (parts[-1] == "header" and parts[0] in TITLED):
            return parts[-1]
        if parts[0] in NAMED and len(parts) > 1 and parts[1] in HOLDERS:
            return parts[0]
    return None


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    aside: bool  # boilerplate by element, role or as comments
    name: int  # the innermost element around that is named as other boilerplate, 0 if none
    article: bool
    block: int  # the innermost block element around


class _Open(NamedTuple):
    """An open element, with what it has from those around it."""

    tag: str
    hidden: bool
    aside: bool
    name: int
    article: bool
    comments: bool  # which an article does not end
    block: int


class _Reader(HTMLParser):
    """Turns markup into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # of each block element, and of each element named as boilerplate, the one of its kind around it
        self.blocks, self.names = [0], [0]
        self.open = [_Open("", False, False, 0, False, False, 0)]
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = next(x for x in reversed(self.open) if x.tag not in INLINE)
                self.lines.append(Line(text, min(self.linked, len(text)), at.aside, at.name, at.article, at.block))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag not in INLINE:
                self._end_line()
            return
        block = tag not in INLINE
        if block:
            self._end_line()
            while len(self.open) > 1:
                # inline elements left open in a paragraph end with it
                k = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag not in INLINE), 0)
                if k and tag in ENDS.get(self.open[k].tag, ()):
                    self.links -= sum(x.tag == "a" for x in self.open[k:])
                    del self.open[k:]
                else:
                    break
        around = self.open[-1]
        known = dict(attrs)
        role = (known.get("role") or "").lower()
        content = tag in ("article", "main") or role in ("main", "article")
        marks = " ".join(filter(None, (known.get("class"), known.get("id"))))
        named = named_as(marks) if marks and tag not in ("html", "body") else None
        comments = around.comments or named in COMMENTS
        style = (known.get("style") or "").replace(" ", "").lower()
        hidden = around.hidden or tag in HIDDEN or "hidden" in known or "display:none" in style
        aside, name, at = around.aside, around.name, around.block
        if block:
            self.blocks.append(at)
            at = len(self.blocks) - 1
        if content and named is None and not comments:
            aside, name = False, 0
        # the header of an article is its title, and old pages are one form
        aside = aside or comments or role in _ROLES or (tag in ASIDE and tag != "form" and not (tag == "header" and around.article))
        if (named and not comments) or tag == "form":
            self.names.append(name)
            name = len(self.names) - 1
        if tag == "a":
            self.links += 1
        self.open.append(_Open(tag, hidden, aside, name, around.article or content, comments, at))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in HIDDEN and tag not in ("script", "style", "title", "textarea"):
            return
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.links -= sum(x.tag == "a" for x in self.open[i:])
                del self.open[i:]
                return
            if tag in INLINE and self.open[i].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1].hidden:
            self.parts.append(data)
            if self.links > 0:
                self.linked += len(data.strip())


def read(html: str) -> _Reader:
    """The page's lines and elements."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._end_line()
    return reader


def stretches(weights: np.ndarray) -> list[tuple[int, int]]:
    """First line and end of each stretch between a surge and a dive."""
    sums = np.convolve(weights, np.ones(SPAN), "same") if len(weights) >= SPAN else np.full(len(weights), weights.sum())
    found, start, surged = [], None, False
    for i, total in enumerate([*sums, 0.0]):
        if total > 0 and start is None:
            start, surged = i, False
        surged = surged or total >= SURGE
        if total <= 0 and start is not None:
            if surged:
                found.append((start, i))
            start = None
    return found


def _weights(lines: list[Line]) -> np.ndarray:
    # a line that is mostly links is part of a list of links
    return np.array([0 if 2 * x.linked > len(x.text) else len(x.text) - x.linked for x in lines], float)


def _shares(at: list[int], weights: np.ndarray, around: list[int]) -> np.ndarray:
    """How much of the weight each element holds, given the element of each weight and the one around each element."""
    held = np.bincount(at, weights, minlength=len(around))
    for i in range(len(around) - 1, 0, -1):  # what is inside comes later
        held[around[i]] += held[i]
    return held


def unnamed(lines: list[Line], names: list[int]) -> list[Line]:
    """The lines that are in no named boilerplate; the name of an element with nearly all text does not count."""
    lines = [x for x in lines if not x.aside]
    if not any(x.name for x in lines):
        return lines
    at = [x.name for x in lines]
    sizes = np.array([len(x.text) for x in lines], float)
    wraps = (_shares(at, sizes, names) > WRAPS * sizes.sum()) & (_shares(at, np.ones(len(lines)), names) >= SPAN)
    clear = [True]
    for i in range(1, len(names)):
        clear.append(clear[names[i]] and bool(wraps[i]))
    return [x for x in lines if clear[x.name]]


def content_of(lines: list[Line], blocks: list[int]) -> list[Line]:
    """The lines from the first surge to the last dive in the content element."""
    weights = _weights(lines)
    found = stretches(weights)
    if not found:
        return lines
    a, b = max(found, key=lambda x: (weights[x[0] : x[1]].sum(), -x[0]))
    at = [blocks[x.block] for x in lines[a:b]]  # a line's own element is no container
    most = (_shares(at, weights[a:b], blocks) >= MOST * weights[a:b].sum()) & (_shares(at, np.ones(b - a), blocks) >= min(SPAN, b - a))
    # elements with more than half are inside one another, and the innermost one comes last
    element = int(np.flatnonzero(most)[-1])
    inside = [element == 0]
    for i in range(1, len(blocks)):
        inside.append(i == element or inside[blocks[i]])
    lines = [x for x in lines if inside[x.block]]
    weights = _weights(lines)
    found = stretches(weights) or [(0, len(lines))]
    kept = np.flatnonzero(weights[found[0][0] : found[-1][1]]) + found[0][0]
    return lines[kept[0] : kept[-1] + 1]


def main_text(html: str | None) -> str:
    page = read(html or "")
    lines = unnamed(page.lines, page.names)
    marked = [x for x in lines if x.article]
    return "\n".join(x.text for x in (marked or content_of(lines, page.blocks)))


def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """pages with `text` and `n_chars`."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    read = pages.withColumn("text", F.pandas_udf(_main_texts, "string")(F.coalesce(F.col(html), F.lit(""))))
    return read.select(*kept, "text", F.length("text").cast("long").alias("n_chars"))


def op5(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
