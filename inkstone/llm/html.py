"""Main text of web pages by the line-block distribution.

A page becomes lines, one for each block of text: markup, scripts, styles, comments,
hidden parts and the head go, inline tags vanish, block tags end a line.  Each line weighs
the length of its text outside links (a heading that is a link weighs all of it); lines in
menus, page headers, footers, sidebars, notices, adverts, forms and reader comments weigh
nothing.  The weights are summed over sliding windows of WINDOW lines.  A stretch of lines
ends where the sum dives to nothing, or at a menu, header, footer or form; a stretch in
which the sum surges to SURGE is text, from its first line with weight to its last, and
what stands in between (a paragraph that is one link) with it.  On a page too short for
any surge all lines with weight are kept.

An article that the page marks (article or main) is evidence, not the answer.  The sums
decide whether the mark is believed: not if the text that surges beside it is longer than
the article (a teaser beside the story), and, for main, which a page has once, if that is
also what a full window of surging lines holds.  For the lines of a believed article any
weight is a surge, so short ones stay, stretches of links still are dives, and what
surges beside it goes.

Names of classes are hints of less weight than elements.  A name counts if all its parts
are words of page furniture ("share-buttons", not "share-price").  In a believed article a
named part still counts for DOUBT of its length, so a long one surges and stays; where
nothing else on the page surges and the named parts surge and hold most of the text, the
names are not believed (a page wrapped in one form or one "legal" division).  Reader
comments are never taken back.

A page is read once by a scanner that keeps the attribute state (a quote only opens a value
after "="), in time and memory proportional to its length, however broken it is.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import table

WINDOW, SURGE, DOUBT = 3, 80, 0.1

#: A tag with quoted values, and one that ends at the first ">"; possessive, so neither reads a character twice.
_STRICT = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)|[!?/][^>]*+)>")
_PLAIN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)|[!?/][^>]*+)>")
_OPENS = re.compile(r"<[a-zA-Z!?/]")
_ATTR = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")
_EMPTY = re.compile("-?>")

#: Elements whose content, up to their end tag, is no text of the page; without an end tag only _ENDLESS take the rest.
_ENDLESS = frozenset("script style title textarea iframe xmp".split())
_RAW = frozenset("script style noscript template title textarea iframe object svg math canvas xmp noembed noframes select option button audio video".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_BLANK = frozenset("br td th wbr img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A new one of these ends an open one of the same group.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), **{h: ("p",) for h in _HEADING}}
_PART = frozenset("nav footer aside menu dialog head".split())
_FORM = frozenset("form fieldset".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Parts that end a stretch of text; an aside or a named part may stand amid it.
_CUTS = frozenset("nav footer menu dialog header form".split())
#: Words of a class or id that name a part of the page other than its text, those of reader comments, and words that say nothing beside them.
_COMMENT = frozenset("comment comments commentlist disqus respond reply replies".split())
_WORDS = _COMMENT | frozenset("""
ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion promoted
nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead toolbar
cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login
share sharing social related recommended recommendations pagination pager skip copyright legal disclaimer
""".split())
_PLAIN_WORDS = frozenset("""
a area articles bar block body bottom box btn button buttons col column container content count entries entry form group head
header heading holder icon icons id inner item items l left line link links list main media middle module outer page panel
posts r right row section site slot small stories tab text title to top unit user users wrap wrapper
""".split())
_HEADER = frozenset(("header", "topbar"))
_ARTICLE = frozenset(("article", "main"))
#: Elements whose own class says nothing.
_WHOLE = frozenset(("body", "main", "html"))
#: How certainly a line is outside the text: not at all, by a name or a form, by reader comments, by its element.
CLEAR, NAMED, READERS, OUTSIDE = range(4)
_ONE, _MAIN = 1, 2


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(source)}


def _named(names: str) -> int:
    """What the names of a class or id say of an element: CLEAR, NAMED or READERS."""
    found = CLEAR
    for name in names.lower().split():
        parts = _NAME.findall(name)
        if any(p in _WORDS for p in parts) and all(p in _WORDS or p in _PLAIN_WORDS or p.isdigit() for p in parts):
            found = max(found, READERS if any(p in _COMMENT for p in parts) else NAMED)
    return found


class _Lines:
    """The lines of a page: (text, weight, certainty that it is outside the text, mark of the article, whether it cuts)."""

    def __init__(self):
        self.out: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.link = 0
        #: (tag, outside, header, mark, cut) of the open elements that matter; by tag and for blocks, where they stand.
        self.open: list[tuple[str, int, bool, int, bool]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.heading = 0
        self.links = 0
        #: A part that cuts may have no text of its own.
        self.cut = False

    def state(self) -> tuple[int, bool, int, bool]:
        return self.open[-1][1:] if self.open else (CLEAR, False, 0, False)

    def text(self, source: str) -> None:
        if source:
            self.parts.append(source)
            if self.links:
                self.link += len(source.strip())

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", unescape("".join(self.parts))).strip()
            if text:
                outside, header, mark, cut = self.state()
                if header and not (mark and self.heading):
                    outside, cut = OUTSIDE, not mark
                self.out.append((text, len(text) if self.heading else max(0, len(text) - self.link), outside, mark, cut))
            self.parts, self.link = [], 0

    def push(self, tag: str, *state) -> None:
        self.where.setdefault(tag, []).append(len(self.open))
        if tag in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, *state))

    def close(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        while len(self.open) > k:
            tag = self.open.pop()[0]
            self.where[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links += 1
            return
        if tag in _BLANK:
            self.parts.append(" ")
        if tag in _BLOCK:
            self.end_line()
            if (closes := _CLOSES.get(tag)) and self.blocks:
                k = self.blocks[-1]
                if self.open[k][0] == "p" and "p" not in closes and len(self.blocks) > 1 and self.open[self.blocks[-2]][0] in closes:
                    k = self.blocks[-2]
                if self.open[k][0] in closes:
                    self.close(k)
        if tag in _VOID:
            return
        outside, header, mark, cut = self.state()
        if tag in _HEADING:
            self.heading += 1
        own = OUTSIDE if tag in _PART else NAMED if tag in _FORM else CLEAR
        cut |= tag in _CUTS
        if attributes and ("=" in attributes or "hidden" in attributes):
            a = _attributes(attributes)
            names, role = f"{a.get('class', '')} {a.get('id', '')}", a.get("role", "").lower()
            if tag not in _WHOLE:
                own = max(own, _named(names))
            if role in _ROLE or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
                own = OUTSIDE
            header |= tag not in _WHOLE and tag not in _HEADING and any(name in _HEADER for name in names.lower().split())
            mark = max(mark, _MAIN if role == "main" or a.get("itemprop", "").lower() == "articlebody" else _ONE if role in _ARTICLE else 0)
        header |= tag == "header"
        if tag not in _BLOCK and not own:
            return  # an inline element that says nothing
        self.push(tag, max(outside, own), header, max(mark, _MAIN if tag == "main" else _ONE if tag in _ARTICLE else 0), cut)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
            return
        if tag in _BLOCK:
            self.end_line()
            if tag in _HEADING:
                self.heading = max(0, self.heading - 1)
            self.links = 0
        # An inline end tag does not reach beyond the block it stands in.
        if (at := self.where.get(tag)) and (tag in _BLOCK or not self.blocks or at[-1] > self.blocks[-1]):
            self.close(at[-1])


def lines(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, weight, certainty that it is outside the text, mark of the article, whether it cuts) of a page's blocks in order."""
    out, at, look, tags = _Lines(), 0, 0, _STRICT
    ends: dict[str, re.Pattern | None] = {}  # None: there is no further end tag
    while (lt := page.find("<", look)) >= 0:
        if page.startswith("<!--", lt):
            out.text(page[at:lt])
            short = _EMPTY.match(page, lt + 4)  # an empty comment
            end = short.end() if short else page.find("-->", lt + 4) + 3
            at = look = end if end > 2 else len(page)
            continue
        m = tags.match(page, lt)
        if m is None:
            if not _OPENS.match(page, lt):
                look = lt + 1
            elif tags is _STRICT:  # a value without its closing quote runs to the end: quotes mean nothing from here
                tags = _PLAIN
            else:  # the page is cut off inside a tag
                out.text(page[at:lt])
                at = len(page)
                break
            continue
        out.text(page[at:lt])
        at = look = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            out.end(tag)
        elif tag in _RAW and not m[3].endswith("/"):
            if tag not in ends:
                ends[tag] = re.compile(rf"</{tag}(?![^\s/>])", re.I | re.A)
            found = ends[tag] and ends[tag].search(page, at)
            if found:
                at = look = found.start()
            else:
                ends[tag] = None
                if tag in _ENDLESS:
                    at = look = len(page)
        else:
            out.start(tag, m[3])
    out.text(page[at:])
    out.end_line()
    return out.out


def sums(weights: list[int]) -> list[int]:
    """The sum of the weights of each line and the next, WINDOW in all."""
    run = [0, *accumulate(weights)]
    return [run[min(len(weights), i + WINDOW)] - run[i] for i in range(len(weights))]


def stretches(weights: list[int], cuts: list[bool], least: int = SURGE) -> list[tuple[int, int]]:
    """(first, last) of the stretches between dives and cuts in which the window sums surge to `least`; both ends have weight."""
    out, edges = [], [-1, *(i for i, cut in enumerate(cuts) if cut), len(weights)]
    for lo, hi in zip(edges, edges[1:]):
        own = weights[lo + 1 : hi]
        total, heavy = sums(own), [i for i, weight in enumerate(own) if weight]
        first = 0
        for k, i in enumerate(heavy):
            # A dive: no weight in the window that follows the last line with weight.
            if k + 1 == len(heavy) or heavy[k + 1] - i > WINDOW:
                if max(total[heavy[first] : i + 1]) >= least:
                    out.append((lo + 1 + heavy[first], lo + 1 + i))
                first = k + 1
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks joined by blank lines, empty if there is none."""
    found = lines(page or "")
    return "\n\n".join(found[i][0] for i in chosen(found))


def chosen(found: list[tuple[str, int, int, int, bool]]) -> list[int]:
    """The lines of the main text, in order."""
    outside = [x[2] for x in found]
    marks = [0 if x[2] >= READERS else x[3] for x in found]
    weights = [0 if x[2] else x[1] for x in found]
    cuts = [x[4] and x[2] > CLEAR for x in found]
    text = stretches(weights, cuts)
    own = sum(w for w, m in zip(weights, marks) if m)
    if own:
        beside = sum(weights[i] for a, b in text for i in range(a, b + 1) if not marks[i])
        if beside <= own or beside < WINDOW * SURGE and _MAIN in marks:
            inside = [w if m else 0 for w, m in zip(weights, marks)]
            doubt = [int(x[1] * DOUBT) if m and x[2] == NAMED else 0 for x, m in zip(found, marks)]
            long = {j for i, total in enumerate(sums(doubt)) if total >= SURGE for j in range(i, min(len(found), i + WINDOW)) if doubt[j]}
            keep = {i for a, b in stretches(inside, [False] * len(found), 1) for i in range(a, b + 1) if marks[i] and not outside[i]}
            return sorted(keep | long)
    named = [x[1] if x[2] == NAMED else 0 for x in found]
    if not text and sum(named) > sum(weights) and max(sums(named)) >= SURGE:
        # Nothing surges outside the named parts, which hold most: the names are not believed.
        text = stretches([x[1] if x[2] <= NAMED else 0 for x in found], [c and o > NAMED for c, o in zip(cuts, outside)])
        outside = [0 if o <= NAMED else o for o in outside]
    keep = [i for a, b in text for i in range(a, b + 1) if not outside[i]]
    return keep or [i for i, weight in enumerate(weights) if weight]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages; a null page counts as empty and has an empty text.

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined by two line ends.  Repeated rows and null ids are returned as they come;
    other columns are not read; a page of any length is read whole; an empty table gives an
    empty result.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Query: the main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
