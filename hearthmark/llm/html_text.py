"""Main text of web pages: parser events, text-to-tag ratios of lines, Gaussian smoothing, two clusters.

The standard library's parser streams through the page once. Every block of text becomes a line with its number of
characters and of tags; their ratio is smoothed over neighbouring lines and a threshold between the two clusters of
ratios (two-means) marks content lines. Regions so found are widened to the article or main elements that hold any of
them, else to the element that the outer ones share; short lines between and beside content lines stay. Elements that hold
no article text (menus, headers, footers, sidebars, forms, notices, adverts, comments, scripts) are left out by tag, role, or
the words of their class and id; such words tell nothing of an element that holds the article itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import map_batches, text_or_empty

SIGMA = 1.0      # of the smoothing, in lines
REACH = 3        # lines on either side that the smoothing looks at
APART = 2.0      # least distance of the cluster centres, in natural logarithms of the ratio
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CHROME_TAGS = frozenset("aside button dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CHROME_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu "
                         "modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar social sponsor "
                         "sponsored subscribe toolbar widget".split())
# An article element of its own is left out by these words only: its class may well name its surroundings.
SIDE_ARTICLE_WORDS = frozenset("ad ads advert advertisement comment comments promo promoted related sponsored".split())
# An end tag of these closes what is still open inside; a start tag closes an open element of the same kind.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
          "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
# Marks of chrome: by a form or a part of a class name (has-sidebar), by a whole name (sidebar), by tag or role.
MAYBE, LIKELY, SURE = 1, 2, 3
PROSE = 40            # characters from which a line counts as a paragraph
BOXES = frozenset("article center div main section td th".split())
_UNFINISHED = re.compile("<[A-Za-z/!?]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _chrome(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """How surely an element is chrome: MAYBE, LIKELY, SURE, or 0.

    A section of an article is judged by whole names: 'related' is a list of links, 'related-work' may be a chapter. The
    header of an article may hold its title.
    """
    if tag in CHROME_TAGS and not (tag == "form" or tag == "header" and in_article):
        return SURE
    if tag in ("body", "html"):
        return 0
    kind = {"form": MAYBE, "header": LIKELY}.get(tag, 0)
    words = SIDE_ARTICLE_WORDS if tag in ("article", "main") else CHROME_WORDS
    for name, value in attrs:
        if name == "role" and (value or "").lower() in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        if name in ("class", "id") and value:
            if not words.isdisjoint(value.lower().split()):
                kind = LIKELY
            elif not (tag == "section" and in_article) and not words.isdisjoint(p.lower() for p in _PARTS.findall(value)):
                kind = max(kind, MAYBE)
    return kind


class Place(NamedTuple):
    """What surrounds a text: its article or main element, innermost mark and box (0: none), and whether it is a first heading."""
    article: int = 0
    mark: int = 0
    box: int = 0
    title: bool = False


class Line(NamedTuple):
    text: str
    tags: int
    at: Place


class Open(NamedTuple):
    tag: str
    hidden: bool
    at: Place
    box: int      # the box that the element itself is, or 0


class Lines(HTMLParser):
    """Lines of a page outside of sure chrome. Articles, marks and boxes are numbered in page order; lists tell of each number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = 0
        self.article_tag, self.article_mark = [""], [0]      # its tag, and the mark that it lies in
        self.mark_above, self.mark_kind = [0], [0]
        self.box_above, self.box_last = [0], [0]             # the last box inside, once it is closed

    def _break(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.lines.append(Line(text, self.tags, self.open[-1].at if self.open else Place()))
            self.tags = 0

    def _close(self, at: int) -> None:
        if any(e.tag in BLOCK for e in self.open[at:]):
            self._break()
        for e in self.open[at:]:
            if e.box:
                self.box_last[e.box] = len(self.box_above) - 1
        del self.open[at:]

    def _place(self, tag: str, around: Place, kind: int) -> Place:
        article, mark, box, title = around
        if kind in (MAYBE, LIKELY):
            self.mark_above.append(mark), self.mark_kind.append(kind)
            mark = len(self.mark_above) - 1
        elif tag == "article" and self.article_tag[article] != "article" or tag == "main" and not article:
            self.article_tag.append(tag), self.article_mark.append(mark)
            article = len(self.article_tag) - 1
        if tag in BOXES:
            self.box_above.append(box), self.box_last.append(0)
            box = len(self.box_above) - 1
        return Place(article, mark, box, title or tag == "h1")

    def handle_starttag(self, tag, attrs):
        if self.open and tag in CLOSES.get(self.open[-1].tag, ()):
            self._close(len(self.open) - 1)
        if tag in BLOCK:
            self._break()
        elif tag in ("br", "wbr"):
            self.text.append(" ")
        hidden, around = (self.open[-1].hidden, self.open[-1].at) if self.open else (False, Place())
        self.tags += not hidden
        if tag not in VOID:
            kind = _chrome(tag, attrs, around.article > 0)
            at = self._place(tag, around, kind)
            self.open.append(Open(tag, hidden or kind == SURE, at, at.box if at.box != around.box else 0))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                self._close(at)
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1].hidden):
            self.text.append(data)

    def close(self):
        if _UNFINISHED.match(self.rawdata):   # a tag or comment that the page breaks off in is no text
            self.rawdata = ""
        super().close()
        self._break()
        self._close(0)

    def marks_of(self, mark: int) -> list[int]:
        """The mark and those around it."""
        chain = []
        while mark:
            chain.append(mark)
            mark = self.mark_above[mark]
        return chain

    def outside(self, cleared: Iterable[int]) -> list[bool]:
        """Of each mark: whether what lies in it counts as text, as it and all marks around it are ``cleared``."""
        cleared, free = set(cleared), [True]
        for mark in range(1, len(self.mark_above)):
            free.append(free[self.mark_above[mark]] and mark in cleared)
        return free

    def shared_box(self, one: int, other: int) -> int:
        """The innermost box that holds both; 0 is the page."""
        while one and not one <= other <= self.box_last[one]:
            one = self.box_above[one]
        return one

    def inside(self, box: int, inner: int) -> bool:
        """Whether a box lies in another one; in the page itself lies only what is in no box."""
        return box <= inner <= self.box_last[box] if box else not inner


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(ratios, REACH, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_threshold(values: np.ndarray) -> float:
    """Border between the two clusters of values; the smallest value if they are less than APART apart."""
    low, high = values.min(), values.max()
    while high - low >= APART:
        border = (low + high) / 2
        new = (values[values < border].mean(), values[values >= border].mean())
        if new == (low, high):
            return border
        low, high = new
    return values.min()


def prose(lines: Iterable[Line]) -> int:
    return sum(len(line.text) for line in lines if len(line.text) >= PROSE)


def article_of(page: Lines) -> int:
    """The article or main element with most text; one that lies in chrome only if all paragraphs do. 0: none."""
    free = page.outside(())
    sizes: dict[int, int] = {}
    for line in page.lines:
        if line.at.article:
            sizes[line.at.article] = sizes.get(line.at.article, 0) + len(line.text)
    good = [a for a in sizes if free[page.article_mark[a]]]
    if not good and not prose(line for line in page.lines if free[line.at.mark]):
        good = list(sizes)
    return max(good, key=lambda a: (page.article_tag[a] == "article", sizes[a]), default=0)


def cleared_marks(page: Lines, article: int, title: Line | None) -> set[int]:
    """Marks that hold the article itself and so are none of chrome.

    Those around the article element. Without one, those around the title and paragraphs, and where all paragraphs lie in
    marks the ones with most of them; a whole name such as 'comments' is only cleared for a title.
    """
    if article:
        return set(page.marks_of(page.article_mark[article]))
    held: dict[int, int] = {}
    for line in page.lines:
        if len(line.text) >= PROSE and not line.at.title:
            for m in page.marks_of(line.at.mark):
                held[m] = held.get(m, 0) + len(line.text)
    free = page.outside(())
    bare = not prose(line for line in page.lines if free[line.at.mark] and not line.at.title)
    cleared = {m for m in page.marks_of(title.at.mark) if held.get(m) and (bare or page.mark_kind[m] == MAYBE)} if title else set()
    while True:
        free = page.outside(cleared)
        if prose(line for line in page.lines if free[line.at.mark] and not line.at.title):
            return cleared
        next_ones = [m for m in held if not free[m] and free[page.mark_above[m]] and page.mark_kind[m] == MAYBE]
        if not next_ones:
            return cleared
        cleared.add(max(next_ones, key=held.__getitem__))


def main_text(html: str) -> str:
    """Blocks of the main text in page order, joined by an empty line."""
    page = Lines()
    page.feed(html)
    page.close()
    article = article_of(page)
    plain = page.outside(())
    heads = [line for line in page.lines if line.at.title and (not article or line.at.article == article)]
    title = next((line for line in heads if plain[line.at.mark]), heads[0] if heads else None)
    free = page.outside(cleared_marks(page, article, title))
    if title and not article and page.mark_kind[title.at.mark] == LIKELY and not free[title.at.mark]:
        title = None   # of a page without an article element: the site's own header
    lines = [line for line in page.lines if free[line.at.mark] or line is title]
    if not lines:
        return ""
    sizes = np.array([len(line.text) for line in lines], float)
    ratio = np.log(smoothed(sizes / np.maximum(1, [line.tags for line in lines])))
    content = ratio >= content_threshold(ratio)
    kind = page.article_tag[article]
    if article and any(c and line.at.article for c, line in zip(content, lines)):
        # all articles that stand beside each other in a page of several
        return "\n\n".join(line.text for line in lines if line.at.article and (kind == "main" or page.article_tag[line.at.article] == kind))
    at = np.flatnonzero(content)
    low, high = at[0], at[-1]
    first, last = (page.shared_box(lines[a].at.box, lines[b].at.box) for a, b in ((low, at[min(1, len(at) - 1)]), (at[max(-2, -len(at))], high)))
    while low and page.inside(first, lines[low - 1].at.box):
        low -= 1
    while high + 1 < len(lines) and page.inside(last, lines[high + 1].at.box):
        high += 1
    return "\n\n".join(line.text for k, line in enumerate(lines) if low <= k <= high or line is title and k < low)


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points). Null and empty html, and pages without main text: an empty text.

    Broken html is read as far as the parser gets, which is to its end. Very long pages are read whole. Repeated rows get
    equal results, an empty table an empty result; other columns are not looked at.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return map_batches(p, run, "page_id long, url string, text string, n_chars long")
