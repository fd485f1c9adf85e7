"""Main text of web pages: parser events to lines, text-to-tag ratios, smoothing, clusters of regions."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIGMA = 2.0
# Share of the standard deviation of smoothed ratios that a content line reaches.
THRESHOLD = 0.5
# Share of a line's text inside links from which it counts as a menu.
LINKED = 0.5
# Characters a tag, weighed and smoothed, that a content line has at least.
LEAST = 0.1
# What a line inside an article or main element has over the same line outside.
BONUS = 1.2
# Share of the leading region's ratio that another region reaches to be content too.
LIKE_LEAD = 1 / 3

# What a full mark leaves of a line's ratio, and share of a page's text from which a container's mark is void.
PENALTY = 0.02
MOST = 0.75

# Elements whose content is no text of the page or belongs to a form's fields, elements that may
# stand in a head, elements beside the article, elements that start a line, containers.
DROPPED = frozenset("script style noscript template svg canvas iframe object head title math "
                    "button select option textarea label".split())
IN_HEAD = frozenset("title style script noscript template base link meta".split())
BESIDE = frozenset("nav header footer aside form dialog menu".split())
UNCLOSED = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINES = frozenset("p div section article main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td "
                  "th thead tbody tfoot caption blockquote pre figure figcaption address hr details "
                  "summary center nav header footer aside form dialog menu".split())
CONTAINERS = frozenset("div section article main body html td details center nav header footer aside form "
                       "dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that mark what is not the article; those of reader comments; words that turn a
# name into a statement about the page ("no-sidebar", "share-enabled").
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
                  "banner sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs header "
                  "footer masthead cookie cookies consent notice notices alert popup modal newsletter "
                  "subscribe subscription signup share sharing social comment comments reply replies "
                  "disqus respond related recommended recommendations more pagination pager tags "
                  "toolbar search login copyright legal disclaimer contentinfo complementary".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
STATES = frozenset("no not non has have with without is enabled disabled on off open closed".split())
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Line:
    """One block of text: its container, its article (0 outside), whether an article or main element
    holds it, its innermost mark, tags met and characters inside links."""

    text: list[str]
    region: int
    article: int
    inside: bool
    mark: int
    heading: bool = False
    tags: int = 0
    linked: int = 0


@dataclass
class Mark:
    """An element that looks like no part of the article: the mark around it (0 is none), what it leaves of
    the ratios inside, and whether that holds for any share of the page's text."""

    around: int = 0
    weight: float = 1.0
    firm: bool = True


def name_mark(name: str) -> Mark:
    """The mark of one class, id or role: ``PENALTY`` if all its words are marks, or the last one is
    (``site-footer``), or one is of comments; its root if half of them are, and so on. A name without marks and
    a state (``no-sidebar``) leave a ratio as it is."""
    words = _PARTS.findall(name.lower())
    share = sum(w in MARKS for w in words) / max(1, len(words))
    if not share or not STATES.isdisjoint(words):
        return Mark(firm=False)
    comments = not COMMENTS.isdisjoint(words)
    return Mark(0, PENALTY if comments or words[-1] in MARKS else PENALTY ** share, comments)


def mark_of(tag: str, attributes: list[tuple[str, str | None]]) -> Mark | None:
    """The mark an element has by its tag, its names or by being hidden; None without one."""
    found = [Mark(0, PENALTY, tag == "nav")] if tag in BESIDE else []
    for key, value in attributes:
        if key in ("class", "id", "role") and value:
            found += [name_mark(name) for name in value.split()]
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            found.append(Mark(0, PENALTY, False))
    weight = min((mark.weight for mark in found), default=1.0)
    return Mark(0, weight, any(mark.firm for mark in found)) if weight < 1 else None


class _Reader(HTMLParser):
    """Turns parser events into lines; dropped elements yield none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Open elements: tag, whether it is dropped, whether it is marked, whether it is a region.
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.containers: list[int] = [0]
        # Container around each container, by number, and whether it may be judged with that one.
        self.parents: list[int] = [0]
        self.plain: list[bool] = [False]
        self.articles: list[int] = []
        self.marks: list[Mark] = [Mark()]
        self.mark = self.heads = self.dropped = self.links = self.count = self.inside = 0
        self.line = Line([], 0, 0, False, 0)

    def break_line(self) -> None:
        if self.line.text:
            self.lines.append(self.line)
        self.line = self.new_line()

    def new_line(self) -> Line:
        """A line of the innermost container."""
        return Line([], self.containers[-1], self.articles[-1] if self.articles else 0,
                    self.inside > 0, self.mark)

    def handle_starttag(self, tag, attrs):
        if self.heads and tag not in IN_HEAD:
            # A head needs no end tag: whatever may not stand in it ends it.
            self.close_to(next(k for k, element in enumerate(self.open) if element[0] == "head"))
        if tag in UNCLOSED:
            self.line.tags += 1
            if tag == "br":
                self.line.text.append(" ")
            elif tag == "hr":
                self.break_line()
            return
        drops = tag in DROPPED
        mark = None if drops or tag in ("html", "body", "article", "main") else mark_of(tag, attrs)
        region = tag in CONTAINERS or mark is not None
        if drops or region or tag in LINES:
            self.break_line()
        self.open.append((tag, drops, mark is not None, region))
        self.dropped += drops
        self.heads += tag == "head"
        if mark:
            mark.around, self.mark = self.mark, len(self.marks)
            self.marks.append(mark)
        if region:
            self.count += 1
            self.parents.append(self.containers[-1])
            self.plain.append(mark is None and tag not in ("article", "main", "body", "html"))
            self.containers.append(self.count)
        if tag == "article":
            self.articles.append(self.count)
        self.inside += tag in ("article", "main")
        if tag == "a":
            self.links += 1
        if region or drops:
            self.line = self.new_line()
        self.line.tags += 1
        if tag in HEADINGS:
            self.line.heading = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in UNCLOSED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), -1)
        if at < 0:
            return
        # An end tag of inline markup or of a paragraph closes no region that was opened inside it.
        _, drops, _, region = self.open[at]
        if not (drops or region) and any(d or r for _, d, _, r in self.open[at + 1:]):
            return
        self.close_to(at)
        self.line.tags += 1

    def close_to(self, at: int) -> None:
        """Ends the open elements from place ``at`` on."""
        while len(self.open) > at:
            name, drops, marked, region = self.open.pop()
            if drops or region or name in LINES:
                self.break_line()
            self.dropped -= drops
            self.heads -= name == "head"
            if marked:
                self.mark = self.marks[self.mark].around
            if region:
                self.containers.pop()
            if name == "article":
                self.articles.pop()
            self.inside -= name in ("article", "main")
            if name == "a":
                self.links -= 1
        fresh = self.new_line()
        self.line.region, self.line.article, self.line.inside, self.line.mark = (
            fresh.region, fresh.article, fresh.inside, fresh.mark)

    def handle_data(self, data):
        if self.dropped or (not self.line.text and data.isspace()):
            return
        self.line.text.append(data)
        if self.links:
            self.line.linked += len(data.strip())


def line_weights(marks: list[Mark], at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The product of the marks around each line, given its innermost mark and its characters outside links.

    A mark around ``MOST`` of all characters or more is void unless it is firm.
    """
    held = np.bincount(at, size, minlength=len(marks))
    for k in range(len(marks) - 1, 0, -1):
        held[marks[k].around] += held[k]
    weight = np.ones(len(marks))
    for k, mark in enumerate(marks[1:], 1):
        void = not mark.firm and held[k] >= MOST * held[0]
        weight[k] = max(weight[mark.around] * (1.0 if void else mark.weight), PENALTY)
    return weight[at]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios after a Gaussian filter of radius ``2 * sigma``, with the ends mirrored."""
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="symmetric"), kernel / kernel.sum(), mode="valid")


def judged_with(regions: list[int], parents: list[int], plain: list[bool]) -> list[int]:
    """The region each line is judged with: its container, or the one around it while a plain container
    holds one line only (a ``div`` or cell in place of a paragraph)."""
    held = Counter(regions)
    moved: dict[int, int] = {}
    for region in sorted(held, reverse=True):
        at = region
        while plain[at] and held[at] == 1:
            at = parents[at]
            if at in held:
                break
        moved[region] = at
    return [moved[r] for r in regions]


def main_text(html: str | None) -> str:
    """Blocks of the article, joined by a line break; empty if there is none.

    Every block is a line with a ratio of characters to tags, higher by a bonus inside an ``article`` or
    ``main``, lower inside marks: elements beside the article (``nav``, ``aside``) and those whose names say so
    (``cookie-notice``). Tags and names decide nothing else about a line; only scripts, styles, the head and the
    fields of forms are never text. A mark around most of a page's text counts as none, but for ``nav`` and
    comments, which may well be longer than their article. Smoothed ratios are weighed by their own line's
    marks again, as its neighbours may be the article. Lines that are mostly links are menus, inside an
    article too, and count as 0; linked headings also count as 0 but stay with their region. Lines whose
    smoothed ratio reaches a share of its standard deviation are content. Regions are containers. The one
    with most content leads; it and every region that has content and, over its text, a ratio like the
    leader's are chosen with all their lines, short ones too. A content line of another region
    joins a chosen region of its own article; outside articles, if it is a heading or chosen lines lie
    on both sides of it. White space inside a block becomes one space.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.break_line()
    lines = [(line, _SPACE.sub(" ", "".join(line.text)).strip()) for line in reader.lines]
    lines = [(line, text) for line, text in lines if text]
    if not lines:
        return ""
    size = np.array([len(text) for _, text in lines], dtype=np.float64)
    linked = np.array([line.linked >= LINKED * len(text) for line, text in lines])
    menu = linked & ~np.array([line.heading for line, _ in lines])
    weight = line_weights(reader.marks, np.array([line.mark for line, _ in lines]), np.where(linked, 0.0, size))
    ratios = np.array([len(text) / max(1, line.tags) * (BONUS if line.inside else 1.0)
                       for line, text in lines]) * weight
    score = np.where(linked, 0.0, ratios)
    level = smoothed(score) * weight
    least = max(THRESHOLD * level.std(), LEAST)
    content = (level >= least) & ~linked
    if not content.any():
        return ""
    own = [line.region for line, _ in lines]
    names, region = np.unique(judged_with(own, reader.parents, reader.plain), return_inverse=True)
    text_size = np.bincount(region, size * ~menu)
    density = np.bincount(region, size * score * ~menu) / np.maximum(text_size, 1.0)
    mass = np.bincount(region, size * level * content)
    core = (np.bincount(region, content) > 0) & (
        density >= max(least, LIKE_LEAD * density[mass.argmax()]))
    core[mass.argmax()] = True
    article = np.array([line.article for line, _ in lines])
    # Lines judged with a container further out are not free to join outside articles: they must be content.
    chosen = core[region] & ~menu & (content | (names[region] == own) | (article > 0))
    firm = np.flatnonzero(chosen)
    place = np.arange(len(lines))
    between = (place > firm[0]) & (place < firm[-1]) | np.array([line.heading for line, _ in lines])
    joins = np.where(article > 0, np.isin(article, article[firm]), between)
    chosen |= (level >= least) & ~menu & joins
    return "\n".join(text for (_, text), c in zip(lines, chosen) if c)


@F.pandas_udf(StringType())
def _texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(html) for html in pages], dtype="object")


def extract_text(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each as one more column, in one pass without a shuffle. Null and
    empty pages and pages without a line of text give an empty text. An existing column is replaced."""
    return pages.withColumn(name, _texts(F.col(html_column)))
