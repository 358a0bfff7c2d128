"""Main-text extraction from HTML by text-to-tag ratios over a stream of parser events.

Parser events are gathered into lines (blocks), each with the length of its text outside
links and the number of tags in it. The ratios text / (tags + 1) of the lines are smoothed
with a Gaussian. A threshold taken from the spread of the page's smoothed ratios parts the
lines into content and what is not: landmarks (article, main) with no line above it go, as
do boxes (div, section, list, table, ...) whose lines lie below it on the mean and whose text is
mostly links; on a page without landmarks what lies before the first line above the
threshold and after the last goes too. Lines within elements whose role is not the article
(menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles,
hidden elements) have no ratio and are never content. Names of class and id tell such a role
only where the element isn't the page's layout: around the article, main or most of the text,
or most of an article. Words that may as well describe an article's own parts (search, notice,
related, ...) name a role only if the whole name is made of such words, and within an
article they are only a suspicion: the element goes if its lines lie below the threshold on the mean
or are mostly links. Headings that lead to the first line above the threshold are content with it.

Null or empty html gives an empty text; an empty table gives no rows; repeated rows are read
one by one; ratios that tie with the threshold count as above it. Unclosed and badly nested
tags are tolerated; the whole page is read, in time proportional to its length. A column of
the output's name is replaced; all others are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags inside a line of text; every other tag ends a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
SKIP = frozenset("head title script style noscript template nav footer aside form button select textarea option iframe object svg canvas menu dialog input audio video map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar tablist status".split())
#: Words of class and id that name what is not the article.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted
    nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination sitemap
    masthead topbar footer bottombar copyright colophon sidebar widget widgets
    comment comments commentlist disqus reply replies respond feedback
    cookie cookies consent gdpr popup paywall share sharing newsletter subscribe signup""".split()
)
#: Words that name it only where nothing else is in the name.
WEAK = frozenset(
    """banner pager toc header foot legal aside rail related recommended recommendations trending popular discussion reactions
    notice notices notification alert modal overlay social follow subscription login search searchbox form skip""".split()
)
#: Words of layout that say nothing themselves.
PLAIN = frozenset("""box block list links link bar wrap wrapper container section area panel inner outer item items post posts story stories article articles site page top bottom left right
    the us me on to by main more read module group row col column content div""".split())
#: An element of these names is the article, whatever else its class says.
CONTENT = frozenset("article main".split())
#: What may stand in a head; any other element ends it.
HEAD = frozenset("html head title meta link base script style noscript template".split())
#: What lines are taken together by.
BOXES = frozenset("body div section article main ul ol dl table figure details blockquote center fieldset".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    def __init__(self, pardoned: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.pardoned, self.count = pardoned, -1  # elements whose names say nothing of them, by number
        self.hard = 0  # open elements that are skipped whatever their names say
        self.near: list[tuple[int, bool]] = []  # of the stack's elements: innermost element with a layout name, hard
        self.parent: dict[int, int] = {}  # of elements with a layout name
        self.within: dict[int, int] = {}  # of elements with a layout name: innermost article or main
        self.written: dict[int, int] = {}  # text by innermost article or main
        self.outer: dict[int, int] = {}  # of articles and mains: the next around them
        self.places: dict[str, list[int]] = {}  # of open elements by tag, in the stack
        self.blocks: list[int] = []  # places of open elements that aren't inline
        self.landmarks: list[tuple[int, int]] = []  # places and numbers of open articles and mains
        self.doubts: list[tuple[int, int]] = []  # places and numbers of open elements with a weak name
        self.size: dict[int, int] = {-1: 0}  # text by innermost element with a layout name
        self.marks: list[tuple[str, int]] = []  # article and main elements, innermost element with a layout name
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, skipped, region and box that it is in or opens
        self.open: Counter[str] = Counter()  # open elements by tag
        self.skipped, self.regions, self.boxes = 0, 1, 1
        self.lines: list[tuple[str, int, int, int, int, int, int]] = []  # text, tags, region, box, characters of links, level of heading, element in doubt
        self.text: list[str] = []
        self.tags = self.linked = 0

    @property
    def region(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            level = next((k for k in range(1, 7) if self.open[f"h{k}"]), 0)
            self.lines.append((text, self.tags, self.region, self.stack[-1][3] if self.stack else 0, self.linked, level, self.doubts[-1][1] if self.doubts else 0))
        self.text, self.tags, self.linked = [], 0, 0

    def never(self, tag: str, attrs: list) -> bool:
        """Whether the element is skipped by what it is."""
        if tag in SKIP:
            return True
        if tag == "header":
            return not self.region
        return any(k == "hidden" or v and (k == "role" and v.lower() in ROLES or k == "aria-hidden" and v.lower() == "true" or k == "style" and _NO_DISPLAY.search(v)) for k, v in attrs)

    def named(self, tag: str, attrs: list) -> int:
        """2 if class or id name what is not the article, 1 if they may, else 0. An article within an article (a comment) has names too."""
        if tag in ("html", "body", "main") or tag == "article" and not self.open["article"]:
            return 0
        found = 0
        for k, v in attrs:
            if v and k in ("class", "id"):
                for name in v.split():
                    words = [w.lower() for w in _SPLIT.split(name) if w]
                    if any(w in NAMES for w in words):
                        return 2
                    if any(w in WEAK for w in words) and all(w in WEAK or w in PLAIN or w.isdigit() for w in words):
                        found = 1
        return found

    def pardon(self) -> frozenset[int]:
        """Elements that only lay the page out, though a name of theirs is of what is not the article.

        While no article or main is free of such elements, from the outermost ones: those that
        hold a main, else those that hold most of the page's text, else those that hold an
        article. Then those within an article or main that hold most of its text. Each element is
        looked at once.
        """
        size, written = dict(self.size), dict(self.written)
        for k in sorted(self.parent, reverse=True):
            size[self.parent[k]] = size.get(self.parent[k], 0) + size.get(k, 0)
        for k in sorted(self.outer, reverse=True):
            written[self.outer[k]] = written.get(self.outer[k], 0) + written.get(k, 0)
        inner: dict[int, list[int]] = {}
        for k, up in self.parent.items():
            inner.setdefault(up, []).append(k)
        holds: dict[str, set[int]] = {tag: set() for tag in CONTENT}
        for tag, k in self.marks:
            while k >= 0 and k not in holds[tag]:
                holds[tag].add(k)
                k = self.parent[k]
        free = {k for _, k in self.marks}
        done: set[int] = set()
        waiting: list[list[int]] = [[], [], []]

        def enter(around: int) -> None:
            for k in inner.get(around, ()):
                for rank, fits in enumerate((k in holds["main"], 2 * size.get(k, 0) > size[-1], k in holds["article"])):
                    if fits:
                        waiting[rank].append(k)
                        break

        enter(-1)
        reached = -1 in free
        while not reached and any(waiting):
            rank = next(r for r in range(3) if waiting[r])
            more, waiting[rank] = waiting[rank], []
            done.update(more)
            reached = any(k in free for k in more)
            for k in more:
                enter(k)
        for k in sorted(self.parent):  # what lies around an element comes before it
            at, up = self.within[k], self.parent[k]
            if at and k not in done and (up < 0 or up in done or self.within[up] != at) and 2 * size.get(k, 0) > written.get(at, 0):
                done.add(k)
        return frozenset(done)

    def end_head(self, now: bool) -> None:
        """The end tag of the head may be left out."""
        if self.open["head"] and (self.stack[-1][0] == "head" or now):
            self.cut(self.places["head"][0])

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self.end_head(tag == "body")
        if tag not in INLINE:
            self.end_line()
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                self.imply(tag)
        self.tags += 1
        if tag == "br":
            self.text.append("\n")
        if tag in VOID:
            return
        self.count += 1
        hard, near = self.never(tag, attrs), self.near[-1][0] if self.near else -1
        bad, region = hard, self.region
        box = self.stack[-1][3] if self.stack else 0
        if tag in BOXES:
            box, self.boxes = self.boxes, self.boxes + 1
        names = 0 if hard else self.named(tag, attrs)
        if names == 1 and self.landmarks:
            self.doubts.append((len(self.stack), self.count))  # the ratios tell
        elif names:
            self.parent[self.count] = near
            self.within[self.count] = self.landmarks[-1][1] if self.landmarks else 0
            near, bad = self.count, self.count not in self.pardoned
        self.hard += hard
        if tag in CONTENT and not self.hard:
            self.marks.append((tag, near))
            self.outer[self.count] = self.landmarks[-1][1] if self.landmarks else 0
            self.landmarks.append((len(self.stack), self.count))
        if tag in CONTENT and not bad and not self.skipped:
            region = self.regions
            self.regions += 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, bad, region, box))
        self.open[tag] += 1
        self.near.append((near, hard))
        self.skipped += bad

    def imply(self, tag: str) -> None:
        """A new p, li, ... ends an open one, with what is open inside it, unless a container lies between."""
        if self.blocks:
            at = self.stack[self.blocks[-1]][0]
            if at == tag or tag in ("td", "th") and at in ("td", "th") or tag in ("dt", "dd") and at in ("dt", "dd"):
                self.cut(self.blocks[-1])

    def cut(self, k: int) -> None:
        for tag, bad, _, _ in self.stack[k:]:
            self.skipped -= bad
            self.open[tag] -= 1
            self.places[tag].pop()
        self.hard -= sum(hard for _, hard in self.near[k:])
        del self.stack[k:], self.near[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        for places in (self.landmarks, self.doubts):
            while places and places[-1][0] >= k:
                places.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("svg",) and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if not self.open[tag]:
            return
        k = self.places[tag][-1]
        if tag not in INLINE or not any(self.places.get(c) and self.places[c][-1] > k for c in CONTENT):
            self.cut(k)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.end_head(True)
        if not self.hard:
            at = self.near[-1][0] if self.near else -1
            self.size[at] = self.size.get(at, 0) + len(data.strip())
            if self.landmarks:
                self.written[self.landmarks[-1][1]] = self.written.get(self.landmarks[-1][1], 0) + len(data.strip())
        if not self.skipped:
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, renormalised at the ends."""
    r = int(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(values, w)[r : r + len(values)]
    return full / np.convolve(np.ones(len(values)), w)[r : r + len(values)]


def _read(html: str, pardoned: frozenset[int] = frozenset()) -> _Lines:
    p = _Lines(pardoned)
    p.feed(html)
    p.close()
    p.end_line()
    return p


def main_text(html: str | None, sigma: float = 1.0, spread: float = 0.5) -> str:
    """The article of one page: blocks in page order joined by one space.

    sigma: of the smoothing, in lines. spread: the threshold, in standard deviations of
    the page's smoothed ratios. A landmark is content if its highest smoothed ratio reaches
    it (the best one always is); where a page has landmarks only they can be content, else
    it is what lies from the first line that reaches the threshold to the last. A box of
    which the mean is below the threshold and more than half of the text is links is not.
    """
    if not html:
        return ""
    p = _read(html)
    pardoned = p.pardon()
    if pardoned:
        p = _read(html, pardoned)
    if not p.lines:
        return ""
    text, tags, region, box, linked, level, doubt = zip(*p.lines, strict=True)
    size = np.array([len(t) for t in text])
    linked = np.minimum(linked, size)
    region, box, level, doubt = np.array(region), np.array(box), np.array(level), np.unique(doubt, return_inverse=True)[1] if any(doubt) else np.zeros(len(text), int)
    soft = smooth((size - linked) / (np.array(tags) + 1), sigma)
    threshold = spread * soft.std()
    written = size > 0
    if not written.any():
        return ""
    total = lambda by, values: np.bincount(by[written], values[written])
    below = total(box, soft) < threshold * total(box, np.ones(len(size)))
    links = written & below[np.minimum(box, len(below) - 1)] & (2 * total(box, linked) > total(box, size))[np.minimum(box, len(below) - 1)]
    if doubt.any():  # 0: not in doubt, as the lowest number
        low = (total(doubt, soft) < threshold * total(doubt, np.ones(len(size)))) | (2 * total(doubt, linked) > total(doubt, size))
        low[0] &= not (np.array(p.lines, object)[:, 6] == 0).any()
        links |= written & low[np.minimum(doubt, len(low) - 1)]
    if links[written].all():
        links[:] = False
    content = written & ~links
    best = np.zeros(region.max() + 1)
    np.maximum.at(best, region[content], soft[content])
    marked = content & (region > 0)
    if marked.any():
        keep = marked & (best[region] >= min(threshold, best[region[marked]].max()))
    else:
        high = np.flatnonzero(content & (soft >= min(threshold, soft[content].max())))
        first = high[0]
        titles = np.flatnonzero(content[:first] & (level[:first] == 1))
        if len(titles):
            first = titles[-1]
        else:
            before = np.flatnonzero(content[:first])[::-1]
            for k in before:
                if not level[k]:
                    break
                first = k
        keep = content.copy()
        keep[:first] = keep[high[-1] + 1 :] = False
    return " ".join(text[k] for k in np.flatnonzero(keep))


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with a column `out`: the main text of the column `html`. Narrow: no shuffle."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in column], dtype=object)

    return pages.withColumn(out, run(F.col(html)))
