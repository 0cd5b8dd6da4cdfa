"""Main text of HTML pages from streaming parser events.

The standard library's parser feeds events to a reader that cuts the page into lines, one for each block, with their
characters and tags. Characters in links and menus weigh nothing, so a menu's ratio is zero whatever its names. The
text-to-tag ratios of all lines are smoothed by a Gaussian, and the threshold that parts the smoothed ratios into two clusters (least
variance within them) chooses the content lines. Where most of their characters stand in article or main elements, the
text is all that these hold, short or of links alone. Else it is every container (nearest section, division, cell,
list) that has a content line, or that holds no more characters in links than outside of them.

What the page itself says isn't the article is left out before: by element, role, or a class or id. A name made of marking
words alone marks at once; a name that has one beside others (`user-comments`) marks unless the element holds the article, its
title or half of the page. Nothing in a marked element ends a line or an element outside of it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import extended, fresh, prepare, table

#: Fixed values of HTML: elements without content, elements that start a line, containers, lists, what a head holds,
#: and for elements that end the one before them, whose end they stop at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
REGION = frozenset("article main section div td body nav".split())
LIST = frozenset("ul ol dl table".split())
HEAD = frozenset("head title meta link script style base noscript template".split())
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}
#: Elements and roles that aren't the article.
ASIDE = frozenset("head title style script noscript template footer aside form button select option textarea iframe object svg canvas dialog audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
#: Words that mark what isn't the article where a class or id is made of them and of plain ones.
WORDS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices alert popup popups modal overlay newsletter subscribe subscription signup login sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead footer footers comment comments commentlist disqus reply replies respond related recommended share sharing social pagination pager toolbar widget copyright disclaimer".split())
PLAIN = frozenset("box boxes container wrapper wrap block top bottom left right site page main inner outer area list item items section bar link links button buttons icons form post posts article articles content text header head title body column col row small large big the and".split())
#: Those that mark beside any other words too, and what follows one of them where it says something else.
CLEAR = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsored cookie cookies consent gdpr popup popups newsletter sidebar sidebars navbar breadcrumb breadcrumbs topbar masthead comment comments commentlist disqus pagination".split())
OTHERWISE = frozenset("hoc lib".split())
#: Whole classes that mark outside of articles only, and elements that no class or id marks.
ALONE = frozenset("header site-header page-header header-main main-header".split())
OWN = frozenset("html body main h1 pre".split())
SIGMA = 1.0
_SPLIT = re.compile(r"[^a-z]+")
_OPEN = re.compile(r"<[A-Za-z/!?]")


def marks(name: str) -> int:
    """2 where a class or id says by all of its words that this isn't the article (`ad-box`), 1 where by one beside others (`ad-slot`)."""
    parts = [x for x in _SPLIT.split(name) if x]
    if WORDS.isdisjoint(parts):
        return 0
    if all(x in WORDS or x in PLAIN for x in parts):
        return 2
    return int(not CLEAR.isdisjoint(parts) and OTHERWISE.isdisjoint(parts))


class _Line(NamedTuple):
    """A block's text, its characters outside of links and menus, its tags and where it stands."""

    text: str
    weight: int
    tags: int
    region: int
    article: int
    menu: bool


class _Reader(HTMLParser):
    """Lines of a page.

    Open elements of each name are known by their places, so an end tag costs what it closes, and a stray one nothing.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple] = []  # tag and the state outside of it
        self.at: dict[str, list[int]] = defaultdict(list)
        self.walls, self.blocks = [-1], [-1]  # places of open regions and of what a paragraph ends at
        self.region, self.article, self.marked, self.doubt, self.menu, self.link, self.regions = 0, -1, -1, 0, False, False, 1
        self.articles = 0
        self.parts: list[tuple[str, bool, int]] = []  # characters, whether they weigh, the doubtful element they are in
        self.tags = 0
        self.held: list[tuple] = []
        # Of elements whose name may mark them: the one around, whether the article or its title is in it, its characters.
        self.around, self.core, self.size = [0], [True], [0]

    def end_line(self) -> None:
        if any(not text.isspace() for text, *_ in self.parts):
            self.held.append((self.parts, self.tags, self.region, self.article, self.menu))
            self.tags = 0
        self.parts = []

    def lines(self) -> list[_Line]:
        """Lines without what the names of elements mark; such an element is kept if it has the article, its title or half of the page."""
        size = self.size[:]
        for k in range(len(size) - 1, 0, -1):
            size[self.around[k]] += size[k]
        gone = [False]
        for k in range(1, len(size)):
            gone.append(gone[self.around[k]] or not self.core[k] and 2 * size[k] < size[0])
        out = []
        for parts, *at in self.held:
            text = " ".join("".join(x for x, _, k in parts if not gone[k]).split())
            if text:
                weight = len(" ".join("".join(x for x, weighs, k in parts if weighs and not gone[k]).split()))
                out.append(_Line(text, weight, *at))
        return out

    def mark_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in ASIDE or tag in ("nav", "menu") and self.article >= 0 or tag == "header" and self.article < 0:
            return 2
        # The page's first article is one whatever its names say.
        own, found = tag in OWN or tag == "article" and not self.articles, 0
        for name, value in attrs:
            if name in ("class", "id") and value:
                for c in value.lower().split() if not own else ():
                    found = max(found, marks(c), 2 * (self.article < 0 and c in ALONE))
            elif name == "role" and (value or "").lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return 2
        return found

    def leave(self, i: int) -> None:
        """Close the open elements from place i on."""
        _, self.region, self.article, self.marked, self.doubt, self.menu, self.link = self.stack[i]
        for tag, *_ in self.stack[i:]:
            self.at[tag].pop()
        del self.stack[i:]
        for places in (self.walls, self.blocks):
            while places[-1] >= i:
                places.pop()

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if tag not in HEAD and self.at["head"] and self.last("template", "noscript") < self.at["head"][0]:
            self.leave(self.at["head"][0])  # the end of a head may be left out
        if block:
            if self.marked < 0:
                self.end_line()
            if self.last("p") > self.blocks[-1]:
                self.leave(self.last("p"))
            if tag in ENDS and self.last(*ENDS[tag][0]) > max(self.last(*ENDS[tag][1]), self.marked - (self.marked >= 0 and self.last(*ENDS[tag][0]) == self.marked)):
                self.leave(self.last(*ENDS[tag][0]))
        elif tag == "a" and self.last("a") > max(self.walls[-1], self.marked):
            self.leave(self.last("a"))
        self.tags += self.marked < 0
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        place = len(self.stack)
        self.stack.append((tag, self.region, self.article, self.marked, self.doubt, self.menu, self.link))
        self.at[tag].append(place)
        if self.marked >= 0:
            if block and tag != "p":
                self.blocks.append(place)
            return
        mark = self.mark_of(tag, attrs) if attrs or tag in ASIDE or tag in ("header", "nav", "menu") else 0
        if block and tag != "p" or mark == 2:
            self.blocks.append(place)
        if mark == 2:
            self.marked = place
            return
        if mark:
            self.around.append(self.doubt)
            self.core.append(False)
            self.size.append(0)
            self.doubt = len(self.core) - 1
        if tag in ("article", "main", "h1"):
            k = self.doubt
            while not self.core[k]:
                self.core[k] = True
                k = self.around[k]
        self.articles += tag == "article"
        if tag in REGION or tag in LIST:
            if tag in REGION:
                self.walls.append(place)
            self.region, self.regions = self.regions, self.regions + 1
            if self.article < 0 and tag in ("article", "main"):
                self.article = self.region
        self.menu = self.menu or tag in ("nav", "menu")
        # An anchor with a name but no address is a place, not a link.
        self.link = self.link or tag == "a" and (not attrs or any(name == "href" for name, _ in attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        block, inside = tag in BLOCK, self.marked >= 0
        if block and not inside:
            self.end_line()
        self.tags += not inside
        # A stray inline end tag closes nothing around it.
        if self.at[tag] and (block or self.at[tag][-1] > self.walls[-1]):
            closed = self.at[tag][-1]
            if inside and block and closed < self.marked:
                self.leave(self.marked)
                self.end_line()
            self.leave(closed)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and not data.isspace():
            self.leave(self.at["head"][0])
        if self.marked >= 0:
            return
        self.size[self.doubt] += len(data) - data.count(" ")
        self.parts.append((data, not (self.link or self.menu), self.doubt))


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted mean of the neighbours within three sigma."""
    r = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    weight = np.convolve(np.ones(len(ratios)), kernel)[r : r + len(ratios)]
    return np.convolve(ratios, kernel)[r : r + len(ratios)] / weight


def parting(scores: np.ndarray) -> float:
    """The least score of the upper of two clusters: those of the least variance within them, by the scores' logarithms."""
    values = np.sort(scores)
    x = np.log1p(values)
    n, total = np.arange(1, len(x)), x.cumsum()
    if not len(n) or x[-1] - x[0] < 1e-9:
        return float(values[0])
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(x) - n)
    return float(values[int(np.argmax(n * (len(x) - n) * (high - low) ** 2)) + 1])


def choose(lines: list[_Line], sigma: float = SIGMA) -> list[int]:
    """Places of the lines that are the main text."""
    weight = np.array([line.weight for line in lines])
    if not weight.any():  # a page of links alone
        weight = np.array([0 if line.menu else len(line.text) for line in lines])
    heavy = np.flatnonzero(weight)
    if not len(heavy):
        return []
    scores = smooth(weight / np.array([max(1, line.tags) for line in lines]), sigma)
    content = heavy[scores[heavy] >= parting(scores[heavy])]
    if 2 * sum(weight[i] for i in content if lines[i].article >= 0) >= weight[content].sum():
        return [i for i, line in enumerate(lines) if line.article >= 0]
    whole = {lines[i].region for i in content}
    plain, linked = defaultdict(int), defaultdict(int)
    for line, w in zip(lines, weight, strict=True):
        plain[line.region] += int(w)
        linked[line.region] += len(line.text) - int(w)
    return [i for i, line in enumerate(lines) if line.region in whole or plain[line.region] >= linked[line.region]]


def ended(html: str) -> str:
    """html without a tag that its end cuts off, and with no comment or section that never ends: a parser looks for the end of each.

    Such a comment is made empty, so what follows is read as the page goes on.
    """
    for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
        end = html.rfind(closing) + 1
        html = html[:end] + html[end:].replace(opening, "<!---->")
    end = html.rfind(">") + 1
    cut = _OPEN.search(html, end)
    return html[: cut.start()] if cut else html


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The page's main text, a line for each block; empty for null, empty and contentless pages."""
    reader = _Reader()
    reader.feed(ended(html or ""))
    reader.close()
    reader.end_line()
    lines = reader.lines()
    return "\n".join(lines[i].text for i in choose(lines, sigma))


def extract(pages: DataFrame, html: str = "html", sigma: float = SIGMA) -> DataFrame:
    """pages without their html and with `text`, the main text of the whole page.

    Null and empty pages give an empty text. Rows, ties and other columns pass through; where pages
    already has a column `text`, the new one is `text_1`.
    """
    prepare(pages.sparkSession)
    arg, out = fresh(pages, "_html", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h, sigma) for h in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*b.schema.names[:-1], out])

    rest = pages.drop(html)
    fed = pages.withColumn(arg, F.col(f"`{html}`").cast("string")).drop(html)
    return fed.mapInArrow(run, extended(rest.schema, (out, "string")))


def query(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
