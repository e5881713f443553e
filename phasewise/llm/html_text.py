"""Main text of HTML pages by text-to-tag ratio.

Standard-library parser events become lines, one for each run of text between
block borders. A line's ratio is its characters over the tags in it. The ratios
are smoothed by a Gaussian ("CETR", Weninger et al.), and the lines above a
threshold (the smoothed ratios' standard deviation, at most half their maximum)
are the content lines. A region is an article or main element, or else a
container of its own. That with the most content characters is the text, with
those of its kind that hold content lines; as smoothing reaches beyond borders,
a container must also pass the threshold as a whole, if it isn't a title's.

Forms, page headers and elements whose class, id or role names a menu, an
advert, comments and the like are weak evidence: their lines' ratios count a
tenth. They lose within a region, but a region inside of them wins where the
content lines are there.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements whose text is never content.
DROPPED = frozenset(
    "head title script style noscript template svg math canvas object iframe audio video nav footer aside button select option textarea menu dialog".split()
)
#: Words of class, id and role that mark such parts.
MARKS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent notice notices alert newsletter subscribe subscription signup popup modal overlay comment comments "
    "respond replies disqus share sharing social related recommended pagination pager toolbar widget complementary contentinfo search login".split()
)
#: Parts of a class that say something of another element: `has-sidebar`, `comments-enabled`.
STATES = frozenset("has no with without enabled disabled open closed on off layout content".split())
#: What a line's ratio counts in each marked element around it, and the characters of a marked container that may be the text.
WEAK, LEAST_MARKED = 0.1, 200
#: Elements that a head may hold; any other, or text, ends it.
IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
CONTAINERS = frozenset("article main".split())
BOXES = frozenset("div section td body center form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends open elements of these names.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
SIGMA, RADIUS = 1.0, 3
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)


class Region(NamedTuple):
    """An article or main element (inside), or a container; marks: marked elements around it, itself included."""

    number: int
    inside: bool
    marks: int


class Line(NamedTuple):
    text: str
    tags: int
    dropped: bool
    region: Region
    marks: int
    heading: bool

    @property
    def own(self) -> bool:
        """Whether no marked element lies between the region and the line."""
        return not self.dropped and self.marks == self.region.marks


class Element(NamedTuple):
    name: str
    dropped: bool
    region: Region
    marks: int


class LineParser(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open = [Element("", False, Region(0, False, 0), 0)]
        self.counts: dict[str, int] = {}
        self.text: list[str] = []
        self.tags = 0
        self.regions = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            at = self.open[-1]
            heading = any(self.counts.get(h) for h in HEADINGS)
            self.lines.append(Line(text, self.tags, at.dropped, at.region, at.marks, heading))
        self.text.clear()
        self.tags = 0

    def pop_to(self, tag: str) -> None:
        while True:
            name = self.open.pop().name
            self.counts[name] -= 1
            if name == tag:
                return

    def end_head(self) -> None:
        self.end_line()
        self.pop_to("head")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.counts.get("head") and (tag == "body" or self.open[-1].name == "head" and tag not in IN_HEAD):
            self.end_head()
        if tag in BLOCK:
            self.end_line()
            if tag not in ("html", "body") and self.counts.get("p"):
                self.pop_to("p")
            for name in ENDS.get(tag, ()):
                for above in reversed(self.open):
                    if above.name in SCOPE[tag]:
                        break
                    if above.name == name:
                        self.pop_to(name)
                        break
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        _, dropped, region, marks = self.open[-1]
        dropped = dropped or tag in DROPPED
        if tag not in ("html", "body"):
            dropped = dropped or self.hidden(attrs)
            marks += tag == "form" or tag == "header" and not region.inside or self.marked(attrs)
        if not region.inside and (tag in CONTAINERS or tag in BOXES):
            self.regions += 1
            region = Region(self.regions, tag in CONTAINERS, marks)
        self.open.append(Element(tag, dropped, region, marks))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def hidden(self, attrs: list[tuple[str, str | None]]) -> bool:
        return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)

    def marked(self, attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for word in value.lower().split():
                    parts = [x for x in _SPLIT.split(word) if x]
                    if not MARKS.isdisjoint(parts) and STATES.isdisjoint((parts[0], parts[-1])):
                        return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag not in VOID and self.counts.get(tag):
            self.pop_to(tag)

    def handle_data(self, data: str) -> None:
        if self.open[-1].name == "head" and data.strip():
            self.end_head()
        self.text.append(data)

    def finish(self) -> list[Line]:
        self.close()
        self.end_line()
        return self.lines


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters for each tag, of marked lines a share; a heading has at least the ratio of the line that it heads."""
    out = np.array([0.0 if x.dropped else len(x.text) / max(1, x.tags) * WEAK**x.marks for x in lines])
    for i in range(len(lines) - 2, -1, -1):
        if lines[i].heading and lines[i].own and lines[i + 1].region == lines[i].region:
            out[i] = max(out[i], out[i + 1])
    return out


def smoothed(ratio: np.ndarray) -> np.ndarray:
    weight = np.convolve(np.ones(len(ratio)), _KERNEL)[RADIUS:-RADIUS]
    return np.convolve(ratio, _KERNEL)[RADIUS:-RADIUS] / weight


def threshold(smooth: np.ndarray) -> float:
    return float(min(smooth.std(), smooth.max() / 2))


def main_text(html: str | None) -> str:
    """Blocks of the main text joined by two line feeds; empty for null, and where there is no content."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    lines = parser.finish()
    if not any(x.own for x in lines):
        return ""
    smooth = smoothed(ratios(lines))
    least = threshold(smooth)
    content = [x for x, s in zip(lines, smooth, strict=True) if s >= least and x.own] or [x for x in lines if x.own]
    size: dict[Region, int] = {}
    for x in content:
        size[x.region] = size.get(x.region, 0) + len(x.text)
    able = {r: n for r, n in size.items() if r.inside or not r.marks or n >= LEAST_MARKED}
    if not able:
        return ""
    free = any(r.inside and not r.marks for r in able)

    def weight(r: Region) -> float:
        """An article in a marked element is nothing beside one that isn't, else as good as other text."""
        return able[r] * (WEAK**r.marks if not r.inside or free else 1.0)

    top = max(able, key=lambda r: (weight(r), -r.number))
    whole: dict[Region, list[Line]] = {r: [] for r in able}
    for x in lines:
        if x.own and x.region in whole:
            whole[x.region].append(x)

    def dense(r: Region) -> bool:
        ratio = sum(len(x.text) for x in whole[r]) / max(1, sum(x.tags for x in whole[r])) * WEAK**r.marks
        return r == top or r.inside or ratio >= least or all(x.heading for x in whole[r])

    chosen = {r.number for r in able if (r.inside, r.marks) == (top.inside, top.marks) and dense(r)}
    return "\n\n".join(x.text for x in lines if x.own and x.region.number in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with a column main_text from html, in place of one of that name.

    Null and empty html, and pages without content, give an empty text; very
    long pages are read whole; repeated rows get the same text each; of regions
    with equally many content characters the first decides; no rows give no rows.
    """
    out = rows.added(pages, ["html"], "main_text string", lambda html: [pa.array([main_text(x.as_py()) for x in html], pa.string())])
    return rows.spread(out, pages.columns, ["main_text"])


def op5_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see extract()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
