"""Main text of web pages from the standard library's parser events.

The events of one page stream into lines: a block element's start or end, wherever it stands, begins a new line. Every
line has a text-to-tag ratio, its characters over its tags; ratios are smoothed with a Gaussian over neighbouring lines
and clustered by a threshold, their standard deviation, into content and the rest. The clusters decide what stays:

1. Parts that are never content by the HTML standard (scripts, styles, menus, footers, side boxes, forms) are no lines at
   all; a form or dialogue that encloses an article is only a wrapper.
2. Words of class and id, and roles, are one signal beside the clusters. A box (div, section, list, table ...) that they call
   a side part is left out, unless it encloses an article or main element or is the body itself; a text block (paragraph,
   heading, item ...) that they call so is left out only if its own ratio lies below the threshold, too.
3. Regions are the outermost article and main elements. Every region with a line of the content cluster stays with all its
   lines, as the ratio alone can't tell a short paragraph from a menu; regions without one go, unless all are.
4. On a page without such an element the region is the smallest container that holds nearly all characters of the content
   cluster, and containers outside it that hold lines of the cluster. Their lines stay, but for lines that are mostly links
   and are not in the cluster.

Narrow: one page at a time, no shuffle; memory and time follow the longest page. Null and empty pages give an empty text,
broken markup gives what the parser makes of it; repeated rows are handled alike. Only the kept columns and the page are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm import buffers as B

# Element names of the HTML standard.
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
                    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
                    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
HIDDEN = frozenset(("head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "audio", "video", "search", "title"))
WRAPPERS = frozenset(("form", "dialog", "search"))  # of the hidden ones, those that may enclose an article
REGIONS = frozenset(("article", "main"))
CONTAINERS = frozenset(("body", "div", "section", "td", "center", "blockquote", "fieldset", "form"))
BOXES = frozenset(("div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "td", "center", "fieldset", "details", "article", "main", "aside", "form", "iframe", "header", "figure", "hgroup"))
# Roles of the accessibility standard and words that name side parts in class and id.
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"))
SIDE_WORDS = frozenset(("ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer",
                        "footer", "gdpr", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "modal", "promo", "related", "respond", "share", "sharing",
                        "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"))
OPTIONAL_END = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


NEARLY_ALL = 0.9  # of the characters of the content cluster


class Line(NamedTuple):
    text: str
    tags: int
    links: int  # characters inside links
    region: int  # outermost article or main element, 0 for none
    container: int
    box: int  # innermost open element that may be a side part as a whole, 0 for none
    named: bool  # a text block that its class, id or role calls a side part


class Lines(HTMLParser):
    """Collects the lines of one page; what encloses an article is known only at the end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.parts, self.tags, self.links = [], [], 0, 0
        self.open, self.names = [], Counter()  # open elements as (tag, undo), and how many of each name
        self.hidden = self.linked = self.named = self.region = self.regions = self.container = 0
        self.parents, self.around, self.wraps, self.box = [0], [0], [True], 0  # containers and boxes by what encloses them

    def _line(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(Line(text, self.tags, self.links, self.region, self.container, self.box, self.named > 0))
        self.parts, self.tags, self.links = [], 0, 0

    def _close(self) -> str:
        tag, hides, box, named, region, container = self.open.pop()
        self.names[tag] -= 1
        self.hidden -= hides
        self.named -= named
        self.linked -= tag == "a"
        if box:
            self.box = self.around[self.box]
        if region is not None:
            self.region = region
        if container is not None:
            self.container = container
        return tag

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1][0] in OPTIONAL_END and tag in OPTIONAL_END[self.open[-1][0]]:
            self._line()
            self._close()
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        side = bool(attrs) and tag not in ("body", "html") and _aside(attrs)
        wrapper = tag in WRAPPERS
        hides = tag in HIDDEN and not wrapper or tag == "header" and not self.region or bool(attrs) and _invisible(attrs)
        box = wrapper or side and tag in BOXES
        region = container = None
        if tag in REGIONS and not side and not self.hidden:
            self.wraps[self.box] = True  # whatever encloses an article is no side part
            region = self.region
            if not self.region:
                self.regions += 1
                self.region = self.regions
        if tag in CONTAINERS or tag in REGIONS:
            container = self.container
            self.parents.append(self.container)
            self.container = len(self.parents) - 1
        if box:
            self.around.append(self.box)
            self.wraps.append(False)
            self.box = len(self.around) - 1
        named = side and not box
        self.open.append((tag, hides, box, named, region, container))
        self.names[tag] += 1
        self.hidden += hides
        self.named += named
        self.linked += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self._line()
        if self.names[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.linked:
                self.links += len(data.strip())

    def finished(self) -> list[Line]:
        """Lines outside side boxes."""
        self._line()
        for box in range(len(self.around) - 1, 0, -1):  # boxes are numbered before those they enclose
            self.wraps[self.around[box]] |= self.wraps[box]
        for box in range(1, len(self.around)):  # from here on: whether it and all around it are no side parts
            self.wraps[box] &= self.wraps[self.around[box]]
        return [x for x in self.lines if self.wraps[x.box]]


def _aside(attrs) -> bool:
    for name, value in attrs:
        if name in ("class", "id") and value and not SIDE_WORDS.isdisjoint(WORD.findall(value.lower())):
            return True
        if name == "role" and value and value.lower() in ROLES:
            return True
    return False


def _invisible(attrs) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian over neighbours up to three sigma away, the weights scaled to what is there at the ends."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        used = weights[low - i + reach: high - i + reach]
        out.append(sum(v * w for v, w in zip(values[low:high], used)) / sum(used))
    return out


def content(lines: list[Line]) -> list[bool]:
    """Lines in the content cluster: smoothed ratio of at least the standard deviation of all ratios, as the threshold.

    The cluster is never empty: the threshold is the greatest smoothed ratio where that is less.
    """
    ratios = [_ratio(x) for x in lines]
    values = smoothed(ratios)
    threshold = min(_deviation(ratios), max(values))
    return [x >= threshold for x in values]


def _ratio(line: Line) -> float:
    return len(line.text) / max(1, line.tags)


def _deviation(ratios: list[float]) -> float:
    mean = sum(ratios) / len(ratios)
    return math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))


def _region(cluster: list[Line], parents: list[int]) -> set[int]:
    """Containers that stay on a page without article: the smallest with nearly all of the cluster, all below it, and those with cluster lines."""
    own = Counter()
    for x in cluster:
        own[x.container] += len(x.text)
    total = Counter(own)
    for c in range(len(parents) - 1, 0, -1):  # containers are numbered before those they enclose
        total[parents[c]] += total[c]
    root = max(c for c in total if total[c] >= NEARLY_ALL * sum(own.values()))  # enclosing ones have smaller numbers
    inside = {root}
    for c in range(root + 1, len(parents)):
        if parents[c] in inside:
            inside.add(c)
    return inside | set(own)


def chosen(lines: list[Line], parents: list[int]) -> list[str]:
    """The texts of the lines that stay."""
    good = content(lines)
    threshold = _deviation([_ratio(x) for x in lines])
    pairs = [(x, g) for x, g in zip(lines, good) if not x.named or _ratio(x) >= threshold]
    regions = {x.region for x, g in pairs if g and x.region} or {x.region for x, _ in pairs if x.region}
    if regions:
        return [x.text for x, _ in pairs if x.region in regions]
    cluster = [x for x, g in pairs if g]
    if not cluster:
        return [x.text for x, _ in pairs]
    stays = _region(cluster, parents)
    return [x.text for x, g in pairs if x.container in stays and (g or 2 * x.links <= len(x.text))]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.finished()
    return "\n".join(chosen(lines, parser.parents)) if lines else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: the kept columns, text, and n_chars in code points."""
    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"))

    def run(batches):
        for batch in B.slices(batches, "_html"):
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*keep, "text", "n_chars"])

    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")
