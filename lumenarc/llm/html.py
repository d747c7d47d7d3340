"""Main text of web pages by text-to-tag ratio.

The standard library's parser gives events; a page becomes a list of lines, one for each block, with its text, the number of
tags in it and the innermost container around it; an article is one container with all that is in it. Lines inside elements that are never main
text (scripts, menus, forms, and elements named as adverts, notices, comments and so on) are left out. The ratio of text
to tags of each line is smoothed with a Gaussian along the page, and two clusters of the smoothed ratios give a threshold: what lies above it is content.
From the page's root on, as long as one container inside holds most of the content (articles count ARTICLE times, main elements MAIN times), that
container is entered; the last one is the content region, or a main element with several articles, which are all kept. All its lines are kept, so headings and
short paragraphs stay, and lists, tables, figures, quotes and details are parts of what they stand in; other divisions in it that are neither content, nor of one
kind with their content siblings, nor between the first and last line of content go, and there too if most of their lines are full of tags.

Inside an article or main element a name of layout alone (search, related, discussion) says less, and so do longer names that hold an unwanted word: such an element, and a form, is kept if it holds an article, the main element or more than half
of the page's text; and where the word is one of layout (not of adverts, notices, menus or comments), also if its own ratio
is above the threshold or 40.

Defined results: a null or empty page has an empty text; equal rows are judged one by one; malformed markup is read as the parser reads it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table, text_of

# Elements by their use, and the names by which pages mark what isn't main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("script style noscript template svg iframe object canvas audio video head nav footer aside form button select textarea dialog menu title".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTAINER = set("body div section td blockquote main article details figure table ul ol".split())
REGION = set("body div section td main article".split())
NAMES = set("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription paywall sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments reply replies respond disqus discussion share sharing social related recommended recommendations widget login signin signup search toolbar copyright skip".split())
FIRM = set("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription paywall comment comments reply replies respond disqus".split())
#: Names that leave no doubt inside an article: those of FIRM and of menus, headers, footers, sidebars and notices.
SURE = FIRM | set("sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar notice notification alert overlay".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
TOKEN = re.compile(r"[a-z]+")
SIGMA, MOST, ARTICLE, MAIN = 1.5, 0.6, 3.0, 2.0
#: Characters to a tag that are prose for sure, on pages where all is prose and the threshold lies higher.
PROSE = 40.0


class Lines(HTMLParser):
    """The lines of a page, and of each region its kind, its parent and what content in it counts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = [("", False, 0)]
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []  # text, tags, region, doubts
        self.regions = ["body"]
        self.parents = [0]
        self.weights = [1.0]
        self.firm: set[int] = set()  # doubts that no ratio lifts
        self.doubts: list[tuple[int, ...]] = [()]  # for each element on the stack, those around it that may be unwanted or wrappers
        self.n_doubts = 0
        self.text: list[str] = []
        self.tags = 1

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            self.lines.append((" ".join(words), self.tags, self.stack[-1][2], self.doubts[len(self.stack) - 1]))
        self.text, self.tags = [], 1

    def unwanted(self, tag: str, attrs: list) -> bool:
        if (tag in NEVER and tag != "form") or (tag == "header" and not any(t in ("article", "main") for t, _, _ in self.stack)):
            return True
        sure = SURE if self.regions[self.stack[-1][2]] == "article" or any(t in ("article", "main") for t, _, _ in self.stack) else NAMES
        for key, value in attrs:
            value = (value or "").lower()
            if key in ("class", "id") and tag not in ("html", "body", "article", "main") and not sure.isdisjoint(value.split()):
                return True
            if key in ("class", "id") and tag == "article" and "comment" in value:
                return True
            if (key == "role" and value in ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return True
        return False

    def doubtful(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """Whether the element may be unwanted (a form, or a word of NAMES inside a longer name), and whether its ratio can't lift that."""
        words = set() if tag in ("html", "body", "article", "main") else {w for k, v in attrs if k in ("class", "id") for w in TOKEN.findall((v or "").lower())}
        return tag == "form" or not NAMES.isdisjoint(words), tag == "form" or not FIRM.isdisjoint(words)

    def close_to(self, tags: tuple[str, ...], until: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                del self.stack[i:]
                return
            if self.stack[i][0] in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCK
        if tag in ("tr", "td", "th"):  # cells and rows may lack their end tags
            self.close_to(("td", "th"), {"tr", "table"})
        if block:
            self.flush()
            if tag == "tr":
                self.close_to(("tr",), {"table"})
            self.close_to(("p",), CONTAINER)
            if tag == "li":
                self.close_to(("li",), {"ul", "ol", "menu"})
            elif tag in ("dt", "dd"):
                self.close_to(("dt", "dd"), {"dl"})
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
            self.tags += tag != "br"
        else:
            self.tags += 1
        if tag in VOID:
            return
        _, skip, region = self.stack[-1]
        if tag in REGION and (self.regions[region] != "article" or tag == "article"):
            self.regions.append(tag)
            self.parents.append(region)
            self.weights.append(max(self.weights[region], {"article": ARTICLE, "main": MAIN}.get(tag, 1.0)))
            region = len(self.regions) - 1
        doubts = () if tag in ("article", "main") else self.doubts[len(self.stack) - 1]
        doubtful, firm = self.doubtful(tag, attrs)
        if doubtful:
            self.n_doubts += 1
            doubts = (*doubts, self.n_doubts)
            if firm:
                self.firm.add(self.n_doubts)
        self.doubts[len(self.stack) :] = [doubts]
        self.stack.append((tag, skip or self.unwanted(tag, attrs), region))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("tr", "table"):
            self.close_to(("td", "th"), {"tr", "table"})
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.text.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    near = np.convolve(ratio, kernel, mode="full")[reach:-reach]
    return near / np.convolve(np.ones(len(ratio)), kernel, mode="full")[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """Half-way between the centres of two clusters (one-dimensional 2-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        new = float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_ratios(texts: list[str], tags: list[int]) -> tuple[np.ndarray, float]:
    """The smoothed text-to-tag ratio of each line and the threshold of content."""
    ratio = smoothed(np.array([len(t) for t in texts]) / np.array(tags))
    return ratio, threshold(ratio)


def main_text(html: str) -> str:
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    chars: Counter = Counter()
    marks: Counter = Counter()
    for text, tags, _, doubts in page.lines:
        for d in doubts:
            chars[d] += len(text)
            marks[d] += tags
    half = sum(len(x[0]) for x in page.lines) / 2
    lines = [x for x in page.lines if all(chars[d] > half for d in x[3] if d in page.firm)]
    if not lines:
        return ""
    ratio, cut = content_ratios([x[0] for x in lines], [x[1] for x in lines])
    kept = [i for i, x in enumerate(lines) if all(chars[d] > half or chars[d] >= min(cut, PROSE) * marks[d] for d in x[3])]
    mass, own, sizes, tags_in = [0.0] * len(page.regions), set(), Counter(), Counter()
    for i in kept:
        _, tags, r, _ = lines[i]
        sizes[r] += 1
        tags_in[r] += tags
        if ratio[i] >= cut:
            own.add(r)
            mass[r] += float(ratio[i]) * page.weights[r]
    children: dict[int, list[int]] = {}
    for r in range(len(mass) - 1, 0, -1):  # parents come before their children
        mass[page.parents[r]] += mass[r]
        children.setdefault(page.parents[r], []).append(r)
    within = lambda r, top: r == top or (r > top and within(page.parents[r], top))
    articles = [r for r in sizes if page.regions[r] == "article"]
    region = 0
    while page.regions[region] != "article" and (best := max(children.get(region, ()), key=mass.__getitem__, default=0)) and mass[best] >= MOST * mass[region]:
        if page.regions[region] == "main" and sum(within(r, region) for r in articles) > 1:
            break
        region = best
    inside = {region}
    for r in range(region + 1, len(mass)):
        if page.parents[r] in inside:
            inside.add(r)
    alike = {(page.parents[r], page.regions[r]) for r in own & inside if page.regions[r] in ("div", "section")}
    even = lambda r: tags_in[r] < 2 * sizes[r]
    chosen = {region}
    for r in sorted(inside):
        kind, up = page.regions[r], page.parents[r]
        if r in own or (kind == "article" and page.regions[region] == "main") or ((up, kind) in alike and even(r)) or (kind == "td" and up in chosen & own):
            chosen.add(r)
    # Smoothing pulls the edges of the text down, so here a line's own ratio counts too.
    content = [i for i in kept if lines[i][2] in chosen and (ratio[i] >= cut or len(lines[i][0]) >= min(cut, PROSE) * lines[i][1])]
    first, last = (content[0], content[-1]) if content else (0, -1)
    return "\n\n".join(lines[i][0] for i in kept if lines[i][2] in chosen or (first < i < last and lines[i][2] in inside and even(lines[i][2])))


def extract(pages: DataFrame, id_name: str = "page_id", url_name: str = "url", html_name: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_name).cast("long").alias("page_id"), F.col(url_name).cast("string").alias("url"), text_of(html_name).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
