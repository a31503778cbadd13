"""Main text of raw web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; every block element starts a new line of the page. Each line has a ratio
of its characters to its tags (link text weighs against it); lines under elements that never hold article text (menus,
page headers and footers, asides, forms, adverts, notices, reader comments; by tag, role, or words of class and id) have
ratio 0. The ratios are smoothed by a Gaussian over neighbouring lines, and lines at or above THRESHOLD standard
deviations of the smoothed ratios cluster as content. The clusters decide which of the page's outermost article and main
elements are content (several may be); these elements set the borders. See content().

Defined results: null or empty html and pages without text give an empty text; unclosed elements end where their
parents end; character references are decoded; white space inside a block is one space; blocks are joined by one
line feed; repeated rows get equal results; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA = 1.0
THRESHOLD = 0.5
LINK_SHARE = 0.5
REGION_SHARE = 0.25  # of the clustered text of the page's largest region

# Element names and the words of class and id attributes, by role.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas dialog menu audio video map".split())
NEVER_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NEVER_WORDS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navigation navbar breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies related recommended recommendations share sharing social pagination pager toolbar widget skip copyright".split())
COMMENT_WORDS = set("comment comments disqus respond reply replies".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption b i em strong span a code".split())
SILENT = ("script", "style", "noscript", "template", "title", "textarea", "option")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
P_CLOSERS = BLOCK - {"body", "html"}

_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    tags: int
    link_chars: int
    region: int  # number of the outermost article or main element, 0 outside
    aside: bool  # under an element that never holds article text


class _Lines(HTMLParser):
    """Collects a Line for each block. Open elements are found by name and by nearest block, never by a search."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int]] = []  # name, aside, region
        self.at: dict[str, list[int]] = {}  # depths of the open elements of a name
        self.blocks: list[int] = []  # depths of the open blocks
        self.parts: list[str] = []
        self.tags = self.link_chars = self.regions = 0

    def state(self) -> tuple[bool, int]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                aside, region = self.state()
                self.lines.append(Line(text, self.tags, self.link_chars, region, aside))
            self.parts = []
        self.tags = self.link_chars = 0

    def push(self, name: str, aside: bool, region: int) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        if name in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((name, aside, region))

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            name = self.open.pop()[0]
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if tag in P_CLOSERS and self.blocks and self.open[self.blocks[-1]][0] == "p":
                self.close_to(self.blocks[-1])
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        given = dict(attrs)
        words = set(re.split(r"[^a-z0-9]+", f"{given.get('class') or ''} {given.get('id') or ''}".lower())) if attrs else set()
        aside, region = self.state()
        if tag in ("article", "main"):
            if words & COMMENT_WORDS:
                aside = True
            else:
                if aside and not any(self.at.get(n) for n in ("script", "style", "template")):
                    # an element that was never closed does not swallow the article
                    aside = any(self.open[i][1] for n in ("article", "main") for i in self.at.get(n, ()))
                if not region:
                    self.regions += 1
                    region = self.regions
        elif tag not in ("html", "body"):
            # the words of class and id speak of containers; inside a region a paragraph or heading is what it is
            named = words & NEVER_WORDS and not (region and tag in TEXT_BLOCKS)
            heading = tag in HEADINGS and region and self.open[-1][0] == "header"
            hidden = "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower()
            role = (given.get("role") or "").lower() in NEVER_ROLES
            aside = (aside and not heading) or tag in NEVER or tag == "header" or bool(named) or role or hidden
        self.push(tag, aside, region)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        depths = self.at.get(tag)
        if depths and (tag in BLOCK or not self.blocks or depths[-1] > self.blocks[-1]):  # inline ends close no blocks
            self.close_to(depths[-1])

    def handle_data(self, data):
        if any(self.at.get(n) for n in SILENT):
            return
        self.parts.append(data)
        if self.at.get("a"):
            self.link_chars += len(data)


def page_lines(html: str | None) -> list[Line]:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the ends are reflected by renormalising the kernel."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        up = down = 0.0
        for j in range(max(0, i - reach), min(len(ratios), i + reach + 1)):
            k = kernel[abs(i - j)]
            up += k * ratios[j]
            down += k
        out.append(up / down)
    return out


def clustered(lines: list[Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> list[bool]:
    """Which lines the smoothed ratios of text to tags put at or above the threshold. Lines under boilerplate elements
    have ratio 0: they are a prior that drags their neighbours down."""
    ratios = [0.0 if x.aside else max(0, len(x.text) - 2 * x.link_chars) / (x.tags + 1) for x in lines]
    even = smoothed(ratios, sigma)
    mean = sum(even) / len(even)
    cut = min(threshold * math.sqrt(sum((x - mean) ** 2 for x in even) / len(even)), max(even))
    return [x >= cut and not line.aside for x, line in zip(even, lines)]


def content(lines: list[Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> list[str]:
    """The lines of the content: clusters choose, elements set the borders.

    Regions whose clustered text is at least REGION_SHARE of the largest one's are content, all in page order. A region
    brings its other lines too, short ones and headings, but not runs of link lines that no cluster holds whole. Pages without a
    region have the run from the first to the last clustered line.
    """
    if not any(not x.aside for x in lines):
        return []
    chosen = clustered(lines, sigma, threshold)
    mass: dict[int, int] = {}
    for line, on in zip(lines, chosen):
        if on:
            mass[line.region] = mass.get(line.region, 0) + len(line.text)
    regions = {r: n for r, n in mass.items() if r}
    links = [x.link_chars > LINK_SHARE * len(x.text) for x in lines]
    if regions:
        least = REGION_SHARE * max(regions.values())
        kept = {r for r, n in regions.items() if n >= least}
        inside = [(x.text, on, link) for x, on, link in zip(lines, chosen, links) if x.region in kept and not x.aside]
        out = []
        for link, run in groupby(inside, key=lambda x: x[2]):
            run = list(run)
            if not link or all(on for _, on, _ in run):
                out += [text for text, *_ in run]
        return out
    at = [i for i, on in enumerate(chosen) if on]
    if not at:
        return []
    return [x.text for x, link in zip(lines[at[0] : at[-1] + 1], links[at[0] : at[-1] + 1]) if not x.aside and not link]


def main_text(html: str | None) -> str:
    return "\n".join(content(page_lines(html)))


def extracted(html: Column) -> Column:
    """String column with the main text of an html column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(h) for h in pages], dtype=object)

    return run(html)
