"""Main text of HTML pages by text-to-tag ratio over parser events.

The standard library's streaming parser turns a page into lines, one for each
block, while elements that never hold main text (scripts, headers, footers,
sidebars, forms) or say so themselves (adverts, notices, comments of readers)
are passed over. A line's ratio is its text outside links over its tags; ratios
are smoothed by a Gaussian along the page and lines above a threshold, a share
of their spread, form clusters. The text of menus counts as links, and the
Gaussian doesn't reach across the border of a menu, an article or a main element,
so that menus fall under the threshold. The content region starts as the innermost container that holds most
of the clusters' mass, the sum of smoothed ratios, in which lines of an article
or main element count MAIN_WEIGHT times. If it lies inside such an element, all
of that belongs to the region; else clusters elsewhere that are as rich as those
inside join it, with all that lies between. Short lines of links are left out
where their run reaches beyond the clusters.

Defined results: a null page is empty; a page without text gives "". Character
references are decoded, white space inside a block becomes one space, blocks are
joined by one newline, and nothing else is dropped or capped. Unclosed and stray
tags are tolerated, cut-off pages keep what they have. Equal pages get equal
texts. Other columns are carried through; names that begin with ``_hx_`` are
refused with a ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from treeloom.llm._text import own_names
from treeloom.plans.sizing import arrow_rows

#: Elements by role in a page.
SKIPPED = frozenset("script style noscript template svg math head title footer aside form button select textarea iframe object canvas audio video dialog".split())
MENUS = frozenset("nav menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Roles of elements that hold no main text.
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status form".split())
#: Words in class or id that mark boilerplate; inside an article all words must be such or of the layout.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert disclaimer sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer foot masthead topbar toolbar comment comments commentlist respond reply replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay lightbox widget widgets pagination pager".split()
)
LAYOUT = frozenset("slot unit wrapper wrap container box block section area panel bar list item items inner outer top bottom left right middle center inline row col column card large small medium mobile desktop full width x px js first last odd even main page site post article entry links buttons posts stories".split())
#: Elements of text, whose names say nothing against them inside an article.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre td th caption figcaption a b i em strong code span".split())
#: A header mark counts outside the article only.
TOP_MARKS = frozenset("header head hero topnav".split())
#: Elements that can be the content region.
HOLDERS = frozenset("article blockquote body center div main section td".split())
#: How often clustered text in an article or main element counts in the choice of container.
MAIN_WEIGHT = 2
#: The share of the clusters' mass that the content region starts with.
MOST = 0.8
_NEGATED = frozenset("with has no without".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Line:
    text: str
    linked: int
    tags: int
    path: tuple[int, ...]  # numbers of the open containers
    main: int  # number of the main element, else of the outermost article, or 0
    menu: bool


def marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element's attributes name boilerplate or hide it."""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id") and value:
            parts = [[x.lower() for x in _TOKEN.findall(part)] for part in value.split()]
            if inside:
                words = {x for part in parts for x in part}
                if tag not in TEXTUAL and words & MARKS and words <= MARKS | LAYOUT:
                    return True
            elif any((x in MARKS or x in TOP_MARKS) and not (i and part[i - 1] in _NEGATED) for part in parts for i, x in enumerate(part)):
                return True
    return False


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int]] = []  # block elements, with numbers
        self.count = self.tags = self.linked = 0
        self.skip: list[str] = []  # open elements from the skipped one on
        self.link = False
        self.buffer: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            frames = [n for t, n in self.open if t == "main"] or [n for t, n in self.open if t == "article"] or [0]
            menu = not frames[0] and any(t in MENUS for t, _ in self.open)
            self.lines.append(Line(text, len(text) if menu else self.linked, self.tags, tuple(n for t, n in self.open if t in HOLDERS), frames[0], menu))
        self.buffer, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag in ("article", "main", "body") and not marked(tag, attrs, True) and self.skip[0] not in ("article", "main") and not any(t in ("article", "main") for t, _ in self.open):
                self.skip = []  # an unclosed menu or advert does not swallow the page
            else:
                if tag not in VOID:
                    self.skip.append(tag)
                return
        inside = any(t in ("article", "main") for t, _ in self.open)
        if tag not in VOID and tag not in ("html", "body") and (tag in SKIPPED or (tag in MENUS and inside) or (tag == "header" and not inside) or marked(tag, attrs, inside)):
            if tag in BLOCKS:
                self.flush()
            self.skip = [tag]
            return
        if tag in BLOCKS:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and self.open and self.open[-1][0] == tag:
                self.open.pop()  # these close their like
            if tag != "hr":
                self.count += 1
                self.open.append((tag, self.count))
        else:
            self.tags += 1
            if tag == "a":
                self.link = True
            elif tag == "br":
                self.buffer.append(" ")

    def handle_startendtag(self, tag, attrs):
        if not self.skip:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            elif any(t == tag for t, _ in self.open) and tag in ("body", "html", "article", "main"):
                self.skip = []
            return
        if tag in BLOCKS:
            self.flush()
            if any(t == tag for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass
        elif tag == "a":
            self.link = False
        elif tag == "br":
            self.buffer.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)
            if self.link:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Ratios under a Gaussian along the page, whose weights at its ends are made whole."""
    reach = int(3 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    return np.convolve(ratios, k)[reach : reach + n] / np.convolve(np.ones(n), k)[reach : reach + n]


def select(lines: list[Line], sigma: float = 1.0, share: float = 0.35) -> list[Line]:
    """The lines of the content region."""
    if not lines:
        return []
    size = np.array([len(x.text) for x in lines], float)
    ratio = (size - np.minimum(size, [x.linked for x in lines])) / (1 + np.array([x.tags for x in lines]))
    menu = np.array([x.menu for x in lines])
    borders = np.flatnonzero(np.diff(menu) | (np.diff([x.main for x in lines]) != 0)) + 1
    wave = np.concatenate([smoothed(part, sigma) for part in np.split(ratio, borders)])
    chosen = wave > 0
    if len(lines) > 1:
        chosen &= wave >= share * min(wave.std(), wave.mean())
    mass = wave * chosen * np.where([x.main > 0 for x in lines], MAIN_WEIGHT, 1)
    weight: dict[int, float] = {}
    for x, s in zip(lines, mass, strict=True):
        if s:
            for n in x.path:
                weight[n] = weight.get(n, 0) + s
    held = [n for n, s in weight.items() if s >= MOST * mass.sum()]  # nested in each other, the largest number innermost
    best = max(held, default=0)
    frame = next((x.main for x in lines if best in x.path and x.main and x.main <= best), 0) if best else 0
    inside = np.array([not best or best in x.path or frame in x.path for x in lines])
    if not frame and (chosen & inside).any():
        rich = inside | (chosen & (ratio >= 0.5 * np.median(ratio[chosen & inside])))
        ends = np.flatnonzero(rich)
        inside[ends[0] : ends[-1] + 1] = True
    region = [(x, c) for x, c, i in zip(lines, chosen, inside, strict=True) if i and (c or not x.menu)]
    out: list[Line] = []
    for links, run in groupby(region, lambda v: len(v[0].text) < 200 and v[0].linked > 0.6 * len(v[0].text) and v[0].tags > 0):
        rows = list(run)
        if not links or all(c for _, c in rows):
            out += [x for x, _ in rows]
    return out


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return "\n".join(x.text for x in select(parser.lines))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html`` and with _hx_text."""
    own_names(pages, "_hx_")
    arrow_rows(pages.sparkSession)
    kept = [c for c in pages.columns if c != html]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("_hx_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # lone surrogates, which a reference can name, have no UTF-8 form
            texts = [main_text(h).encode("utf-8", "replace").decode() for h in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(texts, pa.string())], [*kept, "_hx_text"])

    return pages.select(*kept, html).mapInArrow(run, schema)
