"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each block of text. A line's
ratio is its text per tag. Ratios are smoothed over neighbouring lines by a Gaussian, and lines at or
over the threshold (a share of their spread) form clusters, the content regions. The region with most
text names the container that holds it; it grows to the element around it as long as what that adds
is mostly headings and content regions. What the container holds is the main text, in page order, less
elements that are no content by their tag, role or name (menus, headers, footers, sidebars, notices,
adverts, forms, comments). A form that wraps the page's text is no such form.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import id_type, per_slice

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
DROP = frozenset("nav header footer aside form script style noscript template iframe object svg math button select textarea input dialog head title menu audio video canvas map datalist".split())
DROP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
#: Words of class or id names that mark what isn't content, if the rest of the name only says what kind of box it is.
DROP_NAME = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot adsbygoogle banner banners sponsor sponsors sponsored promo promos promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs "
    "crumbs header masthead footer foot sidebar sidebars aside rail widget widgets related recommended recommendations share sharing social sociable cookie cookies consent gdpr notice notices popup popups modal overlay "
    "newsletter subscribe subscription signup form login search searchbox searchform pagination pager toolbar skip hidden copyright disclaimer".split()
)
#: The same for what readers write; it goes even inside of articles, and articles inside of it.
READERS = frozenset("comment comments commentlist commentlists commentform respond disqus reply replies".split())
#: Words that say what kind of box it is.
BOX = frozenset(
    "container wrapper wrap box inner outer area block blocks section sections list lists item items row col column columns left right top bottom main primary secondary global site page web post posts "
    "blog article articles entry entries story stories content contents body bar bars panel slot unit group links link button buttons icon icons text title thread threads reader readers user users news more latest popular "
    "tags meta info message msg policy small large big full desktop mobile sticky fixed float to the and by us my id nr no".split()
)
NAME = re.compile(r"[a-z0-9]+")
#: Names that tell what a layout has beside the element.
NOT_OWN = ("no-", "has-", "with-", "without-", "is-", "js-")
#: Elements that an opening block closes when they are left open; a paragraph is closed by all.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Events(HTMLParser):
    """Lines of a page: text, tags met in it, path of the elements around it, and whether one of them is to be dropped."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, number, whether and why dropped
        self.made = 0
        self.whole: dict[int, str] = {}  # numbers of articles and mains
        self.forms: dict[int, list] = {}  # of forms that may wrap the page: whether they hold an article or a heading, and their paragraphs
        self.held: list[tuple[int, list[str], int]] = []
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, tuple[int, ...], bool, str]] = []

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            blocks = [x for x in self.stack if x[0] in BLOCK or not x[1]]
            self.lines.append((text, self.tags, tuple(n for _, n, _ in blocks), self.stack[-1][2], blocks[-1][0]))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.cut()
            self.close_open(tag)
            if tag == "body":  # a head that was left open ends here
                heads = [i for i, x in enumerate(self.stack) if x[0] == "head"]
                if heads:
                    self.pop_to(heads[0])
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        around = self.stack[-1][2]
        drop = around or (tag in DROP and tag != "form" and GONE) or bool(attrs) and dropped(tag, dict(attrs))
        if tag in ("article", "main") and around == NAMED and drop == NAMED and not any(t == "article" for t, _, _ in self.stack):
            drop = 0  # what a name seemed to mark holds the article
        if drop and not self.stack[-1][2]:
            self.cut_inline(tag)
        self.made += 1
        if tag in ("article", "main"):
            self.whole[self.made] = tag
        if tag == "form":
            self.forms[self.made] = [False, 0]
        elif tag in ("article", "main", "h1", "p") and not drop:
            for t, n, _ in self.stack:
                if t == "form":
                    self.forms[n][0] |= tag != "p"
                    self.forms[n][1] += tag == "p"
        self.stack.append((tag, self.made, drop))

    def cut_inline(self, tag) -> None:
        """Dropped inline elements take their text along; the text around them stays one block."""
        if tag not in BLOCK:
            self.held.append((len(self.stack), self.text, self.tags))
            self.text = []

    def close_open(self, tag) -> None:
        """What an opening block ends without an end tag of its own."""
        ends = SAME.get(tag, set()) | ({"p"} if tag not in ("option", "optgroup") else set())
        stop = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}.get(tag, {"table"}) | {"article", "section", "div", "main", "body", "td", "th", "li", "blockquote"} - ends
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name in ends:
                self.pop_to(i)
                if name == "p":
                    break
            elif name in stop:
                break

    def pop_to(self, i: int) -> None:
        self.cut()
        self.release(i)
        del self.stack[i:]

    def release(self, i: int) -> None:
        while self.held and self.held[-1][0] >= i:
            _, self.text, self.tags = self.held.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self.pop_to(i)
                    return
            self.cut()
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag:
                if self.stack[i][2] and not self.stack[i - 1][2]:
                    self.text = []
                    self.release(i)
                del self.stack[i]
                return
            if name in BLOCK:
                return

    def handle_data(self, data):
        if self.stack[-1][0] not in ("script", "style"):
            self.text.append(data)

    def end(self):
        """The lines, forms judged: one stays if it holds an article, or over half of the text in several paragraphs or under a heading."""
        self.close()
        self.cut()
        total = sum(len(x[0]) for x in self.lines if not x[3])
        for form, (headed, paragraphs) in self.forms.items():
            inside = sum(len(x[0]) for x in self.lines if form in x[2] and not x[3])
            if not ((headed or paragraphs > 2) and 2 * inside > total):
                self.lines = [(*x[:3], x[3] or GONE if form in x[2] else x[3], x[4]) for x in self.lines]
        return self.lines


#: Why an element is dropped: for a name, which an article in it outweighs, or for good.
NAMED, GONE = 1, 2


def dropped(tag: str, attrs: dict) -> int:
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return GONE
    if (attrs.get("role") or "").lower() in DROP_ROLE:
        return GONE
    if tag in ("html", "body", "main"):
        return 0
    names = [set(NAME.findall(x)) for name in ("class", "id") for x in (attrs.get(name) or "").lower().replace("_", "-").split() if not x.startswith(NOT_OWN)]
    if any(x & READERS and x <= READERS | BOX for x in names):
        return GONE
    return NAMED if tag != "article" and any(x & DROP_NAME and x <= DROP_NAME | BOX for x in names) else 0


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at the ends and normed there."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(ratios) == 1:
        return ratios
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def main_text(html: str | None, sigma: float = 1.0, threshold: float = 0.5) -> str:
    """The main text of a page, its blocks joined by an empty line; empty if there is none."""
    if not html:
        return ""
    parser = Events()
    parser.feed(html)
    lines = parser.end()
    if not lines:
        return ""
    size = np.array([len(t) for t, *_ in lines], float)
    ratio = size / np.maximum(1, [x[1] for x in lines])
    dropped_ = np.array([bool(x[3]) for x in lines])
    level = smooth(ratio * ~dropped_, sigma)
    over = (level >= threshold * level.std()) & ~dropped_
    if not over.any():
        return ""
    # content regions are runs of lines over the threshold; the largest names its container
    edges = np.flatnonzero(np.diff(np.concatenate(([0], over, [0]))))
    runs = [(size[a:b].sum(), a, b) for a, b in zip(edges[::2], edges[1::2])]
    _, a, b = max(runs, key=lambda r: (r[0], -r[1]))
    paths = [x[2] for x in lines]
    container = _container(paths[a:b], size[a:b])
    outer = [i for tag in ("article", "main") for i, n in enumerate(container) if parser.whole.get(n) == tag]
    if outer:  # a part of an article stands for all of it
        container = container[: outer[0] + 1]
    else:
        heading = np.array([x[4] in HEADINGS for x in lines])
        container = _grown(container, paths, size * ~dropped_, over & (ratio >= threshold * ratio[over].mean()) | heading)
    return "\n\n".join(t for t, _, path, drop, _ in lines if not drop and path[: len(container)] == container)


HEADINGS = frozenset(("h1", "h2", "h3"))


def _grown(container: tuple[int, ...], paths: list[tuple[int, ...]], size: np.ndarray, content: np.ndarray) -> tuple[int, ...]:
    """The container, or an element around it: as long as most text that the next one adds is content."""
    while len(container) > 1:
        outer = container[:-1]
        added = np.array([p[: len(outer)] == outer and p[: len(container)] != container for p in paths])
        if size[added & content].sum() < 0.7 * size[added].sum():
            break
        container = outer
    return container


def _container(paths: list[tuple[int, ...]], size: np.ndarray) -> tuple[int, ...]:
    """The deepest element that holds nearly all text of a region."""
    total, out = size.sum(), paths[0][:1]
    while True:
        depth = len(out)
        inner: dict[tuple[int, ...], list] = {}
        for p, s in zip(paths, size):
            if p[:depth] == out and len(p) > depth + 1:  # the last element is the line's own block
                inner.setdefault(p[: depth + 1], []).append(s)
        best = max(inner, key=lambda k: sum(inner[k]), default=None)
        if best is None or sum(inner[best]) < 0.9 * total or len(inner[best]) < 2 and len(paths) > 1:
            return out
        out = best


def extract(pages: DataFrame, sigma: float = 1.0, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page and its number of code points.

    A null or empty page, or one without content, has an empty text. Null ids and urls stay null; repeated
    rows appear each; other columns are ignored; an empty table gives an empty one.
    """

    def run(batch):
        text = [main_text(x, sigma, threshold) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return per_slice(rows, run, f"page_id {id_type(pages, id_col)}, url string, text string, n_chars long", "html")
