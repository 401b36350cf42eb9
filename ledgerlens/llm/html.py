"""Main text of web pages.

The standard library's streaming parser gives tag and text events; text is gathered into lines, one
for each block of the page (a br also ends one), with the number of tags since the line before, and the
container that it stands in.  The text-to-tag ratio of all lines is smoothed with a Gaussian, and a
threshold at the standard deviation of the smoothed ratios splits them in two clusters.  The lines of the
upper cluster (but for lists of links) are seeds, and seeds choose the content region: of all articles and
main elements the one with most text in seeds; on a page without any, the innermost container that holds
three quarters of it, unless it would leave a heading or a seed outside.  All of a region's lines are
content, short ones included; of a region that is no article, containers before the first and after the
last line whose own ratio is over the threshold and the mean are left out, unless they hold a heading.

Never content, wherever they stand: scripts, styles, menus, headers (but an article's), footers, asides,
forms, dialogs and the like by tag or role, hidden elements, articles within articles (reader comments),
and elements named as adverts, comments or sidebars.  Outside of articles more names count.  A form, or an
element named so, around the only article of a page doesn't hide it, nor does an unclosed menu before it.

Defined cases: null html and pages without text give an empty text; cut-off pages are read to their end,
an unfinished tag or comment there is none of the text; character references are decoded; every run of
white space in a line becomes one space; lines are trimmed and joined by one newline.  Nothing is cut to
a length; equal rows give equal texts; columns named as those made here are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import table

SILENT = frozenset("script style noscript template head title svg math canvas iframe object audio video".split())
IN_HEAD = frozenset("title meta link style script base noscript template head".split())
APART = frozenset("nav header footer aside form menu dialog button select textarea option fieldset search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ROOTS = frozenset(["article", "main"])
CONTAINERS = frozenset("div section td body center blockquote ul ol table".split()) | ROOTS
HEADINGS = frozenset(["h1", "h2", "h3"])
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar status".split())
#: Names of elements that are never content, as whole names.
NEVER = frozenset(
    """ad ads adv advert adverts advertisement advertising adslot ad-slot ad-banner adsense sponsored sponsor promo sidebar comment comments comment-list
    commentlist comments-area replies disqus disqus_thread newsletter cookie-notice cookie-banner cookie-bar cookies-banner gdpr paywall breadcrumb breadcrumbs""".split()
)
#: Words of names outside of articles: the whole name, its last word or its first.
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adslot adsense banner banners promo promos promotion sponsor sponsored
    sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer foot masthead topbar cookie cookies consent gdpr
    notice notices disclaimer alert alerts popup modal overlay newsletter subscribe subscription signup share sharing social related recommended
    recommendations widget widgets comment comments commentlist reply replies respond disqus discussion login search pagination pager
    toolbar hidden paywall feedback reactions copyright teaser teasers""".split()
)
REMARKS = frozenset("comment comments reply replies respond".split())
STATES = frozenset("open closed enabled disabled on off count".split())
BEFORE = frozenset("has with no without".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
UNFINISHED = re.compile(r"<(?:[a-zA-Z/!?]|$)")
SIGMA, SHARE = 1.0, 0.75


def hidden(attrs: list) -> bool:
    """Whether role or state say that an element is no part of the text."""
    for key, value in attrs:
        text = (value or "").strip().lower()
        if key == "hidden" and text != "until-found" or key == "role" and text in ROLES or key == "aria-hidden" and text == "true" or key == "style" and UNSEEN.search(text):
            return True
    return False


def named_apart(tag: str, attrs: list, inside: bool) -> bool:
    """Whether class or id say so; inside of articles only by whole names."""
    if tag in ("html", "body"):
        return False
    for key, value in attrs:
        if key in ("class", "id") and value:
            for name in value.split():
                words = [w.lower() for w in NAME.findall(name)]
                if not words:
                    continue
                if tag in ROOTS:  # an article is one, unless it is itself a comment
                    if words[0] in REMARKS and not STATES.intersection(words[1:]):
                        return True
                elif name.lower() in NEVER and not STATES.intersection(words):
                    return True
                elif not inside and (words[0] in WORDS or (words[-1] in WORDS and not (len(words) > 1 and words[-2] in BEFORE))):
                    return True
    return False


class Mark:
    """An element whose lines are no content."""

    def __init__(self, yields: bool) -> None:
        self.yields, self.closed = yields, False  # yields: not to an article inside


class Node:
    """A container: its place in the tree, and for articles the marks around them."""

    def __init__(self, tag: str, parent: Node | None, marks: tuple) -> None:
        self.tag, self.parent, self.marks = tag, parent, marks
        self.root = self if tag in ROOTS else parent.root if parent else None
        self.seeds = self.plain = 0
        self.children: list[Node] = []
        if parent:
            parent.children.append(self)


class Line:
    def __init__(self, text: str, tags: int, linked: int, node: Node, marks: tuple, heading: bool) -> None:
        self.text, self.tags, self.node, self.marks, self.heading = text, tags, node, marks, heading
        self.plain = max(0, len(text) - linked)
        self.seed = self.high = False


class Page(HTMLParser):
    """The lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.node = Node("", None, ())
        self.marks: tuple = ()
        self.silent = False
        self.stack: list[tuple] = []  # tag, and the node, marks and silence around it, and its own mark
        self.text: list[str] = []
        self.link = self.linked = self.tags = 0
        self.heading = False
        self.lines: list[Line] = []

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append(Line(text, self.tags, self.linked, self.node, self.marks, self.heading))
                self.tags = 0
            self.text, self.linked = [], 0
        self.heading = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.silent and tag not in IN_HEAD and any(x[0] == "head" for x in self.stack) and self.stack[-1][0] == "head":
            self.handle_endtag("head")  # an unclosed head ends where the body begins
            self.tags -= 1
        if tag not in INLINE and tag not in SILENT:
            self.end_line()
        if tag in VOID:
            return
        mark = None
        if not self.silent and tag not in SILENT:
            inside = self.node.root is not None
            nested = tag == "article" and inside and self.node.root.tag == "article"
            if nested or tag in APART and not (tag == "header" and inside) or attrs and hidden(attrs):
                mark = Mark(tag == "form")
            elif attrs and named_apart(tag, attrs, inside):
                names = [n.lower() for key, value in attrs if key in ("class", "id") and value for n in value.split()]
                mark = Mark(tag not in ROOTS and NEVER.isdisjoint(names))
        self.stack.append((tag, self.node, self.marks, self.silent, mark))
        if tag == "a":
            self.link += 1
        if tag in SILENT:
            self.silent = True
        if mark:
            self.end_line()
        if tag in CONTAINERS:
            self.node = Node(tag, self.node, self.marks)
        if mark:
            self.marks = (*self.marks, mark)
        self.heading = self.heading or tag in HEADINGS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE and tag not in SILENT:
            self.end_line()
        if tag in VOID or not any(x[0] == tag for x in self.stack):
            return
        while self.stack:
            name, node, marks, silent, mark = self.stack.pop()
            if name == "a":
                self.link = max(0, self.link - 1)
            if mark or node is not self.node:
                self.end_line()
            self.node, self.marks, self.silent = node, marks, silent
            if name == tag:
                if mark:
                    mark.closed = True
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.link:
                self.linked += len(data)

    def close(self) -> None:
        if UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        super().close()
        self.end_line()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at three sigma and renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def content(page: Page) -> list[Line]:
    """The lines of the content region."""
    lines = page.lines
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines])
    even = smooth(ratio)
    threshold = float(even.std())
    usual = max(threshold, float(ratio.mean()))
    for line, own, smoothed in zip(lines, ratio.tolist(), even.tolist()):
        line.seed = smoothed >= threshold and 2 * line.plain >= len(line.text)
        line.high = own >= usual and line.seed

    def outer(line: Line) -> Node | None:
        """The outermost article or main element around a line."""
        node, found = line.node, None
        while node is not None:
            found = node if node.tag in ROOTS else found
            node = node.parent
        return found

    free: list[list[Line]] = [[], []]  # lines that are no one's mark, without and with an article in a mark that yields to it
    for line in lines:
        around = outer(line)
        before = len(around.marks) if around else 0
        if len(line.marks) > before:
            continue
        if all(m.yields or not m.closed for m in line.marks) and around:
            free[any(m.yields for m in line.marks)].append(line)
        elif not line.marks:
            free[0].append(line)
    if not any(outer(x) for x in free[0]) and any(free[1]):
        free[0] = free[1]
    found = free[0]
    if not found:
        return []
    if not any(x.seed and x.plain for x in found):
        for line in found:  # no text stands out: all of it counts
            line.seed = line.high = True
    for line in found:
        node = line.node
        while node is not None:
            node.seeds += line.plain * line.seed
            node.plain += line.plain
            node = node.parent

    roots = {id(x): x for x in (outer(line) for line in found) if x}.values()
    if roots:
        region = max(roots, key=lambda n: (n.seeds, n.plain))
        while region.tag == "main":
            articles, level = [], list(region.children)
            while level:
                node = level.pop()
                articles += [node] if node.tag in ROOTS else []
                level += [] if node.tag in ROOTS else node.children
            best = max(articles, key=lambda n: n.seeds, default=None)
            if best is None or best.seeds < SHARE * region.seeds:
                break
            region = best
    else:
        region = page.top
        while True:
            best = max(region.children, key=lambda n: n.seeds, default=None)
            own = [x for x in found if x.node is region]
            if best is None or best.seeds < SHARE * region.seeds or not best.seeds or any(x.heading or x.seed for x in own):
                break
            region = best

    def child(line: Line) -> Node | None:
        """The region, or the container in it, that holds the line; None outside."""
        node, below = line.node, line.node
        while node is not None and node is not region:
            node, below = node.parent, node
        return None if node is None else below

    kept = [(child(x), x) for x in found]
    kept = [(c, x) for c, x in kept if c is not None]
    if region.root is None:
        strong = {id(c) for c, x in kept if x.high or x.heading} | {id(region)}
        at = [k for k, (c, _) in enumerate(kept) if id(c) in strong]
        if at:
            kept = kept[at[0] : at[-1] + 1]
    return [x for _, x in kept]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    return "\n".join(x.text for x in content(page)) if page.lines else ""


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The other columns of pages with text_col and n_chars (its code points); columns of those names are replaced."""
    others = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower(), "n_chars")]
    rows = pages.select(*(f"`{c}`" for c in others), F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = rows.drop("__html").withColumns({text_col: F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(others))]
            columns = [*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def op1_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
