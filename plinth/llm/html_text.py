"""Main text of web pages from flat text blocks and a decision tree.

Markup is cut into flat blocks of text.  A block is described by its own and
its neighbours' word counts and link densities (Kohlschütter et al. 2010), by
whether it lies in a part that its element names as page furniture, by where it
lies relative to the page's article, and by whether it is a heading or a
paragraph.  A decision tree, grown on the small labelled table below, tells main
text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import texts

#: HTML's elements by their role here.
RAW = {"script", "style", "textarea", "title"}
#: Elements whose inside is no text of the page, if they are closed.
INSERTED = {"template", "svg", "canvas", "iframe", "object", "math", "select", "audio", "video", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul", "button",
}
#: Elements whose start ends an open one of the same name.
SELF_ENDING = {"p", "li", "dd", "dt", "tr", "td", "th"}
HEADINGS, PARAGRAPHS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre", "dd", "figcaption"}
FURNITURE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "fieldset", "head"}
#: Words of class, id and role that name page furniture, whatever stands beside them.
FURNITURE_NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "feedback", "footer",
    "gdpr", "login", "masthead", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "promoted", "replies", "respond", "sidebar", "signup", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
#: Words that do so alone, with each other or with words of arrangement; with other words they may name a subject.
FURNITURE_HINTS = {
    "banner", "bar", "copyright", "discussion", "header", "legal", "menu", "notice", "notification", "notifications", "pager", "promotion", "related", "reply", "search", "share", "sharing",
    "skip", "social", "tags", "teaser",
}
#: Those of them that inside an article name its subject as well.
SUBJECTS = {"discussion", "legal", "search"}
ARRANGEMENT = {
    "area", "block", "bottom", "box", "button", "buttons", "container", "content", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "module", "page",
    "panel", "post", "posts", "right", "row", "section", "site", "slot", "stories", "text", "title", "to", "top", "unit", "wrap", "wrapper", "zone",
}

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_GAP, _NAME, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORD = re.compile(r"[a-z]+")
FEATURES = ["words_before", "words", "words_after", "links_before", "links", "links_after", "furniture", "zone", "kind"]


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int, bool] | None:
    """A tag's attributes, its end and whether it closes itself; None if the page ends first.

    ``last``: where each quote occurs last, so that no search for one is in vain.
    """
    out: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return None
        if page[at] == ">":
            return out, at + 1, page[at - 1] == "/"
        name = _NAME.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if last.get(quote, -1) > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare.group(), bare.end()
        out.setdefault(name.group().lower(), value)


def _tokens(page: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """(kind, name or text, attributes, closes itself); kinds are text, open, close and raw.

    One pass: whatever is broken is looked for once.  A tag that the page's end
    cuts off within a quote ends at its first ``>``, as do all after it.
    """
    at, last, strict = 0, {c: page.rfind(c) for c in "\"'>"}, True
    last_comment, last_data = page.rfind("-->"), page.rfind("]]>")
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last[">"] and not page.startswith("<!--", lt):
            yield "text", page[at:], {}, False
            return
        if lt > at:
            yield "text", page[at:lt], {}, False
        if page.startswith("<!--", lt):
            at = page.index("-->", lt + 2) + 3 if last_comment >= lt + 2 else len(page)
            continue
        if page.startswith("<![CDATA[", lt) and last_data > lt:
            at = page.index("]]>", lt) + 3
            continue
        if page[lt + 1] in "!?":
            at = page.index(">", lt) + 1
            continue
        tag = _TAG.match(page, lt + 1)
        if tag is None:
            if page[lt + 1] == "/":
                at = page.index(">", lt) + 1
            else:
                yield "text", "<", {}, False
                at = lt + 1
            continue
        read = _attributes(page, tag.end(), last) if strict else None
        strict = read is not None
        attributes, at, empty = read or ({}, page.index(">", lt) + 1, False)
        name = tag.group(2).lower()
        if tag.group(1):
            yield "close", name, {}, False
            continue
        yield ("raw" if name in RAW else "open"), name, attributes, empty
        if name in RAW and not (empty and name in ("title", "style", "script")):
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)


class Inserted:
    """An element such as svg, within another perhaps; what it holds goes if it is closed."""

    __slots__ = ("around", "closed")

    def __init__(self, around: Inserted | None):
        self.around, self.closed = around, False


class Block:
    __slots__ = ("parts", "furniture", "zone", "kind", "text", "words", "links")

    def __init__(self, furniture: int, zone: int, kind: int):
        self.parts: list[tuple[str, bool, Inserted | None]] = []  # piece, in a link, innermost inserted element
        self.furniture, self.zone, self.kind = furniture, zone, kind


class Open:
    """An open element: what it is, and what holds inside it."""

    __slots__ = ("name", "furniture", "article", "inserted")

    def __init__(self, name: str, furniture: int, article: bool, inserted: Inserted | None):
        self.name, self.furniture, self.article, self.inserted = name, furniture, article, inserted


_PAGE = Open("", 0, False, None)


def blocks(page: str | None) -> list[Block]:
    """The page's flat blocks, in order, with their own features.

    furniture: 2 in an element that is or is named page furniture, 1 where a
    name only hints at it.  zone: 2 inside an article or main element, 0 outside
    of the page's, and 1 on a page that has none.  kind: 2 for headings, 1 for
    paragraphs.
    """
    out: list[Block] = []
    stack: list[Open] = []
    marks: list[int] = []  # places in the stack of blocks, inserted elements and links
    count: Counter[str] = Counter()  # open elements by name
    made: list[Inserted] = []
    current: Block | None = None

    def cut(depth: int) -> None:
        for gone in stack[depth:]:
            count[gone.name] -= 1
        del stack[depth:]
        while marks and marks[-1] >= depth:
            marks.pop()

    for what, name, attributes, empty in _tokens(page or ""):
        if what == "text":
            inside = stack[-1] if stack else _PAGE
            if current is None:
                block = next((stack[i].name for i in reversed(marks[-3:]) if stack[i].name in BLOCK), "")
                kind = 2 if any(count[h] for h in HEADINGS) else int(block in PARAGRAPHS)
                current = Block(inside.furniture, 2 if inside.article else 0, kind)
            current.parts.append((name, count["a"] > 0, inside.inserted))
            continue
        if name in BLOCK and current is not None:
            out.append(current)
            current = None
        if what == "raw" or name in VOID:
            if name == "br" and current is not None:
                current.parts.append((" ", False, None))
            continue
        if what == "close":
            if count[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                if name in INSERTED:
                    stack[depth].inserted.closed = True
                cut(depth)
            continue
        if empty and (name in ("svg", "math") or count["svg"] or count["math"]):
            continue  # there '/>' ends an element, as in XML
        if count[name] and (name in SELF_ENDING or name == "a"):
            # an element of this kind ends the open one, unless a container lies between
            for i in reversed(marks[-2:]):
                if stack[i].name == name:
                    cut(i)
                    break
                if stack[i].name != "a":
                    break
        inside = stack[-1] if stack else _PAGE
        furniture, article, inserted = inside.furniture, inside.article, inside.inserted
        named = _furniture(name, attributes, article)
        if named < 2 and (name in ("article", "main") or attributes.get("role") == "main" or "articleBody" in attributes.get("itemprop", "")):
            # what an unclosed element before it was cannot claim the page's article
            furniture, article = furniture if article else 0, True
        if name in INSERTED:
            inserted = Inserted(inserted)
            made.append(inserted)
        if name in BLOCK or name in INSERTED or name == "a":
            marks.append(len(stack))
        stack.append(Open(name, max(furniture, named), article, inserted))
        count[name] += 1
    if current is not None:
        out.append(current)
    for element in made:  # outer ones come first
        element.closed |= element.around is not None and element.around.closed
    out = [b for b in out if _finish(b)]
    if not any(b.zone for b in out):
        for b in out:
            b.zone = 1
    return out


def _finish(block: Block) -> bool:
    """Put a block's text together, without what closed inserted elements hold; whether any is left."""
    parts = [(piece, linked) for piece, linked, inserted in block.parts if inserted is None or not inserted.closed]
    block.text = " ".join(html.unescape("".join(piece for piece, _ in parts)).split())
    if block.text:
        block.words = len(block.text.split(" "))
        block.links = min(1.0, len(html.unescape(" ".join(piece for piece, linked in parts if linked)).split()) / block.words)
    return bool(block.text)


def _furniture(name: str, attributes: dict[str, str], article: bool) -> int:
    if name in FURNITURE or name == "header" and not article:
        return 2
    if not attributes or name in ("html", "body"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return 2
    found = 0
    for key in ("class", "id", "role"):
        for token in attributes.get(key, "").lower().split():
            words = set(_WORD.findall(token))
            hints = words & FURNITURE_HINTS
            if words & FURNITURE_NAMES:
                return 2
            if not hints or name in ("article", "main") or hints == {"header"} and words & {"article", "entry", "post", "story"}:
                continue
            # a part of an article may be named by its subject: there density decides
            if words <= FURNITURE_HINTS | ARRANGEMENT and not (article and words <= SUBJECTS):
                return 2
            found = 1
    return found


def feature_rows(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([0, *[b.words for b in found], 0], float)
    links = np.array([0, *[b.links for b in found], 0], float)
    own = np.array([[b.furniture, b.zone, b.kind] for b in found], float).reshape(n, 3)
    return np.column_stack([words[:-2], words[1:-1], words[2:], links[:-2], links[1:-1], links[2:], own])


#: The labelled table: the features in order, then 1 for main text.
LABELLED = np.array([
    # inside an article: paragraphs of any length, headings, lists; not link lists
    [0, 9, 60, 0, 0, 0, 0, 2, 2, 1], [9, 60, 40, 0, 0, 0, 0, 2, 0, 1], [60, 40, 1, 0, 0, 0, 0, 2, 0, 1], [40, 1, 30, 0, 0, 0, 0, 2, 0, 1], [1, 30, 12, 0, 0.1, 0, 0, 2, 0, 1],
    [30, 4, 8, 0, 0, 0, 0, 2, 0, 1], [12, 150, 0, 0, 0.2, 0, 0, 2, 0, 1], [8, 2, 90, 1, 0, 0, 0, 2, 2, 1], [6, 25, 25, 1, 0.3, 0, 0, 2, 0, 1], [80, 18, 3, 0, 0.4, 1, 0, 2, 0, 1],
    [12, 4, 4, 0, 0, 0, 0, 2, 2, 1], [10, 1, 1, 0, 0, 0, 0, 2, 2, 1], [1, 1, 1, 0, 0, 0, 0, 2, 0, 1], [4, 4, 9, 0, 0, 0, 0, 2, 0, 1], [2, 1, 0, 0, 0, 0, 0, 2, 0, 1], [5, 3, 1, 1, 0, 1, 0, 2, 0, 1],
    [12, 9, 2, 0, 0, 0, 0, 2, 2, 1], [300, 2, 5, 0, 0, 0, 0, 2, 0, 1], [14, 600, 14, 0, 0, 0, 0, 2, 0, 1], [9, 9, 300, 0, 0, 0, 0, 2, 0, 1], [1, 8, 8, 1, 0.3, 0.2, 0, 2, 0, 1], [4, 10, 0, 0, 0.5, 0, 0, 2, 0, 1],
    [3, 3, 3, 1, 1, 1, 0, 2, 0, 0], [40, 2, 2, 0, 1, 1, 0, 2, 0, 0], [2, 4, 20, 1, 1, 0, 0, 2, 0, 0], [20, 6, 0, 0, 0.9, 0, 0, 2, 0, 0],
    [4, 2, 3, 0, 0, 1, 0, 2, 0, 1], [20, 2, 1, 0, 0, 1, 0, 2, 0, 1], [2, 2, 3, 1, 0, 1, 0, 2, 0, 1], [9, 3, 2, 0.2, 0.1, 1, 0, 2, 0, 1], [2, 5, 9, 0, 0.4, 1, 0, 2, 1, 1], [30, 2, 4, 0, 0.5, 1, 0, 2, 0, 1],
    # furniture, wherever it lies and however wordy it is
    [0, 1, 1, 0, 1, 1, 2, 0, 0, 0], [1, 1, 1, 1, 1, 1, 2, 0, 0, 0], [1, 12, 9, 1, 0, 0, 2, 0, 0, 0], [50, 14, 0, 0, 0, 0, 2, 0, 0, 0], [30, 45, 60, 0, 0, 0, 2, 2, 0, 0],
    [60, 80, 20, 0, 0, 0, 2, 2, 0, 0], [10, 3, 40, 0, 0, 0, 2, 2, 2, 0], [0, 20, 40, 0, 0.1, 0, 2, 1, 0, 0], [30, 60, 3, 0, 0, 0, 2, 1, 0, 0], [3, 3, 30, 1, 0, 0, 2, 1, 2, 0],
    # outside of the article of a page that has one
    [0, 3, 1, 0, 0, 1, 0, 0, 0, 0], [1, 40, 9, 1, 0, 0, 0, 0, 0, 0], [90, 25, 4, 0, 0.1, 0, 0, 0, 0, 0], [4, 6, 50, 1, 0, 0, 0, 0, 2, 0], [20, 120, 20, 0, 0, 0, 0, 0, 0, 0],
    # pages without an article: density of text and of links decides
    [1, 1, 1, 1, 1, 1, 0, 1, 0, 0], [2, 2, 2, 1, 1, 1, 0, 1, 0, 0], [3, 3, 40, 1, 0.8, 0, 0, 1, 0, 0], [2, 5, 2, 1, 0, 1, 0, 1, 0, 0], [0, 4, 2, 0, 0, 1, 0, 1, 0, 0],
    [4, 6, 0, 0.9, 0, 0, 0, 1, 0, 0], [8, 30, 6, 1, 0.7, 1, 0, 1, 0, 0], [50, 7, 2, 0, 0.8, 1, 0, 1, 0, 0], [2, 9, 3, 1, 0.6, 1, 0, 1, 0, 0], [60, 5, 0, 0, 0, 0, 0, 1, 0, 0],
    [2, 40, 60, 1, 0, 0, 0, 1, 0, 1], [40, 60, 12, 0, 0.1, 0, 0, 1, 0, 1], [60, 14, 45, 0, 0, 0, 0, 1, 0, 1], [14, 45, 8, 0, 0.2, 0.5, 0, 1, 0, 1], [5, 90, 5, 0.5, 0.05, 0, 0, 1, 0, 1],
    [4, 8, 60, 1, 0, 0, 0, 1, 2, 1], [0, 6, 35, 0, 0, 0, 0, 1, 2, 1], [50, 5, 40, 0, 0, 0, 0, 1, 0, 1], [30, 4, 80, 0, 0, 0, 0, 1, 2, 1], [30, 22, 30, 0, 0.3, 0, 0, 1, 0, 1],
    [3, 3, 2, 1, 0, 1, 0, 1, 2, 0], [20, 3, 2, 1, 0, 1, 0, 1, 2, 0], [45, 30, 0, 0, 0, 0, 0, 1, 0, 1], [20, 90, 0, 0, 0.1, 0, 0, 1, 0, 1], [50, 13, 0, 0, 0, 0, 0, 1, 0, 1],
    [40, 30, 3, 0, 0, 1, 0, 1, 0, 1], [40, 25, 2, 0, 0, 0.9, 0, 1, 0, 1], [60, 3, 4, 0, 0, 1, 0, 1, 0, 0], [12, 4, 3, 0, 0, 0, 0, 1, 0, 0], [3, 4, 3, 0, 0, 0, 0, 1, 0, 0], [30, 5, 4, 0, 0, 0.4, 0, 1, 0, 0],
    [2, 5, 30, 1, 0, 0, 0, 1, 2, 1], [1, 4, 25, 1, 0, 0.05, 0, 1, 2, 1], [2, 6, 50, 1, 0, 0, 0, 1, 2, 1], [1, 5, 40, 1, 0, 0, 0, 1, 0, 0],
    # names that only hint at furniture: density decides
    [40, 60, 30, 0, 0, 0, 1, 2, 1, 1], [30, 12, 40, 0, 0.1, 0, 1, 2, 1, 1], [60, 4, 8, 0, 0, 0, 1, 2, 1, 1], [20, 3, 60, 0, 0, 0, 1, 2, 2, 1], [50, 25, 10, 0, 0.2, 0, 1, 2, 0, 1],
    [40, 6, 3, 0, 1, 1, 1, 2, 0, 0], [30, 2, 2, 0, 1, 1, 1, 2, 0, 0], [60, 8, 0, 0, 0.9, 0, 1, 2, 1, 0], [9, 30, 4, 0.5, 0, 0, 1, 0, 1, 0], [20, 4, 3, 0, 1, 1, 1, 1, 0, 0],
    [20, 30, 25, 0, 0, 0, 1, 1, 1, 1], [30, 4, 2, 0, 0, 0, 1, 1, 0, 0],
    # pages without an article: paragraphs and headings of any length, unless they are or lead to links
    [3, 2, 2, 0, 0, 0, 0, 1, 1, 1], [0, 1, 0, 0, 0, 0, 0, 1, 1, 1], [40, 2, 30, 0, 0, 0, 0, 1, 1, 1], [60, 3, 0, 0, 0, 0, 0, 1, 1, 1], [2, 60, 3, 1, 0.1, 0, 0, 1, 1, 1], [4, 12, 1, 1, 0.2, 1, 0, 1, 1, 1],
    [2, 7, 1, 0, 0, 1, 0, 1, 1, 1], [12, 3, 1, 0, 0, 1, 0, 1, 1, 1], [5, 1, 1, 0, 0, 1, 0, 1, 1, 1], [30, 5, 2, 0, 0, 1, 0, 1, 1, 1], [0, 15, 2, 0, 0, 1, 0, 1, 1, 1], [3, 2, 2, 1, 0, 0, 0, 1, 1, 1],
    [0, 3, 2, 0, 0, 0, 0, 1, 2, 1], [2, 3, 4, 0, 0, 0, 0, 1, 2, 1], [1, 3, 2, 1, 0, 0, 0, 1, 2, 1], [50, 2, 3, 0, 0, 0, 0, 1, 2, 1],
    [40, 2, 1, 0, 0, 1, 0, 1, 2, 0], [3, 4, 1, 0, 0, 1, 0, 1, 2, 0], [2, 3, 3, 1, 1, 1, 0, 1, 1, 0], [30, 5, 0, 0, 0.9, 0, 0, 1, 1, 0], [0, 4, 20, 0, 1, 0, 0, 1, 1, 0], [9, 6, 9, 0, 0.8, 0, 0, 1, 1, 0],
])


class DecisionTree:
    """CART with Gini impurity, grown until leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10):
        self.nodes: list[tuple[int, float, int, int, bool]] = []
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, bool(2 * y.sum() > len(y))))
        if depth and 0 < y.sum() < len(y) and (best := self._best(x, y)) is not None:
            feature, cut = best
            low = x[:, feature] <= cut
            left = self._grow(x[low], y[low], depth - 1)
            right = self._grow(x[~low], y[~low], depth - 1)
            self.nodes[at] = (feature, cut, left, right, self.nodes[at][4])
        return at

    @staticmethod
    def _best(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        best, found = np.inf, None
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[:, feature] <= cut
                impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
                if impurity < best - 1e-12:
                    best, found = impurity, (feature, float(cut))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            feature, cut, left, right, verdict = self.nodes[at]
            if feature < 0:
                out[rows] = verdict
                continue
            low = x[rows, feature] <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


_tree: DecisionTree | None = None


def tree() -> DecisionTree:
    global _tree
    if _tree is None:
        _tree = DecisionTree(LABELLED[:, :-1], LABELLED[:, -1])
    return _tree


def main_text(page: str | None) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree().predict(feature_rows(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Reads page_id, url and html.  Null and empty html, and pages without main
    text, give an empty text and 0.  Ids and urls are passed on as they are,
    null or repeated.  Unclosed and stray tags do not lose text, but an unclosed
    script, style, textarea, title or comment runs to the end of the page, as in a
    browser.
    A page takes time in proportion to its length, however broken it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(t) for t in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
