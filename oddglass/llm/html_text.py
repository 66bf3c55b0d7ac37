"""Main text of HTML pages: flat blocks classified by a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block has its own word count and
link density, those of its neighbours (the block before and after it, and the longest plain text
within two blocks on either side), and what encloses it. A decision tree fitted in numpy on the
small labelled table below says which blocks are main text.

What encloses a block is read from tags and from the parts of class and id names: menus, headers,
footers, sidebars, notices, adverts, forms and comments. Such an element counts only if it does not
hold the page: the page's main part is the article, main or so named element with the most words
of its own, and whatever encloses that is no menu, whatever its name; on a page without one neither
is a form or a named element that holds most of the page's words. Names that say how a page is laid out (has-sidebar,
sidebar-right, no-header) are not names of parts, and an element that is also named as main text is.

Scripts, styles, comments of the markup, the head and hidden text are no blocks. Character
references are decoded, white space inside a block becomes one space, kept blocks are joined by a
line end in page order. Null and empty pages, and pages without main text, give the empty text.
Unclosed and stray tags are tolerated: a tag ends at the next "<" where it is never closed, and a
button or list box at the next block. Work grows with a page's length, however it is broken; pages
of any length are read whole inside Spark's own partitions, without a shuffle. Rows are kept one for
one, repeated rows and null ids included; other columns are left behind.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, narrow, rows, texts

OPEN = re.compile(r"<(?:!--|(/?)([A-Za-z][A-Za-z0-9:-]*)|[!?])")
#: What matters inside a tag, and inside a declaration.
STOP, CLOSE = re.compile(r"""[<>"']"""), re.compile(r"[<>]")
#: Quoted values that hold a "<" may be so long and so many in one tag; without one they have no bound.
ODD_VALUE, ODD_VALUES = 1024, 64
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "button", "option", "canvas"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
MAIN = {"article", "main"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
#: Names of classes and ids, by their parts, that mark what is not main text.
CHROME_NAMES = set("ad ads advert advertisement advertising banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice gdpr popup modal newsletter subscribe signup comment comments disqus reply replies respond related share sharing social toolbar widget login search pagination pager copyright disclaimer alert".split())
MAIN_NAMES = {"article", "main", "content", "post", "entry", "story"}
#: Parts that make a name one of the page's layout: "has-sidebar" is not a sidebar.
LAYOUT = {"has", "with", "without", "no"}
#: Parts that name a piece of the text itself where they stand inside the main part.
OF_TEXT = {"header", "masthead"}
ROLES = {"navigation", "complementary", "contentinfo", "search", "form", "alert", "dialog"}
PARTS = re.compile(r"[a-z]+")
#: Elements that end an unclosed button or list box.
BREAKS = re.compile(r"<(?:/?(?:address|article|aside|blockquote|body|div|dl|fieldset|footer|form|h[1-6]|header|html|main|nav|ol|p|section|table|ul))\b", re.I)
#: Share of a page's words below an element that makes it the page rather than a part of it.
MOST = 0.5
#: What the words of a main part count for that stands inside a menu or the like, such as comments.
UNDER = 0.3


class Block:
    __slots__ = ("text", "words", "links", "main", "chrome", "heading", "inside")

    def __init__(self, text, words, links, heading, inside):
        self.text, self.words, self.links, self.heading, self.inside = text, words, links, heading, inside
        self.main = self.chrome = False


class Element:
    """An open element with a role: what it is, whether by its name only, and the words found below it."""

    __slots__ = ("name", "role", "named", "soft", "above", "words", "own", "holds")

    def __init__(self, name, role, named, soft, above):
        self.name, self.role, self.named, self.soft, self.above = name, role, named, soft, above
        self.words = self.own = 0
        self.holds = False


def _role(name: str, attributes: str) -> tuple[str, bool, bool]:
    """(main, chrome, hidden or nothing; by name only; text where it stands in the main part) of an opened element."""
    role, named = ("chrome", False) if name in CHROME else ("main", False) if name in MAIN else ("", True)
    main, chrome = False, set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if key == "hidden" and not attributes[m.start() - 1:m.start()].strip() or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden", False, False
        if key in ("class", "id", "role"):
            for one in value.split():
                parts = set(PARTS.findall(one))
                if key == "role" and one in ROLES:
                    chrome.add(one)
                elif parts & CHROME_NAMES and not parts & LAYOUT:
                    chrome |= parts & CHROME_NAMES
                elif parts & MAIN_NAMES and not parts & CHROME_NAMES:
                    main = True
    if role or name in ("body", "html"):
        return role, named, False
    if name == "header":
        return "chrome", True, True
    return ("main" if main else "chrome" if chrome else ""), True, name == "p" or chrome <= OF_TEXT


class Reader:
    """One page as flat blocks and the elements that enclose them."""

    def __init__(self, page: str):
        self.page, self.out, self.stack = page, [], []
        self.open: dict[str, int] = {}
        self.roles: list[Element | None] = [None]
        self.hidden = self.link = 0
        self.heading = False
        self.texts, self.linked = [], []
        self.absent: dict[str, int] = {}
        self.closes: dict[str, tuple[int, int]] = {}
        self.read()
        self.settle()

    def tag_end(self, at: int) -> int:
        """Behind the tag whose name ends at ``at``; -1 where another tag starts before it is closed."""
        odd = 0
        while True:
            m = STOP.search(self.page, at)
            if not m or m.group() == "<":
                return -1
            if m.group() == ">":
                return m.end()
            quote, at = m.group(), m.end()
            if at >= self.absent.get(quote, len(self.page) + 1):
                continue
            end = self.page.find(quote, at)
            if end < 0:
                self.absent[quote] = at
            elif self.page.find("<", at, end) < 0:
                at = end + 1
            else:
                odd += 1
                if end - at > ODD_VALUE or odd > ODD_VALUES:
                    return -1
                at = end + 1

    def raw_end(self, name: str, at: int) -> int:
        """Where the page goes on behind an element that holds no text of it."""
        start, end = self.closes.get(name, (-1, -1))
        if start < at and name not in self.absent:
            m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, at)
            if m:
                start, end = self.closes[name] = m.span()
            else:
                self.absent[name] = at
        if start < at:  # never closed
            return len(self.page) if name in ("script", "style") else at
        if name in ("button", "select", "option") and (b := BREAKS.search(self.page, at, start)):
            return b.start()
        return end

    def flush(self) -> None:
        if self.texts:
            whole = " ".join(html.unescape("".join(self.texts)).split())
            if whole:
                words = whole.count(" ") + 1
                n = len(html.unescape("".join(self.linked)).split()) if self.linked else 0
                inside = self.roles[-1]
                self.out.append(Block(whole, words, min(1.0, n / words), self.heading, inside))
                if inside is not None:
                    inside.own += words
        self.texts, self.linked = [], []

    def push(self, name: str, role: str, named: bool, soft: bool) -> None:
        self.stack.append((name, role))
        self.open[name] = self.open.get(name, 0) + 1
        if role == "hidden":
            self.hidden += 1
        elif role:
            above = self.roles[-1]
            self.roles.append(Element(name, role, named, soft, above))
            self.made.append(self.roles[-1])

    def close(self, index: int) -> None:
        while len(self.stack) > index:
            name, role = self.stack.pop()
            self.open[name] -= 1
            if role == "hidden":
                self.hidden -= 1
            elif role:
                self.roles.pop()

    def find(self, name: str, stops: frozenset = frozenset()) -> int | None:
        """The innermost open element of that name. What lies above it is closed with it, so the walk is paid for."""
        if not self.open.get(name):
            return None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                return i
            if self.stack[i][0] in stops:
                return None
        return None

    def read(self) -> None:
        page, at, end = self.page, 0, len(self.page)
        self.made: list[Element] = []
        text_from = 0

        def text(upto: int) -> None:
            if upto > text_from and not self.hidden:
                piece = page[text_from:upto]
                self.texts.append(piece)
                if self.link:
                    self.linked.append(piece)

        while True:
            m = OPEN.search(page, at)
            if not m:
                break
            name = (m.group(2) or "").lower()
            if not name:
                if m.group() == "<!--":
                    stop = page.find("-->", m.end())
                    after = end if stop < 0 else stop + 3
                else:
                    c = CLOSE.search(page, m.end())
                    after = c.end() if c and c.group() == ">" else -1
            else:
                after = self.tag_end(m.end())
            if after < 0:  # not a tag: its "<" is text
                at = m.end()
                continue
            text(m.start())
            at = text_from = after
            if name:
                at = text_from = self.tag(name, bool(m.group(1)), page[m.end():after - 1], after)
        text(end)
        self.flush()

    def tag(self, name: str, closing: bool, attributes: str, at: int) -> int:
        """Take one tag; returns where the page goes on."""
        if name in RAW and not closing and not attributes.endswith("/"):
            after = self.raw_end(name, at)
            if name in ("option", "select", "button", "textarea", "iframe", "title"):
                self.texts.append(" ")
            return after
        if name == "br":
            self.texts.append(" ")
            return at
        if name == "a":
            self.link = 0 if closing else 1
            if not closing:
                self.linked.append(" ")
            return at
        if name in BLOCK:
            self.flush()
            self.heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if name in ("p", "li", "td", "div", "section", "article"):
                self.link = 0 if closing or name in ("p", "li") else self.link
        if name in VOID:
            return at
        if name == "p":
            old = self.find("p", P_STOPS)
            if old is not None:
                self.close(old)
            role, named, soft = ("", True, True) if closing else _role(name, attributes)
            if role in ("chrome", "hidden"):
                self.push("p", role, named, soft)
            return at
        if closing:
            index = self.find(name)
            if index is not None:
                self.close(index)
        elif (name in BLOCK or name in ("span", "ins")) and not attributes.endswith("/"):
            role, named, soft = _role(name, attributes)
            self.push(name, "" if name == "span" and role == "main" else role, named, soft)
        return at

    def settle(self) -> None:
        """Which enclosing elements count: each block is then inside the main part, inside other parts, or neither."""
        total = sum(b.words for b in self.out)
        for e in self.made:
            e.words = e.own
        for e in reversed(self.made):  # an element comes after the one that encloses it
            if e.above is not None:
                e.above.words += e.words
        # The page's main part: what has most words outside menus and the like within it.
        plain = {id(e): e.own if e.role == "main" else 0 for e in self.made}
        for e in reversed(self.made):
            if e.role == "main" and e.above is not None and e.above.role == "main":
                plain[id(e.above)] += plain[id(e)]
        under: dict[int, bool] = {}
        for e in self.made:
            under[id(e)] = e.above is not None and (under[id(e.above)] or e.above.role == "chrome")
        mains = [e for e in self.made if e.role == "main" and plain[id(e)]]
        best = max(mains, key=lambda e: plain[id(e)] * (UNDER if under[id(e)] else 1.0), default=None)
        e = best.above if best is not None else None
        while e is not None:
            e.holds, e = True, e.above
        state: dict[int, tuple[bool, bool]] = {}
        for e in self.made:
            main, chrome = state[id(e.above)] if e.above is not None else (False, False)
            if e.role == "main":
                main = True
            elif not ((e.named or e.name in HOLDERS) and (e.holds or best is None and e.words > MOST * total)):
                # Inside the main part a header, or a paragraph named as a notice, is part of the text.
                chrome = chrome or not (main and e.soft)
            state[id(e)] = main, chrome
        for b in self.out:
            if b.inside is not None:
                b.main, b.chrome = state[id(b.inside)]


#: Tags of forms, which may enclose a whole page.
HOLDERS = {"form", "fieldset"}
P_STOPS = frozenset(MAIN | {"div", "section"})


def blocks(page: str) -> list[Block]:
    """The page's flat blocks of text, in order."""
    return Reader(page).out


# A small labelled table. Columns: words, link density, words and link density of the block
# before and after, inside the main part, the page has a main part, inside a menu or the like,
# heading, label (1: main text).
_SINGLE = np.array([
    [1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 0], [1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 0], [2, 1.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 0],
    [8, 0.0, 1, 1.0, 11, 0.0, 0, 1, 1, 0, 0], [30, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 0], [12, 0.0, 90, 0.0, 0, 0.0, 0, 1, 1, 0, 0],
    [60, 0.0, 80, 0.0, 0, 0.0, 0, 1, 1, 0, 0], [5, 0.2, 70, 0.0, 6, 0.0, 0, 1, 1, 0, 0], [25, 0.0, 40, 0.0, 12, 0.0, 1, 1, 1, 0, 0],
    [70, 0.0, 50, 0.0, 9, 0.0, 1, 1, 1, 0, 0], [3, 1.0, 40, 0.0, 3, 1.0, 1, 1, 1, 0, 0], [14, 0.1, 30, 0.0, 16, 0.0, 1, 1, 1, 0, 0],
    [6, 0.0, 2, 1.0, 30, 0.0, 0, 0, 1, 1, 0], [45, 0.0, 6, 0.0, 50, 0.0, 0, 0, 1, 0, 0], [4, 1.0, 4, 1.0, 4, 1.0, 0, 0, 1, 0, 0],
    [11, 0.0, 9, 0.0, 90, 0.0, 1, 1, 0, 1, 1], [6, 0.0, 8, 0.0, 40, 0.0, 1, 1, 0, 1, 1], [90, 0.0, 11, 0.0, 40, 0.0, 1, 1, 0, 0, 1],
    [120, 0.05, 90, 0.0, 2, 0.0, 1, 1, 0, 0, 1], [2, 0.0, 120, 0.0, 30, 0.0, 1, 1, 0, 0, 1], [1, 0.0, 40, 0.0, 50, 0.0, 1, 1, 0, 0, 1],
    [30, 0.2, 2, 0.0, 1, 0.0, 1, 1, 0, 0, 1], [7, 0.0, 30, 0.0, 12, 0.0, 1, 1, 0, 0, 1], [3, 0.0, 7, 0.0, 3, 0.0, 1, 1, 0, 0, 1],
    [15, 0.4, 30, 0.0, 25, 0.0, 1, 1, 0, 0, 1], [4, 0.5, 60, 0.0, 20, 0.0, 1, 1, 0, 0, 1], [1, 1.0, 50, 0.0, 40, 0.0, 1, 1, 0, 0, 1],
    [9, 1.0, 40, 0.0, 60, 0.0, 1, 1, 0, 0, 1], [400, 0.0, 5, 0.0, 10, 0.0, 1, 1, 0, 0, 1], [5, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0, 0, 1],
    [3, 0.0, 0, 0.0, 5, 0.0, 0, 1, 0, 0, 0], [20, 0.0, 2, 1.0, 9, 0.0, 0, 1, 0, 0, 0], [50, 0.0, 60, 0.0, 4, 0.0, 0, 1, 0, 0, 0],
    [9, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0, 0, 0], [7, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 1, 0], [2, 1.0, 1, 1.0, 5, 0.0, 0, 1, 0, 0, 0],
    [1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0], [2, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0], [3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0],
    [2, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0], [12, 0.9, 3, 1.0, 14, 0.8, 0, 0, 0, 0, 0], [25, 0.6, 12, 0.9, 20, 0.7, 0, 0, 0, 0, 0],
    [40, 0.5, 30, 0.6, 10, 0.9, 0, 0, 0, 0, 0], [6, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0], [4, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0],
    [5, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 0, 0], [6, 0.3, 50, 0.0, 3, 1.0, 0, 0, 0, 0, 0], [3, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 0, 0],
    [40, 0.0, 3, 0.0, 50, 0.0, 0, 0, 0, 0, 1], [60, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 1], [25, 0.0, 60, 0.1, 3, 1.0, 0, 0, 0, 0, 1],
    [120, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0, 0, 1], [18, 0.1, 40, 0.0, 60, 0.0, 0, 0, 0, 0, 1], [35, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1],
    [16, 0.0, 0, 0.0, 20, 0.0, 0, 0, 0, 0, 1], [22, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 1], [300, 0.2, 20, 0.0, 12, 0.9, 0, 0, 0, 0, 1],
    [6, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1, 1], [4, 0.0, 80, 0.0, 70, 0.0, 0, 0, 0, 1, 1], [9, 0.0, 3, 0.0, 45, 0.0, 0, 0, 0, 1, 1],
    [2, 1.0, 0, 0.0, 48, 0.0, 0, 0, 0, 0, 0], [3, 1.0, 60, 0.0, 60, 0.0, 0, 0, 0, 0, 0], [1, 1.0, 48, 0.0, 0, 0.0, 0, 0, 0, 0, 0],
    [5, 0.8, 30, 0.0, 40, 0.0, 0, 0, 0, 0, 0], [8, 0.9, 0, 0.0, 90, 0.0, 0, 0, 0, 0, 0], [4, 0.6, 70, 0.0, 55, 0.0, 0, 0, 0, 0, 0],
    [3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 0], [2, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 1, 0], [4, 1.0, 10, 0.9, 4, 1.0, 0, 0, 0, 1, 0],
])

# Blocks of pages without a main part, judged by more than their neighbours: before the label stand
# the longest plain text within two blocks before and after.
_SHORT = np.array([
    [3, 0.0, 40, 0.0, 3, 0.0, 0, 0, 0, 0, 40, 40, 1], [3, 0.0, 3, 0.0, 40, 0.0, 0, 0, 0, 0, 40, 40, 1], [2, 0.0, 60, 0.0, 2, 0.0, 0, 0, 0, 0, 60, 30, 1],
    [2, 0.0, 2, 0.0, 30, 0.0, 0, 0, 0, 0, 60, 30, 1], [1, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 0, 50, 60, 1], [2, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 40, 30, 1],
    [5, 0.2, 4, 0.0, 25, 0.0, 0, 0, 0, 0, 25, 45, 1], [14, 0.0, 40, 0.0, 40, 0.0, 0, 0, 0, 0, 40, 40, 1], [9, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0, 50, 0, 1],
    [8, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 60, 0, 1], [14, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 30, 0, 1], [9, 0.0, 3, 0.0, 50, 0.0, 0, 0, 0, 0, 3, 50, 1],
    [14, 0.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0, 0, 40, 1], [10, 0.1, 12, 0.0, 35, 0.0, 0, 0, 0, 0, 12, 35, 1], [12, 0.0, 35, 0.0, 10, 0.0, 0, 0, 0, 0, 35, 10, 1],
    [2, 0.0, 1, 1.0, 48, 0.0, 0, 0, 0, 1, 0, 48, 1], [2, 0.0, 0, 0.0, 48, 0.0, 0, 0, 0, 1, 0, 48, 1], [3, 0.0, 40, 0.0, 40, 0.0, 0, 0, 0, 1, 40, 40, 1],
    [3, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, 0, 0, 60, 0], [2, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 60, 0, 0], [3, 0.0, 50, 0.0, 2, 0.0, 0, 0, 0, 0, 50, 2, 0],
    # Menus and the like stay out whatever stands near, with a main part on the page and without one.
    [14, 0.0, 9, 0.0, 60, 0.0, 0, 1, 1, 0, 60, 60, 0], [3, 0.0, 60, 0.0, 40, 0.0, 0, 1, 1, 0, 60, 40, 0], [40, 0.0, 60, 0.0, 50, 0.0, 0, 1, 1, 0, 60, 50, 0],
    [14, 0.0, 50, 0.0, 14, 0.0, 0, 0, 1, 0, 50, 60, 0], [3, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 0, 40, 60, 0], [60, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1, 0, 40, 50, 0],
    [8, 0.0, 40, 0.0, 60, 0.0, 1, 1, 1, 0, 40, 60, 0], [30, 0.0, 40, 0.0, 60, 0.0, 1, 1, 1, 0, 40, 60, 0], [2, 0.0, 50, 0.0, 40, 0.0, 1, 1, 1, 1, 50, 40, 0],
    [14, 0.0, 40, 0.0, 40, 0.0, 0, 1, 0, 0, 40, 40, 0], [40, 0.0, 60, 0.0, 60, 0.0, 0, 1, 0, 0, 60, 60, 0], [3, 0.0, 40, 0.0, 30, 0.0, 0, 1, 0, 0, 40, 30, 0],
    [4, 1.0, 60, 0.0, 60, 0.0, 0, 0, 0, 0, 60, 60, 0], [9, 0.9, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 40, 50, 0], [12, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 0, 0],
])


def _near(words, links) -> float:
    """The words of a neighbour that is plain text, else 0."""
    return np.where(links < 0.5, words, 0)


ROWS = np.concatenate([
    np.column_stack([_SINGLE[:, :-1], _near(_SINGLE[:, 2], _SINGLE[:, 3]), _near(_SINGLE[:, 4], _SINGLE[:, 5]), _SINGLE[:, -1]]), _SHORT])


def _elsewhere(main: int, page: int, chrome: int, label: int) -> np.ndarray:
    """The blocks of the table, standing elsewhere: inside the main part, beside it, or inside a menu."""
    out = ROWS.copy()
    out[:, 6:9], out[:, -1] = (main, page, chrome), label
    return out


# Where a page has a main part, whether a block stands in it decides, whatever its length and links.
LABELLED = np.concatenate([ROWS, _elsewhere(1, 1, 0, 1), _elsewhere(0, 1, 0, 0), _elsewhere(0, 1, 1, 0), _elsewhere(1, 1, 1, 0), _elsewhere(0, 0, 1, 0)])


class Tree:
    """A binary decision tree: at each node a column, a cut and two branches, or a label."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.column, self.cut, self.below, self.above, self.label = -1, 0.0, None, None, int(y.mean() >= 0.5)
        if y.min() == y.max():
            return
        best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for cut in (values[1:] + values[:-1]) / 2:
                left = y[x[:, c] <= cut]
                right = y[x[:, c] > cut]
                impurity = sum(s.mean() * (1 - s.mean()) * len(s) for s in (left, right))
                if impurity < best[0] - 1e-12:
                    best = (impurity, c, float(cut))
        if best[1] >= 0:
            self.column, self.cut = best[1:]
            low = x[:, self.column] <= self.cut
            self.below, self.above = Tree(x[low], y[low]), Tree(x[~low], y[~low])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.label)
        low = x[:, self.column] <= self.cut
        out = np.empty(len(x), int)
        out[low], out[~low] = self.below.predict(x[low]), self.above.predict(x[~low])
        return out


@functools.lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree(LABELLED[:, :-1], LABELLED[:, -1])


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, 12))
    x[:, 0] = [b.words for b in found]
    x[:, 1] = [b.links for b in found]
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    x[:, 6] = [b.main for b in found]
    x[:, 7] = any(b.main and not b.chrome for b in found)
    x[:, 8] = [b.chrome for b in found]
    x[:, 9] = [b.heading for b in found]
    plain = np.where(x[:, 8] > 0, 0, _near(x[:, 0], x[:, 1]))
    for back in (1, 2):
        x[back:, 10] = np.maximum(x[back:, 10], plain[:-back])
        x[:-back, 11] = np.maximum(x[:-back, 11], plain[back:])
    return x


def main_texts(pages: list[str]) -> list[str]:
    """Main text of each page; the blocks of all pages are classified together."""
    found = [blocks(p) for p in pages]
    some = [f for f in found if f]
    kept = iter(tree().predict(np.concatenate([features(f) for f in some]))) if some else iter(())
    return ["\n".join(b.text for b in f if next(kept)) for f in found]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""

    def run(batch: pa.RecordBatch):
        return rows(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(main_texts(texts(batch, "html")), pa.string()))

    return map_texts(narrow(pages, page_id="long", url="string", html="string"), run, "page_id long, url string, text string", "html")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
