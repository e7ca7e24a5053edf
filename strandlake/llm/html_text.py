"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags, in one pass over its characters.
Each block has its word count and link density, those of the blocks before and after
it, and what encloses it (page furniture; an article; a heading).  A decision tree,
grown from the small labelled table below, keeps or drops each block.

Elements are furniture by their tag or by a word of their class, id or role.  A page's
wrapper often has such a word too (``has-sidebar``, a form around all): a mark doesn't
count on html, body, main and article, nor on an element that holds an article, nor on
one that holds most of the page's words while nothing else on the page reads like text.
A word that names a topic as often (``social``, ``search``) is a weak mark, and as a
part of a name inside an article none if the element holds what reads like text.  Links
of an article that nothing marks as furniture are its own, but for those of a word or two.

Defined results: null and empty pages give an empty text.  Comments, scripts, styles
and other unseen elements are dropped whole; a comment, script or style that is never
closed runs to the page's end, any other to the next block.  A tag that the page's end
cuts off is dropped; a quote that is never closed is no quote.  Text outside any tag is
a block.  Character references are decoded once, with or without their semicolon as
HTML has it, and not across tags.  Repeated rows give the same text each.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by how they are laid out.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul title".split()
)
UNSEEN = "script style noscript template textarea select svg math iframe object canvas audio video head title button".split()
FURNITURE = frozenset("nav aside footer header form menu dialog figure fieldset search".split())
FIRM = FURNITURE - {"form", "fieldset"}
# Words of a class, id or role that name page furniture.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored sponsors promo promotion promoted "
    "sidebar side aside rail widget widgets menu menus nav navbar navigation navigations breadcrumb breadcrumbs pagination pager toc footer foot copyright "
    "header masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts warning disclaimer newsletter subscribe subscription signup "
    "popup modal overlay share sharing social related recommended recommendations more-like-this comment comments commentlist reply replies respond "
    "disqus discussion feedback login search form contentinfo complementary tags tagcloud outbrain taboola".split()
)

#: Hints that name a topic as often as furniture.
VAGUE = frozenset("header form search social login tags".split())
_BY_SIDE = re.compile(r"side[-_]?by[-_]?side")
#: Hints that on a paragraph of an article describe its style.
STYLES = frozenset(("warning", "disclaimer"))
PARAGRAPHS = frozenset("p li blockquote pre td dd".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in UNSEEN}
_BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS, key=len, reverse=True)) + r")(?=[\s/>])", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])")
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|[\s\"'])(?:aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*?display\s*:\s*none|'[^']*?display\s*:\s*none))", re.I)
_HIDDEN_FLAG = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)", re.I)
_PARTS = re.compile(r"[-_]+|(?<=\D)(?=\d)")
#: A block of so many words with at most this density reads like text.
TEXT_WORDS, TEXT_DENSITY = 20, 0.3


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: int  # 0, 1 for a style of a paragraph in an article, 2
    article: bool
    heading: bool

    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


NONE, STYLE, FAINT, WEAK, STRONG, SURE = range(6)


def _hint(attrs: str, less: frozenset = frozenset()) -> int:
    """How surely class, id or role name furniture: STRONG if a word of them says nothing else, WEAK if a part of one does.

    VAGUE words say it less surely: WEAK by themselves, FAINT as a part.
    """
    found = NONE
    for m in _NAMED.finditer(attrs):
        for word in _BY_SIDE.sub("", (m[1] or m[2] or m[3] or "").lower()).split():
            parts = [x for x in _PARTS.split(word) if x]
            hints = [x for x in parts if x in HINTS and x not in less]
            firm = not VAGUE.issuperset(hints)
            if word in HINTS and word not in less or parts and len(hints) == len(parts):
                found = max(found, STRONG if firm or word in HINTS and word not in VAGUE else WEAK)
            elif hints:
                found = max(found, WEAK if firm else FAINT)
    return found


def _styled(attrs: str) -> bool:
    """Whether the only words that name furniture are STYLES."""
    return _hint(attrs, STYLES) == NONE


def _hidden(attrs: str) -> bool:
    low = attrs.lower()
    if "hidden" not in low and "none" not in low:
        return False
    return bool(_HIDDEN.search(attrs) or _HIDDEN_FLAG.search(_QUOTED.sub("''", attrs)))


class _Page:
    """Searches in a page; what isn't found from one place isn't looked for from a later one."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()
        self.closes: dict[str, tuple[int, int]] = {}
        self.tags: dict[str, list[tuple[int, int]]] | None = None
        self.levels: dict[str, tuple[list[int], list[int], dict[int, list[int]]]] = {}

    def shut(self, name: str, at: int) -> int:
        """Where the end tag begins that ends the block of this name around a place; -1 if there is none.

        The page's block tags are looked up once; a name's running depth, and the tags that
        lead to each depth, then give the first tag after the place that leads below its depth.
        """
        if self.tags is None:
            self.tags = {}
            for m in _TAG.finditer(self.page):
                if (found := m[2].lower()) in BLOCKS:
                    self.tags.setdefault(found, []).append((m.start(), -1 if m[1] else 1))
        if name not in self.levels:
            tags = self.tags.get(name, [])
            levels, to = list(accumulate(step for _, step in tags)), {}
            for i, level in enumerate(levels):
                to.setdefault(level, []).append(i)
            self.levels[name] = [begin for begin, _ in tags], levels, to
        begins, levels, to = self.levels[name]
        first = bisect_left(begins, at)
        below = to.get((levels[first - 1] if first else 0) - 1, [])
        i = bisect_left(below, first)
        return begins[below[i]] if i < len(below) else -1

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def close(self, name: str, at: int) -> tuple[int, int]:
        """Where the next end tag of an unseen element begins and ends; (-1, -1) if there is none."""
        known = self.closes.get(name)
        if known is None or 0 <= known[0] < at:
            m = _CLOSE[name].search(self.page, at)
            end = self.page.find(">", m.end()) if m else -1
            known = self.closes[name] = (m.start(), end + 1) if end >= 0 else (-1, -1)
        return known

    def tag_end(self, at: int) -> int:
        """After the tag's >, quoted attribute values skipped; -1 if the page ends first."""
        while m := _STOP.search(self.page, at):
            at = m.end()
            if not m[1]:
                return at
            shut = self.find(m[1], at)
            at = shut + 1 if shut >= 0 else at
        return -1

    def unseen_end(self, at: int, name: str, around: str) -> int:
        """Where an unseen element ends: after its end tag, or at the next block's tag if its enclosing block ends before that."""
        begin, end = self.close(name, at)
        if name in ("script", "style"):
            return end if begin >= 0 else len(self.page)
        if begin >= 0 and not (around and 0 <= self.shut(around, at) < begin):
            return end
        found = _BLOCK_TAG.search(self.page, at)
        return found.start() if found else len(self.page)


@dataclass
class _Mark:
    """An element that may be furniture, with what it holds."""

    parent: int
    surety: int
    inside: bool = False  # whether it lies in an article
    article: bool = False  # whether it holds one
    words: int = 0
    texts: int = 0


def _furniture(marks: list[_Mark], inner: list[int], found: list[Block]) -> list[int]:
    """For each mark how surely what it holds is furniture, wrappers left out; mark 0 is the page."""
    for mark, block in zip(inner, found, strict=True):
        marks[mark].words += block.words
        marks[mark].texts += block.words >= TEXT_WORDS and block.density() <= TEXT_DENSITY
    own = [m.texts for m in marks]
    for mark in reversed(marks[1:]):
        above = marks[mark.parent]
        above.article |= mark.article
        above.texts += mark.texts
        if mark.surety != SURE:  # sure furniture isn't counted among the words of what is around it
            above.words += mark.words
    out, free = [NONE], own[0]
    for i, mark in enumerate(marks[1:], 1):
        surety = mark.surety
        if surety in (FAINT, WEAK, STRONG):
            most = 2 * mark.words > marks[0].words and not free and mark.texts >= (2 if surety == STRONG else 1)
            if mark.article or most or surety == FAINT and mark.inside and mark.texts:
                surety = NONE
        out.append(max(out[mark.parent], surety))
        if out[i] == NONE:
            free += own[i]
    return out


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order."""
    out: list[Block] = []
    # name, the number of the innermost mark, whether it is or lies in an article, in a heading
    stack: list[tuple[str, int, bool, bool]] = []
    open_: Counter = Counter()  # names on the stack
    marks, inner = [_Mark(0, NONE)], []
    parts: list[str] = []
    linked = anchor = 0
    look = _Page(page)

    def text(a: int, b: int):
        nonlocal linked
        part = page[a:b]
        if "&" in part:
            part = _html.unescape(part)
        parts.append(part)
        if anchor:
            linked += len(part.split())

    def flush():
        nonlocal linked
        words = "".join(parts).split()
        parts.clear()
        if words:
            _, mark, good, head = stack[-1] if stack else ("", 0, False, False)
            out.append(Block(" ".join(words), len(words), linked, NONE, good, head))
            inner.append(mark)
        linked = 0

    at = begin = 0  # where the next tag is looked for, and where the text before it begins
    while (at := look.find("<", at)) >= 0:
        m = _OPEN.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = at + 5 if page.startswith("<!-->", at) else look.find("-->", at + 3 if page.startswith("<!--->", at) else at + 4) + 3
                end = end if end > at else len(page)
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                end = look.find(">", at) + 1 or len(page)
            else:
                at += 1
                continue  # a sign, not a tag
            text(begin, at)
            at = begin = end
            continue
        text(begin, at)
        end = look.tag_end(m.end())
        if end < 0:
            at = begin = len(page)
            break
        closes, name = m[1], m[2].lower()
        attrs = page[m.end() : end - 1]
        at = end
        if name in _CLOSE and not closes and not (name in ("svg", "math") and attrs.endswith("/")):
            at = look.unseen_end(end, name, stack[-1][0] if stack else "")
        begin = at
        if name == "a":
            anchor = 0 if closes else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            if name == "hr":
                continue
            if closes:
                anchor = 0
                while open_[name]:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == name:
                        break
            elif name not in _CLOSE:
                if name in _ENDS_P and stack and stack[-1][0] == "p":
                    open_[stack.pop()[0]] -= 1
                _, mark, good, head = stack[-1] if stack else ("", 0, False, False)
                own = NONE
                if name in FURNITURE and not (good and name in ("header", "figure")):
                    own = SURE if name in FIRM else WEAK
                if attrs:
                    hint = _hint(attrs, _HEADERS if good else frozenset()) if name not in ("body", "html") else NONE
                    if hint and good and name in PARAGRAPHS and _styled(attrs):
                        hint = STYLE
                    own = SURE if _hidden(attrs) else max(own, hint)
                if name in ("article", "main"):
                    if own in (NONE, FAINT, WEAK):  # a comment marked up as an article leaves its section as it is
                        marks[mark].article = True
                        own = NONE
                if own:
                    marks.append(_Mark(mark, own, good))
                    mark = len(marks) - 1
                stack.append((name, mark, good or name in ("article", "main"), name in _HEADINGS or (head and name != "div")))
                open_[name] += 1
    text(begin, len(page))
    flush()
    surety = _furniture(marks, inner, out)
    for block, mark in zip(out, inner, strict=True):
        block.furniture = min(surety[mark], 2)
    return out


_HEADERS = frozenset(("header",))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ENDS_P = BLOCKS - {"body", "html", "head"}

FEATURES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "furniture", "article", "heading")
# Labelled table: a block's features in the order of FEATURES, then 1 if it is main text.
TABLE = (
    (60, 0.0, 45, 0.0, 70, 0.0, 0, 1, 0, 1), (25, 0.0, 60, 0.0, 30, 0.0, 0, 1, 0, 1), (8, 0.0, 40, 0.0, 35, 0.0, 0, 1, 0, 1),
    (3, 0.0, 2, 1.0, 50, 0.0, 0, 1, 1, 1), (9, 0.0, 6, 0.0, 80, 0.0, 0, 1, 1, 1), (12, 0.0, 1, 1.0, 20, 0.0, 0, 1, 1, 1),
    (1, 0.0, 30, 0.0, 4, 0.0, 0, 1, 0, 1), (40, 0.1, 50, 0.0, 3, 0.0, 0, 1, 0, 1), (30, 0.3, 40, 0.1, 40, 0.1, 0, 1, 0, 1),
    (5, 0.0, 9, 0.0, 6, 0.2, 0, 1, 0, 1), (2, 0.0, 1, 0.0, 2, 0.0, 0, 1, 0, 1), (14, 0.5, 30, 0.0, 30, 0.0, 0, 1, 0, 1),
    (90, 0.0, 3, 0.0, 0, 0.0, 0, 1, 0, 1), (20, 0.05, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (6, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0, 1),
    (20, 0.0, 40, 0.0, 4, 1.0, 0, 1, 0, 1), (35, 0.0, 30, 0.0, 3, 1.0, 0, 1, 0, 1), (8, 0.0, 50, 0.0, 2, 1.0, 0, 1, 0, 1),
    (3, 0.0, 40, 0.0, 2, 1.0, 0, 1, 0, 1), (5, 0.0, 60, 0.0, 4, 1.0, 0, 1, 0, 1), (2, 0.0, 20, 0.0, 3, 0.9, 0, 1, 0, 1),
    (15, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 1), (30, 0.05, 20, 0.0, 5, 1.0, 0, 0, 0, 1), (11, 0.0, 25, 0.0, 1, 1.0, 0, 0, 0, 1),
    (45, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0, 1), (7, 0.0, 2, 1.0, 3, 1.0, 0, 1, 1, 1), (6, 0.0, 3, 1.0, 30, 0.0, 0, 0, 1, 1),
    (50, 0.0, 3, 1.0, 3, 1.0, 2, 0, 0, 0), (18, 0.0, 40, 0.0, 3, 1.0, 2, 1, 0, 0), (55, 0.1, 60, 0.0, 2, 1.0, 2, 1, 0, 0),
    (4, 1.0, 40, 0.0, 4, 1.0, 0, 1, 0, 1), (3, 1.0, 3, 1.0, 3, 1.0, 0, 1, 0, 1), (2, 1.0, 60, 0.0, 2, 1.0, 0, 1, 0, 0),
    (6, 0.9, 5, 1.0, 6, 1.0, 0, 1, 0, 1), (10, 1.0, 30, 0.0, 0, 0.0, 0, 1, 0, 1), (4, 1.0, 4, 1.0, 30, 0.0, 0, 1, 0, 1), (4, 1.0, 4, 1.0, 70, 0.0, 0, 1, 0, 1), (5, 1.0, 50, 0.0, 60, 0.0, 0, 1, 0, 1),
    (1, 0.0, 4, 1.0, 0, 0.0, 0, 1, 0, 1), (5, 0.0, 5, 1.0, 2, 0.0, 0, 1, 0, 1), (3, 0.0, 4, 1.0, 3, 1.0, 0, 1, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 40, 0.0, 1, 1.0, 0, 1, 0, 0), (2, 1.0, 2, 1.0, 30, 0.0, 0, 1, 0, 0), (2, 1.0, 2, 1.0, 0, 0.0, 0, 1, 0, 0),
    (50, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 1), (35, 0.02, 20, 0.0, 60, 0.0, 0, 0, 0, 1), (16, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1),
    (9, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 1), (80, 0.1, 2, 1.0, 4, 1.0, 0, 0, 0, 1), (22, 0.0, 3, 0.0, 40, 0.0, 0, 0, 0, 1),
    (5, 0.0, 4, 1.0, 60, 0.0, 0, 0, 1, 1), (8, 0.0, 2, 0.0, 45, 0.0, 0, 0, 1, 1), (30, 0.3, 40, 0.0, 30, 0.0, 0, 0, 0, 1),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
    (6, 0.8, 4, 1.0, 5, 1.0, 0, 0, 0, 0), (4, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (12, 0.7, 6, 1.0, 8, 0.9, 0, 0, 0, 0),
    (5, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1, 0), (25, 0.9, 20, 0.8, 30, 0.9, 0, 0, 0, 0),
    (60, 0.0, 50, 0.0, 3, 0.0, 2, 0, 0, 0), (12, 0.0, 3, 1.0, 9, 0.0, 2, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0, 0),
    (30, 0.1, 1, 0.0, 20, 0.1, 2, 0, 0, 0), (8, 0.0, 70, 0.0, 0, 0.0, 2, 0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 2, 0, 1, 0),
    (40, 0.0, 45, 0.0, 50, 0.0, 2, 1, 0, 0), (9, 0.0, 60, 0.0, 70, 0.0, 2, 1, 0, 0), (4, 0.0, 30, 0.0, 25, 0.0, 2, 1, 1, 0),
    (22, 0.2, 50, 0.0, 12, 0.5, 2, 1, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 2, 1, 0, 0), (100, 0.0, 0, 0.0, 0, 0.0, 2, 0, 0, 0),
    (2, 0.0, 1, 1.0, 25, 0.0, 0, 0, 1, 1), (1, 0.0, 3, 1.0, 40, 0.0, 0, 0, 1, 1), (3, 0.0, 2, 1.0, 30, 0.0, 0, 0, 1, 1),
    (14, 0.0, 40, 0.0, 50, 0.0, 1, 1, 0, 1), (30, 0.05, 60, 0.0, 20, 0.0, 1, 1, 0, 1), (6, 0.0, 30, 0.0, 70, 0.0, 1, 1, 0, 1), (4, 1.0, 30, 0.0, 40, 0.0, 1, 1, 0, 0),
)
MAX_DEPTH = 6


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = MAX_DEPTH):
    """A tree of (feature, threshold, at most, above) and leaves 0 or 1: the split with the least Gini impurity, first of equals."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = labels[rows[:, f] <= t]
            high = labels[rows[:, f] > t]
            cost = sum(len(x) * x.mean() * (1 - x.mean()) for x in (low, high))
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(t)
    if best is None:
        return int(share >= 0.5)
    _, f, t = best
    left = rows[:, f] <= t
    return f, t, grow(rows[left], labels[left], depth - 1), grow(rows[~left], labels[~left], depth - 1)


def default_tree():
    table = np.array(TABLE, float)
    return grow(table[:, :-1], table[:, -1])


def kept(tree, features: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_text(page: str | None, tree=None) -> str:
    found = blocks(page) if page else []
    tree = default_tree() if tree is None else tree
    out = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        features = (
            b.words, b.density(), before.words if before else 0, before.density() if before else 0.0,
            after.words if after else 0, after.density() if after else 0.0, b.furniture, b.article, b.heading,
        )
        if kept(tree, features):
            out.append(b.text)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    tree = default_tree()

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
