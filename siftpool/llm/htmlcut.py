"""Main-text extraction from HTML by minimum-cut labelling.

A page is read into text blocks. A logistic classifier over a block's tags,
class and id words, links, length and punctuation gives each block its log-odds
of being content; they become capacities from the source (content) or to the
sink (boilerplate). Blocks that follow each other, on the page or in one parent
element, are joined by smoothness edges, which are the weaker the farther apart
the blocks lie in the tree, and weaker across the borders of sectioning elements.
The minimum cut, found by max-flow, separates content from boilerplate. Blocks
inside elements that never hold the article (scripts, menus, forms and so on) are
fixed on the sink's side by a capacity that no cut can pay. The classifier and
the edges' scale are fitted on generated pages of several layouts: see htmltrain.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]+|"[^"<]*"|'[^'<]*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|aria-label|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is not text of the page.
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements that never hold the article.
NEVER = frozenset(("head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map", "datalist", "fieldset"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "math", "mfrac", "mi", "mn", "mo", "mrow", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "semantics"))
#: Opening one of these ends an open element of the right-hand kinds.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset(("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
SECTIONS = frozenset(("article", "section", "main", "div", "header", "footer", "nav", "aside", "body", "table", "ul", "ol"))
#: Elements whose class and id speak of the page or of the article's subject.
WHOLE = frozenset(("html", "body", "main", "article"))
#: Words of class, id, role and label that speak against or for content.
AGAINST = frozenset("ad ads advert advertisement advertising adbox banner banners billboard breadcrumb breadcrumbs byline captcha comment comments commentlist cookie cookies consent copyright discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation navigational newsletter notice notices notification outbrain pager pagination paywall popup privacy promo promoted promotion recommended related replies reply respond search share sharing shares shoutbox sidebar sidebars signin signup skip social sponsor sponsored subscribe subscription taboola tags toc toolbar topbar widget widgets complementary contentinfo banner dialog alert alertdialog".split())
#: Of these, such as stand for a part of an article as well.
SOFT = frozenset("byline header privacy search tags toc".split())
#: Words of a reader's comment; an article element of only these is no article.
REMARK = frozenset("comment comments replies reply review reviews".split())
#: A class name with one of these tells what the page has elsewhere.
ABOUT = frozenset("has no with without".split())
#: A short line outside an article with one of these is a notice.
_RIGHTS = re.compile(r"©|\ball rights reserved\b|\bcopyright\b", re.I)
FOR = frozenset("article articlebody body content contents entry main maincontent post postbody story storybody text".split())
STRONG = (AGAINST | (REMARK - {"review", "reviews"})) - SOFT
#: Capacities that may not be cut; a border's and a later sibling's share of an edge.
FIXED, BORDER, SIBLING = 1e6, 0.2, 0.5
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


ARTICLE, MAIN, HEADER, BARRED = 1, 2, 4, 8


class Block:
    """A run of text in one block element: its element's number and tag, and what the elements above it say."""

    __slots__ = ("flags", "linked", "marks", "node", "parts", "section", "tag", "text")

    def __init__(self, node: int, tag: str) -> None:
        self.node, self.tag = node, tag
        self.parts: list[str] = []
        self.linked, self.text, self.flags, self.section = 0, "", 0, 0
        self.marks: frozenset[str] = frozenset()


def _marks(tag: str, attributes: str) -> frozenset[str]:
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.add("!hidden")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            out.add("!hidden")
        elif name != "aria-hidden":
            for token in value.split():
                words = {w.lower() for w in re.split(r"[^A-Za-z]+", token) if w}
                words.update(p.lower() for p in _PARTS.findall(token))
                if not words & ABOUT and (tag not in WHOLE or (tag == "article" and words and words <= REMARK)):
                    out |= words
    return frozenset(w for w in out if w in AGAINST or w in REMARK or w in FOR or w == "!hidden")


class Tree:
    """Elements of a page by number, a parent's below its children's; each costs the same however deep it lies."""

    def __init__(self) -> None:
        self.parent, self.tags, self.marks = [0], [""], {}

    def add(self, parent: int, tag: str, marks: frozenset[str]) -> int:
        self.parent.append(parent)
        self.tags.append(tag)
        if marks:
            self.marks[len(self.tags) - 1] = marks
        return len(self.tags) - 1

    def settle(self, found: list[Block]) -> None:
        """Give each block flags, section and marks of the elements above it.

        Words against content do not count on an element that has half of the
        page's text and a title, main or article element below it: it is a wrapper.
        """
        n = len(self.tags)
        size, holds = [0] * n, [False] * n
        for b in found:
            size[b.node] += len(b.text)
        for i in range(n - 1, 0, -1):
            own = self.marks.get(i, _NONE)
            holds[i] |= self.tags[i] in ("h1", "main") or (self.tags[i] == "article" and not own & REMARK)
            size[self.parent[i]] += size[i]
            holds[self.parent[i]] |= holds[i]
        flags, section, marks = [0] * n, [0] * n, [_NONE] * n
        for i in range(1, n):
            tag, up = self.tags[i], self.parent[i]
            own = self.marks.get(i, _NONE)
            if own and holds[i] and 2 * size[i] >= size[0]:
                own -= AGAINST | REMARK
            marks[i] = marks[up] | own if own - marks[up] else marks[up]
            section[i] = i if tag in SECTIONS else section[up]
            flags[i] = flags[up] | (ARTICLE if tag == "article" else MAIN if tag == "main" else BARRED if tag in NEVER else HEADER if tag == "header" and not flags[up] & ARTICLE else 0)
        for b in found:
            b.flags, b.section, b.marks = flags[b.node], section[b.node], marks[b.node]

    def steps(self, a: int, b: int) -> int:
        """Elements on the way from a to b through the tree; walks no farther than their common ancestor."""
        out = 0
        while a != b:
            if a > b:
                a = self.parent[a]
            else:
                b = self.parent[b]
            out += 1
        return out


_NONE: frozenset[str] = frozenset()


def blocks(page: str) -> tuple[list[Block], Tree]:
    """Text blocks in page order; white space inside a block is one space, character references are decoded.

    The time is linear in the page's length, whatever is nested or left open.
    """
    out: list[Block] = []
    tree = Tree()
    # Open elements: tag, number, place of the nearest one that is no inline element.
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    opened: list[dict[str, int]] = [{}]  # how many of a tag are open, inline ones since the last sectioning element
    blocks_open: dict[str, int] = {}
    links, now, at = 0, None, 0

    def close(until: int) -> None:
        nonlocal links
        while len(stack) > until:
            tag = stack.pop()[0]
            links -= tag == "a"
            if tag in SECTIONS:
                opened.pop()
            if tag in INLINE:
                opened[-1][tag] -= 1
            else:
                blocks_open[tag] -= 1

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            text = m[0]
            if text.startswith("<") and text != "<":
                continue
            if now is None:
                holder = stack[stack[-1][2]]
                now = Block(stack[-1][1], holder[0])
                out.append(now)
            now.parts.append(text)
            if links:
                now.linked += len(text)
            continue
        inline = tag in INLINE
        if m[1] or m[4]:
            if not inline:
                now = None
            if (opened[-1] if inline else blocks_open).get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                now = None
            continue
        if not inline:
            now = None
            ends = CLOSES.get(tag, ())
            if tag in ENDS_P:
                ends = (*ends, "p")
            while (holder := stack[-1][2]) and stack[holder][0] in ends:
                close(holder)
        if not attributes.rstrip().endswith("/") or tag in SECTIONS or inline or tag == "p":
            node = tree.add(stack[-1][1], tag, _marks(tag, attributes) if attributes else _NONE)
            stack.append((tag, node, stack[-1][2] if inline else len(stack)))
            count = opened[-1] if inline else blocks_open
            count[tag] = count.get(tag, 0) + 1
            if tag in SECTIONS:
                opened.append({})
            links += tag == "a"
    kept = []
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    tree.settle(kept)
    return kept, tree


#: What the classifier reads of a block, in this order.
FEATURES = ("in_article", "in_main", "in_header", "word_against", "word_soft", "word_for", "hidden", "links", "length", "stops", "title", "heading", "paragraph", "rights")


def barred(block: Block) -> bool:
    """Whether an element rules the block out."""
    return bool(block.flags & BARRED) or (bool(block.flags & HEADER) and not block.flags & MAIN)


def features(block: Block) -> list[float]:
    raw = sum(map(len, block.parts)) or 1
    inside = bool(block.flags & ARTICLE)
    return [
        inside,
        bool(block.flags & MAIN),
        bool(block.flags & HEADER),
        bool(block.marks & STRONG),
        bool(block.marks & SOFT),
        bool(block.marks & FOR),
        "!hidden" in block.marks,
        (block.linked / raw) ** 2 * (0.5 if inside else 1.0),
        math.log1p(len(block.text) / 20),
        block.text[-1] in ".!?…\"'”’",
        block.tag == "h1",
        block.tag in ("h2", "h3"),
        block.tag in ("p", "pre", "blockquote"),
        0.0 if inside or not _RIGHTS.search(block.text) else 20 / (20 + block.text.count(" ")),
    ]


def log_odds(block: Block, weights: list[float]) -> float:
    """The classifier: log-odds that the block is content; -inf where an element rules it out. The last weight is the constant."""
    if barred(block):
        return -math.inf
    return sum(w * x for w, x in zip(weights, features(block), strict=False)) + weights[-1]


class Network:
    """Max-flow by shortest augmenting paths in layers (Dinic)."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.room += (forth, back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque((source,))
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if level[b] < 0 and self.room[e] > 1e-9:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def side(self, source: int, sink: int) -> list[bool]:
        """Nodes on the source's side of a minimum cut."""
        while (level := self.levels(source))[sink] >= 0:
            step = [0] * len(self.out)
            trail: list[int] = []
            a = source
            while True:
                if a == sink:
                    flow = min(self.room[e] for e in trail)
                    for k, e in enumerate(trail):
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    cut = next(k for k, e in enumerate(trail) if self.room[e] <= 1e-9)
                    a = self.to[trail[cut] ^ 1]
                    del trail[cut:]
                    continue
                while step[a] < len(self.out[a]):
                    e = self.out[a][step[a]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    step[a] += 1
                else:
                    if not trail:
                        break
                    a = self.to[trail.pop() ^ 1]
                    step[a] += 1
                    continue
                trail.append(e)
                a = self.to[e]
        return [x >= 0 for x in level]


def label(found: list[Block], tree: Tree, weights: list[float], scale: float) -> list[bool]:
    """Which blocks are content: the side of the source in the minimum cut. scale: the capacity between two paragraphs in a row."""
    n = len(found)
    net = Network(n + 2)
    source, sink = n, n + 1
    last: dict[int, int] = {}

    def join(i: int, j: int, share: float) -> None:
        a, b = found[i], found[j]
        border = BORDER if a.section != b.section or a.marks != b.marks else 1.0
        room = scale * share * border / max(tree.steps(a.node, b.node) - 1, 1)
        net.join(i, j, room, room)

    for i, b in enumerate(found):
        odds = log_odds(b, weights)
        if odds == -math.inf:
            net.join(i, sink, FIXED)
        elif odds >= 0:
            net.join(source, i, odds)
        else:
            net.join(i, sink, -odds)
        if i:
            join(i - 1, i, 1.0)
        up = tree.parent[b.node]
        if up in last and last[up] != i - 1:
            join(last[up], i, SIBLING)
        last[up] = i
    return net.side(source, sink)[:n]


def main_text(page: str, weights: list[float] | None = None, scale: float | None = None) -> str:
    """The page's content blocks, joined by one space; by the fitted classifier and scale unless others are given."""
    if weights is None:
        from .htmltrain import fitted

        weights, scale = fitted()
    found, tree = blocks(page)
    return " ".join(b.text for b, content in zip(found, label(found, tree, weights, scale), strict=True) if content)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages without the html column, with text string and n_chars long (its code points); columns of these names are replaced.

    A null, empty or text-free page has the empty text. Repeated pages are rows
    as any others; an empty table gives an empty result.
    """
    from .htmltrain import fitted

    names = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    weights, scale = fitted()  # on the driver, once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "", weights, scale) for x in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, text_col, "n_chars"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*names).schema)
    return pages.select(*names, html_col).mapInArrow(run, f"{kinds}`{text_col}` string, n_chars long")
