"""Generated pages of several layouts, and what is fitted on them: the block classifier and the edges' scale.

No labelled pages are given, so pages are made here, with blocks known to be
content or not. The classifier is a logistic regression on blocks of the pages in
TRAINED layouts; the scale is the one of SCALES that labels most blocks of other
such pages rightly. Pages in HELD_OUT layouts serve for figures only.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

from . import htmlcut
from .cotrain import Logistic

PAGES = 240
SCALES = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0)


class Writer:
    """Text of random words; what is written as content is remembered."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.content: set[str] = set()

    def words(self, low: int, high: int) -> str:
        word = lambda: "".join(self.rng.choice("bcdfglmnprst") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 4)))
        return " ".join(word() for _ in range(self.rng.randint(low, high))).capitalize()

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.words(4, 16) + self.rng.choice("....!?") for _ in range(self.rng.randint(low, high)))

    def keep(self, text: str) -> str:
        self.content.add(" ".join(text.split()))
        return text

    def links(self, n: int, tag: str) -> str:
        return "".join(f"<{tag}><a href=/x>{self.words(1, 4)}</a></{tag}>" for _ in range(n))

    def body(self, tag: str = "p") -> str:
        """An article's blocks: paragraphs, short lines, headings, a line that is a link, a list."""
        out = [f"<h1>{self.keep(self.words(2, 9))}</h1>"] if self.rng.random() < 0.9 else []
        for _ in range(self.rng.randint(2, 9)):
            kind = self.rng.random()
            if kind < 0.62:
                out.append(f"<{tag}>{self.keep(self.prose())}</{tag}>")
            elif kind < 0.74:
                out.append(f"<{tag}>{self.keep(self.words(1, 4))}</{tag}>")
            elif kind < 0.84:
                out.append(f"<h2>{self.keep(self.words(1, 6))}</h2>")
            elif kind < 0.92:
                out.append(f"<{tag}><a href=/y>{self.keep(self.words(3, 8))}</a></{tag}>")
            else:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.prose(1, 2))}</li>" for _ in range(self.rng.randint(2, 4))) + "</ul>")
        return "".join(out)

    def remarks(self, outer: str, inner: str) -> str:
        return f"<div {outer}>" + "".join(f"<div {inner}><p>{self.prose(1, 9)}</p></div>" for _ in range(self.rng.randint(1, 5))) + "</div>"


def semantic(w: Writer) -> str:
    advert = f"<div class=ad>{w.prose(1, 3)}</div>" * (w.rng.random() < 0.6)
    return f"<body><header><p>{w.words(1, 5)}</p></header><nav><ul>{w.links(5, 'li')}</ul></nav>{advert}<main><article>{w.body()}{w.remarks('class=comments', 'class=comment-body') if w.rng.random() < 0.5 else ''}</article></main><aside><p>{w.prose()}</p></aside><footer>{w.prose()}</footer>"


def classed(w: Writer) -> str:
    name = w.rng.choice(["content", "post-body", "entry", "main-content", "article-text"])
    side = w.rng.choice(["sidebar", "related", "newsletter", "widget", "promo-box"])
    inner = w.body() + (f"<div class='{w.rng.choice(['ad-box', 'share', 'sponsored'])}'>{w.prose(1, 3)}</div><p>{w.keep(w.prose())}</p>" if w.rng.random() < 0.5 else "")
    return f"<body><div class=header>{w.words(1, 6)}</div><div id=menu>{w.links(6, 'span')}</div><div class='{name}'>{inner}</div><div class={side}><h2>{w.words(1, 3)}</h2><p>{w.prose(1, 7)}</p></div>{w.remarks('id=comments', 'class=comment')}<div class=footer>© 2020 {w.words(2, 8)}</div>"


def plain(w: Writer) -> str:
    end = w.rng.choice([f"<div>Copyright {w.words(1, 5)}</div>", f"<div>© {w.words(2, 9)}. All rights reserved.</div>"])
    return f"<body><div>{w.links(5, 'div')}</div><div>{w.links(3, 'p')}</div><div>{w.body(w.rng.choice(['p', 'div']))}</div><div><h2>{w.words(1, 3)}</h2><ul>{w.links(7, 'li')}</ul></div>{end}"


def table(w: Writer) -> str:
    return f"<body><table><tr><td>{w.links(6, 'div')}</td><td>{w.body()}</td><td>{w.links(4, 'p')}{w.words(1, 4)}</td></tr></table><center>© {w.words(2, 6)}</center>"


def remarked(w: Writer) -> str:
    return f"<body><nav>{w.links(4, 'li')}</nav><article class=post>{w.body()}<div id=comments><ol class=comment-list>" + "".join(f"<li class=comment><div class='comment-content text'><p>{w.prose(2, 14)}</p></div></li>" for _ in range(w.rng.randint(1, 6))) + f"</ol></div></article><div class='related posts'>{w.links(4, 'p')}<p>{w.prose(1, 3)}</p></div>"


def sections(w: Writer) -> str:
    return f"<body><div class=topbar>{w.links(4, 'span')}</div><main><section>{w.body()}</section><section class=related-stories><h3>{w.words(1, 3)}</h3>{w.links(5, 'p')}</section></main><div role=contentinfo><p>{w.prose(1, 3)}</p></div>"


def wrapped(w: Writer) -> str:
    return f"<body><div class='layout sidebar-right'><div><div>{w.links(6, 'div')}</div></div><div><div>{w.body()}</div></div><div><div>{w.links(3, 'p')}<div>{w.words(1, 5)}</div></div></div></div><div>{w.links(3, 'span')} © {w.words(1, 4)}</div>"


def definition(w: Writer) -> str:
    return f"<body><table><tr><td><ul>{w.links(8, 'li')}</ul></td><td><div><div>{w.body('div')}</div><blockquote>{w.keep(w.prose())}</blockquote></div></td></tr><tr><td>{w.words(1, 3)}</td><td>{w.links(4, 'span')}</td></tr></table>"


TRAINED = (semantic, classed, plain, table, remarked)
HELD_OUT = (sections, wrapped, definition)


def pages(layouts: tuple, n: int, seed: int) -> list[tuple[list[htmlcut.Block], htmlcut.Tree, list[bool]]]:
    """n pages, read: blocks, tree, and whether each block is content."""
    out = []
    for i in range(n):
        w = Writer(seed * 100_003 + i)
        found, tree = htmlcut.blocks(layouts[i % len(layouts)](w))
        out.append((found, tree, [b.text in w.content for b in found]))
    return out


def accuracy(made: list, weights: list[float], scale: float) -> tuple[int, int]:
    """Blocks labelled rightly, and all blocks."""
    right = total = 0
    for found, tree, truth in made:
        right += sum(a == b for a, b in zip(htmlcut.label(found, tree, weights, scale), truth, strict=True))
        total += len(truth)
    return right, total


@lru_cache(maxsize=1)
def fitted() -> tuple[list[float], float]:
    """Weights, with the constant last, and the scale; the same in every process."""
    made = pages(TRAINED, PAGES, 1)
    rows = [(htmlcut.features(b), y) for found, _, truth in made for b, y in zip(found, truth, strict=True) if not htmlcut.barred(b)]
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], int)
    model = Logistic(ridge=0.5).fit(x, y)
    slopes = model.weights[:-1] / model.scale
    # What no generated page has (hidden blocks) counts as a word against.
    unseen = x.std(axis=0) == 0
    slopes[unseen] = -abs(slopes[htmlcut.FEATURES.index("word_against")])
    weights = [*slopes.tolist(), float(model.weights[-1] - (slopes * model.mean)[~unseen].sum())]
    other = pages(TRAINED, PAGES, 2)
    return weights, max(SCALES, key=lambda s: accuracy(other, weights, s)[0])
