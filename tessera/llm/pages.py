"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, from left to right, into text blocks: what stands between
two tags that begin or end a block. A block has its number of words and the
share of them inside links, those of the block before and after it, and what
the elements around it say: the innermost one that is an article or names
itself content, or that is navigation, sidebar, notice, advert, form, comments
and the like. A decision tree, fitted to the labelled pages of
``page_samples``, tells main text from the rest; blocks of main text are
joined in page order.

Texts are as a browser has them: character references are decoded, comments,
scripts, styles and other elements without visible text are skipped as a
whole, unclosed ones up to the end of the page, and line breaks are white
space. White space, of any script, inside a block becomes one space. A null or
empty page, or one without main text, has an empty text. Every row has a row,
repeated and null ids included; rows are judged by their page alone, so there
are no ties, and an empty table gives no rows. Time and memory follow the
length of a page, whatever is in it; nothing is cut off. Other columns stay,
whatever they are called.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_samples
from .textops import map_batches

# Every alternative ends at the end of the page at the latest, so no part of a page is looked at twice.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[\"'=])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:\s|^)(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?(?=\s|/|$)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements of HTML by what they do to text.
#: Their content is text up to their own end tag, and none of it is seen.
RAW = set("script style title textarea xmp iframe noembed noframes".split())
#: Nothing inside is seen.
UNSEEN = set("noscript template svg object canvas audio video datalist".split())
#: Part of the running text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd map mark math meter nobr output picture progress q ruby rb rt rp s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes if it is the innermost open element; others close a paragraph.
CLOSES = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}}
BAD_TAGS = set("nav aside footer form select button menu dialog fieldset label legend".split())
#: Names (in classes, ids and roles) of what is no main text, wherever it stands.
BAD_NAMES = set("nav navigation navbar menu menubar breadcrumb breadcrumbs masthead footer sidebar aside complementary contentinfo ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations trending comment comments disqus respond reply replies discussion form pagination pager widget toolbar copyright legal disclaimer skip teaser".split())
GOOD_NAMES = set("article articlebody story".split())
#: Names that main text and what surrounds it share.
WEAK_NAMES = set("content main post entry text body page".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "kind", "ends")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: float  # -1 in what is no main text, 1 in an article, 0.5 in what is named content, else 0
    kind: int  # 2 a heading, 1 a paragraph, else 0
    main: bool  # in a main element


class _Place(NamedTuple):
    hint: float
    bad: bool  # nothing inside can be good again
    unseen: bool
    kind: int
    main: bool


def _names(attributes: str) -> tuple[set[str], bool]:
    """Words of classes, ids and roles, and whether the element is hidden."""
    names, hidden = set(), False
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        else:
            names.update(w.lower() for w in _WORDS.findall(value))
            names.update(w.lower() for w in value.split())
    return names, hidden


def _inside(place: _Place, tag: str, attributes: str) -> _Place:
    """The place of text inside an element."""
    names, hidden = _names(attributes) if attributes and tag not in ("html", "body") else ((), False)
    hint, bad, main = place.hint, place.bad, place.main
    good = tag == "article" or not GOOD_NAMES.isdisjoint(names)
    header = tag == "header" or "header" in names
    if tag in BAD_TAGS or not BAD_NAMES.isdisjoint(names) or (header and not good and hint < 1 and not main):
        # A form or a named box may enclose a whole page, so an article inside counts; not so in comments or navigation.
        hint, bad = -1.0, bad or tag in ("nav", "aside", "footer") or not {"comment", "comments", "replies", "disqus", "sidebar"}.isdisjoint(names)
    elif not bad:
        if good:
            hint = 1.0
        elif tag == "main" or "main" in names or not WEAK_NAMES.isdisjoint(names):
            hint, main = max(hint, 0.5) if hint >= 0 else 0.5, main or tag == "main" or "main" in names
    kind = 2 if tag in HEADINGS else 1 if tag in ("p", "blockquote", "pre") else place.kind if tag == "div" and place.kind == 2 else 0
    return _Place(hint, bad, place.unseen or hidden or tag in UNSEEN, kind, main)


def blocks(page: str) -> list[Block]:
    """The visible text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, _Place]] = []
    open_: dict[str, int] = {}
    place = outer = _Place(0.0, False, False, 0, False)
    parts: list[str] = []
    linked, link, articles, at = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), place.hint, place.kind, place.main))
            parts.clear()
        linked = 0

    def text(low: int, high: int) -> None:
        nonlocal linked
        if low < high and not place.unseen:
            part = html.unescape(page[low:high])
            parts.append(part)
            if link:
                linked += len(part.split())

    def pop() -> None:
        name, _ = stack.pop()
        open_[name] -= 1

    while m := _TOKEN.search(page, at):
        text(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            link = not m[1]
        elif tag == "br":
            parts.append(" ")
        if tag in INLINE:
            continue
        if m[1]:
            flush()
            link = False
            if open_.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
                place = stack[-1][1] if stack else outer
            continue
        if tag in RAW:
            flush()
            end = _end(tag).search(page, at)
            at = end.start() if end else len(page)
            continue
        flush()
        if tag in VOID:
            continue
        while stack and stack[-1][0] in CLOSES.get(tag, {"p"}):
            pop()
        place = _inside(stack[-1][1] if stack else outer, tag, m[3].rstrip("/ "))
        articles += place.hint == 1 and tag == "article"
        stack.append((tag, place))
        open_[tag] = open_.get(tag, 0) + 1
    text(at, len(page))
    flush()
    # Where a page marks no article, its main element is one.
    return out if articles else [b._replace(place=1.0) if b.main and b.place == 0.5 else b for b in out]


@cache
def _end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)


def features(found: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block of a page."""
    x = np.zeros((len(found), len(FEATURES)))
    if found:
        x[:, 0] = [b.words for b in found]
        x[:, 1] = [b.linked / b.words for b in found]
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
        x[:, 6], x[:, 7] = [b.place for b in found], [b.kind for b in found]
        x[:, 8] = [b.text[-1] in ".!?…。！？:;\"'»”)" for b in found]
    return x


Tree = float | tuple[int, float, "Tree", "Tree"]


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, leaf: int = 3) -> Tree:
    """A decision tree (feature, border, below or at, above) by Gini impurity; leaves hold the share of main text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * leaf:
        return share
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cost = ones[:-1] * (1 - ones[:-1] / n) + (ones[-1] - ones[:-1]) * (1 - (ones[-1] - ones[:-1]) / (len(y) - n))
        cost[(v[1:] == v[:-1]) | (n < leaf) | (len(y) - n < leaf)] = np.inf
        k = int(np.argmin(cost)) if len(cost) else 0
        if len(cost) and cost[k] < best[0]:
            best = (float(cost[k]), f, float((v[k] + v[k + 1]) / 2))
    _, f, border = best
    if f < 0:
        return share
    low = x[:, f] <= border
    return f, border, fit_tree(x[low], y[low], depth - 1, leaf), fit_tree(x[~low], y[~low], depth - 1, leaf)


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The share of main text in the leaf of each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, border, low, high = tree
    below = x[:, f] <= border
    out = np.empty(len(x))
    out[below], out[~below] = predict(low, x[below]), predict(high, x[~below])
    return out


def train(samples: list[tuple[str, list[str]]] | None = None) -> Tree:
    """The tree for labelled pages: (html, blocks of main text); without any, for those of ``page_samples``."""
    x, y = [], []
    for page, main in page_samples.samples() if samples is None else samples:
        found, main = blocks(page), set(main)
        x.append(features(found))
        y += [b.text in main for b in found]
    return fit_tree(np.concatenate(x), np.array(y, float))


def main_text(pages: DataFrame, tree: Tree | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``text_col``, which takes the place of ``html_col`` and of a column of its own name."""
    tree = train() if tree is None else tree
    kept = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page or "") for page in batch.column(0).to_pylist()]
            good = predict(tree, np.concatenate([features(f) for f in found])) >= 0.5 if found else []
            texts, at = [], 0
            for f in found:
                texts.append("\n".join(b.text for b, g in zip(f, good[at : at + len(f)], strict=True) if g))
                at += len(f)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    plain = pages.select(quoted(html_col).alias("html"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(kept)))
    schema = ", ".join([*(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), "text string"])
    return map_batches(plain, run, schema).toDF(*kept, text_col)
