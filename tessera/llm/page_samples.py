"""A small table of labelled pages, made by a rule: layouts filled with words of no language.

Each page comes with the blocks of its main text. Layouts differ in what marks
the main text (an article, a main element, names of boxes, nothing at all) and
in what stands around and inside it.
"""

from __future__ import annotations

import random

#: Pages of each layout.
PAGES = 8
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo za".split()


class _Filler:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def words(self, low: int, high: int, end: str = "") -> str:
        n = self.rng.randint(low, high)
        return " ".join("".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4))) for _ in range(n)) + end

    def links(self, n: int, box: str = "li") -> str:
        return "".join(f'<{box}><a href="/{self.words(1, 1)}">{self.words(1, 4)}</a></{box}>' for _ in range(n))

    def long(self) -> str:
        return self.words(18, 110, self.rng.choice(("", ".", ".", ".")))

    def any(self) -> str:
        return self.words(1, 6, ".") if self.rng.random() < 0.3 else self.words(5, 110, ".")


def _article(f: _Filler, short: bool = True, box: str = "p") -> tuple[str, list[str]]:
    """Heading and body; ``short`` allows paragraphs of any length, lists, quotes and links alone."""
    main, out = [], []

    def add(text: str, before: str, after: str) -> None:
        main.append(text)
        out.append(before + text + after)

    add(f.words(3, 12), "<h1>", "</h1>")
    for _ in range(f.rng.randint(3, 8)):
        kind = f.rng.random() if short else 0.0
        text = f.any() if short else f.long()
        if kind < 0.7:
            if text.count(" ") > 20 and f.rng.random() < 0.3:
                head, tail = f.words(8, 12), f.words(12, 40, ".")
                link = f.words(1, 3)
                main.append(f"{head} {link} {tail}")
                out.append(f'<{box}>{head} <a href="#">{link}</a> {tail}</{box}>')
            else:
                add(text, f"<{box}>", f"</{box}>")
        elif kind < 0.8:
            add(f.words(1, 8), "<h2>", "</h2>")
        elif kind < 0.88:
            for _ in range(3):
                add(f.words(1, 9), "<li>", "</li>")
        elif kind < 0.94:
            add(text, "<blockquote>", "</blockquote>")
        else:
            link = f.words(2, 6)
            main.append(link)
            out.append(f'<p><a href="/more">{link}</a></p>')
    return "".join(out), main


def _around(f: _Filler, named: bool) -> tuple[str, str]:
    """What comes before and after the main text, with elements and names that say so, or without."""
    if named:
        top = [f"<header><p>{f.words(1, 5)}</p><form><label>{f.words(1, 2)}</label></form></header>", f"<nav><ul>{f.links(6)}</ul></nav>", f'<div class="cookie-notice">{f.words(8, 30, ".")}<button>{f.words(1, 1)}</button></div>', f'<div class="ad">{f.words(3, 40, ".")}</div>', f'<div id="site-header">{f.words(2, 8)}</div>']
        low = [f'<aside><h3>{f.words(1, 3)}</h3><p>{f.words(8, 60, ".")}</p></aside>', f'<div class="sidebar"><ul>{f.links(5)}</ul><p>{f.words(5, 40, ".")}</p></div>', f'<section class="comments"><h3>{f.words(1, 3)}</h3><div>{f.words(1, 3)}</div><p>{f.long()}</p><p>{f.any()}</p></section>', f'<form><p>{f.words(3, 30, ".")}</p><label>{f.words(1, 3)}</label></form>', f"<footer>&copy; {f.words(2, 14, '.')}<p>{f.words(8, 50, '.')}</p></footer>"]
    else:
        top = [f"<div>{f.words(1, 4)}</div>", f"<ul>{f.links(7)}</ul>", f'<div>{f.links(5, "span")}</div>', f"<div>{f.words(2, 9, '.')}</div>"]
        low = [f"<ul>{f.links(6)}</ul>", f"<div>&copy; {f.words(2, 9, '.')}</div>", f'<p>{f.words(3, 10, ".")}</p>', f'<p><a href="/">{f.words(2, 5)}</a> | <a href="/b">{f.words(1, 4)}</a></p>', f"<div>{f.words(1, 5)}</div>"]
    pick = lambda boxes: "".join(b for b in boxes if f.rng.random() < 0.7)
    return pick(top), pick(low)


def samples(seed: int = 1) -> list[tuple[str, list[str]]]:
    """(html, blocks of main text) of labelled pages."""
    out = []
    for layout in range(9):
        for k in range(PAGES):
            f = _Filler(seed * 1000 + layout * 100 + k)
            # Without names only long paragraphs can be told, whatever element they are.
            body, main = _article(f, short=layout < 7, box="p" if layout < 7 else ("p", "div", "td")[k % 3])
            top, low = _around(f, named=layout < 7)
            inner = f'<div class="share">{f.links(3, "span")}</div><div class="related"><p>{f.words(4, 30, ".")}</p></div>' if k % 2 else ""
            if layout == 0:
                page = f"{top}<article>{body}{inner}</article>{low}"
            elif layout == 1:
                page = f"{top}<main><p>{f.words(1, 4)}</p><article>{body}</article>{inner}</main>{low}"
            elif layout == 2:
                page = f"{top}<main>{body}{inner}</main>{low}"
            elif layout == 3:
                page = f'<form action="/">{top}<div class="article-body">{body}{inner}</div>{low}</form>'
            elif layout == 4:
                page = f'{top}<article><header>{body}</header><footer>{f.words(2, 20)}</footer><section class="comments"><article><p>{f.long()}</p></article></section></article>{low}'
            elif layout == 5:
                # Names that the main text shares with short lines and rows of links.
                page = f'{top}<div id="content"><div>{f.links(4, "span")}</div>{body}<ul>{f.links(5)}</ul></div>{low}'
            elif layout == 6:
                page = f'{top}<div itemprop="articleBody">{body}</div>{low}'
            else:
                page = f"{top}<div>{body}</div>{low}" if layout == 7 else f"{top}{body}{low}"
            out.append((f"<!DOCTYPE html><html><head><title>{f.words(2, 8)}</title></head><body>{page}</body></html>", main))
    return out
