"""Pre-tokens of byte-level tokenizers, found for whole chunks at once.

Characters get one of four classes; pre-tokens begin where the class changes,
with the rules for blanks, contractions and single digits on top. Spans are
byte spans of the chunk, so equal pre-tokens have equal hashes.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache
from typing import NamedTuple

import numpy as np
from tokenizers import Regex, pre_tokenizers

from .textops import CODE_POINT, Chunk, hash_spans

OTHER, LETTER, NUMBER, SPACE = range(4)
# Characters with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


_UNKNOWN = 255
_table = np.full(sys.maxunicode + 1, _UNKNOWN, np.uint8)
_table[WHITE_SPACE] = SPACE


@cache
def _splitters() -> dict[int, pre_tokenizers.PreTokenizer]:
    return {kind: pre_tokenizers.Split(Regex(pattern), "removed", invert=True) for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"))}


def _kind(c: str) -> int:
    """Class of a character; those that Python's Unicode version doesn't know are looked up in the tokenizer library's."""
    category = unicodedata.category(c)
    if category == "Cn":
        return next((kind for kind, s in _splitters().items() if s.pre_tokenize_str(c)), OTHER)
    return {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)


def _kinds(code: np.ndarray) -> np.ndarray:
    kinds = _table[code]
    new = np.unique(code[kinds == _UNKNOWN])
    if len(new):
        _table[new] = [_kind(chr(c)) for c in new.tolist()]
        kinds = _table[code]
    return kinds


class Spans(NamedTuple):
    start: np.ndarray  # byte offsets within the chunk
    end: np.ndarray
    doc: np.ndarray


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins."""
    at = np.flatnonzero(CODE_POINT[data])
    code = data[at].astype(np.uint32)
    for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        which = np.flatnonzero((code >= low) & (code < high) & (data[at] == code))
        if len(which):
            value = code[which] & keep
            for k in range(1, more + 1):
                value = (value << 6) | (data[at[which] + k] & 0x3F)
            code[which] = value
    return code, at


def spans(chunk: Chunk, blanks: bool, special: re.Pattern[bytes] | None = None) -> Spans:
    """Pre-tokens of all texts of a chunk.

    ``blanks``: white space is kept, one blank joins what follows it, and digits
    form runs; otherwise white space goes and every digit stands alone.
    ``special``: strings that are always one pre-token and end those beside them.
    """
    data, offsets = chunk.data, chunk.offsets
    code, at = _characters(data)
    n = len(code)
    if not n:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none)
    kind = _kinds(code)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, offsets)] = True
    held = []
    if special:
        raw, from_ = data.tobytes(), 0
        while m := special.search(raw, from_):
            from_ = m.start() + 1
            if np.searchsorted(offsets, m.start(), "right") == np.searchsorted(offsets, m.end(), "left"):
                held.append(tuple(np.searchsorted(at, m.span()).tolist()))
                edge[[*held[-1]]] = True
                from_ = m.end()
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    if blanks:
        # The last white space before something else begins a pre-token of its own; a blank takes what follows along.
        follows = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:n]) + 1
        start[follows - 1] = True
        start[follows[code[follows - 1] == 0x20]] = False
    else:
        start[:n] |= kind == NUMBER
    _contractions(code, start, edge)
    for a, b in held:
        start[a:b] = False
        start[[a, b]] = True
    begin = np.flatnonzero(start[:n])
    stop = np.append(begin[1:], n)
    if not blanks:
        keep = kind[begin] != SPACE
        begin, stop = begin[keep], stop[keep]
    where = np.append(at, len(data))
    first = where[begin]
    return Spans(first, where[stop], np.searchsorted(offsets, first, "right") - 1)


def _contractions(code: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
    """Where a pre-token begins with an apostrophe and one of s t m d re ve ll, that much is one pre-token."""
    n = len(code)
    at = np.flatnonzero(start[:n] & (code == ord("'")))
    at = at[(at + 1 < n) & ~edge[np.minimum(at + 1, n)]]
    if not len(at):
        return
    one, two = code[at + 1], np.where((at + 2 < n) & ~edge[np.minimum(at + 2, n)], code[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    for which, size in ((at[short], 2), (at[long], 3)):
        start[which + 1] = False
        start[which + size] = True


def distinct(chunk: Chunk, found: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct pre-tokens, one occurrence of each, and for every pre-token which one it is."""
    return np.unique(hash_spans(chunk.data, found.start, found.end), return_index=True, return_inverse=True)
