"""Byte-level BPE by one walk over a trie of distinct pre-tokens.

The encoding of a byte string is fixed by the last token of each of its
prefixes: cut that token off and look at the prefix that is left. So a trie
over the distinct pre-tokens needs one state for each node, the last token
there, and it follows from the states above: a token that ends at the node
is the right one if it and the last token before it stay apart when merged by
rank. Sorted pre-tokens visit the trie depth first, and what they share with
the one before is not computed again.

Rows stand alone, so there is no shuffle. Null counts as empty, with no
tokens. A text of any length is encoded whole. Pre-tokens count as equal if
their 64-bit hashes are. Special tokens of the file are found before anything
else, the longest one first. Every row has its own result, also with repeated
or null ids. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import distinct, spans
from .textops import chunks, map_batches

#: Bytes of texts whose distinct pre-tokens make one trie, and of those that are cut into pre-tokens at once.
GROUP_BYTES, CHUNK_BYTES = 8 << 20, 1 << 19
#: Compared pairs of tokens that a worker remembers.
REMEMBERED = 1 << 18
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in vocabulary files: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file with byte-level BPE."""

    def __init__(self, text: str):
        file = json.loads(text)
        alphabet, model = byte_alphabet(), file["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.id_of = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        if any(t.get(k) for t in file["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that depend on what stands beside them aren't supported")
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        self.find_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        to_bytes = lambda t: bytes(alphabet[c] for c in t)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = self.id_of[to_bytes(a)], self.id_of[to_bytes(b)]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(self.id_of[to_bytes(a + b)], (*pair, r))
        self._apart: dict[int, bool] = {}
        alone: set[int] = {i for b, i in self.id_of.items() if len(b) == 1}
        for t, (a, b, r) in self.parts.items():
            if a in alone and b in alone and self._stay_apart(a, b, r):
                alone.add(t)
        #: Tokens that are the encoding of their own bytes, by bytes; and the lengths of the longer ones by last three bytes, longest first.
        self.tokens = {self.bytes_of[t]: t for t in alone}
        lengths: dict[bytes, set[int]] = {}
        for b in self.tokens:
            if len(b) > 2:
                lengths.setdefault(b[-3:], set()).add(len(b))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in lengths.items()}
        self.bytes_of |= {i: b for b, i in self.special.items()}
        self.width = {i: len(b) for i, b in self.bytes_of.items()}

    def _spine(self, t: int, right: bool, until: int) -> Iterator[tuple[int, int]]:
        """The tokens that stood at one end of ``t`` while it was merged, and the rank at which each ended."""
        yield t, until
        while t in self.parts:
            a, b, r = self.parts[t]
            t = b if right else a
            yield t, r

    def _stay_apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge by rank, leftmost first, joins ``a`` and ``b`` across their border before rank ``until``."""
        for x, x_until in self._spine(a, True, until):
            for y, y_until in self._spine(b, False, until):
                r = self.rank.get((x, y), NEVER)
                if r < x_until and (r <= y_until if y_until != until else r < y_until):
                    return False
        return True

    def _compare(self, a: int, b: int) -> bool:
        if len(self._apart) >= REMEMBERED:
            self._apart.clear()
        found = self._apart[a << 20 | b] = self._stay_apart(a, b)
        return found

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Encodings of byte strings in ascending order, by a depth-first walk over their trie."""
        before, last, short = b"", [-1], (2, 1)
        tokens, lengths, known, compare, width = self.tokens.get, self.lengths.get, self._apart.get, self._compare, self.width
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for size in lengths(word[depth - 3 : depth], short) if depth > 2 else short:
                    if size <= depth:
                        token = tokens(word[depth - size : depth])
                        if token is None:
                            continue
                        if size < depth:
                            earlier = last[depth - size]
                            apart = known(earlier << 20 | token)
                            if apart is False or (apart is None and not compare(earlier, token)):
                                continue
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no encoding for {word!r}")
            before = word
            ids, depth = [], len(word)
            while depth:
                ids.append(last[depth])
                depth -= width[last[depth]]
            yield ids[::-1]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=1)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def _groups(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``budget`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= budget:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode_texts(vocabulary: Vocabulary, column: pa.Array) -> Iterator[tuple[int, str, bytes]]:
    """For each text of a column: number of tokens, the ids as text, and the bytes that they decode to.

    Every distinct pre-token of the column is encoded once. Only hashes, places
    and what belongs to distinct pre-tokens are held for all of it.
    """
    place: dict[int, int] = {}
    words: list[bytes] = []
    parts = []
    for c in chunks(column, CHUNK_BYTES):
        found = spans(c, True, vocabulary.find_special)
        h, at, which = distinct(c, found)
        raw, own = c.data.tobytes(), []
        for k, a, b in zip(h.tolist(), found.start[at].tolist(), found.end[at].tolist(), strict=True):
            w = place.setdefault(k, len(words))
            if w == len(words):
                words.append(raw[a:b])
            own.append(w)
        parts.append((np.array(own, np.int32)[which], np.searchsorted(found.doc, np.arange(len(c.offsets)))))
    del place
    # In ascending order, so that neighbours share as much of the trie as they can.
    order = sorted((w for w in range(len(words)) if words[w] not in vocabulary.special), key=words.__getitem__)
    ids = [""] * len(words)
    n = np.ones(len(words), np.int64)
    for w, found in zip(order, vocabulary.encode_sorted(words[w] for w in order), strict=True):
        ids[w], n[w], words[w] = ",".join(map(str, found)), len(found), vocabulary.decode(found)
    for w, word in enumerate(words):
        if not ids[w]:
            ids[w] = str(vocabulary.special[word])
    for which, bounds in parts:
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = which[a:b]
            yield int(n[own].sum()), ",".join([ids[w] for w in own.tolist()]), b"".join([words[w] for w in own.tolist()])


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256 and decoded_sha256; with ``ids`` also the token ids and the decoded text.

    ``vocabulary`` is the path of the vocabulary file; the driver reads it and
    sends its text to the tasks.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, GROUP_BYTES):
            n, digest, decoded_digest, all_ids, texts = [], [], [], [], []
            for count, text, raw in encode_texts(_vocabulary(sent.value), batch.column(1)):
                back = raw.decode("utf-8", "replace")
                n.append(count)
                digest.append(hashlib.sha256(text.encode()).hexdigest())
                decoded_digest.append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    all_ids.append([int(i) for i in text.split(",")] if text else [])
                    texts.append(back)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded_digest, pa.string())]
            if ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
    kinds = [kind, "bigint", "string", "string", *(["array<int>", "string"] if ids else [])]
    return map_batches(docs.select(id_col, text_col), run, ", ".join(f"`{a}` {b}" for a, b in zip(names, kinds, strict=True)))
