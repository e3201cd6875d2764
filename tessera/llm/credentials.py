"""Secret scans by grammar inference.

1. A first pass finds the base matches of every whole text. Labelled
   credentials are their values, by kind: a sample bounded by ``SAMPLE`` for
   each kind and ``SAMPLE_BYTES`` for a value, the same in every run. Prefix
   trees of their symbols are merged into one stochastic automaton for each
   kind; another is inferred from runs outside base matches, as the background.
2. Candidates are all runs of ``SHORTEST`` characters or more of the class
   that base values are made of, without what base spans cover. Every one is
   scored by format likelihood. It becomes a span of kind ``learned`` if some
   automaton finds it as likely as all but a few of its own training values
   and takes no step that is unheard of there, and if the background finds it
   less likely.

Base spans always stay. Null counts as empty and has no spans. Whole texts are
scanned, whatever their length; offsets are code points, ends exclusive. Spans
that begin at one place stand in the order of kinds. Every row has its own
result, also with repeated or null ids, and an empty table gives none. Where no
text has a base match nothing can be learned, and there are no other spans.
Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, infer
from .storage import discard, materialize
from .textops import ALL_BYTES, DIGIT, LOWER, UPPER, chunks, class_of, map_batches, map_rows, per_doc, pieces

#: Distinct labelled values for each kind, and ordinary words, that automata are inferred from.
SAMPLE = 1500
#: One ordinary long word in so many is offered to the sample.
WORDS_OFFERED = 64
#: Share of training values that are less likely than a candidate has to be.
LEAST_LIKELY = 0.02
#: Bits per symbol by which a format has to be likelier than the background.
ADVANTAGE = 0.5
SHORTEST = 8
#: Longest value that automata are inferred from.
SAMPLE_BYTES = 512
#: Scores of distinct candidates that a task remembers.
REMEMBERED = 1 << 17
MASK = "[SECRET]"

KINDS = ("assign", "access", "hex", "learned")
# The base patterns and their least lengths.
BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_CREDENTIAL = UPPER | LOWER | DIGIT | class_of("+/_.=-")
_HEX = DIGIT | ((ALL_BYTES >= 0x61) & (ALL_BYTES <= 0x66))
_SIGN = class_of(":=")


_SYMBOLS = {ord(c): s for members, s in (("0123456789", "0"), ("abcdef", "h"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U")) for c in members}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: str


def symbols(value: str) -> tuple[str, str]:
    """The shape and the letters of a value.

    Letters: 0 digits, h lower-case letters up to f, l other lower-case
    letters, U capitals; others stand for themselves. Shape: the same for all
    letters and digits, by what the value is made of: 0 digits, x hexadecimal
    digits, U capitals and digits, a anything.
    """
    letters = value.translate(_SYMBOLS)
    made = set(letters) & set("0hlU")
    kind = "0" if made <= {"0"} else "x" if made <= {"0", "h"} and "0" in made else "U" if made <= {"0", "U"} else "a"
    return letters.translate({ord(c): kind for c in "0hlU"}), letters


def base_spans(text: str) -> list[Span]:
    """The base matches of a text, by start and then kind."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        # Runs below the least length fail in any case, so long ones may be asked for directly.
        for m in (_HEX_RUN if kind == "hex" else pattern).finditer(text):
            if len(m.group(group)) >= least:
                found.append(Span(kind, m.start(), m.end(), m.group(group)))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def candidates(text: str, base: list[Span]) -> Iterator[Span]:
    """Runs of credential characters outside the base spans."""
    at, k = 0, 0
    covered = sorted((b.start, b.end) for b in base)
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(covered) and covered[k][1] <= at:
            k += 1
        for start, stop in covered[k:]:
            if start >= end:
                break
            if start - at >= SHORTEST:
                yield Span("learned", at, start, text[at:start])
            at = max(at, stop)
        if end - at >= SHORTEST:
            yield Span("learned", at, end, text[at:end])


def _suspects(chunk) -> tuple[np.ndarray, list[bytes]]:
    """Which texts of a chunk may have a base span, by byte classes alone; and a share of the long runs, the same in every run."""
    data, offsets = chunk.data, chunk.offsets
    raw = data.tobytes()
    suspect = per_doc(chunk, _SIGN[data]) > 0
    at = raw.find(b"AKIA")
    while at >= 0:
        suspect[np.searchsorted(offsets, at, "right") - 1] = True
        at = raw.find(b"AKIA", at + 4)
    hexes = pieces(chunk, _HEX, hashed=False)
    suspect[hexes.doc[hexes.end - hexes.start >= 32]] = True
    runs = pieces(chunk, _CREDENTIAL)
    offered = np.flatnonzero((runs.end - runs.start >= SHORTEST) & (runs.end - runs.start <= SAMPLE_BYTES) & (runs.hash % np.uint64(WORDS_OFFERED) == 0))
    return suspect, [raw[runs.start[i] : runs.end[i]] for i in offered.tolist()]


def _texts(batch: pa.RecordBatch, at: int):
    """Row, text (or None where no base pattern can match) and offered runs for every row of a batch."""
    for c in chunks(batch.column(at)):
        suspect, words = _suspects(c)
        raw = c.data.tobytes()
        yield c.first, [raw[c.offsets[i] : c.offsets[i + 1]].decode() if suspect[i] else None for i in range(c.last - c.first)], words


_SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def _labelled(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, value) of base matches, and offered runs as of kind ``""``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for _, texts, words in _texts(batch, 0):
                base = [s for t in texts if t for s in base_spans(t)]
                values = {s.value for s in base}
                rows |= {(s.kind, s.value) for s in base if len(s.value) <= SAMPLE_BYTES}
                rows |= {("", w) for w in (w.decode() for w in words) if w not in values}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["kind", "value"])

    return map_batches(docs.select(text_col), run, "kind string, value string")


class Formats(NamedTuple):
    """Automata by kind with the least likelihood each asks for, and the background."""

    automata: dict[str, tuple[Automaton, float]]
    background: Automaton | None

    def score(self, value: str) -> tuple[str, float] | None:
        """The likeliest format of a candidate and its advantage over the background in bits per symbol, or None."""
        s = symbols(value)
        best = None
        for kind, (automaton, least) in self.automata.items():
            bits, sure = automaton.bits(*s, early=True)
            if sure and bits >= least and (best is None or bits > best[1]):
                best = (kind, bits)
        if best is None:
            return None
        ahead = best[1] - (self.background.bits(*s)[0] if self.background else -8.0)
        return (best[0], ahead) if ahead >= ADVANTAGE else None


def learn(docs: DataFrame, text_col: str) -> Formats:
    """Automata from a bounded sample of the labelled values and ordinary runs of ``docs``."""
    values = materialize(_labelled(docs, text_col).distinct(), "values")
    known = values.where("kind <> ''").select("value")
    ordinary = values.where("kind = ''").join(known, "value", "left_anti")
    automata, background = {}, None
    for kind in ("", *BASE):
        of = (values.where(F.col("kind") == kind) if kind else ordinary).select("value")
        sample = [r["value"] for r in of.orderBy(F.xxhash64(F.lit(kind), "value"), "value").limit(SAMPLE).collect()]
        if not sample:
            continue
        automaton = infer([symbols(v) for v in sample])
        if kind:
            automata[kind] = (automaton, float(np.quantile([automaton.bits(*symbols(v))[0] for v in sample], LEAST_LIKELY)))
        else:
            background = automaton
    discard(values)
    return Formats(automata, background)


class _Scanner:
    """All spans of texts; remembers the scores of candidates it has met."""

    def __init__(self, formats: Formats) -> None:
        self.formats, self.known = formats, {}

    def secret(self, value: str) -> bool:
        if value not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[value] = self.formats.score(value) is not None
        return self.known[value]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        extra = [s for s in candidates(text, base) if self.secret(s.value)] if self.formats.automata else []
        return sorted([*base, *extra], key=lambda s: (s.start, KINDS.index(s.kind)))

    def batch(self, column: pa.RecordBatch, at: int) -> Iterator[tuple[int, str, list[Span]]]:
        """Row, text and spans of each text of a column that is not null."""
        for first, texts, _ in _texts(column, at):
            for i, suspect in enumerate(texts, first):
                text = suspect if suspect is not None else column.column(at)[i].as_py()
                if text:
                    yield i, text, self.spans(text, base_spans(text) if suspect is not None else [])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start, end, value) by start and then kind."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(sent.value)
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, _, spans in scanner.batch(batch, 1):
                found[i] = [s._asdict() for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], [id_col, "spans"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, spans {_SPANS}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with ``MASK`` in place of every secret, and ``length_col``, where there is one, brought up to date."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col))
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(sent.value)
        for batch in batches:
            changed = {i: _masked(text, spans) for i, text, spans in scanner.batch(batch, at) if spans}
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(columns[at].to_pylist())], batch.schema[at].type)
                if length is not None:
                    columns[length] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[length].to_pylist())], batch.schema[length].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return map_rows(docs, run)


def _masked(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for s in spans:
        if s.start >= end:
            out += [text[end : s.start], MASK]
        end = max(end, s.end)
    return "".join([*out, text[end:]])
