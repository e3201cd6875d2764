"""Vectorised text helpers for Arrow batches inside tasks.

Texts stay UTF-8 bytes. A piece (word or line) is a maximal run of bytes of a
class, cut at document ends. Pieces get 64-bit hashes that agree on every
machine: sums of fixed random byte values times powers of an odd number,
modulo 2**64, followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

ALL_BYTES = np.arange(256)
#: Bytes of words by white space: everything but blank and 0x09 to 0x0D.
WORD = ~((ALL_BYTES == 0x20) | ((ALL_BYTES >= 0x09) & (ALL_BYTES <= 0x0D)))
LINE = ALL_BYTES != 0x0A
UPPER = (ALL_BYTES >= 0x41) & (ALL_BYTES <= 0x5A)
LOWER = (ALL_BYTES >= 0x61) & (ALL_BYTES <= 0x7A)
DIGIT = (ALL_BYTES >= 0x30) & (ALL_BYTES <= 0x39)
CODE_POINT = (ALL_BYTES & 0xC0) != 0x80
_FOLDED = _VALUES[np.where(UPPER, ALL_BYTES + 0x20, ALL_BYTES)]


def class_of(characters: str) -> np.ndarray:
    """A table of 256 booleans, true for these ASCII characters."""
    table = np.zeros(256, bool)
    table[list(characters.encode("ascii"))] = True
    return table


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + 1), np.uint64(base))
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= CHUNK_BYTES + 1:  # those of longer pieces aren't kept
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Chunk(NamedTuple):
    first: int  # row of the batch
    last: int  # row after the chunk
    data: np.ndarray  # bytes of these texts, one after the other
    offsets: np.ndarray  # where each text begins, and the end


def chunks(column: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in groups of about ``budget`` bytes; null counts as empty, a longer text stands alone."""
    if len(column) == 0:
        return
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Pieces(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # row within the chunk
    hash: np.ndarray


def pieces(chunk: Chunk, members: np.ndarray, fold: bool = False, hashed: bool = True) -> Pieces:
    """Maximal runs of bytes in ``members``; ``fold`` hashes A-Z like a-z.

    Hashes are made in segments that end between pieces, so memory for them
    follows the segment and the longest piece, not the longest text.
    """
    data, offsets = chunk.data, chunk.offsets
    inside = members[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Pieces(start, end, doc, hash_spans(data, start, end, fold) if hashed else np.zeros(0, np.uint64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of ascending spans of bytes that do not overlap."""
    values = _FOLDED if fold else _VALUES
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, "right")))
        low, high = start[at], end[stop - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * _power(_BASE, high - low), out=sums[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * _power(_INVERSE, high - low)[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def per_doc(chunk: Chunk, mask: np.ndarray) -> np.ndarray:
    """How many bytes of each text have ``mask``."""
    sums = np.zeros(len(chunk.offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(chunk.offsets))
    if len(full):
        sums[full] = np.add.reduceat(mask, chunk.offsets[full], dtype=np.int64)
    return sums


def windows(words: Pieces, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one text, and the index of their first words."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    h = np.zeros(len(first), np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words.hash[first + k]
    return mix(h + np.uint64(size)), first


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES`` bytes (or what the session asks for, if that is less), so long texts don't pile up in a worker.

    Spark reads the size when the query runs, which is after this returns, so
    the setting stays in the session.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = spark.conf
    # Spark's own reading of sizes such as 64m.
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name))
    if not 0 < size <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over whole rows whatever their columns are called; ``run`` finds them by position."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return map_batches(plain, run, plain.schema).toDF(*df.columns)
