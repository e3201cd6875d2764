"""Token counts by counting the pieces of every distinct pre-token once.

1. Count pre-tokens over all documents.
2. Count the pieces of each distinct pre-token once, with the tokenizer.
3. Count pre-tokens within each document and join: the most frequent ones (at
   most ``HEAD`` entries of 12 bytes, so their table has a bound that doesn't
   grow) are sent to all tasks and summed on the spot; the rest is joined by
   hash and summed. Token ids of documents are never made.

Null counts as empty: no bytes and no tokens. Texts of any length are counted
whole. Pre-tokens count as equal if their 64-bit hashes are. Special strings
in a text are one token each, as in the library. Repeated ids and null ids
keep one row each. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .pretokens import distinct, spans
from .storage import materialize
from .textops import chunks, map_batches

HEAD = 1 << 20
CHUNK_BYTES = 1 << 20
_NOT_SPECIAL = "\n"


@lru_cache(maxsize=1)
def _tokenizer(file: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _normal(text: str, tokenizer: Tokenizer) -> str:
    """The normal form, up to white space. Latin-1 texts are composed already, so lower case is all that is left to do."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return tokenizer.normalizer.normalize_str(text)
    return text.lower()


def _normalized(column: pa.Array, tokenizer: Tokenizer) -> tuple[pa.Array, np.ndarray]:
    """Texts in normal form; special strings give way to a line end and are counted."""
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    find = re.compile("|".join(map(re.escape, special)))
    texts, extra = [], np.zeros(len(column), np.int64)
    for i, t in enumerate(column.to_pylist()):
        parts = [t or ""]
        if any(s in parts[0] for s in special):
            parts = find.split(parts[0])
            extra[i] = len(parts) - 1
        texts.append(_NOT_SPECIAL.join([_normal(p, tokenizer) for p in parts]))
    return pa.array(texts, pa.string()), extra


def _pieces(column: pa.Array, tokenizer: Tokenizer):
    """For groups of texts: rows, special strings in them, the chunk, its pre-token spans, and the distinct ones."""
    for raw in chunks(column, CHUNK_BYTES):
        texts, extra = _normalized(column.slice(raw.first, raw.last - raw.first), tokenizer)
        for c in chunks(texts, 2 * CHUNK_BYTES):
            found = spans(c, False)
            yield raw.first + c.first, raw.first + c.last, extra[c.first : c.last], c, found, *distinct(c, found)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a vocabulary file whose tokenizer normalises
    (NFC, white space, lower case) and splits at letters, digits and others.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def pretokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, c, found, h, at, which in _pieces(batch.column(0), _tokenizer(sent.value)):
                raw = c.data.tobytes()
                words = [raw[a:b] for a, b in zip(found.start[at].tolist(), found.end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(np.bincount(which, minlength=len(h)))], ["h", "pretoken", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent.value)
        for batch in batches:
            sizes = [len(e) for e in tokenizer.encode_batch_fast(batch.column(1).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), batch.column(2)], ["h", "pieces", "n"])

    words = map_batches(docs.select(text_col), pretokens, "h bigint, pretoken string, n bigint").groupBy("h").agg(F.first("pretoken").alias("pretoken"), F.sum("n").alias("n"))
    counts = materialize(map_batches(words, pieces, "h bigint, pieces int, n bigint"), "pieces")
    least = _threshold(counts)
    head = spark.sparkContext.broadcast(_head(counts.where(F.col("n") >= least)))
    tail = counts.where(F.col("n") < least).select("h", "pieces")

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, extra, c, found, h, _, which in _pieces(batch.column(1), _tokenizer(sent.value)):
                n = b - a
                place = np.minimum(np.searchsorted(known, h.view(np.int64)), max(len(known) - 1, 0))
                hit = known[place] == h.view(np.int64) if len(known) else np.zeros(len(h), bool)
                size = np.where(hit, sizes[place], 0) if len(known) else np.zeros(len(h), np.int64)
                total = np.bincount(found.doc, weights=size[which], minlength=n).astype(np.int64) + extra if len(which) else extra
                rare = np.flatnonzero(~hit[which])
                key, many = np.unique(np.stack([found.doc[rare], which[rare]]), axis=1, return_counts=True) if len(rare) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum(np.bincount(key[0], minlength=n))]).astype(np.int32)
                own = batch.column(1).slice(a, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(a, n),
                        pc.fill_null(pc.binary_length(own), 0).cast(pa.int64()),
                        pa.array(total),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)[key[1]])),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(many.astype(np.int32))),
                    ],
                    ["row", "id", "n_bytes", "common", "rare", "times"],
                )
                row += n

    rows = materialize(map_batches(docs.select(id_col, text_col), by_document, f"row bigint, id {kind}, n_bytes bigint, common bigint, rare array<bigint>, times array<int>"), "frequencies")
    rare = rows.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    sums = rare.join(tail, "h").groupBy("row").agg(F.sum(F.col("pieces").cast("long") * F.col("times")).alias("uncommon"))
    n_tokens = F.col("common") + F.coalesce("uncommon", F.lit(0).cast("long"))
    out = rows.select("row", "id", "n_bytes", "common").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def _threshold(counts: DataFrame) -> int:
    """The lowest frequency from which on there are at most ``HEAD`` pre-tokens."""
    top = 1 << 20
    sizes = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n"))
    total, least = 0, top + 1
    for row in sizes.toLocalIterator():  # at most 2 ** 20 rows
        total += row["k"]
        if total > HEAD:
            break
        least = row["n"]
    return least


def _head(common: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = common.select("h", "pieces").toArrow()
    order = np.argsort(table["h"].to_numpy())
    return table["h"].to_numpy()[order], table["pieces"].to_numpy()[order]
