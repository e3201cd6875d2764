"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps the
measurements and one bit for each failed rule; policies (versioned sets of
rules) and ablations are then bit operations on the ledger, without texts.

Null or empty text: no words, so the first rule fails. Tables may have more
columns; only the two named ones are read. Repeated ids are repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import CODE_POINT, LINE, LOWER, UPPER, WORD, Chunk, chunks, class_of, map_batches, map_rows, mix, per_doc, pieces, windows

SYMBOLS = class_of("#*$%&|<>")
EXCLAMATION = class_of("!")
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclamations", "n_echo_words")

#: Rules by bit. Each says when a document fails, in integers, for arrays and for columns alike.
RULES = {
    "too_few_words": lambda m: m["n_words"] < 20,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 25 * m["n_words"],
    "repeated_lines": lambda m: (m["n_lines"] >= 4) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    "shouting": lambda m: (m["n_letters"] >= 40) & (100 * m["n_upper"] > 50 * m["n_letters"]),
    "exclamations": lambda m: 100 * m["n_exclamations"] > 50 * m["n_words"],
    "echoed_words": lambda m: 100 * m["n_echo_words"] > 30 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 40 * m["n_words"],
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_windows"))
DEFAULT = Policy("full-1", tuple(RULES))


def measure(chunk: Chunk) -> dict[str, np.ndarray]:
    """The measures of every text of a chunk."""
    n = len(chunk.offsets) - 1
    words = pieces(chunk, WORD)
    lines = pieces(chunk, LINE)
    count = lambda rows: np.bincount(rows, minlength=n)
    # A line counts if a word begins within it.
    has_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_doc, line_hash = lines.doc[has_word], lines.hash[has_word]
    order = np.lexsort((line_hash, line_doc))
    same = (line_doc[order][1:] == line_doc[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    # Windows of one text that share a hash; all their words are repeated.
    h, first = windows(words, WINDOW)
    key = mix(h + words.doc[first].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order_w = np.argsort(key)
    equal = key[order_w][1:] == key[order_w][:-1]
    twice = np.zeros(len(key), bool)
    twice[order_w[1:][equal]] = True
    twice[order_w[:-1][equal]] = True
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + WINDOW, -1)
    covered = np.cumsum(step)[:-1] > 0
    echo = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    data = chunk.data
    return {
        "n_words": count(words.doc),
        "word_chars": per_doc(chunk, (WORD & CODE_POINT)[data]),
        "n_symbols": per_doc(chunk, SYMBOLS[data]),
        "n_dup_lines": count(line_doc[order][1:][same]),
        "n_repeat_words": count(words.doc[covered]),
        "n_lines": count(line_doc),
        "n_upper": per_doc(chunk, UPPER[data]),
        "n_letters": per_doc(chunk, (UPPER | LOWER)[data]),
        "n_exclamations": per_doc(chunk, EXCLAMATION[data]),
        "n_echo_words": count(words.doc[1:][echo]),
    }


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(c) for c in chunks(batch.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate([p[m] for p in parts]), pa.int64()) for m in MEASURES)], [id_col, *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, ", ".join([f"`{id_col}` {kind}", *(f"{m} bigint" for m in MEASURES)]))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the measures and ``failed`` (long), the bits of the failed rules."""
    columns = {m: F.col(m) for m in MEASURES}
    bits = [F.when(fails(columns), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return _measured(docs, id_col, text_col).withColumn("failed", failed.cast("long"))


def passes(policy: Policy, failed: str = "failed") -> F.Column:
    """Whether a ledger row is kept by ``policy``."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of ``policy``: documents that fail it, those that fail only it, and those kept without it.

    Rows are first counted by mask (at most 2 ** rules rows), so the ledger is read once.
    """
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules)))
    on = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("mask") == F.col("r.bit")
    zero = F.lit(0).cast("long")
    return (
        masks.withColumn("r", rules)
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(on, F.col("n")).otherwise(zero)).alias("n_failed"),
            F.sum(F.when(only, F.col("n")).otherwise(zero)).alias("n_only"),
            F.sum(F.when(only | (F.col("mask") == 0), F.col("n")).otherwise(zero)).alias("n_kept_without"),
        )
    )


def keep_documents(docs: DataFrame, policy: Policy = DEFAULT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with all their columns, in one pass and without a shuffle."""
    at = docs.columns.index(text_col)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [~np.logical_or.reduce([RULES[r](m) for r in policy.rules]) for m in map(measure, chunks(batch.column(at)))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return map_rows(docs, run)
