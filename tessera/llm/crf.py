"""A quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe it and the lines before
and after it; neighbouring labels have transition weights. Forward-backward
gives each line's probability of being good, and their geometric mean,
weighted by length, is the document's score: it falls fast with the share of
bad lines. A power fitted on the training documents puts the border between
good and bad at ``BORDER``.

The model is fitted to the lines of at most ``SAMPLE`` labelled documents, and
at most ``LINES`` lines, which take their document's label; the same ones in
every run. Labels, ids and
other columns never enter a score. Scoring needs one pass and no shuffle.

An empty or null text counts as one empty line. Texts are scored whole, whatever
their length. Without any labelled document every score is 0.5. Scores may tie. Every row has its own result, also with
repeated or null ids. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import ALL_BYTES, DIGIT, LINE, LOWER, UPPER, WORD, Chunk, chunks, class_of, map_batches, pieces

#: Labelled documents that the model is fitted to, and lines of all of them and of one, at most.
SAMPLE, LINES, LONGEST = 3000, 200_000, 10_000
STEPS = 150
RATE = 0.1
PENALTY = 1e-3
#: Probabilities of lines count as this much at least.
LEAST = 1e-6
#: Scores from here on are called good.
BORDER = 0.3

_SYMBOL = class_of("#*$%&|<>{}[]\\^~_=")
_STOP = class_of(".?")
_EXCLAIM = class_of("!")
_BAR = class_of("|")
_LETTER = UPPER | LOWER | (ALL_BYTES >= 0x80)
OWN = ("bias", "length", "upper", "symbols", "bars", "exclamations", "digits", "letters", "word_length", "echo", "same_as_before", "ends", "short")
NEAR = tuple(OWN.index(f) for f in ("upper", "symbols", "bars", "exclamations", "echo"))
N_FEATURES = len(OWN) + 2 * len(NEAR) + 2


class Lines(NamedTuple):
    doc: np.ndarray  # row of the chunk; every row has a line
    size: np.ndarray  # bytes, 1 at least
    features: np.ndarray


def _per_line(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[end] - sums[start]


def lines(chunk: Chunk) -> Lines:
    """The lines that hold a word, or one empty line, of every text of a chunk."""
    n, data = len(chunk.offsets) - 1, chunk.data
    found, words = pieces(chunk, LINE), pieces(chunk, WORD)
    first, last = np.searchsorted(words.start, found.start), np.searchsorted(words.start, found.end)
    keep = last > first
    start, end, doc, h, first, last = (x[keep] for x in (found.start, found.end, found.doc, found.hash, first, last))
    size, n_words = np.maximum(end - start, 1), np.maximum(last - first, 1)
    share = lambda table: _per_line(table[data], start, end) / size
    by_word = lambda table: np.minimum(_per_line(table[data], start, end) / n_words, 4.0)
    echo = np.zeros(len(words.hash) + 1, bool)
    echo[1:-1] = words.hash[1:] == words.hash[:-1]
    same = np.zeros(len(doc))
    same[1:] = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    x = np.zeros((len(doc), N_FEATURES))
    own = [
        np.ones(len(doc)),
        np.log1p(size) / 5,
        _per_line(UPPER[data], start, end) / np.maximum(_per_line((UPPER | LOWER)[data], start, end), 1),
        by_word(_SYMBOL),
        by_word(_BAR),
        by_word(_EXCLAIM),
        share(DIGIT),
        share(_LETTER),
        np.minimum(size / n_words / 8, 4.0),
        _per_line(echo, first, np.maximum(last, first)) / n_words,
        same,
        _STOP[data[end - 1]].astype(float) if len(end) else np.zeros(0),
        (n_words < 5).astype(float),
    ]
    for k, values in enumerate(own):
        x[:, k] = values
    at = len(own)
    if len(doc) > 1:
        after = doc[1:] == doc[:-1]
        for f in NEAR:
            x[1:, at] = np.where(after, x[:-1, f], 0)
            x[:-1, at + 1] = np.where(after, x[1:, f], 0)
            at += 2
    if len(doc):
        x[:, -2] = np.concatenate([[True], doc[1:] != doc[:-1]])
        x[:, -1] = np.concatenate([doc[1:] != doc[:-1], [True]])
    empty = np.setdiff1d(np.arange(n), doc)
    if len(empty):
        blank = np.zeros((len(empty), N_FEATURES))
        blank[:, [0, -2, -1]] = 1
        order = np.argsort(np.concatenate([doc, empty]), kind="stable")
        doc, size, x = np.concatenate([doc, empty])[order], np.concatenate([size, np.ones(len(empty), np.int64)])[order], np.concatenate([x, blank])[order]
    return Lines(doc, size, x)


class Grid(NamedTuple):
    """Where the k-th line of each document is, documents with most lines first."""

    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, doc: np.ndarray) -> Grid:
        _, first, count = np.unique(doc, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        return cls(first[order], count[order])

    def steps(self) -> Iterator[np.ndarray]:
        """For k = 0, 1, ...: the rows of the k-th lines of the documents that have one."""
        n = len(self.count)
        for k in range(int(self.count[0]) if n else 0):
            n = int(np.searchsorted(-self.count, -k, "left"))
            yield self.first[:n] + k


def messages(score: np.ndarray, grid: Grid, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good: forward with, and backward without the line's own ``score``; ``moves[s, t]`` is the weight of label s before t."""
    pass_on = lambda a, m: np.logaddexp(m[1, 1] + a, m[0, 1]) - np.logaddexp(m[1, 0] + a, m[0, 0])
    forward, backward = score.copy(), np.zeros_like(score)
    steps = list(grid.steps())
    for before, now in zip(steps[:-1], steps[1:], strict=True):
        forward[now] += pass_on(forward[before[: len(now)]], moves)
    for now, after in zip(steps[-2::-1], steps[:0:-1], strict=True):
        backward[now[: len(after)]] = pass_on(score[after] + backward[after], moves.T)
    return forward, backward


class Model(NamedTuple):
    weights: np.ndarray
    moves: np.ndarray
    power: float = 1.0

    def scores(self, found: Lines) -> np.ndarray:
        """The geometric mean over its bytes of each document's probability of good, to the model's power."""
        good = np.log(np.maximum(self.good(found.doc, found.features), LEAST))
        return np.exp(self.power * np.bincount(found.doc, weights=found.size * good) / np.bincount(found.doc, weights=found.size))

    def good(self, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Each line's marginal probability of being good."""
        forward, backward = messages(x @ self.weights, Grid.of(doc), self.moves)
        return 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))


def fit(doc: np.ndarray, x: np.ndarray, label: np.ndarray) -> Model:
    """Maximum conditional likelihood of the lines' labels, by gradient steps with adaptive rates."""
    if not len(doc):
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)))
    grid, n = Grid.of(doc), len(np.unique(doc))
    steps = list(grid.steps())
    before = np.concatenate([b[: len(a)] for b, a in zip(steps[:-1], steps[1:], strict=True)]) if len(steps) > 1 else np.zeros(0, np.int64)
    after = before + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[before], label[after]), 1)
    theta = np.zeros(x.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        score = x @ weights
        forward, backward = messages(score, grid, moves)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        pair = np.stack([moves[s, t] + s * forward[before] + t * (score[after] + backward[after]) for s in (0, 1) for t in (0, 1)])
        pair = np.exp(pair - pair.max(0)) if len(before) else pair
        expected = (pair / pair.sum(0)).sum(1) if len(before) else np.zeros(4)
        gradient = np.concatenate([x.T @ (label - p), seen.ravel() - expected]) / n - PENALTY * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def calibrated(model: Model, found: Lines, label: np.ndarray) -> Model:
    """The model with the power that puts the best border between the training documents at ``BORDER``."""
    if len(np.unique(label)) < 2:
        return model
    score = np.clip(model.scores(found), 1e-9, 1 - 1e-9)
    order = np.argsort(score)
    score, good = score[order], label[order]
    # Right answers if the first k documents are called bad.
    right = np.concatenate([[0], np.cumsum(good == 0)]) + good.sum() - np.concatenate([[0], np.cumsum(good)])
    best = [k for k in np.flatnonzero(right == right.max()) if 0 < k < len(score)]
    if not best:
        return model
    border = max(((score[k] - score[k - 1], (score[k] + score[k - 1]) / 2) for k in best))[1]
    return model._replace(power=float(np.log(BORDER) / np.log(border)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of at most ``SAMPLE`` of the rows of ``labels`` (id, label 0 or 1) by a hash of their ids."""
    chosen = labels.select(F.col(id_col).alias("_of"), F.col(label_col).cast("int").alias("_label")).where(F.col("_of").isNotNull() & F.col("_label").isin(0, 1))
    chosen = chosen.groupBy("_of").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_of"), "_of").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_of")).groupBy("_of", "_label").agg(F.min("_text").alias("_text"))
    n_lines = F.coalesce(F.regexp_count("_text", F.lit("\n")), F.lit(0)) + 1
    # At most SAMPLE rows of id and number, so one task may add them up.
    upto = F.sum("_lines").over(Window.orderBy(F.xxhash64("_of"), "_of"))
    few = texts.select("_of", n_lines.alias("_lines")).where(F.col("_lines") <= LONGEST).withColumn("_upto", upto).where(F.col("_upto") <= LINES).select("_of")
    rows = texts.join(F.broadcast(few), "_of").select("_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                found = lines(c)
                order = np.searchsorted(found.doc, np.arange(len(c.offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.first, c.last - c.first), pa.array([found.features[a:b].astype(np.float32).tobytes() for a, b in zip(order[:-1], order[1:], strict=True)], pa.binary()), pa.array([found.size[a:b].astype(np.float64).tobytes() for a, b in zip(order[:-1], order[1:], strict=True)], pa.binary())], ["label", "features", "sizes"])

    table = map_batches(rows, run, "label int, features binary, sizes binary").toArrow()
    parts = sorted(zip(table["label"].to_pylist(), table["features"].to_pylist(), table["sizes"].to_pylist(), strict=True))
    x = [np.frombuffer(f, np.float32).reshape(-1, N_FEATURES) for _, f, _ in parts]
    doc = np.repeat(np.arange(len(x)), [len(f) for f in x])
    label = np.repeat(np.array([v for v, _, _ in parts], np.int64), [len(f) for f in x])
    size = np.concatenate([np.zeros(0), *(np.frombuffer(s, np.float64) for _, _, s in parts)])
    found = Lines(doc, size, np.concatenate([np.zeros((0, N_FEATURES)), *x]).astype(np.float64))
    return calibrated(fit(found.doc, found.features, label), found, np.array([v for v, _, _ in parts], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score, as the model gives it (see ``Model.scores``)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                found = lines(c)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.last - c.first), pa.array(model.scores(found))], [id_col, "score"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")


def held_out(id_: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text is a multiple of ``folds``; such rows are never learnt from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(False))
