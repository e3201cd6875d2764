"""Ranked lexical search by a bit-sliced impact index.

Documents are numbered within blocks. For a term of a block the index holds a
bitmap for each bit of the impacts that the term has in the block's documents:
bit d of slice s is bit s of the impact in document d. Slices are kept for the
64-document words that hold the term, so a rare term costs a few words and a
frequent one shares them. A search adds the slices of an item's terms by
bitwise full adders, all documents of a block and all items at once, and finds
the best documents of an item by descending from the most significant slice of
the sums: documents with the bit set stay or, while they are too few, are taken.

``postings`` counts queried terms, a pass over the texts; ``build_index`` turns
them into slices when the weights are known; ``search_index`` may be run on the
table again and again. The corpus is never shuffled: a block stays in its task,
which returns its ten best documents for each item, and only these are merged.

Terms are maximal runs of ASCII letters, ASCII digits and characters beyond
ASCII, with A-Z lower-cased; they are compared by 64-bit hashes. Null texts
and texts without a term are no documents of the statistics and are never
found. Every row is a document and every row of ``items`` an item, repeated ids
included: a repeated item has a ranking for each of its rows. Equal scores are
ranked by ascending id, rows without id last. An item without a term, or whose
terms no document has, gets no rows, and so does everything if there are no
documents. A text of any length is one document; the memory for it follows its
length. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .storage import materialize
from .textops import ALL_BYTES, DIGIT, LOWER, UPPER, chunks, map_batches, per_doc, pieces

#: Documents of a block, a multiple of 64.
BLOCK_DOCS = 1024
#: Terms of items, with repeats by item, that one pass over the documents takes; a single larger item is taken whole.
PASS_TERMS = 1 << 20
#: Words of a slice of bitmap sums that are added at once, and terms of the items that own them.
SUM_WORDS, TABLE_TERMS = 1 << 16, 1 << 21
TERM = UPPER | LOWER | DIGIT | (ALL_BYTES >= 0x80)
_ONE = np.uint64(1)


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: first row, number of terms of each row, and row and hash of each term."""
    for chunk in chunks(column):
        n = np.zeros(len(chunk.offsets) - 1, np.int64)
        found = pieces(chunk, TERM, fold=True)
        np.add.at(n, found.doc, 1)
        yield chunk.first, n, found.doc, found.hash


def _packed(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, id, term) of the distinct terms of each row of ``items``; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, term in _terms(batch.column(2)):
                key = np.unique(np.stack([row.astype(np.uint64), term]), axis=1)
                at = pa.array(key[0].astype(np.int64) + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key[1].view(np.int64))], ["item", "id", "term"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(numbered, run, f"item bigint, id {items.schema[id_col].dataType.simpleString()}, term bigint")


def postings(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: ids, numbers of terms, and (document of the block, place in ``terms``, occurrences) of each queried term.

    ``terms``: ascending hashes. Sums of the block's statistics come along: documents, terms and the documents of each queried term.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queried = sent.value
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            sizes = [len(h[1]) for h in held]
            shift = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            n = np.concatenate([h[1] for h in held])
            doc = np.concatenate([h[2] + s for h, s in zip(held, shift, strict=True)])
            term, tf = (np.concatenate([h[k] for h in held]) for k in (3, 4))
            used, df = np.unique(term, return_counts=True)
            cells = [pa.concat_arrays([h[0] for h in held]).to_pylist(), _packed(n, np.int64), _packed(doc, np.int32), _packed(term, np.int32), _packed(tf, np.int64), int((n > 0).sum()), int(n.sum()), _packed(used, np.int32), _packed(df, np.int32)]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, fields, strict=True)], schema=pa.schema(fields))

        for batch in batches:
            for first, n, row, term in _terms(batch.column(1)):
                at = np.minimum(np.searchsorted(queried, term), len(queried) - 1)
                hit = np.flatnonzero(queried[at] == term)
                key, tf = np.unique(row[hit] * len(queried) + at[hit], return_counts=True)
                doc, place = np.divmod(key, len(queried))
                for low in range(0, len(n), BLOCK_DOCS):
                    a, b = np.searchsorted(doc, [low, low + BLOCK_DOCS])
                    part = n[low : low + BLOCK_DOCS]
                    if held and sum(len(h[1]) for h in held) + len(part) > BLOCK_DOCS:
                        yield block()
                        held = []
                    held.append((batch.column(0).slice(first + low, len(part)), part, doc[a:b] - low, place[a:b], tf[a:b]))
        if held:
            yield block()

    fields = [pa.field("ids", pa.list_(pa.int64())), *(pa.field(c, pa.binary()) for c in ("n", "doc", "term", "tf")), pa.field("n_docs", pa.int64()), pa.field("n_terms", pa.int64()), pa.field("used", pa.binary()), pa.field("df", pa.binary())]
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "ids array<bigint>, n binary, doc binary, term binary, tf binary, n_docs bigint, n_terms bigint, used binary, df binary")


def _frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """In how many documents each queried term is; summed inside tasks, so a task sends ``size`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for used, df in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[np.frombuffer(used, np.int32)] += np.frombuffer(df, np.int32)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "df"])

    df = np.zeros(size, np.int64)
    found = map_batches(blocks.select("used", "df"), run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return df


def _impacts(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) with m = 10 + (90 n N) div L, of each posting."""
    big = 90 * int(n.max(initial=0)) * n_docs >= 1 << 63  # then in numbers of any size
    m = 10 + (90 * n.astype(object if big else np.int64) * n_docs // n_terms).astype(np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def build_index(blocks: DataFrame, df: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each block of ``postings``: ids, and for each term and 64-document word that holds it the impact bits, slice by slice."""
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    sent = blocks.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, doc, term, tf = (np.frombuffer(row[c], k) for c, k in (("n", np.int64), ("doc", np.int32), ("term", np.int32), ("tf", np.int64)))
                impact = _impacts(n[doc], tf, sent.value[term], n_docs, n_terms).astype(np.uint64)
                order = np.lexsort((doc, term))
                doc, term, impact = doc[order], term[order], impact[order]
                word = doc >> 6
                first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(word, prepend=-1))
                bit = (doc & 63).astype(np.uint64)
                slices = int(impact.max(initial=0)).bit_length()
                bits = [np.bitwise_or.reduceat(((impact >> np.uint64(s)) & _ONE) << bit, first) for s in range(slices)] if len(first) else []
                cells = [row["ids"], slices, _packed(term[first], np.int32), _packed(word[first], np.int16), b"".join(map(bytes, bits))]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["ids", "slices", "term", "word", "bits"])

    return map_batches(blocks.select("ids", "n", "doc", "term", "tf"), run, "ids array<bigint>, slices int, term binary, word binary, bits binary")


def _add(sums: list[np.ndarray], more: list[np.ndarray]) -> None:
    """Add bit-sliced numbers to bit-sliced sums, by full adders from the least significant slice."""
    carry = None
    for s in range(max(len(sums), len(more))):
        if s >= len(more) and carry is None:
            break
        if s == len(sums):
            sums.append(np.zeros_like(sums[0] if sums else more[0]))
        a, b = sums[s], more[s] if s < len(more) else None
        if b is None:
            sums[s], carry = a ^ carry, a & carry
        elif carry is None:
            sums[s], carry = a ^ b, a & b
        else:
            half = a ^ b
            sums[s], carry = half ^ carry, (a & b) | (half & carry)
        if s >= len(more) and not carry.any():
            carry = None
    if carry is not None and carry.any():
        sums.append(carry)


def _members(words: np.ndarray) -> np.ndarray:
    """Numbers of the documents of a bitmap."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _best(sums: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` documents of largest sums (slices by words) above 0; equal ones by ``order``."""
    taken, open_ = np.zeros_like(sums[0]), np.bitwise_or.reduce(sums, axis=0)
    for row in sums[::-1]:
        held = open_ & row
        n = int(np.bitwise_count(taken | held).sum())
        if n > k:
            open_ = held
        else:
            taken, open_ = taken | held, open_ & ~row
            if n == k:
                return _members(taken)
    rest = _members(open_)
    some = _members(taken)
    return np.concatenate([some, rest[np.argsort(order[rest], kind="stable")][: k - len(some)]])


def search_index(index: DataFrame, items: list[np.ndarray], k: int) -> DataFrame:
    """(item, id, score) of the ``k`` best documents that each task finds for each item, given by the places of its terms."""
    # Items of like length together: their numbers, and their terms by rank; -1, which has no slices, where an item has no more.
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    order = sorted(range(len(items)), key=lambda i: -len(items[i]))
    while order:
        longest = len(items[order[0]])
        step = max(1, min(SUM_WORDS * 64 // BLOCK_DOCS, TABLE_TERMS // max(1, longest)))
        part, order = order[:step], order[step:]
        table = np.full((len(part), longest), -1, np.int64)
        for i, item in enumerate(part):
            table[i, : len(items[item])] = items[item]
        tables.append((np.array(part), table))
    sent = index.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                term, word = np.frombuffer(row["term"], np.int32), np.frombuffer(row["word"], np.int16)
                if not len(term):
                    continue
                bits = np.frombuffer(row["bits"], np.uint64).reshape(row["slices"], len(term))
                ids, words = row["ids"], -(-len(row["ids"]) // 64)
                order = np.empty(len(ids), np.int64)
                order[sorted(range(len(ids)), key=lambda d: (ids[d] is None, ids[d] or 0))] = np.arange(len(ids))
                present, place = np.unique(term, return_inverse=True)
                dense = np.zeros((row["slices"], len(present) + 1, words), np.uint64)  # the last term has no bits
                dense[:, place, word] = bits
                for numbers, asked in sent.value:
                    at = np.minimum(np.searchsorted(present, asked), len(present) - 1)
                    at = np.where(present[at] == asked, at, len(present))
                    at = np.sort(at, axis=1)  # terms of the block first
                    sums: list[np.ndarray] = []
                    for rank in range(at.shape[1]):
                        live = np.flatnonzero(at[:, rank] < len(present))
                        if not len(live):
                            break
                        if len(live) == len(at):
                            _add(sums, [s[at[:, rank]] for s in dense])
                        else:
                            part = [s[live] for s in sums]
                            _add(part, [s[at[live, rank]] for s in dense])
                            while len(sums) < len(part):
                                sums.append(np.zeros((len(at), words), np.uint64))
                            for s, p in zip(sums, part, strict=True):
                                s[live] = p
                    if not sums:
                        continue  # none of their terms is in the block
                    stacked = np.stack(sums, axis=1)
                    for i in np.flatnonzero(stacked.any(axis=(1, 2))).tolist():
                        docs = _best(stacked[i], order, k)
                        ones = (stacked[i][:, docs >> 6] >> (docs & 63).astype(np.uint64)) & _ONE
                        scores = (ones.astype(np.int64) << np.arange(len(ones))[:, None]).sum(0)
                        have = best.setdefault(int(numbers[i]), [])
                        have += [(-int(s), ids[d] is None, ids[d] or 0) for s, d in zip(scores, docs.tolist(), strict=True)]
                        have.sort()
                        del have[k:]
        for item, found in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found)), pa.array([None if none else i for _, none, i in found], pa.int64()), pa.array([-s for s, _, _ in found])], ["item", "id", "score"])

    return map_batches(index, run, "item bigint, id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: (item_col, rank, id_col, score).

    Items are taken in passes of about ``PASS_TERMS`` terms, so what a task and
    the driver hold of them is bounded whatever their number.
    """
    spark = docs.sparkSession
    listed = materialize(item_terms(items, item_col, item_text_col), "items")
    passes = -(-max(1, listed.count()) // PASS_TERMS)
    found = []
    for p in range(passes):
        rows = listed.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).select("item", "term").toArrow()
        if not rows.num_rows:
            continue
        numbers, item = np.unique(rows.column(0).to_numpy(), return_inverse=True)
        terms, place = np.unique(rows.column(1).to_numpy().view(np.uint64), return_inverse=True)
        places = np.split(place[np.argsort(item, kind="stable")], np.cumsum(np.bincount(item))[:-1])
        blocks = materialize(postings(docs, terms, id_col, text_col), "postings")
        total: Row = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        if not total["n"]:
            break
        index = build_index(blocks, _frequencies(blocks, len(terms)), total["n"], total["l"])
        of = spark.createDataFrame([(k, int(n)) for k, n in enumerate(numbers)], "item bigint, row bigint")
        best = search_index(index, places, k).join(of, "item").select(F.col("row").alias("item"), "id", "score")
        found.append(best)
    kind = items.schema[item_col].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} bigint, score bigint")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
    return ranked.join(listed.select("item", F.col("id").alias("named")).distinct(), "item").select(F.col("named").alias(item_col), "rank", F.col("id").alias(id_col), "score")
