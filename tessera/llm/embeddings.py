"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c or more lie within eps = sqrt(2 - 2c) of each other,
and so do their projections on any axes. Vectors are sorted by label and by
the grid cells (of side eps) of their leading principal coordinates, cut into
blocks of the sorted sequence, and only blocks whose bounding boxes come
within eps meet. Two blocks that meet are joined recursively: halves whose
boxes are further apart are skipped, small intervals are compared by their
cosines in double precision. Nothing is left out, so where vectors of a label
fill their space evenly and hardly a block is distant, all its blocks meet.

Equal vectors of one label are joined as one, with their number. A block pair
returns link counts and a spanning forest of its links, so a group of copies
or near copies never comes out as all its pairs.

Null vectors or labels, zero vectors and vectors with null or non-finite
components link with nothing. Vectors of different lengths don't link. Every
row is a vector of its own: rows that share an id share nothing else, and rows
without id link like any other; a component's id is the smallest one in it,
null if it has none. Equal cosines are no ties to break: all
pairs at or above the border link. An empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize
from .textops import map_batches

#: Leading principal coordinates that order vectors and bound blocks.
AXES = 6
#: Bytes, in double precision, of a block of the sorted sequence (``LEAF`` vectors at least). Blocks that meet travel whole, so larger ones travel less often.
BLOCK_BYTES = 4 << 20
LEAF = 128


def _number(vectors: DataFrame, vector_col: str) -> type:
    """The type in which vectors are kept: that of the column, so that nothing is lost."""
    return np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64


def _units(raw: list[bytes], number: type) -> np.ndarray:
    """Rows of unit length, in double precision, of packed vectors of one length."""
    x = np.frombuffer(b"".join(raw), number).astype(np.float64).reshape(len(raw), -1)
    # First by the largest component, so that no square overflows or vanishes.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cut(raw: bytes, n: int) -> list[bytes]:
    """``raw`` in ``n`` equal parts."""
    size = len(raw) // n
    return [raw[k * size : (k + 1) * size] for k in range(n)]


def _by_length(column: pa.Array, number: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the packed vectors of each length."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, _units(column.take(pa.array(at)).to_pylist(), number)


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, raw) of every row; raw is null for vectors that can't link."""
    kind, number = vectors.schema[label_col].dataType.simpleString(), _number(vectors, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            values = column.flatten().to_numpy(zero_copy_only=False).astype(number) + number(0)  # negative zeros become zeros
            ends = np.cumsum(lengths)
            count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[ends], prepend=0)  # noqa: B023, E731
            good = (count(np.isfinite(values)) == lengths) & (count(values != 0) > 0) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], ends]).astype(np.int32) * np.dtype(number).itemsize
            raw = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pc.if_else(pa.array(good), raw, pa.scalar(None, pa.binary()))], ["id", "label", "raw"])

    return map_batches(vectors.select(F.col(id_col).cast("long").alias("id"), vector_col, label_col), run, f"id bigint, label {kind}, raw binary")


def _axes(classes: DataFrame, number: type) -> dict[int, np.ndarray]:
    """By vector length: leading principal axes, from sums of products over all unit vectors (length squared rows at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch.column(0), number):
                x = np.column_stack([x, np.ones(len(x))])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + x.T @ x
        for n, s in sums.items():
            i, j = np.triu_indices(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n - 1, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["n", "i", "j", "s"])

    rows = map_batches(classes.select("raw"), run, "n int, i int, j int, s double").groupBy("n", "i", "j").agg(F.sum("s").alias("s")).toArrow().to_pandas()
    axes = {}
    for n, part in rows.groupby("n"):
        s = np.zeros((n + 1, n + 1))
        s[part["i"], part["j"]] = s[part["j"], part["i"]] = part["s"]
        mean = s[:n, n] / s[n, n]
        _, vectors = np.linalg.eigh(s[:n, :n] / s[n, n] - np.outer(mean, mean))
        axes[int(n)] = vectors[:, ::-1][:, :AXES]
    return axes


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, number: type) -> DataFrame:
    """Blocks of the sorted sequence: (block, label, dim, low, high, reps, sizes, places, raw)."""
    kind = classes.schema["label"].dataType.simpleString()
    sent = classes.sparkSession.sparkContext.broadcast(axes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, dims = np.zeros((len(batch), AXES)), np.zeros(len(batch), np.int32)
            for at, x in _by_length(batch.column(3), number):
                found = x @ sent.value[x.shape[1]]
                p[at, : found.shape[1]], dims[at] = found, x.shape[1]
            cells = np.floor(p / eps).astype(np.int32)
            places = pa.Array.from_buffers(pa.binary(AXES * 8), len(batch), [None, pa.py_buffer(p)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), places, pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), AXES).cast(pa.list_(pa.int32()))], ["label", "rep", "size", "raw", "dim", "place", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, label_type = [], None

        def packed() -> pa.RecordBatch:
            labels, reps, sizes, raw, dims, places = zip(*held, strict=True)
            p = np.frombuffer(b"".join(places), np.float64).reshape(-1, AXES)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([labels[0]], label_type), pa.array([dims[0]], pa.int32()), pa.array([p.min(0)], pa.list_(pa.float64())), pa.array([p.max(0)], pa.list_(pa.float64())), pa.array([reps], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([p.tobytes()], pa.binary()), pa.array([b"".join(raw)], pa.binary())], names)

        for batch in batches:
            label_type = batch.schema.field("label").type
            for row in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                if held and ((row[0], row[4]) != (held[0][0], held[0][4]) or len(held) >= max(LEAF, BLOCK_BYTES // (8 * row[4]))):
                    yield packed()
                    block, held = block + 1, []
                held.append(row)
        if held:
            yield packed()

    names = ["block", "label", "dim", "low", "high", "reps", "sizes", "places", "raw"]
    placed = map_batches(classes.select("label", "rep", "size", "raw"), project, f"label {kind}, rep bigint, size bigint, raw binary, dim int, place binary, cells array<int>")
    # The grid order; ids break ties, so copies of a cell can be dealt to several tasks.
    order = ["label", "dim", "cells", "rep"]
    return map_batches(placed.repartitionByRange(*order).sortWithinPartitions(*order), pack, f"block bigint, label {kind}, dim int, low array<double>, high array<double>, reps array<bigint>, sizes array<bigint>, places binary, raw binary")


def _intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cosine: float, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors with a cosine of ``cosine`` or more; for one block with itself, each pair once."""
    open_ = [(0, len(x), 0, len(y))]
    while open_:
        a, b, c, d = open_.pop()
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if gap @ gap > eps * eps * (1 + 1e-9):
            continue
        if max(b - a, d - c) <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine - 1e-9)
            i, j = i + a, j + c
            exact = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            if same:
                exact &= i < j
            yield i[exact], j[exact]
            continue
        m, n = (a + b + 1) // 2, (c + d + 1) // 2
        for p, q in ((a, m), (m, b)):
            for r, s in ((c, n), (n, d)):
                if p < q and r < s and not (same and s <= p):
                    open_.append((p, q, r, s))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Positions of links that span the components of nodes 0 to n - 1."""
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return kept


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id (smallest id reachable) and kept (id is component_id)."""
    eps, number = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9), _number(vectors, vector_col)
    rows = materialize(_prepared(vectors, id_col, vector_col, label_col), "vectors")
    # Equal vectors of a label are a class, which goes by a number of its own.
    found = rows.where(F.col("raw").isNotNull()).groupBy("label", "raw").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    classes = materialize(found.withColumn("rep", F.monotonically_increasing_id()), "classes")
    blocks = materialize(_blocks(classes, _axes(classes, number), eps, number), "blocks")
    # Blocks meet by the first cell that both span, and only if their boxes come within eps in all leading axes.
    box = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "label", "dim", "low", "high")))
    cell = lambda c, at: F.floor(F.col(c)[0] / eps).cast("int") + at
    spans = lambda s, more: F.explode(F.sequence(cell(f"low_{s}", -more), cell(f"high_{s}", more)))
    left, right = box("a").withColumn("cell", spans("a", 1)), box("b").withColumn("cell", spans("b", 0))
    gap = F.aggregate(F.zip_with(F.arrays_zip("low_a", "high_a"), F.arrays_zip("low_b", "high_b"), lambda a, b: F.greatest(F.lit(0.0), a["low_a"] - b["high_b"], b["low_b"] - a["high_a"])), F.lit(0.0), lambda s, g: s + g * g)
    meet = left.join(right, (F.col("label_a") == F.col("label_b")) & (F.col("dim_a") == F.col("dim_b")) & (left["cell"] == right["cell"]) & (F.col("block_a") <= F.col("block_b"))).where(gap <= eps * eps * (1 + 1e-9))
    meet = materialize(meet.select("block_a", "block_b").distinct(), "meetings")
    full = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "reps", "sizes", "places", "raw")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (na, nb), same = (len(r["reps_a"]), len(r["reps_b"])), r["block_a"] == r["block_b"]
                x, y = (_units(_cut(r[c], n), number) for c, n in (("raw_a", na), ("raw_b", nb)))
                px, py = (np.frombuffer(r[c], np.float64).reshape(-1, AXES) for c in ("places_a", "places_b"))
                shift = 0 if same else na
                ids = np.array(r["reps_a"] + ([] if same else r["reps_b"]), np.int64)
                sizes = np.array(r["sizes_a"] + ([] if same else r["sizes_b"]), np.int64)
                links = np.zeros(len(ids), np.int64)
                tree_i, tree_j = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for i, j in _intervals(x, y, px, py, cosine, eps, same):
                    j = j + shift
                    links += np.bincount(i, sizes[j], len(ids)).astype(np.int64) + np.bincount(j, sizes[i], len(ids)).astype(np.int64)
                    i, j = np.concatenate([tree_i, i]), np.concatenate([tree_j, j])
                    kept = _forest(i, j, len(ids))
                    tree_i, tree_j = i[kept], j[kept]
                some = np.flatnonzero(links)
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[tree_i]])), pa.concat_arrays([none, pa.array(ids[tree_j])]), pa.array(np.concatenate([links[some], np.zeros(len(tree_i), np.int64)]))], ["a", "b", "links"])

    pairs = meet.join(full("a"), "block_a").join(full("b"), "block_b")
    found = materialize(map_batches(pairs, run, "a bigint, b bigint, links bigint"), "links")
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("id", "rep")
    joined = classes.select("rep", "least", "size").join(links, "rep", "left").join(components, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ends = joined.join(least, "component").select("rep", (F.coalesce("links", F.lit(0).cast("long")) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = rows.where(F.col("raw").isNotNull()).join(classes.select("label", "raw", "rep"), ["label", "raw"]).join(ends, "rep").select("id", "n_links", "component_id")
    alone = rows.where(F.col("raw").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
