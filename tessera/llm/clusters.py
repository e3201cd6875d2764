"""Centroid clustering in whole numbers by exponion search.

Vectors are packed in blocks that stay where they are; a block carries for each
vector its centroid, an upper bound of the distance to it and a lower bound of
the distance to any other. When centroids move, bounds move with them, and a
vector whose bounds still part it from all others is not compared at all. For
the rest the distance to its own centroid is found exactly, and if that does
not settle it, only centroids inside a ball around its own one are scanned: a
prefix of the list of centroids sorted by distance from that one. The ball's
radius is twice the vector's distance plus that to the next centroid, so it
holds the nearest and the second nearest; the radius is inclusive and bounds
have to part strictly, with room for rounding, so that ties are always seen.
Distances that decide are squared and whole, ties go to the smaller number.

A round reads and writes the blocks once. Each block carries the sums of its
vectors by centroid, so the new centroids come from these columns alone, a few
numbers for each task; the driver holds centroids only.

Kept are vectors of ``dims`` components that are neither null nor non-finite;
other rows get no row. Every kept row is a vector, repeated ids and equal
vectors included; rows without id stay and can begin as a centroid only when
there are too few others. Equal ids begin in the order of their components.
With fewer kept vectors than ``k`` there are as many centroids as vectors; an
empty table gives no rows. Components are whole numbers up to 2**48, larger
ones count as that; distances and their sums that exceed 64 bits count as the
largest such number. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize
from .textops import map_batches

#: Components up to here have squared distances of 64 bits; others are computed with numbers of any size.
SMALL = 1 << 27
LARGEST = 1 << 48
LONG = (1 << 63) - 1
_FIELDS = {"ids": pa.list_(pa.int64()), "wide": pa.int32(), "raw": pa.binary(), "cluster": pa.binary(), "upper": pa.binary(), "lower": pa.binary(), "distance": pa.list_(pa.int64()), "numbers": pa.binary(), "counts": pa.binary(), "sums": pa.binary(), "inertia": pa.list_(pa.string())}
_SCHEMA = "ids array<bigint>, wide int, raw binary, cluster binary, upper binary, lower binary, distance array<bigint>, numbers binary, counts binary, sums binary, inertia array<string>"


def whole(vectors: DataFrame, scale: int, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """Blocks (ids, wide, raw) of kept vectors as whole numbers floor(scale * x), in the narrowest type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            fit = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims)
            x = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), dims)
            good = np.isfinite(x).all(axis=1)
            if not good.any():
                continue
            v = np.floor(np.clip(scale * x[good], -LARGEST, LARGEST)).astype(np.int64)
            most = int(np.abs(v).max())
            wide = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).take(pa.array(fit[good])).to_pylist()], pa.list_(pa.int64())), pa.array([wide], pa.int32()), pa.array([v.astype(f"i{wide}").tobytes()])], ["ids", "wide", "raw"])

    return map_batches(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), run, "ids array<bigint>, wide int, raw binary")


def _unpacked(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["raw"], f"i{row['wide']}").reshape(-1, dims).astype(np.int64)


def first_centroids(blocks: DataFrame, k: int, dims: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``1:<id>``; each task offers ``k`` of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[bool, str, list[int]]] = []
        for batch in batches:
            for row in batch.to_pylist():
                keys = [(i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()) for i in row["ids"]]
                v = _unpacked(row, dims)
                border = sorted(keys)[: k][-1]
                best = sorted(best + [(*key, v[at].tolist()) for at, key in enumerate(keys) if key <= border])[:k]
        if best:
            none, key, v = zip(*best, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(none), pa.array(key), pa.array(v, pa.list_(pa.int64()))], ["none", "key", "v"])

    rows = map_batches(blocks.select("ids", "wide", "raw"), run, "none boolean, key string, v array<bigint>").orderBy("none", "key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dims)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to ``c`` (one row, or one each), in the type of the rows."""
    d = x - c
    return (d * d).sum(axis=-1)


def _exact(*rows: np.ndarray) -> list[np.ndarray]:
    """The same whole numbers in a type whose squared distances are exact."""
    big = max((int(np.abs(r).max()) for r in rows if r.size), default=0) >= SMALL
    return [r.astype(object if big else np.int64) for r in rows]


class Centroids:
    """Centroids with what the search needs: for each one the others sorted by distance, and how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None) -> None:
        self.at, was = _exact(now, now if before is None else before)
        between = np.sqrt(np.array([_squared(self.at, c) for c in self.at], float))
        np.fill_diagonal(between, -1.0)  # first in its own list
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.moved = np.sqrt(_squared(self.at, was).astype(float))
        # The most that any other centroid has moved.
        self.others = np.array([np.delete(self.moved, j).max(initial=0.0) for j in range(len(now))])


def _above(x: np.ndarray) -> np.ndarray:
    """A little more, so that rounding never hides a tie."""
    return x * (1 + 1e-9) + 1e-6


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds, and how many distances were computed, after centroids moved; bounds are those before the move."""
    upper, lower = upper + c.moved[cluster], np.maximum(lower - c.others[cluster], 0.0)
    if len(c.at) < 2:
        return cluster, upper, lower, 0
    half = c.sorted[cluster, 1] / 2
    todo = np.flatnonzero(np.maximum(lower, half) <= _above(upper))
    cluster, computed = cluster.copy(), len(todo)
    exact = _squared(x[todo], c.at[cluster[todo]])
    upper[todo] = np.sqrt(exact.astype(float))
    still = np.maximum(lower[todo], half[todo]) <= _above(upper[todo])
    todo, exact = todo[still], exact[still]
    held = cluster[todo]
    for a in np.unique(held):
        mine = np.flatnonzero(held == a)
        rows, near = todo[mine], exact[mine]
        reach = np.searchsorted(c.sorted[a], _above(2 * upper[rows] + c.sorted[a, 1]), "right")
        by = np.argsort(-reach, kind="stable")
        rows, near, reach = rows[by], near[by], reach[by]
        owner, second = np.full(len(rows), a), np.full(len(rows), np.inf)
        for rank in range(1, int(reach.max(initial=0))):
            j, n = c.order[a, rank], int(np.searchsorted(-reach, -rank, "left"))  # those that reach further than this rank
            d = _squared(x[rows[:n]], c.at[j])
            computed += n
            closer = (d < near[:n]) | ((d == near[:n]) & (j < owner[:n]))
            second[:n] = np.minimum(second[:n], np.where(closer, near[:n], d).astype(float))
            near[:n], owner[:n] = np.where(closer, d, near[:n]), np.where(closer, j, owner[:n])
        cluster[rows], upper[rows], lower[rows] = owner, np.sqrt(near.astype(float)), np.sqrt(second)
    return cluster, upper, lower, computed


def _round(blocks: DataFrame, c: Centroids, dims: int, last: bool) -> DataFrame:
    """Blocks assigned to ``c``, with the sums of their vectors by centroid; exact distances in the ``last`` round."""
    sent = blocks.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                centroids = sent.value
                vectors = _unpacked(row, dims)
                x = _exact(vectors, centroids.at)[0]
                if row.get("cluster") is None:
                    # No bounds yet: any centroid, all others possible.
                    cluster = np.zeros(len(x), np.int64)
                    upper, lower = np.sqrt(_squared(x, centroids.at[0]).astype(float)), np.zeros(len(x))
                    centroids = Centroids(centroids.at.astype(np.int64))
                else:
                    cluster, upper, lower = (np.frombuffer(row[name], kind) for name, kind in (("cluster", np.int64), ("upper", float), ("lower", float)))
                cluster, upper, lower, _ = assign(x, cluster, upper, lower, centroids)
                numbers, place, counts = np.unique(cluster, return_inverse=True, return_counts=True)
                sums = np.add.reduceat(vectors[np.argsort(place, kind="stable")], np.cumsum(counts) - counts)
                distance = inertia = None
                if last:
                    distance = [min(LONG, int(d)) for d in _squared(x, centroids.at[cluster])]
                    inertia = [str(sum(distance[i] for i in np.flatnonzero(place == p))) for p in range(len(numbers))]
                cells = {"ids": row["ids"], "wide": row["wide"], "raw": row["raw"], "cluster": cluster.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "distance": distance, "numbers": numbers.tobytes(), "counts": counts.tobytes(), "sums": sums.tobytes(), "inertia": inertia}
                if last:
                    cells |= {"raw": None, "upper": None, "lower": None}
                yield pa.RecordBatch.from_arrays([pa.array([v], _FIELDS[k]) for k, v in cells.items()], list(cells))

    return map_batches(blocks, run, _SCHEMA)


def _next(blocks: DataFrame, now: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors, from the sums of the blocks; a centroid without vectors stays."""
    k, dims = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for numbers, counts, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(of, np.int64).reshape(-1, dims).astype(object)
                for j, n, s in zip(np.frombuffer(numbers, np.int64).tolist(), np.frombuffer(counts, np.int64).tolist(), rows, strict=True):
                    have = sums.get(j, (0, 0))
                    sums[j] = have[0] + n, have[1] + s
        for j, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * (dims + 1)), pa.array(range(dims + 1), pa.int32()), pa.array([str(v) for v in [*s, n]])], ["j", "i", "s"])

    rows = map_batches(blocks.select("numbers", "counts", "sums"), run, "j bigint, i int, s string").groupBy("j", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {(r["j"], r["i"]): int(r["s"]) for r in rows}
    return np.array([[sums[j, i] // sums[j, dims] if (j, dims) in sums else now[j, i] for i in range(dims)] for j in range(k)], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept row of ``vectors``: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    blocks = materialize(whole(vectors, scale, dims, id_col, vector_col), "vectors")
    now = first_centroids(blocks, k, dims)
    if not len(now):
        return spark.createDataFrame([], f"{id_col} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    before = None
    for n in range(rounds + 1):
        done = materialize(_round(blocks, Centroids(now, before), dims, n == rounds), "clusters")
        discard(blocks)
        blocks = done
        if n < rounds:
            before, now = now, _next(blocks, now)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(np.frombuffer(row["cluster"], np.int64).astype(np.int32)), pa.array(row["distance"], pa.int64())], [id_col, "cluster", "distance"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for numbers, inertia in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for j, s in zip(np.frombuffer(numbers, np.int64).tolist(), inertia, strict=True):
                    sums[j] = sums.get(j, 0) + int(s)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([str(s) for s in sums.values()])], ["j", "s"])

    found = map_batches(blocks.select("numbers", "inertia"), totals, "j bigint, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["j"]: int(r["s"]) for r in found}
    whole_ = min(LONG, sum(inertia.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    known = spark.createDataFrame([(j, min(LONG, inertia.get(j, 0)), whole_, digest[j]) for j in range(len(now))], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row for each centroid.
    return map_batches(blocks.select("ids", "cluster", "distance"), rows, f"{id_col} bigint, cluster int, distance bigint").join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
