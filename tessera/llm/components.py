"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

#: Edges that a task of a star step takes.
EDGES = 50_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star step on edges (a, b) with a > b, in ``parts`` tasks: links neighbours to the smallest one.

    The minimum per node is combined before the shuffle and joined back, so no
    list of neighbours is ever gathered; a hot hub is split by the skew join.
    """
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").coalesce(parts).distinct().coalesce(parts)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of long ids, in either direction, to (id, component), the smallest id reachable.

    Only ids with an edge to another id appear. No edges give no rows. The
    number of rounds follows the logarithm of the longest path.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(now)
    while before[0]:
        parts = before[0] // EDGES + 1
        new = materialize(_star(_star(now, True, parts), False, parts), "edges")
        discard(now)
        now, after = new, _signature(new)
        if after == before:
            break
        before = after
    # Every remaining edge leads from a node to the smallest id of its component.
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
