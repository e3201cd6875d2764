"""Placement and relation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize

#: Pairs of blocks for each partition, and ids of a row in the shuffle.
_BLOCK_PAIRS, _PACKED = 16, 512


def half_set(a: str, b: str) -> Column:
    """V1: exactly one of two cells that go together is set."""
    return F.col(a).isNull() != F.col(b).isNull()


def bad_relations(rows: DataFrame) -> DataFrame:
    """V1-V3: rows that a relation table may not have, with ``fault``: an image missing, an unknown relation, or half a displacement."""
    fault = F.when(F.col("image_a").isNull() | F.col("image_b").isNull(), F.lit("image missing"))
    fault = fault.when(~F.coalesce(F.col("rel").isin("-", "X"), F.lit(True)), F.lit("unknown relation"))
    fault = fault.when(half_set("dx", "dy"), F.lit("half a displacement"))
    return rows.withColumn("fault", fault).where(F.col("fault").isNotNull())


def checked_relations(rows: DataFrame) -> DataFrame:
    """The rows unchanged; the job fails on the first one that ``bad_relations`` would list."""
    ok = F.col("image_a").isNotNull() & F.col("image_b").isNotNull() & F.coalesce(F.col("rel").isin("-", "X"), F.lit(True)) & ~half_set("dx", "dy")
    return rows.withColumn("_ok", F.assert_true(ok, "a relation row is invalid")).where(F.col("_ok").isNull()).drop("_ok")


def is_open(*columns: str) -> Column:
    """P10: whether any of a part's parameters is still to be found."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def angle_correction(has_column: bool) -> Column:
    """The angle correction of a part; without the column it is 0 where an angle is given, with it an empty cell stays open."""
    return F.col("dangle_deg") if has_column else F.when(F.col("angle_deg").isNotNull(), F.lit(0.0))


def candidate_pairs(parts: DataFrame, block: int = 1024) -> DataFrame:
    """Pairs a < b of one collage of which at least one is open.

    Parts of a collage are dealt into blocks by a hash of their ids, and a task
    pairs single blocks with each other, so a large collage is spread out. A
    pair is made once, not in both orders. Blocks have about ``block`` parts at
    least and are as few as keep all partitions busy: each part goes to the
    partitions once for every block of its collage, so what is shuffled grows
    with the parts and not with their square. Ids travel as arrays.
    """
    partitions = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = parts.where("image_id is not null").select("collage_id", "image_id", F.coalesce("open", F.lit(False)).alias("open"))
    n = listed.groupBy("collage_id").agg(F.count("*").alias("_parts"))
    pairs = F.col("_parts").cast("double") ** 2
    # A collage has a share of the pairs of blocks, as it has of the pairs of parts.
    wanted = F.sqrt(2 * _BLOCK_PAIRS * partitions * pairs / F.col("_all"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum(pairs).alias("_all")))).withColumn("_n", F.ceil(F.least(F.col("_parts") / block, wanted)).cast("int"))  # one row
    n = n.select("collage_id", "_n", F.ceil(F.col("_parts") / (F.col("_n") * _PACKED)).cast("int").alias("_packs"))
    # Written, so that Spark sees that collages are fewer than parts and does not broadcast the parts.
    dealt = listed.join(materialize(n, "collages"), "collage_id").withColumn("_own", F.expr("pmod(hash(image_id), _n)")).withColumn("_pack", F.expr("pmod(xxhash64(image_id), _packs)"))
    packed = dealt.groupBy("collage_id", "_n", "_own", "_pack", "open").agg(F.sort_array(F.collect_list("image_id")).alias("_ids"))
    # Block i meets those from i on as the first one of a pair of blocks, those up to i as the second.
    first = packed.select("collage_id", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_n") - 1)).alias("_j"), F.col("open").alias("_open_a"), F.col("_ids").alias("_ids_a"))
    second = packed.select("collage_id", F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"), F.col("open").alias("_open_b"), F.col("_ids").alias("_ids_b"))
    # A merge join keeps one block at a time. As a broadcast one it would run in the few tasks that read the parts, and without a number of partitions in a few that are small in bytes.
    key = ["collage_id", "_i", "_j"]
    both = first.repartition(partitions, *key).hint("merge").join(second.repartition(partitions, *key), key).where("_open_a or _open_b")
    # In compiled loops Spark keeps all that a row gives. A filter of arrays is not compiled, so no more than the ids of one array are kept.
    last = F.element_at("_ids_b", -1)
    some = both.select(*key, "_ids_b", F.explode(F.filter("_ids_a", lambda a: (F.col("_i") < F.col("_j")) | (a < last))).alias("_a"))
    made = some.select(*key, "_a", F.explode("_ids_b").alias("_b")).where("_i < _j or _a < _b")
    return made.select("collage_id", F.least("_a", "_b").alias("image_a"), F.greatest("_a", "_b").alias("image_b"))


def _pair_key(relations: DataFrame) -> list[str]:
    """What names a pair: its images, and its collage where relations tell it (image ids may begin anew in each collage)."""
    return [*(c for c in ["collage_id"] if c in relations.columns), "image_a", "image_b"]


def mirrored(relations: DataFrame) -> DataFrame:
    """Relations with the reverse of each, its displacement negated."""
    key = _pair_key(relations)
    back = relations.select(*key[:-2], F.col("image_b").alias("image_a"), F.col("image_a").alias("image_b"), "rel", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))
    return relations.select(*key, "rel", "dx", "dy").unionByName(back)


def swapped_points(relations: DataFrame) -> DataFrame:
    """Relations with points, with the reverse of each, its points swapped."""
    key = _pair_key(relations)
    swapped = F.transform("pts", lambda p: F.struct(p["xb"].alias("xa"), p["yb"].alias("ya"), p["xa"].alias("xb"), p["ya"].alias("yb")))
    return relations.select(*key, "rel", "pts").unionByName(relations.select(*key[:-2], F.col("image_b").alias("image_a"), F.col("image_a").alias("image_b"), "rel", swapped.alias("pts")))


def first_of_pairs(relations: DataFrame, order: str) -> DataFrame:
    """The row of each pair that is the first by ``order`` (rows without it come last).

    The lowest ``order`` of each pair is found by a group-by that needs no sort,
    and only the rows that have it are sorted.
    """
    key = _pair_key(relations)
    lowest = materialize(relations.groupBy(*key).agg(F.min(order).alias("_lowest")), "lowest")
    some = relations.join(lowest, key).where(F.col(order).eqNullSafe(F.col("_lowest")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return some.withColumn("_rank", rank).where("_rank = 1").select(*relations.columns)


def attach_known(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidate pairs with what is known of them.

    What is known is written first: Spark then sees how little it is before it
    plans the join, and pairs, which are many, stay in the tasks that make
    them. Only where it is too large for a broadcast do they move.
    """
    return pairs.join(materialize(relations, "known"), _pair_key(relations), "left")


def unmatched_images(relations: DataFrame, images: DataFrame) -> DataFrame:
    """Images that relations name and the image table lacks."""
    of = [c for c in ["collage_id"] if c in relations.columns and c in images.columns]
    named = relations.select(*of, F.explode(F.array("image_a", "image_b")).alias("image_id")).distinct()
    return named.join(images, [*of, "image_id"], "left_anti")


def duplicate_images(parts: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are listed more than once."""
    return parts.groupBy(path).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_pairs(relations: DataFrame) -> DataFrame:
    """Pairs that occur more than once after mirroring."""
    return mirrored(relations).groupBy(*_pair_key(relations)).agg(F.count("*").alias("n")).where("n > 1")


def unknown_columns(df: DataFrame, known: list[str]) -> list[str]:
    """U4: columns of a CSV that nothing reads."""
    return [c for c in df.columns if c not in known]


def image_list(listed: DataFrame, given: DataFrame) -> DataFrame:
    """Images of the CSV, then those given by name, with a rank of their source."""
    return listed.withColumn("source_rank", F.lit(0)).unionByName(given.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def fill_down(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Detail rows get the images of the header row above them; within ``by`` (a file), by ``order``. ``orphan`` marks details without a header."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("header", F.col("image_a").isNotNull())
    out = out.withColumn("image_a", F.last("image_a", ignorenulls=True).over(w)).withColumn("image_b", F.last("image_b", ignorenulls=True).over(w))
    return out.withColumn("orphan", F.col("image_a").isNull())


def header_and_details(relations: DataFrame) -> DataFrame:
    """SNK4: a header row for each pair, then a row for each point (``pts``: array of xa, ya, xb, yb), numbered by ``pos``; other columns stay."""
    empty = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("xa", "ya", "xb", "yb")))
    more = [c for c in relations.columns if c not in ("image_a", "image_b", "rel", "pts")]
    flat = relations.select(*more, "image_a", "image_b", "rel", F.posexplode(F.concat(F.array(empty), "pts")).alias("pos", "p"))
    return flat.select(*more, "image_a", "image_b", "rel", "pos", "p.xa", "p.ya", "p.xb", "p.yb")


def relation_mark(d: Column) -> Column:
    """SNK3: X where there is a displacement, - where there is none."""
    return F.when(d.isNull(), F.lit("-")).otherwise(F.lit("X"))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with ``position``, their index within ``by`` in ascending ``order``.

    Ranges of rows are numbered by themselves, and each begins where those
    before it end, so a large group is no task of its own.
    """
    held = materialize(rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.groupBy(by, "_range").agg(F.count("*").alias("_n")).select(by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_range", by).orderBy(order)) - 1
    return held.withColumn("_at", within).join(begins, [by, "_range"]).select(*rows.columns, (F.col("_begin") + F.col("_at")).cast("int").alias("position"))


def pin_first(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Where no part of a collage has a parameter fixed, the first part's becomes 0. Adds ``position``, the index within the collage."""
    some = parts.groupBy("collage_id").agg(*(F.max(F.col(c).isNotNull()).alias(f"_{c}") for c in columns))
    pinned = {c: F.when(~F.col(f"_{c}") & (F.col("position") == 0), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in columns}
    return numbered(parts, "collage_id", "image_id").join(some, "collage_id").select(*(pinned.get(c, F.col(c)) for c in parts.columns), "position")
