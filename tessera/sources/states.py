"""State tables as CSV.

Columns are found by name, in any order; a missing column and an empty cell
both mean that the value is still to be found, except for ``DAngle``. Tables
of several collages have a column ``Collage`` besides, which parts and pairs
are told apart by.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import placement
from .storage import materialize

# Column names of the CSV files and ours.
PART_COLUMNS = {"Image": "path", "Angle": "angle_deg", "DAngle": "dangle_deg", "X": "x", "Y": "y"}
RELATION_COLUMNS = {"ImageA": "image_a", "ImageB": "image_b", "Rel": "rel", "DX": "dx", "DY": "dy"}
POINT_COLUMNS = {"ImageA": "image_a", "ImageB": "image_b", "Rel": "rel", "XA": "xa", "YA": "ya", "XB": "xb", "YB": "yb"}
COLLAGE = {"Collage": "collage_id"}
TEXT = ("path", "image_a", "image_b", "rel")


def _typed(name: str, column: F.Column) -> F.Column:
    return F.nullif(column, F.lit("")).cast("string" if name in TEXT else "long" if name == "collage_id" else "double").alias(name)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    # Every file has to have the header of the first one.
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def _with_collage(names: dict[str, str], columns: list[str]) -> dict[str, str]:
    """``names`` and that of the collage, where a table (ours or a file's) has it."""
    return names | {k: v for k, v in COLLAGE.items() if k in columns or v in columns}


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """SRC2, C3, U4: parts (path, angle_deg, dangle_deg, x, y); only ``Image`` has to be there, unknown columns are warned of and ignored."""
    raw = _csv(spark, path)
    if "Image" not in raw.columns:
        raise ValueError("a placement table needs a column Image")
    names = _with_collage(PART_COLUMNS, raw.columns)
    if unknown := placement.unknown_columns(raw, list(names)):
        warnings.warn(f"columns that nothing reads: {', '.join(unknown)}", stacklevel=2)
    rows = raw.select(*(_typed(ours, F.col(theirs) if theirs in raw.columns else F.lit(None)) for theirs, ours in names.items()))
    return rows.withColumn("dangle_deg", placement.angle_correction("DAngle" in raw.columns))


def _strict(spark: SparkSession, path: str, names: dict[str, str], *more: F.Column) -> DataFrame:
    raw = _csv(spark, path)
    if lacking := [c for c in names if c not in raw.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return raw.select(*(_typed(ours, F.col(theirs)) for theirs, ours in _with_collage(names, raw.columns).items()), *more)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """SRC3, V1-V3, J2: displacements of pairs, both ways; an invalid row fails the job."""
    return placement.mirrored(placement.checked_relations(_strict(spark, path, RELATION_COLUMNS)))


def read_correspondences(spark: SparkSession, path: str) -> DataFrame:
    """SRC4, W2, A16: (image_a, image_b, rel, pts) from header and detail rows; a pair may have one header row.

    Several files, in the order of their names, are one table: details at the
    beginning of a file belong to the last header before it. Splits of files
    are filled down by themselves; only their last headers meet.
    """
    part = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row_id")]
    rows = _strict(spark, path, POINT_COLUMNS, *part)
    key = [*(c for c in ["collage_id"] if c in rows.columns), "image_a", "image_b"]
    rows = materialize(rows.withColumn("header", F.col("image_a").isNotNull()), "points")
    head = F.when(F.col("header"), F.struct(*key))
    inside = Window.partitionBy("file", "start").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    splits = rows.groupBy("file", "start").agg(F.max_by(head, F.when(F.col("header"), F.col("row_id"))).alias("head"))
    carried = splits.select("file", "start", F.last("head", ignorenulls=True).over(before).alias("carried"))
    filled = rows.withColumn("own", F.last(head, ignorenulls=True).over(inside)).join(carried, ["file", "start"]).withColumn("of", F.coalesce("own", "carried"))
    filled = filled.withColumn("_ok", F.assert_true(F.col("of").isNotNull(), "a point comes before any pair")).where(F.col("_ok").isNull())
    point = F.when(F.col("xa").isNotNull(), F.struct("file", "start", "row_id", F.struct("xa", "ya", "xb", "yb").alias("p")))
    named = filled.select(*(F.col("of")[c].alias(c) for c in key), "header", "rel", point.alias("point"))
    grouped = named.groupBy(*key).agg(F.sum(F.col("header").cast("int")).alias("headers"), F.max("rel").alias("rel"), F.sort_array(F.collect_list("point")).alias("q"))
    grouped = grouped.withColumn("_ok", F.assert_true(F.col("headers") == 1, "a pair is listed twice")).where(F.col("_ok").isNull())
    return grouped.select(*key, "rel", F.transform("q", lambda q: q["p"]).alias("pts"))


def _write(df: DataFrame, path: str, names: dict[str, str]) -> None:
    df.select(*(F.col(ours).alias(theirs) for theirs, ours in _with_collage(names, df.columns).items())).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def _in_order(df: DataFrame, *names: str) -> DataFrame:
    """In the order of image ids, which number the inputs, where they are at hand; else by name."""
    ids = {"path": "image_id", "image_a": "id_a", "image_b": "id_b"}
    return df.orderBy(*(c for c in ["collage_id"] if c in df.columns), *(ids[n] if ids[n] in df.columns else n for n in names))


def write_angles(parts: DataFrame, path: str) -> None:
    """SNK1: Image and Angle."""
    _write(_in_order(parts, "path"), path, {k: PART_COLUMNS[k] for k in ("Image", "Angle")})


def write_positions(parts: DataFrame, path: str) -> None:
    """SNK2: Image, Angle, X, Y. With a fitted rotation (c, s) its angle is added to the first one."""
    if "c" in parts.columns:
        parts = parts.withColumn("angle_deg", F.col("angle_deg") + F.degrees(F.atan2("s", "c")))
    _write(_in_order(parts, "path"), path, {k: PART_COLUMNS[k] for k in ("Image", "Angle", "X", "Y")})


def write_relations(relations: DataFrame, path: str) -> None:
    """SNK3, T3: displacements, Rel by whether there is one, in order of pairs."""
    _write(_in_order(relations.withColumn("rel", placement.relation_mark(F.col("dx"))), "image_a", "image_b"), path, RELATION_COLUMNS)


def write_correspondences(relations: DataFrame, path: str) -> None:
    """SNK4, T3: a header row per pair, then a row per point. Ranges of pairs are files, whose names are in their order; a pair stays in one file."""
    flat = placement.header_and_details(relations)
    ids = {"image_a": "id_a", "image_b": "id_b"}
    pair = [*(c for c in ["collage_id"] if c in flat.columns), *(i if i in flat.columns else c for c, i in ids.items())]
    flat = flat.repartitionByRange(*pair).sortWithinPartitions(*pair, "pos")
    head = F.col("pos") == 0
    _write(flat.withColumns({c: F.when(head, F.col(c)) for c in ("image_a", "image_b", "rel")}), path, POINT_COLUMNS)


def relations_by_id(relations: DataFrame, parts: DataFrame) -> DataFrame:
    """Relations that name paths, by the collage and image ids of ``parts`` (collage_id, image_id, path); both images have to be of one collage."""
    of = [c for c in ["collage_id"] if c in parts.columns]
    ids = lambda s: parts.select(*of, F.col("path").alias(f"image_{s}"), F.col("image_id").alias(f"id_{s}"))
    both = relations.join(ids("a"), [*(of if "collage_id" in relations.columns else []), "image_a"]).join(ids("b"), [*of, "image_b"])
    return both.drop("image_a", "image_b").withColumnsRenamed({"id_a": "image_a", "id_b": "image_b"})


def relations_by_path(relations: DataFrame, parts: DataFrame) -> DataFrame:
    """Relations of image ids, by the paths of ``parts`` (collage_id, image_id, path); the ids stay as id_a and id_b."""
    paths = lambda s: parts.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("path").alias(f"path_{s}"))
    both = relations.join(paths("a"), ["collage_id", "image_a"]).join(paths("b"), ["collage_id", "image_b"])
    return both.withColumnsRenamed({"image_a": "id_a", "image_b": "id_b", "path_a": "image_a", "path_b": "image_b"})
