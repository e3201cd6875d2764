"""Inputs derived from the given tables: mosaics with a known truth, placements, relations, geometries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP, SIDE, PER_COLLAGE = 40, 64, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mosaic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of parts cut from ``embeddings``: part k is lines 40 k to 40 k + 63, four parts a collage; ``line`` has the values."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    last = rows.agg(F.max("vec_id").alias("last"))
    k = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("vec_id") - SIDE + STEP) / STEP)), F.floor(F.col("vec_id") / STEP)))
    cut = rows.select("vec_id", F.col("embedding").alias("line"), k.alias("k")).join(F.broadcast(last), F.col("k") * STEP + SIDE - 1 <= F.col("last"))  # one row
    return cut.select(F.floor(F.col("k") / PER_COLLAGE).alias("collage_id"), F.col("k").cast("int").alias("image_id"), (F.col("vec_id") - F.col("k") * STEP).cast("int").alias("y"), "line")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the parts of ``mosaic_lines``."""
    lines = mosaic_lines(spark, sf_dir).select("collage_id", "image_id", "y", F.posexplode("line").alias("x", "v"))
    return lines.select("collage_id", "image_id", "y", "x", F.col("v").cast("double").alias("v"))


def mosaic_planes(lines: DataFrame) -> DataFrame:
    """The planes of parts, put together of whole lines."""
    ordered = F.array_sort(F.collect_list(F.struct("y", F.col("line").cast("array<double>").alias("line"))))
    return lines.groupBy("collage_id", "image_id").agg((F.max("y") + 1).cast("int").alias("height"), F.max(F.size("line")).alias("width"), F.flatten(F.transform(ordered, lambda p: p["line"])).alias("data"))


def mosaic_parts(lines: DataFrame) -> DataFrame:
    """The parts of a mosaic, from its lines or pixels, with nothing known of them."""
    rows = lines.select("collage_id", "image_id").distinct()
    return rows.withColumn("open", F.lit(True)).withColumn("x", F.lit(None).cast("double")).withColumn("y", F.lit(None).cast("double")).withColumn("angle_deg", F.lit(0.0))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placement table from ``customer``, with some angles and positions open."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_nationkey").cast("long").alias("collage_id"),
        F.col("c_custkey").cast("int").alias("image_id"),
        F.concat(F.lit("scans/"), "c_name", F.lit(".jpeg")).alias("path"),
        F.when(F.col("c_custkey") % 3 != 0, F.round(F.col("c_acctbal").cast("double") / 10000, 4)).alias("angle_deg"),
        F.when(F.col("c_custkey") % 5 == 0, F.round(F.col("c_acctbal").cast("double"), 2)).alias("x"),
        F.when(F.col("c_custkey") % 7 == 0, F.round(-F.col("c_acctbal").cast("double"), 2)).alias("y"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A displacement table from ``orders``, with repeated pairs."""
    o = table(spark, sf_dir, "orders")
    rel = F.when(F.col("o_orderstatus") == "P", F.lit("X")).when(F.col("o_orderstatus") == "F", F.lit("-"))
    known = rel == "X"
    return o.select(
        F.col("o_orderkey").cast("long").alias("row_id"),
        (F.col("o_custkey") % 50).cast("int").alias("image_a"),
        (F.floor(F.col("o_custkey") / 50) % 50).cast("int").alias("image_b"),
        rel.alias("rel"),
        F.when(known, F.round(F.col("o_totalprice").cast("double") / 1000, 5)).alias("dx"),
        F.when(known, F.floor(F.col("o_totalprice").cast("double") / 100).cast("double")).alias("dy"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and detail rows from ``conversations``: turn 0 names the pair, later turns are points."""
    c = table(spark, sf_dir, "conversations")
    head = F.col("turn") == 0
    return c.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("int").alias("turn"),
        F.when(head, F.col("conv_id").cast("long")).alias("image_a"),
        F.when(head, F.col("conv_id").cast("long") + 1).alias("image_b"),
        F.when(~head, (F.length("text") % 97).cast("double")).alias("xa"),
        F.when(~head, (F.length("text") % 89).cast("double")).alias("ya"),
    )


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic ten images wide from ``supplier``: 100 by 80 boxes every 80 by 60, turned by up to half a degree."""
    k = F.col("s_suppkey").cast("int")
    angle = F.radians(((k * 7) % 11 - 5) / 10.0)
    return table(spark, sf_dir, "supplier").select(F.lit(0).cast("long").alias("collage_id"), k.alias("image_id"), F.round(F.cos(angle), 9).alias("c"), F.round(F.sin(angle), 9).alias("s"), (k % 10 * 80).cast("double").alias("mx"), (F.floor(k / 10) * 60).cast("double").alias("my"), F.lit(100).alias("w"), F.lit(80).alias("h"))


def mosaic_geometry(lines: DataFrame) -> DataFrame:
    """Geometry of the parts of a mosaic, from its lines or pixels: each 40 lines below the one before, turned by up to half a degree."""
    rows = lines.select("collage_id", "image_id").distinct()
    angle = F.radians(((F.col("image_id") * 7) % 11 - 5) / 10.0)
    return rows.select("collage_id", "image_id", F.round(F.cos(angle), 9).alias("c"), F.round(F.sin(angle), 9).alias("s"), F.lit(8.0).alias("mx"), (F.col("image_id") % PER_COLLAGE * STEP + 8).cast("double").alias("my"), F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"))


def neighbours(geometry: DataFrame) -> DataFrame:
    """Displacements of images beside and below each other, as their places say."""
    side = lambda s: geometry.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("mx").alias(f"x{s}"), F.col("my").alias(f"y{s}"))
    # The neighbour's number follows from the image's own, so this is an equi-join.
    left = side("a").withColumn("image_b", F.explode(F.array(F.col("image_a") + 1, F.col("image_a") + 10)))
    both = left.join(side("b"), ["collage_id", "image_b"]).where("image_b = image_a + 10 or image_a % 10 < 9")
    return both.select("collage_id", "image_a", "image_b", (F.col("xb") - F.col("xa")).alias("dx"), (F.col("yb") - F.col("ya")).alias("dy"))
