"""Whole jobs: from parts to blended canvases."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import canvas, layout, matching, orient, placement
from ..sources import states
from ..sources.storage import exists


def orient_images(parts: DataFrame, images: DataFrame, maximum: float = 1.0, steps: int = 40, spectral: bool = False, levels: int = 0) -> DataFrame:
    """Angles of all parts: given ones stay, the others are found by row profiles, with ``levels`` from few angles to fine ones, or with ``spectral`` from power spectra (H6)."""
    unknown = images.join(parts.where("angle_deg is null").select("collage_id", "image_id"), ["collage_id", "image_id"], "left_semi")
    if spectral:
        angles = orient.spectral_angles(unknown, maximum)
    else:
        angles = orient.find_angles_by_levels(unknown, maximum, steps, levels) if levels else orient.find_angles(unknown, maximum, steps)
    found = angles.select("collage_id", "image_id", F.col("angle_deg").alias("found"))
    return parts.join(found, ["collage_id", "image_id"], "left").withColumn("angle_deg", F.coalesce("angle_deg", "found", F.lit(0.0))).drop("found")


def prepare_planes(parts: DataFrame, images: DataFrame, n: int = 20) -> DataFrame:
    """Planes without their low frequencies, turned by their angles, with left and top."""
    high = orient.smoothed(images, n, high=True)
    return orient.turned(high.join(parts.select("collage_id", "image_id", "angle_deg"), ["collage_id", "image_id"]))


def _moved_by_corners(found: DataFrame, images: DataFrame, change) -> DataFrame:
    """Pairs with ``left`` and ``top`` of both planes at hand for ``change``; 0 for planes that were not turned."""
    place = images.select("collage_id", "image_id", *(F.col(c) if c in images.columns else F.lit(0.0).alias(c) for c in ("left", "top")))
    side = lambda s: place.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("left").alias(f"left_{s}"), F.col("top").alias(f"top_{s}"))
    return change(found.join(side("a"), ["collage_id", "image_a"]).join(side("b"), ["collage_id", "image_b"]))


def match_pairs(parts: DataFrame, images: DataFrame, relations: DataFrame | None = None, pad: int = 1024, portion: float = 0.25, maximum: float = 0.2, only: Column | None = None) -> DataFrame:
    """(collage_id, image_a, image_b, rel, dx, dy) of all candidate pairs (or ``only`` some), ``-`` for those that don't overlap.

    Planes are fetched only for pairs that ``relations`` (image_a, image_b, rel, dx, dy, and collage_id where image ids
    aren't unique) don't decide.
    """
    pairs = placement.candidate_pairs(parts.withColumn("open", placement.is_open("x", "y")))
    pairs = pairs if only is None else pairs.where(only)
    if relations is None:
        known = pairs.withColumn("rel", F.lit(None).cast("string")).withColumn("dx", F.lit(None).cast("double")).withColumn("dy", F.lit(None).cast("double"))
    else:
        known = placement.attach_known(pairs, relations)
    decided = F.coalesce((F.col("rel") == "-") | ((F.col("rel") == "X") & F.col("dx").isNotNull()), F.lit(False))
    done = known.where(decided).select(*matching.PAIR, "rel", *(F.when(F.col("rel") == "X", F.col(c)).alias(c) for c in ("dx", "dy")))
    rest = known.where(~decided).select(*matching.PAIR, "rel")
    found = matching.match(rest, images, pad, portion, maximum)
    # A displacement of turned planes becomes absolute by the corners of their boxes.
    absolute = _moved_by_corners(found, images, lambda p: p.select(*matching.PAIR, "overlaps", (F.col("dx") + F.col("left_a") - F.col("left_b")).alias("dx"), (F.col("dy") + F.col("top_a") - F.col("top_b")).alias("dy")))
    all_ = rest.join(absolute, matching.PAIR, "left")
    good = F.col("dx").isNotNull() & (F.coalesce(F.col("rel") == "X", F.lit(False)) | F.coalesce("overlaps", F.lit(False)))
    return done.unionByName(all_.select(*matching.PAIR, F.when(good, F.lit("X")).otherwise(F.lit("-")).alias("rel"), *(F.when(good, F.col(c)).alias(c) for c in ("dx", "dy"))))


def match_pairs_rotated(parts: DataFrame, images: DataFrame, relations: DataFrame | None = None, pad: int = 1024, portion: float = 0.25, maximum: float = 0.2, n: int = 5, side: int = 64) -> DataFrame:
    """(collage_id, image_a, image_b, rel, pts) of all candidate pairs, where angle corrections count as open; points are in the frames of the turned planes.

    ``relations``: (image_a, image_b, rel, pts), as read from a state; decided pairs are not matched again.
    """
    pairs = placement.candidate_pairs(parts.withColumn("open", placement.is_open("dangle_deg", "x", "y")))
    if relations is None:
        known = pairs.withColumn("rel", F.lit(None).cast("string")).withColumn("pts", F.array().cast(matching.POINTS))
    else:
        known = placement.attach_known(pairs, relations)
    decided = F.coalesce((F.col("rel") == "-") | ((F.col("rel") == "X") & (F.size("pts") > 0)), F.lit(False))
    done = known.where(decided).select(*matching.PAIR, "rel", F.when(F.col("rel") == "X", F.col("pts")).otherwise(F.array().cast(matching.POINTS)).alias("pts"))
    found = matching.match_stamps(known.where(~decided).select(*matching.PAIR, "rel"), images, pad, portion, maximum, n, side)
    shifted = F.transform("pts", lambda p: F.struct((p["xa"] + F.col("left_a")).alias("xa"), (p["ya"] + F.col("top_a")).alias("ya"), (p["xb"] + F.col("left_b")).alias("xb"), (p["yb"] + F.col("top_b")).alias("yb")))
    absolute = _moved_by_corners(found, images, lambda p: p.select(*matching.PAIR, F.when(F.size("pts") > 0, F.lit("X")).otherwise(F.lit("-")).alias("rel"), shifted.alias("pts")))
    return done.unionByName(absolute)


def place_parts_rotated(parts: DataFrame, matched: DataFrame) -> DataFrame:
    """Positions and rotations (c, s) of all parts from corresponding points; the first part of a collage without fixed ones stays."""
    pinned = placement.pin_first(parts, ["x", "y", "dangle_deg"])
    points = matched.select(*matching.PAIR, F.explode("pts").alias("p")).select(*matching.PAIR, "p.xa", "p.ya", "p.xb", "p.yb")
    return layout.solve_layout(pinned, points)


def match_in_steps(folder: str, parts: DataFrame, images: DataFrame, relations: DataFrame | None = None, steps: int = 16, **how) -> DataFrame:
    """``match_pairs`` in ``steps`` equal shares of the pairs, each written to ``folder`` when it is done.

    A job that is broken off and run again on the same folder, parts and number
    of steps takes the shares that are complete as they are and goes on with the rest.
    """
    spark = parts.sparkSession
    share = F.pmod(F.xxhash64(*matching.PAIR), F.lit(steps))
    done = []
    for k in range(steps):
        path = f"{folder.rstrip('/')}/step-{k}-of-{steps}"
        if not exists(spark, f"{path}/_SUCCESS"):
            match_pairs(parts, images, relations, only=share == k, **how).write.mode("overwrite").parquet(path)
        done.append(path)
    return spark.read.parquet(*done)


def write_state(folder: str, parts: DataFrame, matched: DataFrame) -> None:
    """SNK2-SNK4: positions (path, angle_deg, x, y) and relations by path, displacements or points, in a folder; and their collage, where they tell it."""
    states.write_positions(parts, f"{folder}/position")
    (states.write_correspondences if "pts" in matched.columns else states.write_relations)(matched, f"{folder}/relation")


def resume(spark: SparkSession, folder: str, rotated: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC2-SRC4: the tables that ``write_state`` wrote, relations both ways.

    A pair that is listed twice, in either direction, is an error (A16). Images
    that relations name and the placement table lacks, and columns that nothing
    reads, are warned of (J4, U4).
    """
    parts = states.read_parts(spark, f"{folder}/position")
    relations = states.read_correspondences(spark, f"{folder}/relation") if rotated else states.read_relations(spark, f"{folder}/relation")
    if rotated:
        relations = placement.swapped_points(relations)
    of = [c for c in ["collage_id"] if c in relations.columns]
    twice = relations.groupBy(*of, "image_a", "image_b").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"the pair {twice['image_a']}, {twice['image_b']} is listed {twice['n']} times")
    lacking = placement.unmatched_images(relations, parts.select(*(c for c in of if c in parts.columns), F.col("path").alias("image_id")))
    if not lacking.isEmpty():
        warnings.warn("relations name images that the placement table lacks", stacklevel=2)
    return parts, relations


def place_parts(parts: DataFrame, matched: DataFrame) -> DataFrame:
    """Positions of all parts from displacements; in each collage without a fixed part the first is at the origin."""
    pinned = placement.pin_first(parts, ["x", "y"])
    return layout.solve_positions(pinned, matched.where("dx is not null"))


def geometry_of(positions: DataFrame, images: DataFrame, angles: DataFrame | None = None) -> DataFrame:
    """Geometry of placed parts, moved to a canvas at the origin: the first angle times a fitted rotation (c, s), if there is one."""
    dims = images.select("collage_id", "image_id", F.col("width").alias("w"), F.col("height").alias("h"))
    rows = positions.join(dims, ["collage_id", "image_id"])
    angle = F.lit(0.0)
    if angles is not None:
        rows, angle = rows.join(angles.select("collage_id", "image_id", "angle_deg"), ["collage_id", "image_id"]), F.col("angle_deg")
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    if "c" in positions.columns:
        c, s = G.multiply((c, s), (F.col("c"), F.col("s")))
    placed = rows.select("collage_id", "image_id", c.alias("c"), s.alias("s"), F.col("x").alias("mx"), F.col("y").alias("my"), "w", "h")
    return canvas.canvas(placed)


def blend_average(geometry: DataFrame, images: DataFrame, channels: Sequence[str] = ("v",)) -> DataFrame:
    return canvas.average_pixels(canvas.average_tiles(geometry, images, channels), channels)


def blend_weighted(geometry: DataFrame, images: DataFrame, gamma: float = 2.0, channels: Sequence[str] = ("v",)) -> DataFrame:
    return canvas.blend_by_distance(geometry, images, gamma, channels)


def blend_shaped(geometry: DataFrame, images: DataFrame, n: int = 200, hard: bool = False, channels: Sequence[str] = ("v",)) -> DataFrame:
    """Blend along seams of small difference: masks are peeled, then the last owner counts, or masks are smoothed to weights."""
    tiles = canvas.shaped_tiles(geometry, images, n, hard, channels)
    return canvas.owner_pixels(tiles, channels) if hard else canvas.weighted_pixels(tiles, channels)


def collage(parts: DataFrame, images: DataFrame, pad: int = 1024, portion: float = 0.25, maximum: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Positions of all parts and the averaged canvas, of planes that are upright and prepared already."""
    matched = match_pairs(parts, images, None, pad, portion, maximum)
    positions = place_parts(parts, matched)
    return positions, blend_average(geometry_of(positions, images), images)


def process(parts: DataFrame, images: DataFrame, pad: int = 1024, portion: float = 0.25, maximum: float = 0.2, smooth: int = 20, gamma: float = 2.0, rotated: bool = False, channels: Sequence[str] = ("v",), n: int = 5, side: int = 64, keep=lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The automatic job from scans to the weighted canvas: oriented parts, positions and canvas.

    ``images``: planes of the scans as they are. With ``rotated`` rotations are
    corrected from corresponding points, as far as ``dangle_deg`` leaves them open. ``keep`` may write a table and read it
    again, so that a stage that several others need runs once.
    """
    corrected = parts.withColumn("dangle_deg", placement.angle_correction("dangle_deg" in parts.columns))
    oriented = keep(orient_images(corrected, images))
    planes = keep(prepare_planes(oriented, images, smooth))
    if rotated:
        positions = place_parts_rotated(oriented, keep(match_pairs_rotated(oriented, planes, None, pad, portion, maximum, n, side)))
    else:
        positions = place_parts(oriented, keep(match_pairs(oriented, planes, None, pad, portion, maximum)))
    positions = keep(positions)
    return oriented, positions, blend_weighted(keep(geometry_of(positions, images, oriented)), images, gamma, channels)
