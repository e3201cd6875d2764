"""Overlapping pairs by correlation.

``pixels``: (collage_id, image_id, y, x, v). Displacement (dx, dy) of (a, b)
means that pixel (x, y) of a shows what pixel (x - dx, y - dy) of b shows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry, kernels

PAIR = ["collage_id", "image_a", "image_b"]
POINTS = "array<struct<xa: double, ya: double, xb: double, yb: double>>"


def brightness(pixels: DataFrame) -> DataFrame:
    """The brightness channel."""
    return pixels.select("collage_id", "image_id", "y", "x", F.col("luma").alias("v"))


def clip(pixels: DataFrame, left: int, top: int, w: int, h: int) -> DataFrame:
    """A rectangle of every image, with its corner as new origin."""
    inside = F.col("x").between(left, left + w - 1) & F.col("y").between(top, top + h - 1)
    return pixels.where(inside).withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def sizes(pixels: DataFrame) -> DataFrame:
    """Width and height of every image."""
    return pixels.groupBy("collage_id", "image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def shrink(pixels: DataFrame, ky: int, kx: int) -> DataFrame:
    """A4: means of blocks; incomplete blocks are dropped."""
    block = pixels.groupBy("collage_id", "image_id", F.floor(F.col("y") / ky).alias("y"), F.floor(F.col("x") / kx).alias("x"))
    return block.agg(F.count("*").alias("n"), F.avg("v").alias("v")).where(F.col("n") == ky * kx).drop("n")


def centred(pixels: DataFrame) -> DataFrame:
    """Values less the mean of their image."""
    return pixels.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("collage_id", "image_id")))


def _side(pixels: DataFrame, s: str) -> DataFrame:
    return pixels.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("y").alias(f"y{s}"), F.col("x").alias(f"x{s}"), F.col("v").alias(f"v{s}"))


def correlation_scores(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """A5: for every displacement of a pair the sum of products; for small planes (``match`` is for large ones)."""
    both = pairs.join(_side(pixels, "a"), ["collage_id", "image_a"]).join(_side(pixels, "b"), ["collage_id", "image_b"])
    return both.groupBy(*PAIR, (F.col("xa") - F.col("xb")).alias("dx"), (F.col("ya") - F.col("yb")).alias("dy")).agg(F.sum(F.col("va") * F.col("vb")).alias("score"))


def mask_scores(scores: DataFrame, dims: DataFrame, portion: float) -> DataFrame:
    """Scores become 0, and ``wide`` false, where the overlap is less than a share of the smallest side."""
    side = lambda s: dims.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("w").alias(f"w{s}"), F.col("h").alias(f"h{s}"))
    full = scores.join(side("a"), ["collage_id", "image_a"]).join(side("b"), ["collage_id", "image_b"])
    area = geometry.overlap_area(F.col("wa"), F.col("ha"), F.col("wb"), F.col("hb"), F.col("dx"), F.col("dy"))
    least = geometry.minimum_overlap(portion, F.col("wa"), F.col("ha"), F.col("wb"), F.col("hb"))
    wide = (area["width"] >= least) & (area["height"] >= least)
    return full.select(*PAIR, "dx", "dy", F.when(wide, F.col("score")).otherwise(F.lit(0.0)).alias("score"), wide.alias("wide"))


def best_displacement(scores: DataFrame) -> DataFrame:
    """The displacement with the highest score of those wide enough; on ties the last by (dy, dx)."""
    best = scores.where("wide").groupBy(*PAIR).agg(F.max(F.struct("score", "dy", "dx")).alias("m"))
    return best.select(*PAIR, "m.dx", "m.dy", "m.score")


def overlap_pixels(moves: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of a beside those of b that a displacement puts there."""
    left = moves.select(*PAIR, "dx", "dy").join(_side(pixels, "a"), ["collage_id", "image_a"])
    left = left.withColumn("xb", F.col("xa") - F.col("dx")).withColumn("yb", F.col("ya") - F.col("dy"))
    return left.join(_side(pixels, "b"), ["collage_id", "image_b", "xb", "yb"])


def overlap_difference(moves: DataFrame, pixels: DataFrame) -> DataFrame:
    """Root mean square difference within the overlap."""
    d = F.col("va") - F.col("vb")
    return overlap_pixels(moves, pixels).groupBy(*PAIR, "dx", "dy").agg(F.sqrt(F.avg(d * d)).alias("difference"), F.count("*").alias("n"))


def verdict(rel: Column, difference: Column, maximum: float) -> Column:
    """Whether a pair overlaps: what is given counts, else the difference has to be below the maximum."""
    return F.when(rel == "-", F.lit(False)).when(rel == "X", F.lit(True)).otherwise(F.coalesce(difference < maximum, F.lit(False)))


def compose_pair(moves: DataFrame, pixels: DataFrame) -> DataFrame:
    """Both images of a pair in coordinates of the first: the mean where both are, else the one that is."""
    a = moves.select(*PAIR).join(_side(pixels, "a"), ["collage_id", "image_a"]).select(*PAIR, F.col("ya").alias("y"), F.col("xa").alias("x"), "va")
    b = moves.select(*PAIR, "dx", "dy").join(_side(pixels, "b"), ["collage_id", "image_b"]).select(*PAIR, (F.col("yb") + F.col("dy")).alias("y"), (F.col("xb") + F.col("dx")).alias("x"), "vb")
    return a.join(b, [*PAIR, "y", "x"], "full").select(*PAIR, "y", "x", ((F.coalesce("va", "vb") + F.coalesce("vb", "va")) / 2).alias("v"))


def match_relational(parts: DataFrame, pixels: DataFrame, factor: int = 4, portion: float = 0.25, maximum: float = 0.02) -> DataFrame:
    """The minimum slice by joins of pixels: candidate pairs, shrunk planes, correlation, mask, best displacement (in pixels of full size) and verdict. For small planes; ``match_shrunk`` is for large ones."""
    from .placement import candidate_pairs

    small = shrink(pixels, factor, factor)
    moves = best_displacement(mask_scores(correlation_scores(candidate_pairs(parts), small), sizes(small), portion))
    found = moves.join(overlap_difference(moves, small), [*PAIR, "dx", "dy"], "left")
    overlaps = verdict(F.lit(None).cast("string"), F.col("difference"), maximum)
    return found.select(*PAIR, (F.col("dx") * factor).alias("dx"), (F.col("dy") * factor).alias("dy"), "score", "difference", overlaps.alias("overlaps"))


def match_shrunk(pairs: DataFrame, images: DataFrame, factor: int = 4, portion: float = 0.25, maximum: float = 0.02) -> DataFrame:
    """The same of planes, shrunk before they travel to their pairs."""
    small = _shrunk(images, factor)
    scored = _by_pair(pairs.select(*PAIR), small, lambda row, a, b: _scored(a, b, portion), "dx int, dy int, score double, difference double")
    overlaps = verdict(F.lit(None).cast("string"), F.col("difference"), maximum)
    return scored.select(*PAIR, (F.col("dx") * factor).alias("dx"), (F.col("dy") * factor).alias("dy"), "score", "difference", overlaps.alias("overlaps"))


def planes(pixels: DataFrame) -> DataFrame:
    """One row per image: height, width and the values in row order. An image has to fit one row."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return pixels.groupBy("collage_id", "image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.transform(ordered, lambda p: p["v"]).alias("data"))


def _array(row: dict, s: str) -> np.ndarray:
    return np.asarray(row[f"data_{s}"], float).reshape(row[f"height_{s}"], row[f"width_{s}"])


def _pair_planes(pairs: DataFrame, images: DataFrame) -> DataFrame:
    side = lambda s: images.select("collage_id", F.col("image_id").alias(f"image_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("height", "width", "data")))
    # Dealt by pair, not by collage, so a large collage is spread out.
    return pairs.join(side("a"), ["collage_id", "image_a"]).join(side("b"), ["collage_id", "image_b"]).repartition(*PAIR)


def _by_pair(pairs: DataFrame, images: DataFrame, match: Callable[[dict, np.ndarray, np.ndarray], tuple | None], schema: str) -> DataFrame:
    """Pairs with what ``match`` finds in the planes of each; pairs without a find go."""
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                found = match(row, _array(row, "a"), _array(row, "b"))
                if found is not None:
                    out.append((row["collage_id"], row["image_a"], row["image_b"], *found))
            yield pd.DataFrame(out, columns=[*PAIR, *names])

    return _pair_planes(pairs, images).mapInPandas(run, f"collage_id long, image_a int, image_b int, {schema}")


def _shrunk(images: DataFrame, factor: int) -> DataFrame:
    """A4: planes of block means."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                p = kernels.shrink(np.asarray(r["data"], float).reshape(r["height"], r["width"]), factor, factor)
                out.append((r["collage_id"], r["image_id"], *p.shape, p.ravel()))
            yield pd.DataFrame(out, columns=["collage_id", "image_id", "height", "width", "data"])

    return images.select("collage_id", "image_id", "height", "width", "data").mapInPandas(run, "collage_id long, image_id int, height int, width int, data array<double>")


def _scored(a: np.ndarray, b: np.ndarray, portion: float) -> tuple | None:
    found = kernels.correlate(a, b, round(portion * min(*a.shape, *b.shape)))
    return None if found is None else (found[1], found[2], found[0], kernels.rms(a, b, *found[1:]))


def match(pairs: DataFrame, images: DataFrame, pad: int = 1024, portion: float = 0.25, maximum: float = 0.2) -> DataFrame:
    """Displacement, difference and verdict of each pair, by FFT on shrunk planes and then on clips."""
    found = _by_pair(pairs.select(*PAIR), images, lambda row, a, b: kernels.coarse_to_fine(a, b, pad, portion), "dx int, dy int, difference double")
    return found.withColumn("overlaps", F.col("difference") < maximum)


def match_once(pairs: DataFrame, images: DataFrame, portion: float = 0.25) -> DataFrame:
    """H2: displacement, score and difference of each pair by one FFT at full size."""
    return _by_pair(pairs.select(*PAIR), images, lambda row, a, b: _scored(a, b, portion), "dx int, dy int, score double, difference double")


def match_stamps(pairs: DataFrame, images: DataFrame, pad: int = 1024, portion: float = 0.25, maximum: float = 0.2, n: int = 5, side: int = 64) -> DataFrame:
    """Corresponding points of each pair, ``pts`` (array of xa, ya, xb, yb); empty where the planes differ. ``rel`` X skips that test."""

    def points(row: dict, a: np.ndarray, b: np.ndarray) -> tuple:
        return ([dict(zip(("xa", "ya", "xb", "yb"), p, strict=True)) for p in kernels.stamps(a, b, pad, portion, maximum, n, side, row["rel"] == "X")],)

    full = pairs.select(*PAIR, F.col("rel") if "rel" in pairs.columns else F.lit(None).cast("string").alias("rel"))
    return _by_pair(full, images, points, f"pts {POINTS}")


def pad_sizes(dims: DataFrame) -> DataFrame:
    """By collage and axis, the sum of the two largest sizes (a pad size that fits every pair) and the smaller of them."""
    axes = dims.select("collage_id", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("w").alias("size")), F.struct(F.lit("y").alias("axis"), F.col("h").alias("size")))).alias("a")).select("collage_id", "a.axis", "a.size")
    ranked = axes.withColumn("k", F.row_number().over(Window.partitionBy("collage_id", "axis").orderBy(F.desc("size")))).where("k <= 2")
    return ranked.groupBy("collage_id", "axis").agg(F.sum("size").alias("both"), F.min("size").alias("smaller"))
