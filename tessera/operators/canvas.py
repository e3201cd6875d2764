"""Canvases.

``geometry``: (collage_id, image_id, c, s, mx, my, w, h). Canvas pixels that no
part covers have no row. Values are ``v``, or the channels of a colour image.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels
from ..sources.storage import materialize
from . import raster, seams

GEOMETRY = ["collage_id", "image_id", "c", "s", "mx", "my", "w", "h"]
PIXEL = ["collage_id", "y", "x"]
#: Channels of colour planes, each an array of the image's values.
COLOUR = ("luma", "cb", "cr")


def bounding_boxes(geometry: DataFrame) -> DataFrame:
    """Bounds of each placed image on the plane."""
    left, top, right, bottom = G.box_bounds(F.col("c"), F.col("s"), F.col("w"), F.col("h"))
    return geometry.select("collage_id", "image_id", (left + F.col("mx")).alias("left"), (top + F.col("my")).alias("top"), (right + F.col("mx")).alias("right"), (bottom + F.col("my")).alias("bottom"))


def canvas(geometry: DataFrame) -> DataFrame:
    """A10: geometry moved to a canvas that begins at the origin, with the canvas size."""
    whole = bounding_boxes(geometry).groupBy("collage_id").agg(F.min("left").alias("l"), F.min("top").alias("t"), F.max("right").alias("r"), F.max("bottom").alias("b"))
    moved = geometry.join(whole, "collage_id").withColumn("mx", F.col("mx") - F.col("l")).withColumn("my", F.col("my") - F.col("t"))
    return moved.select(*GEOMETRY, F.ceil(F.col("r") - F.col("l")).alias("canvas_w"), F.ceil(F.col("b") - F.col("t")).alias("canvas_h"))


def _struct() -> F.Column:
    return F.struct(*GEOMETRY[1:])


def near_pairs(geometry: DataFrame, margin: float = 0.0) -> DataFrame:
    """(collage_id, ga, gb) of different images whose boxes, each larger by ``margin`` on all sides, meet.

    Boxes meet in the cells of a grid as wide as the widest image of the
    collage, so an image is only compared with those around it.
    """
    boxes = bounding_boxes(geometry).select("collage_id", "image_id", *((F.col(c) + by).alias(c) for c, by in (("left", -margin), ("top", -margin), ("right", margin), ("bottom", margin))))
    full = geometry.join(boxes, ["collage_id", "image_id"])
    cell = full.groupBy("collage_id").agg(F.max(F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"), F.lit(1.0))).alias("cell"))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("cell")), F.floor(F.col(high) / F.col("cell"))))
    celled = full.join(cell, "collage_id").withColumn("i", span("left", "right")).withColumn("j", span("top", "bottom"))
    side = lambda s: celled.select("collage_id", "i", "j", "cell", _struct().alias(f"g{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("left", "top", "right", "bottom")))
    near = (F.col("ga.image_id") != F.col("gb.image_id")) & (F.col("left_a") <= F.col("right_b")) & (F.col("left_b") <= F.col("right_a")) & (F.col("top_a") <= F.col("bottom_b")) & (F.col("top_b") <= F.col("bottom_a"))
    # Two boxes that meet share the cell of the corner where their intersection begins.
    first = (F.col("i") == F.floor(F.greatest("left_a", "left_b") / F.col("cell"))) & (F.col("j") == F.floor(F.greatest("top_a", "top_b") / F.col("cell")))
    return side("a").join(side("b").drop("cell"), ["collage_id", "i", "j"]).where(near & first).select("collage_id", "ga", "gb")


def edge_intersections(geometry: DataFrame) -> DataFrame:
    """(collage_id, image_id, x, y) where an edge of an image meets an edge of another; images whose boxes are apart never meet."""
    crossed = near_pairs(geometry).select("collage_id", "ga.image_id", F.explode(G.edges(F.col("ga"))).alias("e"), "gb").select("collage_id", "image_id", "e", F.explode(G.edges(F.col("gb"))).alias("f"))
    return crossed.withColumn("p", G.intersect(F.col("e"), F.col("f"))).where("p is not null").select("collage_id", "image_id", "p.x", "p.y")


def contained_corners(geometry: DataFrame) -> DataFrame:
    """Corners of images that lie in another image of the collage, to the nearest pixel."""
    pairs = near_pairs(geometry, 1.0).select("collage_id", F.col("ga.image_id").alias("image_id"), F.col("gb.image_id").alias("of"))
    points = geometry.select("collage_id", "image_id", F.posexplode(G.corners(_struct())).alias("k", "p"))
    others = geometry.select("collage_id", F.col("image_id").alias("of"), _struct().alias("g"))
    x, y = G.unplace(F.col("g"), (F.col("p.x"), F.col("p.y")))
    inside = G.in_box(F.bround(x), F.bround(y), F.col("g.w"), F.col("g.h"))
    found = pairs.join(points, ["collage_id", "image_id"]).join(others, ["collage_id", "of"]).where(inside)
    return found.groupBy("collage_id", "image_id", "k").agg(F.first("p").alias("p")).select("collage_id", "image_id", "p.x", "p.y")


def special_points(geometry: DataFrame) -> DataFrame:
    """Intersections and contained corners of every image."""
    return edge_intersections(geometry).unionByName(contained_corners(geometry))


def contained_anywhere(x: F.Column, y: F.Column, geometries: F.Column, image: F.Column) -> F.Column:
    """Whether a canvas point lies in an image of the array other than ``image``."""
    return F.exists(geometries, lambda g: (g["image_id"] != image) & G.in_box(*G.unplace(g, (x, y)), g["w"], g["h"]))


def spread(images: DataFrame) -> DataFrame:
    """Images dealt over all partitions by an explicit number: their rows are short, so Spark would put them into one task, but each becomes thousands of pixels.

    In this order of keys, else it is left out after a join or a group-by of images, whose partitions Spark does put together.
    """
    return images.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "collage_id")


def cover(geometry: DataFrame, *more: str) -> DataFrame:
    """Canvas pixels that each placed image covers, with their place (sx, sy) in it; from geometry alone.

    Columns in ``more`` come along. What is joined by image belongs into them:
    Spark takes the pixels for as few as the images and may broadcast them.
    """
    left, top, right, bottom = G.box_bounds(F.col("c"), F.col("s"), F.col("w"), F.col("h"))
    span = lambda low, high: F.explode(F.sequence(F.floor(low).cast("int"), F.ceil(high).cast("int")))
    rows = spread(geometry).select(*GEOMETRY, *more, _struct().alias("g"), span(F.col("my") + top, F.col("my") + bottom).alias("y"))
    rows = rows.withColumn("x", span(F.col("mx") + left, F.col("mx") + right)).where("x >= 0 and y >= 0")
    sx, sy = G.unplace(F.col("g"), (F.col("x"), F.col("y")))
    return rows.withColumn("sx", sx).withColumn("sy", sy).where(G.valid_coords(F.col("sx"), F.col("sy"), F.col("w"), F.col("h"))).select("collage_id", "image_id", "y", "x", "sx", "sy", "g", *more)


def _rows(r: dict, y: np.ndarray, x: np.ndarray, sx: np.ndarray, sy: np.ndarray, channels: Sequence[str]) -> dict:
    """Key and values of an image's pixels."""
    shape = r["height"], r["width"]
    values = {c: kernels.sample(np.asarray(r["data" if c == "v" else c], float).reshape(shape), sx, sy)[0] for c in channels}
    return {"collage_id": r["collage_id"], "image_id": r["image_id"], "y": y, "x": x, **values}


def resample(geometry: DataFrame, images: DataFrame, channels: Sequence[str] = ("v",)) -> DataFrame:
    """(collage_id, image_id, y, x, v or channels) of the canvas pixels that each placed image covers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                yield pd.DataFrame(_rows(r, *kernels.grid(r), channels))

    return geometry.select(*GEOMETRY).join(images, ["collage_id", "image_id"]).mapInPandas(run, f"collage_id long, image_id int, y int, x int, {', '.join(f'{c} double' for c in channels)}")


def sizes(geometry: DataFrame) -> DataFrame:
    """A10: (collage_id, canvas_h, canvas_w) of canvases that begin at the origin."""
    return bounding_boxes(geometry).groupBy("collage_id").agg(F.ceil(F.max("bottom")).alias("canvas_h"), F.ceil(F.max("right")).alias("canvas_w"))


def _drawn(rows: DataFrame, channels: Sequence[str], planes_of, merge=raster.add, empty: float = 0.0, tile: int = raster.TILE) -> DataFrame:
    """By collage: the raster of ``planes_of`` (row, place of each pixel, values of its channels)."""

    def draw(r: dict) -> Iterator[raster.Box]:
        y, x, sx, sy = kernels.grid(r)
        if len(y):
            values = [kernels.sample(np.asarray(r["data" if c == "v" else c], float).reshape(r["height"], r["width"]), sx, sy)[0] for c in channels]
            found = planes_of(r, (y, x, sx, sy), values)
            planes = np.full((len(found), int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), empty)
            planes[:, y - y.min(), x - x.min()] = found
            yield (r["collage_id"],), int(y.min()), int(x.min()), planes

    return raster.from_rows(rows, draw, seams.COLLAGE, merge, tile, empty)


def _columns(channels: Sequence[str]) -> str:
    return ", ".join(f"{c} double" for c in channels)


def average_tiles(geometry: DataFrame, images: DataFrame, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """The raster (number of images, sums of values) of each collage."""
    rows = geometry.select(*GEOMETRY).join(images, ["collage_id", "image_id"])
    return _drawn(rows, channels, lambda r, at, v: [np.ones(len(at[0])), *v], tile=tile)


def average_pixels(tiles: DataFrame, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """Mean and number of the values at each canvas pixel."""
    read = lambda p: (p[0] > 0, {"n": p[0].astype(np.int64), **{c: p[k] / np.maximum(p[0], 1) for k, c in enumerate(channels, 1)}})
    return raster.to_pixels(tiles, seams.COLLAGE, read, f"n bigint, {_columns(channels)}", tile)


def cover_tiles(geometry: DataFrame, tile: int = raster.TILE) -> DataFrame:
    """The raster (number of images) of each collage; from geometry alone."""
    return _drawn(spread(geometry.select(*GEOMETRY)), (), lambda r, at, v: [np.ones(len(at[0]))], tile=tile)


def cover_pixels(tiles: DataFrame, tile: int = raster.TILE) -> DataFrame:
    """The number of images at each canvas pixel."""
    return raster.to_pixels(tiles, seams.COLLAGE, lambda p: (p[0] > 0, {"n": p[0].astype(np.int64)}), "n bigint", tile)


def _shares(planes: np.ndarray, channels: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Values of planes (weight, weighted values, number, values); the plain mean where all weights are 0."""
    n = len(channels)
    weight, number = planes[0], planes[n + 1]
    safe = np.where(weight > 0, weight, 1.0)
    return number > 0, {c: np.where(weight > 0, planes[1 + k] / safe, planes[n + 2 + k] / np.maximum(number, 1)) for k, c in enumerate(channels)}


def weighted_tiles(geometry: DataFrame, images: DataFrame, gamma: float = 2.0, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """The raster (weight, weighted values, number, values) of each collage, by distances."""

    def planes_of(r: dict, at: tuple, v: list[np.ndarray]) -> list[np.ndarray]:
        weight = _distances(r, *at) ** gamma
        return [weight, *(weight * c for c in v), np.ones(len(weight)), *v]

    rows = _surrounded(geometry).join(images, ["collage_id", "image_id"])
    return _drawn(rows, channels, planes_of, tile=tile)


def weighted_pixels(tiles: DataFrame, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """Weighted means at each canvas pixel."""
    return raster.to_pixels(tiles, seams.COLLAGE, lambda p: _shares(p, channels), _columns(channels), tile)


def owner_tiles(geometry: DataFrame, images: DataFrame, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """The raster (image, its values) of the last image at each pixel; no image is minus infinity."""
    rows = geometry.select(*GEOMETRY).join(images, ["collage_id", "image_id"])
    return _drawn(rows, channels, lambda r, at, v: [np.full(len(at[0]), float(r["image_id"])), *v], raster.last, -np.inf, tile)


def owner_pixels(tiles: DataFrame, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """The last image and its values at each canvas pixel."""
    read = lambda p: (np.isfinite(p[0]), {"image_id": np.where(np.isfinite(p[0]), p[0], 0).astype(np.int32), **{c: p[k] for k, c in enumerate(channels, 1)}})
    return raster.to_pixels(tiles, seams.COLLAGE, read, f"image_id int, {_columns(channels)}", tile)


def average_canvas(placed: DataFrame, channels: Sequence[str] = ("v",)) -> DataFrame:
    """Mean and number of the values at each canvas pixel."""
    return placed.groupBy(*PIXEL).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in channels))


def _surrounded(geometry: DataFrame) -> DataFrame:
    """Geometry with the images around each image, far enough to hold a corner of it to the nearest pixel."""
    others = near_pairs(geometry, 1.0).groupBy("collage_id", F.col("ga.image_id").alias("image_id")).agg(F.collect_list("gb").alias("others"))
    return geometry.select(*GEOMETRY).join(others, ["collage_id", "image_id"], "left")


def side_points(geometry: DataFrame) -> DataFrame:
    """For each canvas pixel of an image and each of its sides (k), the distance and whether the foot point lies in another image."""
    rows = cover(_surrounded(geometry).withColumn("others", F.coalesce("others", F.array())), "others")
    feet = rows.select("collage_id", "image_id", "y", "x", "others", F.posexplode(G.sides(F.col("g"), (F.col("x").cast("double"), F.col("y").cast("double")))).alias("k", "q"))
    return feet.select("collage_id", "image_id", "y", "x", "k", F.col("q.d").alias("d"), contained_anywhere(F.col("q.x"), F.col("q.y"), F.col("others"), F.col("image_id")).alias("contained"))


def _distances(r: dict, y: np.ndarray, x: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    others = [] if r["others"] is None else [o.asDict() if hasattr(o, "asDict") else dict(o) for o in r["others"]]
    return kernels.distances(r, others, kernels.special_points(r, others), y, x, sx, sy)


def distance_map(geometry: DataFrame) -> DataFrame:
    """For the canvas pixels of each image, how far it is to where it may end (see ``kernels.distances``).

    An image meets the images around it only, so a collage may have any number of parts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                y, x, sx, sy = kernels.grid(r)
                yield pd.DataFrame({"collage_id": r["collage_id"], "image_id": r["image_id"], "y": y, "x": x, "d": _distances(r, y, x, sx, sy)})

    return _surrounded(geometry).repartition("collage_id", "image_id").mapInPandas(run, "collage_id long, image_id int, y int, x int, d double")


def _weighted(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Values weighted by ``wt``; the plain mean where all weights are 0."""
    sums = rows.groupBy(*PIXEL).agg(F.sum("wt").alias("total"), *(e for c in channels for e in (F.sum(F.col("wt") * F.col(c)).alias(f"_s_{c}"), F.avg(c).alias(f"_m_{c}"))))
    return sums.select(*PIXEL, *(F.when(F.col("total") > 0, F.col(f"_s_{c}") / F.nullif("total", F.lit(0.0))).otherwise(F.col(f"_m_{c}")).alias(c) for c in channels))


def weighted_canvas(placed: DataFrame, distances: DataFrame, gamma: float = 2.0, channels: Sequence[str] = ("v",)) -> DataFrame:
    """Values weighted by a power of distances that are at hand."""
    return _weighted(placed.join(distances, ["collage_id", "image_id", "y", "x"]).withColumn("wt", G.weight(F.col("d"), gamma)), channels)


def blend_by_distance(geometry: DataFrame, images: DataFrame, gamma: float = 2.0, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """Values weighted by a power of distances, summed by tile."""
    return weighted_pixels(weighted_tiles(geometry, images, gamma, channels, tile), channels, tile)


def owner(placed: DataFrame) -> DataFrame:
    """The value (or channels) of the last image at each canvas pixel."""
    values = [c for c in placed.columns if c not in ("collage_id", "y", "x", "image_id")]
    last = placed.groupBy(*PIXEL).agg(F.max(F.struct("image_id", *values)).alias("m"))
    return last.select(*PIXEL, "m.image_id", *(f"m.{c}" for c in values))


def difference_to_average(placed: DataFrame, average: DataFrame) -> DataFrame:
    """How far each image's value is from the mean at its pixel."""
    mean = average.select(*PIXEL, F.col("v").alias("mean"))
    return placed.join(mean, PIXEL).select("collage_id", "image_id", "y", "x", F.abs(F.col("v") - F.col("mean")).alias("v"))


def as_bytes(rows: DataFrame, channels: Sequence[str] = ("v",)) -> DataFrame:
    """M6, SNK5: values as bytes, ready for a raster."""
    return rows.withColumns({c: G.to_byte(F.col(c)) for c in channels})


def border(masks: DataFrame) -> DataFrame:
    """Set pixels that are first or last of their row or column. A task keeps the ends of rows and columns, not their pixels."""
    line = lambda across, along: F.struct(F.lit(across == "y").alias("row"), F.col(across).alias("k"), F.col(along).alias("p"))
    pixels = masks.select("collage_id", "image_id", F.explode(F.array(line("y", "x"), line("x", "y"))).alias("l")).select("collage_id", "image_id", "l.*")
    ends = pixels.groupBy("collage_id", "image_id", "row", "k").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    edge = ends.select("collage_id", "image_id", "row", "k", F.explode(F.array("low", "high")).alias("p"))
    return edge.select("collage_id", "image_id", F.expr("if(row, k, p)").alias("y"), F.expr("if(row, p, k)").alias("x")).distinct()


def peel(geometry: DataFrame, images: DataFrame, n: int = 200, tile: int = raster.TILE) -> DataFrame:
    """(collage_id, image_id, y, x) that each image keeps when masks are peeled along large smoothed differences, region by region."""
    on = seams.placed(geometry, images, tile=tile)
    covered = seams.cover(on, tile)
    kept = seams.peeled(seams.differences(on, covered), covered, sizes(geometry), n, tile)
    return raster.to_pixels(kept, seams.IMAGE, lambda p: (p[0] > 0, {}), "", tile)


def shaped_tiles(geometry: DataFrame, images: DataFrame, n: int = 200, hard: bool = False, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """The raster of a blend along seams: as of ``owner_tiles`` if ``hard``, else as of ``weighted_tiles``. Seams follow the first channel."""
    on = materialize(seams.placed(geometry, images, channels, tile), "placed")
    covered = materialize(seams.cover(on, tile), "cover")
    whole = sizes(geometry)
    kept = materialize(seams.peeled(seams.differences(on, covered), covered, whole, n, tile), "kept")
    by_image = seams.hidden(on, kept) if hard else seams.weigh(on, seams.soft(kept, whole, n, tile))

    def draw(r: dict) -> Iterator[raster.Box]:
        planes = raster.box_of(r)
        if hard:
            planes = np.where(planes[0] > 0, np.concatenate([np.full_like(planes[:1], r["image_id"]), planes[1:]]), -np.inf)
        yield (r["collage_id"],), r["ty"] * tile + r["y"], r["tx"] * tile + r["x"], planes

    return raster.from_rows(by_image, draw, seams.COLLAGE, raster.last if hard else raster.add, tile, -np.inf if hard else 0.0)
