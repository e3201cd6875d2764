"""Seams along small differences on tiled rasters.

Masks of images are peeled where several cover a pixel. Peeling goes from a
pixel to those beside it and only ever changes pixels that two images or more
cover, so connected regions of such pixels have nothing to do with each other:
they are labelled across tiles, and each is peeled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.storage import materialize
from . import graph, raster

IMAGE, COLLAGE = ["collage_id", "image_id"], ["collage_id"]
#: Digits of smoothed differences, about those of a single-precision number.
DIGITS = 7
WIDE = 1 << 31  # more than any canvas is wide


def placed(geometry: DataFrame, images: DataFrame, channels: Sequence[str] = ("v",), tile: int = raster.TILE) -> DataFrame:
    """The raster of each image on the canvas: mask, then values."""

    def draw(r: dict) -> Iterator[raster.Box]:
        y, x, sx, sy = kernels.grid(r)
        if len(y):
            planes = np.zeros((1 + len(channels), int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1))
            at = y - y.min(), x - x.min()
            planes[0][at] = 1
            for k, c in enumerate(channels, 1):
                planes[k][at] = kernels.sample(np.asarray(r["data" if c == "v" else c], float).reshape(r["height"], r["width"]), sx, sy)[0]
            yield (r["collage_id"], r["image_id"]), int(y.min()), int(x.min()), planes

    rows = geometry.select(*IMAGE, "c", "s", "mx", "my", "w", "h").join(images, IMAGE)
    return raster.from_rows(rows, draw, IMAGE, tile=tile)


def _to_collage(row: dict) -> Iterator[raster.Box]:
    yield (row["collage_id"],), row["ty"] * row["tile"] + row["y"], row["tx"] * row["tile"] + row["x"], raster.box_of(row)


def cover(on: DataFrame, tile: int = raster.TILE) -> DataFrame:
    """By collage: the number of images at each pixel, and the sums of their values."""
    return raster.from_rows(on.withColumn("tile", F.lit(tile)), _to_collage, COLLAGE, tile=tile)


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, change, like: DataFrame) -> DataFrame:
    """``change`` (planes of the left box, those of the right one or None) of boxes of the same tile, in the left box."""
    by = [*keys, "ty", "tx"]
    kept = [c for c in like.columns if c != "data"]
    other = right.select(*by, *(F.col(c).alias(f"other_{c}") for c in ("y", "x", "h", "w", "data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                planes, wide = raster.box_of(row), None
                if row["other_data"] is not None:
                    have = raster.box_of({c: row[f"other_{c}"] for c in ("h", "w", "data")})
                    wide = np.zeros((len(have), *planes.shape[1:]))
                    y, x = row["other_y"] - row["y"], row["other_x"] - row["x"]
                    y0, x0, y1, x1 = max(0, y), max(0, x), min(planes.shape[1], y + have.shape[1]), min(planes.shape[2], x + have.shape[2])
                    if y0 < y1 and x0 < x1:
                        wide[:, y0:y1, x0:x1] = have[:, y0 - y : y1 - y, x0 - x : x1 - x]
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]], batch.schema.field(c).type) for c in kept), pa.array([change(planes, wide).tobytes()], pa.binary())], [*kept, "data"])

    return left.join(other, by, how).mapInArrow(run, like.schema)


def differences(on: DataFrame, covered: DataFrame) -> DataFrame:
    """Mask, and how far each image's (first) value is from the mean at its pixel; 0 outside the image."""
    mean = lambda wide: wide[1] / np.maximum(wide[0], 1)
    return _beside(on, covered, COLLAGE, "inner", lambda p, wide: np.stack([p[0], np.abs(p[1] - mean(wide)) * p[0]]), on)


def smoothed_differences(diff: DataFrame, sizes: DataFrame, n: int, tile: int = raster.TILE) -> DataFrame:
    """H4: mask, its border, and the differences smoothed over the whole canvas, of each image's tiles.

    Two images that cover a pixel are equally far from its mean, so their
    differences tie; rounded, they still do after smoothing, whatever the tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                planes, y0, x0 = raster.box_of(row), -row["y"], -row["x"]
                at = slice(y0, min(y0 + tile, row["h"])), slice(x0, min(x0 + tile, row["w"]))
                mask = planes[0] > 0
                if not mask[at].any():
                    continue
                out = np.stack([mask, kernels.border(mask), np.round(kernels.smooth(planes[1], n), DIGITS)])[:, at[0], at[1]]
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]], diff_schema[c]) for c in [*IMAGE, "ty", "tx"]), *(pa.array([v], pa.int32()) for v in (0, 0, *out.shape[1:])), pa.array([out.tobytes()], pa.binary())], [*IMAGE, *raster.BOX, "data"])

    diff_schema = {"collage_id": pa.int64(), "image_id": pa.int32(), "ty": pa.int32(), "tx": pa.int32()}
    return raster.with_margin(diff, sizes, IMAGE, max(n, 1), tile).mapInArrow(run, diff.schema)


def regions(covered: DataFrame, tile: int = raster.TILE) -> DataFrame:
    """By collage: a plane with 1 more than the label of the pixel's region, 0 where fewer than two images are. The label is the first pixel of the region, y * ``WIDE`` + x, of one of its tiles."""

    def named(row: dict) -> np.ndarray:
        box = raster.box_of(row)
        found = kernels.labels(box[0] > 1)
        y, x = np.divmod(found - 1, box.shape[2])
        return np.where(found > 0, (y + row["ty"] * tile + row["y"]) * WIDE + x + row["tx"] * tile + row["x"] + 1, 0)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                found = named(row)
                if found.any():
                    yield batch.slice(k, 1).set_column(batch.schema.get_field_index("data"), "data", pa.array([found.astype(float).tobytes()], pa.binary()))

    labelled = materialize(covered.mapInArrow(local, covered.schema), "regions")

    def rims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Labelled pixels at the borders of tiles: those of the first row and column, and those of the last ones where they meet the next tile."""
        for batch in batches:
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                box = raster.box_of(row)[0].astype(np.int64)
                y, x = np.nonzero(box)
                ay, ax, label = y + row["y"], x + row["x"], box[y, x]
                for at, dy, dx, side in ((ay == 0, 0, 0, 0), (ax == 0, 0, 0, 1), (ay == tile - 1, 1, 0, 2), (ax == tile - 1, 0, 1, 3)):
                    if at.any():
                        n = int(at.sum())
                        yield pa.RecordBatch.from_arrays([pa.array([row["collage_id"]] * n, pa.int64()), pa.array([side % 2] * n, pa.int32()), pa.array([side >= 2] * n), pa.array((ay[at] + row["ty"] * tile + dy).astype(np.int32)), pa.array((ax[at] + row["tx"] * tile + dx).astype(np.int32)), pa.array(label[at])], ["collage_id", "way", "far", "y", "x", "label"])

    rim = labelled.mapInArrow(rims, "collage_id bigint, way int, far boolean, y int, x int, label bigint")
    node = F.struct("collage_id", "label")
    on = ["collage_id", "way", "y", "x"]
    edges = rim.where("far").select(*on, node.alias("a")).join(rim.where("not far").select(*on, node.alias("b")), on).select("a", "b").distinct()
    names = graph.components(edges).select("id.collage_id", F.col("id.label").alias("label"), F.col("component.label").alias("region"))
    # What a tile has to rename: its own labels that are not the region's.
    of_tile = rim.withColumn("ty", F.floor((F.col("y") - (F.col("far") & (F.col("way") == 0)).cast("int")) / tile).cast("int")).withColumn("tx", F.floor((F.col("x") - (F.col("far") & (F.col("way") == 1)).cast("int")) / tile).cast("int")).select("collage_id", "ty", "tx", "label").distinct()
    renamed = of_tile.join(names, ["collage_id", "label"]).where("label <> region").groupBy("collage_id", "ty", "tx").agg(F.collect_list("label").alias("labels"), F.collect_list("region").alias("regions"))

    columns = labelled.columns

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                plane = raster.box_of(row).copy()
                if row["labels"] is not None:
                    order = np.argsort(row["labels"])
                    have, new = np.asarray(row["labels"])[order].astype(float), np.asarray(row["regions"])[order].astype(float)
                    at = np.minimum(np.searchsorted(have, plane), len(have) - 1)
                    plane = np.where(have[at] == plane, new[at], plane)
                yield batch.slice(k, 1).select(columns).set_column(columns.index("data"), "data", pa.array([plane.tobytes()], pa.binary()))

    return labelled.join(renamed, ["collage_id", "ty", "tx"], "left").select(*labelled.columns, "labels", "regions").mapInArrow(rename, labelled.schema)


def peeled(diff: DataFrame, covered: DataFrame, sizes: DataFrame, n: int = 200, tile: int = raster.TILE) -> DataFrame:
    """H5: by image, a plane that is 1 where the image keeps its pixel. A task holds the pixels of one region."""
    rows = materialize(smoothed_differences(diff, sizes, n, tile), "differences")
    marked = regions(covered, tile)
    joined = rows.join(marked.select("collage_id", "ty", "tx", *(F.col(c).alias(f"other_{c}") for c in ("y", "x", "h", "w", "data"))), ["collage_id", "ty", "tx"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pixels of each region in an image's tile."""
        for batch in batches:
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                mask, border, low = raster.box_of(row)
                label = np.zeros(mask.shape, np.int64)
                have = raster.box_of({c: row[f"other_{c}"] for c in ("h", "w", "data")})[0]
                y, x = row["other_y"] - row["y"], row["other_x"] - row["x"]
                label[y : y + have.shape[0], x : x + have.shape[1]] = have[: mask.shape[0] - y, : mask.shape[1] - x]
                label[mask == 0] = 0
                for one in np.unique(label[label > 0]).tolist():
                    y, x = np.nonzero(label == one)
                    cells = [row["collage_id"], one, row["image_id"], (y + row["ty"] * tile + row["y"]).astype(np.int32), (x + row["tx"] * tile + row["x"]).astype(np.int32), low[y, x], border[y, x] > 0]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.bool_())), strict=True)], ["collage_id", "region", "image_id", "y", "x", "d", "edge"])

    def peel(group: pd.DataFrame) -> pd.DataFrame:
        parts, borders, ids = [], [], []
        for i, of in group.groupby("image_id", sort=True):
            y, x, d, edge = (np.concatenate(of[c].to_list()) for c in ("y", "x", "d", "edge"))
            shape = int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1
            mask, diff, begin = np.zeros(shape, bool), np.zeros(shape), np.zeros(shape, bool)
            at = y - y.min(), x - x.min()
            mask[at], diff[at], begin[at] = True, d, edge
            ids.append(i)
            parts.append((int(y.min()), int(x.min()), mask, diff))
            borders.append(begin)
        top, left = min(p[0] for p in parts), min(p[1] for p in parts)
        kept = kernels.peel([(y - top, x - left, m, d) for y, x, m, d in parts], borders)
        gone = [(m & ~k, y, x) for (y, x, m, _), k in zip(parts, kept, strict=True)]
        return pd.DataFrame([(group["collage_id"].iloc[0], i, y, x, *g.shape, g.astype(float).tobytes()) for i, (g, y, x) in zip(ids, gone, strict=True) if g.any()], columns=["collage_id", "image_id", "top", "left", "h", "w", "data"])

    found = joined.mapInArrow(spread, "collage_id bigint, region bigint, image_id int, y array<int>, x array<int>, d array<double>, edge array<boolean>")
    lost = found.groupBy("collage_id", "region").applyInPandas(peel, "collage_id bigint, image_id int, top int, left int, h int, w int, data binary")
    removed = raster.from_rows(lost, lambda r: iter([((r["collage_id"], r["image_id"]), r["top"], r["left"], raster.box_of(r))]), IMAGE, tile=tile)
    return _beside(rows, removed, IMAGE, "left", lambda p, wide: (p[:1] if wide is None else p[:1] * (wide == 0)), rows)


def soft(kept: DataFrame, sizes: DataFrame, n: int, tile: int = raster.TILE) -> DataFrame:
    """H4: weights from masks, smoothed over the whole canvas."""
    return raster.smoothed(kept, sizes, IMAGE, n, tile)


def weigh(on: DataFrame, weights: DataFrame) -> DataFrame:
    """By image: weight, weighted values, number and values, where the image is."""
    return _beside(on, weights, IMAGE, "inner", lambda p, wide: np.concatenate([p[:1] * wide[:1], p[1:] * p[:1] * wide[:1], p]), on)


def hidden(on: DataFrame, kept: DataFrame) -> DataFrame:
    """By image: mask and values of the pixels that it keeps."""
    return _beside(on, kept, IMAGE, "inner", lambda p, wide: p * wide[:1], on)
