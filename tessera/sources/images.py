"""Image parts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from .storage import located

# BT.601 weights of red, green and blue in brightness.
RED, GREEN, BLUE = 0.299, 0.587, 0.114


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def _channels(r: dict) -> dict[str, np.ndarray]:
    """luma, cb and cr (0 to 1) of a decoded image: blue, green, red bytes, or one grey byte, for each pixel."""
    raw = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"]) / 255.0
    b, g, red = (raw[:, :, k if r["nChannels"] >= 3 else 0] for k in range(3))
    luma = RED * red + GREEN * g + BLUE * b
    return {"luma": luma, "cb": 0.5 + (b - luma) / (2 * (1 - BLUE)), "cr": 0.5 + (red - luma) / (2 * (1 - RED))}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (path, y, x, luma, cb, cr; 0 to 1) of the JPEG files of a folder, decoded by Spark's image source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                y, x = np.mgrid[0 : r["height"], 0 : r["width"]]
                yield pd.DataFrame({"path": r["origin"], "y": y.ravel(), "x": x.ravel(), **{c: v.ravel() for c, v in _channels(r).items()}})

    return _decoded(spark, path).mapInPandas(run, "path string, y int, x int, luma double, cb double, cr double")


def read_planes(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """SRC1: a row for each of ``parts`` (collage_id, image_id, path) whose file is in the folder: height, width, ``data`` (its brightness), luma, cb, cr.

    A file and a part meet where the part's path ends with the file's path below the folder; where several do, the longest
    counts. Decoded images stay whole: pixels are neither exploded nor gathered.
    """
    system, target = located(spark, path)
    plain = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"  # file:/a and file:///a are one place
    root = re.sub(plain, r"\1:/", system.makeQualified(target).toString().rstrip("/"))
    files = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.origin")
    below = files.select("origin", F.regexp_replace("origin", plain, "$1:/").substr(F.lit(len(root) + 2), F.length("origin")).alias("end"))
    steps = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                c = {k: v.ravel() for k, v in _channels(r).items()}
                yield pd.DataFrame([{"collage_id": r["collage_id"], "image_id": r["image_id"], "height": r["height"], "width": r["width"], "data": c["luma"], **c}])

    fits = parts.select("collage_id", "image_id", F.explode(ends).alias("end")).join(below, "end")
    chosen = fits.groupBy("collage_id", "image_id").agg(F.max_by("origin", F.length("end")).alias("origin"))
    rows = _decoded(spark, path).join(chosen, "origin")
    arrays = ", ".join(f"{c} array<double>" for c in ("data", "luma", "cb", "cr"))
    return rows.mapInPandas(run, f"collage_id long, image_id int, height int, width int, {arrays}")


def write_raster(pixels: DataFrame, path: str, tile: int = 256) -> None:
    """SNK5: canvas pixels as Parquet, by collage and tile."""
    tiled = pixels.withColumn("tile_y", F.floor(F.col("y") / tile)).withColumn("tile_x", F.floor(F.col("x") / tile))
    tiled.repartition("collage_id", "tile_y", "tile_x").write.mode("overwrite").partitionBy("collage_id", "tile_y", "tile_x").parquet(path)


def write_tiles(tiles: DataFrame, keys: list[str], read: Callable[[np.ndarray], tuple[np.ndarray, Sequence[np.ndarray]]], path: str, scale: float = 1.0) -> None:
    """SNK5, M6: a tiled raster of any key (collage, image, pair) as bytes.

    ``read`` gives, of a box's planes, where there are pixels and the values (0
    to ``scale``) of the channels. A row is a box of a tile: keys, ty, tx, y, x,
    h, w, ``there`` (a bit for each pixel) and ``data`` (a byte for each pixel
    and channel, channel by channel).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, data = [], []
            for k in range(batch.num_rows):
                mask, values = read(raster.box_of(raster.record(batch, k)))
                there.append(np.packbits(mask).tobytes())
                data.append(b"".join(np.where(mask, np.floor(255 * np.clip(v / scale, 0, 1) + 0.5), 0).astype(np.uint8).tobytes() for v in values))
            place = [batch.column(c) for c in (*keys, *raster.BOX)]
            yield pa.RecordBatch.from_arrays([*place, pa.array(there, pa.binary()), pa.array(data, pa.binary())], [*keys, *raster.BOX, "there", "data"])

    kinds = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)
    tiles.mapInArrow(run, f"{kinds}, {', '.join(f'{c} int' for c in raster.BOX)}, there binary, data binary").write.mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str, keys: list[str], channels: Sequence[str], tile: int = 256) -> DataFrame:
    """Pixels (keys, y, x, a byte for each channel) of what ``write_tiles`` wrote."""
    rows = spark.read.parquet(path)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = raster.record(batch, k)
                n = r["h"] * r["w"]
                at = np.flatnonzero(np.unpackbits(np.frombuffer(r["there"], np.uint8), count=n))
                values = np.frombuffer(r["data"], np.uint8).reshape(len(channels), n)[:, at].astype(np.int32)
                y, x = np.divmod(at, r["w"])
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]] * len(at), batch.schema.field(c).type) for c in keys), pa.array((y + r["ty"] * tile + r["y"]).astype(np.int32)), pa.array((x + r["tx"] * tile + r["x"]).astype(np.int32)), *(pa.array(v) for v in values)], [*keys, "y", "x", *channels])

    return rows.mapInArrow(run, f"{kinds}, y int, x int, {', '.join(f'{c} int' for c in channels)}")
