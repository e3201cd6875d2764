"""Angles and smoothing of planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels

IMAGE = ["collage_id", "image_id"]


def row_profile(pixels: DataFrame, *more: str) -> DataFrame:
    """A1: sums of brightness by row."""
    return pixels.groupBy(*IMAGE, *more, "y").agg(F.sum("v").alias("s"))


def differences(profiles: DataFrame, *more: str) -> DataFrame:
    """Each row's sum less the next one's, n - 1 rows."""
    w = Window.partitionBy(*IMAGE, *more).orderBy("y")
    return profiles.withColumn("d", F.lead("s").over(w) - F.col("s")).where(F.col("d").isNotNull()).select(*IMAGE, *more, "y", "d")


def sharpness(profiles: DataFrame, *more: str) -> DataFrame:
    """A2: sum of squared differences of a profile."""
    return differences(profiles, *more).groupBy(*IMAGE, *more).agg(F.sum(F.col("d") * F.col("d")).alias("score"))


def best_angle(scores: DataFrame, maximum: float, steps: int) -> DataFrame:
    """A3: the sharpest test angle of each image; the later one on ties."""
    best = scores.groupBy(*IMAGE).agg(F.max(F.struct("score", "angle_ix")).alias("m"))
    return best.select(*IMAGE, (F.lit(-maximum) + F.col("m.angle_ix") * (2.0 * maximum) / steps).alias("angle_deg"), F.col("m.score").alias("score"))


def turned_profiles(images: DataFrame, maximum: float = 1.0, steps: int = 40) -> DataFrame:
    """H1, A1: row profiles of every plane at every test angle. Rows leave the task as sums, not as pixels."""
    angles = [-maximum + i * (2.0 * maximum) / steps for i in range(steps + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                plane = np.asarray(row["data"], float).reshape(row["height"], row["width"])
                sums = kernels.turn(plane, angles[row["angle_ix"]])[0].sum(1)
                out.append(pd.DataFrame({"collage_id": row["collage_id"], "image_id": row["image_id"], "angle_ix": row["angle_ix"], "y": np.arange(len(sums)), "s": sums}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*IMAGE, "angle_ix", "y", "s"])

    spread = images.withColumn("angle_ix", F.explode(F.sequence(F.lit(0), F.lit(steps)))).repartition(*IMAGE, "angle_ix")
    return spread.mapInPandas(run, "collage_id long, image_id int, angle_ix int, y int, s double")


def find_angles(images: DataFrame, maximum: float = 1.0, steps: int = 40) -> DataFrame:
    """The angle of each plane that makes its rows sharpest."""
    return best_angle(sharpness(turned_profiles(images, maximum, steps), "angle_ix"), maximum, steps)


def _climb(plane: np.ndarray, maximum: float, steps: int, levels: int) -> tuple[int, float]:
    """The sharpest test angle of a plane, as its number and score: every 2^levels-th first, then in halves of that step those beside the best.

    Before the last level the plane is shrunk so far that neighbouring angles
    move the ends of its rows by about a pixel, and centred, as the surroundings are 0.
    """
    each = 2.0 * maximum / steps

    def score(k: int, small: np.ndarray) -> float:
        rows = kernels.turn(small, -maximum + k * each)[0].sum(1)
        return float((np.diff(rows) ** 2).sum())

    best = max((score(k, plane), k) for k in range(steps + 1)) if levels <= 0 else None
    for level in range(levels, -1, -1) if levels > 0 else ():
        stride = 1 << level
        by = max(1, int(plane.shape[1] * np.radians(stride * each)))
        small = kernels.shrink(plane - plane.mean(), *(min(by, n) for n in plane.shape)) if level else plane
        at = range(0, steps + 1, stride) if best is None else (k for k in (best[1] - stride, best[1], best[1] + stride) if 0 <= k <= steps)
        best = max((score(k, small), k) for k in at)
    return best[1], best[0]


def find_angles_by_levels(images: DataFrame, maximum: float = 1.0, steps: int = 40, levels: int = 3) -> DataFrame:
    """As ``find_angles``, from few angles of small planes to fine ones: with 41 angles, three full turns in place of 41.

    The sharpness of a shrunk plane has a wider peak, so the few angles don't
    miss it. The end may be a step or two from that of all angles where the
    sharpness is flat, and elsewhere where it has several peaks of like height.
    """

    def change(row, plane):
        k, score = _climb(plane, maximum, steps, levels)
        return row["collage_id"], row["image_id"], -maximum + k * (2.0 * maximum) / steps, score

    return _by_plane(images, change, "collage_id long, image_id int, angle_deg double, score double")


def _by_plane(images: DataFrame, change, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([change(row, np.asarray(row["data"], float).reshape(row["height"], row["width"])) for row in batch.to_dict("records")], columns=[c.split()[0] for c in schema.split(", ")])

    return images.mapInPandas(run, schema)


def spectral_angles(images: DataFrame, maximum: float = 1.0) -> DataFrame:
    """H6: the angle of each plane from its power spectrum."""
    return _by_plane(images, lambda row, p: (row["collage_id"], row["image_id"], kernels.spectral_angle(p, maximum)), "collage_id long, image_id int, angle_deg double")


def turned(images: DataFrame) -> DataFrame:
    """H1: planes turned by ``angle_deg`` into their bounding boxes, with left and top."""

    def change(row, plane):
        v, left, top = kernels.turn(plane, row["angle_deg"])
        return row["collage_id"], row["image_id"], left, top, v.shape[0], v.shape[1], v.ravel()

    return _by_plane(images, change, "collage_id long, image_id int, left double, top double, height int, width int, data array<double>")


def smoothed(images: DataFrame, n: int, high: bool = False) -> DataFrame:
    """Planes smoothed n times, or with ``high`` what the smoothing takes away."""

    def change(row, plane):
        low = kernels.smooth(plane, n)
        return row["collage_id"], row["image_id"], row["height"], row["width"], (plane - low if high else low).ravel()

    return _by_plane(images, change, "collage_id long, image_id int, height int, width int, data array<double>")


def pixels_of(images: DataFrame) -> DataFrame:
    """Planes back to pixels."""
    rows = images.select(*IMAGE, "width", F.posexplode("data").alias("k", "v"))
    return rows.select(*IMAGE, F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).alias("x"), "v")


def lowpass(pixels: DataFrame, n: int = 1) -> DataFrame:
    """(1, 2, 1) / 4 along both axes with clamped borders, n times, by windows; for small n (``smoothed`` is for large ones)."""
    for _ in range(n):
        for along, across in (("y", "x"), ("x", "y")):
            w = Window.partitionBy(*IMAGE, across).orderBy(along)
            v = F.col("v")
            pixels = pixels.withColumn("v", (F.coalesce(F.lag("v").over(w), v) + 2 * v + F.coalesce(F.lead("v").over(w), v)) / 4)
    return pixels


def highpass(pixels: DataFrame, n: int = 1) -> DataFrame:
    """Values less their smoothed ones."""
    low = lowpass(pixels.withColumn("_v", F.col("v")), n)
    return low.withColumn("v", F.col("_v") - F.col("v")).drop("_v")


def gather(pixels: DataFrame, places: DataFrame, dims: DataFrame) -> DataFrame:
    """Cubic interpolation as a join: ``places`` (collage_id, image_id, ty, tx, sx, sy) meet the pixels of their image, and the four by four clamped neighbours of each are summed there.

    Neighbours are no rows of their own, which would be sixteen times as many
    as the places. Missing pixels count for nothing. A task holds one image.
    """

    def run(at: pa.Table, of: pa.Table) -> pa.Table:
        sx, sy, w, h = (at[c].to_numpy() for c in ("sx", "sy", "w", "h"))
        y, x, v = of["y"].to_numpy(), of["x"].to_numpy(), of["v"]
        shape = (max([0, *h, *(y + 1)]), max([0, *w, *(x + 1)])) if len(y) * len(sx) else (1, 1)
        plane, known, there = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        set_ = v.is_valid().to_numpy()
        np.add.at(plane, (y, x), np.where(set_, v.fill_null(0.0).to_numpy(), 0.0))
        there[y, x], known[y[set_], x[set_]] = True, True
        i, j = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
        across, down = kernels.cubic(sx - i), kernels.cubic(sy - j)
        out, some, any_ = np.zeros(len(sx)), np.zeros(len(sx), bool), np.zeros(len(sx), bool)
        for b in range(4):
            r = np.clip(j + b - 1, 0, h - 1)
            for a in range(4):
                c = np.clip(i + a - 1, 0, w - 1)
                out += down[b] * across[a] * plane[r, c]
                some |= known[r, c]
                any_ |= there[r, c]
        nx, ny = np.floor(sx + 0.5), np.floor(sy + 0.5)
        valid = (nx >= 0) & (nx < w) & (ny >= 0) & (ny < h)
        found = at.select([*IMAGE, "ty", "tx"]).append_column("valid", pa.array(valid)).append_column("v", pa.array(out, mask=~some))
        return found.filter(pa.array(any_))

    # The side of images is the smaller one, though Spark may take the places for as few.
    sized = places.join(dims.hint("shuffle_hash"), IMAGE).select(*IMAGE, "ty", "tx", "sx", "sy", "w", "h")
    schema = ", ".join([*(f"{c} {places.schema[c].dataType.simpleString()}" for c in (*IMAGE, "ty", "tx")), "valid boolean", "v double"])
    values = pixels.select(*IMAGE, "y", "x", F.col("v").cast("double").alias("v"))
    return sized.groupBy(*IMAGE).cogroup(values.groupBy(*IMAGE)).applyInArrow(run, schema)
