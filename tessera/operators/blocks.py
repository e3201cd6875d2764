"""Planes of any size, smoothed, turned and matched as tiles.

A plane is a raster of one plane with the key (collage_id, image_id), its size a
row (collage_id, image_id, canvas_h, canvas_w). A task holds a few tiles, a
plane shrunk to the pad size or a clip of half of it, never a whole plane. Results
are those of the kernels on whole planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import kernels
from . import raster
from .matching import PAIR

PLANE = ["collage_id", "image_id"]
PATCH = ["py", "px", "ph", "pw"]


def tiles_of(images: DataFrame, tile: int = raster.TILE) -> DataFrame:
    """Tiles of planes that come in one row each. Larger planes come as boxes of their own: ``raster.merged`` makes tiles of them."""

    def draw(row: dict) -> Iterator[raster.Box]:
        yield tuple(row[k] for k in PLANE), 0, 0, np.asarray(row["data"], float).reshape(1, row["height"], row["width"])

    return raster.from_rows(images.select(*PLANE, "height", "width", "data"), draw, PLANE, tile=tile)


def sizes_of(images: DataFrame) -> DataFrame:
    return images.select(*PLANE, F.col("height").alias("canvas_h"), F.col("width").alias("canvas_w"))


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def patches(tiles: DataFrame, wanted: DataFrame, keys: Sequence[str], ids: Sequence[str] = (), tile: int = raster.TILE) -> DataFrame:
    """Rectangles (py, px, ph, pw) of rasters, put together of their tiles: ``data`` in place of the boxes, 0 where no box is.

    ``wanted`` has keys, ``ids`` that tell rectangles apart, and the rectangle. Those without any pixel have no row.
    """
    by = [*keys, *ids, *PATCH]
    reach = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / tile).cast("int"), F.floor((F.col(at) + F.col(size) - 1) / tile).cast("int")))
    asked = wanted.where("ph > 0 and pw > 0").select(*by).withColumn("ty", reach("py", "ph")).withColumn("tx", reach("px", "pw"))
    boxes = asked.join(tiles.select(*keys, *raster.BOX, "data"), [*keys, "ty", "tx"])
    names = [*by, "oy", "ox", "oh", "ow", "data"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by] + [pa.int32()] * 4 + [pa.binary()]
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                top, left = row["ty"] * tile + row["y"], row["tx"] * tile + row["x"]
                y0, y1 = max(top, row["py"]), min(top + row["h"], row["py"] + row["ph"])
                x0, x1 = max(left, row["px"]), min(left + row["w"], row["px"] + row["pw"])
                if y0 < y1 and x0 < x1:
                    part = raster.box_of(row)[:, y0 - top : y1 - top, x0 - left : x1 - left]
                    cells = [*(row[c] for c in by), y0 - row["py"], x0 - row["px"], y1 - y0, x1 - x0, part.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, kinds, strict=True)], names)

    def paste(group: pa.Table) -> pa.Table:
        out = None
        for row in group.select(["ph", "pw", *names[len(by) :]]).to_pylist():
            part = np.frombuffer(row["data"], float).reshape(-1, row["oh"], row["ow"])
            if out is None:
                out = np.zeros((len(part), row["ph"], row["pw"]))
            out[:, row["oy"] : row["oy"] + row["oh"], row["ox"] : row["ox"] + row["ow"]] = part
        return group.select(by).slice(0, 1).append_column("data", pa.array([out.tobytes()], pa.binary()))

    parts = boxes.mapInArrow(cut, f"{_ddl(asked, by)}, oy int, ox int, oh int, ow int, data binary")
    return parts.groupBy(*by).applyInArrow(paste, f"{_ddl(asked, by)}, data binary")


def highpass(tiles: DataFrame, sizes: DataFrame, n: int, tile: int = raster.TILE) -> DataFrame:
    """Planes less what n smoothings leave of them."""

    def draw(row: dict) -> Iterator[raster.Box]:
        yield tuple(row[k] for k in PLANE), row["ty"] * tile + row["y"], row["tx"] * tile + row["x"], row["sign"] * raster.box_of(row)

    signed = tiles.withColumn("sign", F.lit(1.0)).unionByName(raster.smoothed(tiles, sizes, PLANE, n, tile).withColumn("sign", F.lit(-1.0)))
    return raster.from_rows(signed, draw, PLANE, tile=tile)


def _turn(c: float, s: float, w: int, h: int) -> tuple[float, float, int, int]:
    """Left, top, width and height of the box that a turned plane fills."""
    left, top, right, bottom = kernels.bounds(c, s, w, h)
    return left, top, int(np.ceil(right - left)), int(np.ceil(bottom - top))


def turned(tiles: DataFrame, sizes: DataFrame, tile: int = raster.TILE) -> tuple[DataFrame, DataFrame]:
    """H1: planes turned by ``angle_deg`` of ``sizes`` into their bounding boxes, and their sizes with left and top.

    A tile of the result needs the pixels under its turned outline and two beyond.
    """

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [_turn(np.cos(np.radians(r["angle_deg"])), np.sin(np.radians(r["angle_deg"])), r["canvas_w"], r["canvas_h"]) for r in rows]
            cells = [[f[3] for f in found], [f[2] for f in found], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(cells, [pa.int32(), pa.int32(), pa.float64(), pa.float64()], strict=True))], [*PLANE, "canvas_h", "canvas_w", "left", "top"])

    known = sizes.select(*PLANE, "canvas_h", "canvas_w", "angle_deg")
    boxes = known.mapInArrow(extent, f"{_ddl(known, PLANE)}, canvas_h int, canvas_w int, left double, top double")
    to = boxes.select(*PLANE, F.col("canvas_h").alias("to_h"), F.col("canvas_w").alias("to_w"), "left", "top").join(known, PLANE)
    each = lambda size: F.explode(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / tile).cast("int")))
    c, s = F.cos(F.radians("angle_deg")), F.sin(F.radians("angle_deg"))
    grid = to.withColumn("to_y", each("to_h")).withColumn("to_x", each("to_w"))
    y, x = ([F.col(f"to_{a}") * tile + F.col(o), F.least((F.col(f"to_{a}") + 1) * tile, F.col(f"to_{size}")) - 1 + F.col(o)] for a, o, size in (("y", "top", "h"), ("x", "left", "w")))
    sx, sy = [c * i + s * j for i in x for j in y], [c * j - s * i for i in x for j in y]
    low = lambda v: F.greatest(F.floor(F.least(*v)).cast("int") - 2, F.lit(0))
    high = lambda v, size: F.least(F.floor(F.greatest(*v)).cast("int") + 4, F.col(size).cast("int"))
    ids = ["to_y", "to_x", "to_h", "to_w", "left", "top", "angle_deg"]
    wanted = grid.select(*PLANE, *ids, low(sy).alias("py"), low(sx).alias("px"), high(sy, "canvas_h").alias("y1"), high(sx, "canvas_w").alias("x1"))
    wanted = wanted.select("*", (F.col("y1") - F.col("py")).alias("ph"), (F.col("x1") - F.col("px")).alias("pw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                cos, sin = np.cos(np.radians(row["angle_deg"])), np.sin(np.radians(row["angle_deg"]))
                h, w = (min(tile, row[f"to_{size}"] - row[f"to_{a}"] * tile) for a, size in (("y", "h"), ("x", "w")))
                v, u = np.mgrid[:h, :w]
                v, u = v + row["to_y"] * tile + row["top"], u + row["to_x"] * tile + row["left"]
                plane = np.frombuffer(row["data"], float).reshape(row["ph"], row["pw"])
                # The rectangle ends inside the plane only where no neighbour beyond it is read.
                values, valid = kernels.sample(plane, cos * u + sin * v - row["px"], cos * v - sin * u - row["py"])
                cells = [*(row[c] for c in PLANE), row["to_y"], row["to_x"], 0, 0, h, w, np.where(valid, values, 0.0).tobytes()]
                kinds = [*(batch.schema.field(c).type for c in PLANE), *[pa.int32()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([a], t) for a, t in zip(cells, kinds, strict=True)], [*PLANE, *raster.BOX, "data"])

    planes = patches(tiles, wanted, PLANE, ids, tile).mapInArrow(run, ", ".join([_ddl(known, PLANE), *(f"{b} int" for b in raster.BOX), "data binary"]))
    return planes, boxes


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs with heights and widths (ha, wa, hb, wb) of both planes."""
    side = lambda s: sizes.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.col("canvas_h").cast("int").alias(f"h{s}"), F.col("canvas_w").cast("int").alias(f"w{s}"))
    return pairs.join(side("a"), ["collage_id", "image_a"]).join(side("b"), ["collage_id", "image_b"])


def _side(tiles: DataFrame, s: str) -> DataFrame:
    return tiles.select("collage_id", F.col("image_id").alias(f"image_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in [*raster.BOX, "data"]))


def _box(row: dict, s: str, tile: int) -> tuple[int, int, np.ndarray]:
    """Top, left and values of one side's box."""
    return row[f"ty_{s}"] * tile + row[f"y_{s}"], row[f"tx_{s}"] * tile + row[f"x_{s}"], np.frombuffer(row[f"data_{s}"], float).reshape(row[f"h_{s}"], row[f"w_{s}"])


def _rows(df: DataFrame, find: Callable[[dict], tuple | None], schema: str) -> DataFrame:
    """Pairs with what ``find`` makes of each row; rows without a find go."""
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"integer": pa.int32(), "double": pa.float64()}
        for batch in batches:
            like = [*(batch.schema.field(c).type for c in PAIR), *(kinds[f.dataType.typeName()] for f in fields)]
            for k in range(batch.num_rows):
                row = raster.record(batch, k)
                found = find(row)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*(row[c] for c in PAIR), *found], like, strict=True)], [*PAIR, *(f.name for f in fields)])

    return df.mapInArrow(run, f"{_ddl(df, PAIR)}, {schema}")


def correlation(pairs: DataFrame, tiles: DataFrame, tile: int = raster.TILE) -> DataFrame:
    """H2: the scores of all displacements of each pair, a raster over (dy, dx).

    Each tile of the first plane meets each of the second; the product of two
    tiles is a box of displacements, and boxes add up inside tasks before and
    after the shuffle. Work is that of all meetings, so for planes of many tiles
    ``match`` is the way.
    """

    def draw(row: dict) -> Iterator[raster.Box]:
        (top_a, left_a, a), (top_b, left_b, b) = _box(row, "a", tile), _box(row, "b", tile)
        shape = a.shape[0] + b.shape[0] - 1, a.shape[1] + b.shape[1] - 1
        scores = np.fft.irfft2(np.fft.rfft2(a, shape) * np.conj(np.fft.rfft2(b, shape)), shape)
        back = b.shape[0] - 1, b.shape[1] - 1
        yield tuple(row[k] for k in PAIR), top_a - top_b - back[0], left_a - left_b - back[1], np.roll(scores, back, (0, 1))[None]

    both = pairs.select(*PAIR).join(_side(tiles, "a"), ["collage_id", "image_a"]).join(_side(tiles, "b"), ["collage_id", "image_b"])
    return raster.from_rows(both, draw, PAIR, tile=tile)


def best_displacement(scores: DataFrame, sizes: DataFrame, portion: float, tile: int = raster.TILE) -> DataFrame:
    """The displacement with the highest score among wide enough overlaps; on ties the last by (dy, dx)."""

    def find(row: dict) -> tuple | None:
        plane = raster.box_of(row)[0]
        dy, dx = (row[f"t{a}"] * tile + row[a] + np.arange(n) for a, n in (("y", row["h"]), ("x", row["w"])))
        least = max(round(portion * min(row["ha"], row["hb"], row["wa"], row["wb"])), 1)
        oy, ox = (np.minimum(row[f"{a}a"], row[f"{a}b"] + d) - np.maximum(0, d) for a, d in (("h", dy), ("w", dx)))
        ok = (oy >= least)[:, None] & (ox >= least)[None, :]
        if not ok.any():
            return None
        ranked = np.where(ok, np.round(plane, 9), -np.inf)
        i, j = divmod(ranked.size - 1 - int(np.argmax(ranked.ravel()[::-1])), ranked.shape[1])
        return float(ranked[i, j]), int(dy[i]), int(dx[j]), float(plane[i, j])

    best = _rows(_sized(scores, sizes), find, "ranked double, dy int, dx int, score double")
    best = best.groupBy(*PAIR).agg(F.max(F.struct("ranked", "dy", "dx", "score")).alias("m"))
    return best.select(*PAIR, "m.dx", "m.dy", "m.score")


def _overlap(moved: DataFrame) -> DataFrame:
    """The overlap (left, top, w, h) in the first plane after a displacement."""
    left, top = F.greatest(F.lit(0), "dx"), F.greatest(F.lit(0), "dy")
    return moved.withColumn("left", left).withColumn("top", top).withColumn("w", F.least(F.col("wa"), F.col("wb") + F.col("dx")) - left).withColumn("h", F.least(F.col("ha"), F.col("hb") + F.col("dy")) - top)


def difference(moves: DataFrame, tiles: DataFrame, sizes: DataFrame, tile: int = raster.TILE) -> DataFrame:
    """``moves`` (with dx, dy) and the root mean square difference within the overlap, from sums of the tiles that meet there."""
    over = _overlap(_sized(moves.select(*PAIR, "dx", "dy"), sizes)).where("w > 0 and h > 0")
    first = over.join(_side(tiles, "a"), ["collage_id", "image_a"])
    touches = lambda t, start, size: (F.col(t) * tile < F.col(start) + F.col(size)) & ((F.col(t) + 1) * tile > F.col(start))
    first = first.where(touches("ty_a", "top", "h") & touches("tx_a", "left", "w"))
    under = lambda t, d: F.explode(F.sequence(F.floor((F.col(t) * tile - F.col(d)) / tile).cast("int"), F.floor((F.col(t) * tile + tile - 1 - F.col(d)) / tile).cast("int")))
    both = first.withColumn("ty_b", under("ty_a", "dy")).withColumn("tx_b", under("tx_a", "dx")).join(_side(tiles, "b"), ["collage_id", "image_b", "ty_b", "tx_b"])

    def find(row: dict) -> tuple | None:
        (top_a, left_a, a), (top_b, left_b, b) = _box(row, "a", tile), _box(row, "b", tile)
        top_b, left_b = top_b + row["dy"], left_b + row["dx"]
        y0, x0 = max(top_a, top_b), max(left_a, left_b)
        y1, x1 = min(top_a + a.shape[0], top_b + b.shape[0]), min(left_a + a.shape[1], left_b + b.shape[1])
        if y0 >= y1 or x0 >= x1:
            return None
        d = a[y0 - top_a : y1 - top_a, x0 - left_a : x1 - left_a] - b[y0 - top_b : y1 - top_b, x0 - left_b : x1 - left_b]
        return (float((d * d).sum()),)

    sums = _rows(both, find, "s double").groupBy(*PAIR).agg(F.sum("s").alias("s"))
    found = over.join(sums, PAIR, "left").select(*PAIR, F.sqrt(F.coalesce("s", F.lit(0.0)) / (F.col("w") * F.col("h"))).alias("difference"))
    return moves.join(found, PAIR, "left").withColumn("difference", F.coalesce("difference", F.lit(float("inf"))))


def match_once(pairs: DataFrame, tiles: DataFrame, sizes: DataFrame, portion: float = 0.25, tile: int = raster.TILE) -> DataFrame:
    """H2: displacement, score and difference of each pair at full size."""
    return difference(best_displacement(correlation(pairs, tiles, tile), sizes, portion, tile), tiles, sizes, tile)


def shrunk(tiles: DataFrame, factors: DataFrame, tile: int = raster.TILE) -> DataFrame:
    """A4: (collage_id, image_id, ky, kx, ph, pw, data), whole planes of block means; incomplete blocks are dropped.

    ``factors``: collage_id, image_id, canvas_h, canvas_w, ky, kx. Tiles become sums before the shuffle.
    """
    keys = [*PLANE, "ky", "kx"]

    def draw(row: dict) -> Iterator[raster.Box]:
        top, left, ky, kx = row["ty"] * tile + row["y"], row["tx"] * tile + row["x"], row["ky"], row["kx"]
        planes = raster.box_of(row)[:, : max(row["canvas_h"] // ky * ky - top, 0), : max(row["canvas_w"] // kx * kx - left, 0)]
        if planes.size:
            starts = lambda at, n, k: np.unique(np.maximum(np.arange(at // k, (at + n - 1) // k + 1) * k - at, 0))
            sums = np.add.reduceat(np.add.reduceat(planes, starts(top, planes.shape[1], ky), 1), starts(left, planes.shape[2], kx), 2)
            yield tuple(row[k] for k in keys), top // ky, left // kx, sums / (ky * kx)

    small = raster.from_rows(tiles.join(factors, PLANE), draw, keys, tile=tile)
    whole = factors.select(*keys, F.lit(0).alias("py"), F.lit(0).alias("px"), F.floor(F.col("canvas_h") / F.col("ky")).cast("int").alias("ph"), F.floor(F.col("canvas_w") / F.col("kx")).cast("int").alias("pw"))
    return patches(small, whole, keys, tile=tile).drop("py", "px")


def _plane(row: dict, s: str) -> np.ndarray:
    return np.frombuffer(row[f"data_{s}"], float).reshape(row[f"ph_{s}"], row[f"pw_{s}"])


def coarse(pairs: DataFrame, tiles: DataFrame, sizes: DataFrame, pad: int, portion: float, tile: int = raster.TILE) -> DataFrame:
    """Displacements by a match of planes shrunk to the pad size."""
    least = F.floor(portion * F.least("ha", "wa", "hb", "wb"))
    factor = lambda a: F.greatest(F.lit(1), F.ceil((F.col(f"{a}a") + F.col(f"{a}b") - least) / pad)).cast("int")
    known = _sized(pairs.select(*PAIR), sizes).withColumn("ky", factor("h")).withColumn("kx", factor("w"))
    of = lambda s: known.select("collage_id", F.col(f"image_{s}").alias("image_id"), F.col(f"h{s}").alias("canvas_h"), F.col(f"w{s}").alias("canvas_w"), "ky", "kx")
    small = shrunk(tiles, of("a").unionByName(of("b")).distinct(), tile)
    side = lambda s: small.select("collage_id", F.col("image_id").alias(f"image_{s}"), "ky", "kx", *(F.col(c).alias(f"{c}_{s}") for c in ("ph", "pw", "data")))
    both = known.join(side("a"), ["collage_id", "image_a", "ky", "kx"]).join(side("b"), ["collage_id", "image_b", "ky", "kx"]).repartition(*PAIR)

    def find(row: dict) -> tuple | None:
        a, b = _plane(row, "a"), _plane(row, "b")
        found = kernels.correlate(a, b, round(portion * min(*a.shape, *b.shape)))
        return None if found is None else (found[1] * row["kx"], found[2] * row["ky"])

    return _rows(both, find, "dx int, dy int")


def match(pairs: DataFrame, tiles: DataFrame, sizes: DataFrame, pad: int = 1024, portion: float = 0.25, maximum: float = 0.2, tile: int = raster.TILE, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Displacement, difference and verdict of each pair, by FFT on shrunk planes and then on clips.

    Clips come from the few tiles under them, differences are sums by pairs of
    tiles. ``keep`` may write displacements and read them again, so that they are found once.
    """
    rough = _overlap(_sized(keep(coarse(pairs, tiles, sizes, pad, portion, tile)), sizes))
    rough = rough.withColumn("pw", F.least(F.col("w"), F.lit(pad // 2))).withColumn("ph", F.least(F.col("h"), F.lit(pad // 2)))
    at = lambda start, size, clip: F.col(start) + F.floor((F.col(size) - F.col(clip)) / 2).cast("int")
    rough = rough.withColumn("py", at("top", "h", "ph")).withColumn("px", at("left", "w", "pw"))
    clip = lambda s: rough.select("collage_id", F.col(f"image_{s}").alias("image_id"), "image_a", "image_b", F.lit(s).alias("side"), *((F.col("py"), F.col("px")) if s == "a" else ((F.col("py") - F.col("dy")).alias("py"), (F.col("px") - F.col("dx")).alias("px"))), "ph", "pw")
    clips = keep(patches(tiles, clip("a").unionByName(clip("b")), PLANE, ["image_a", "image_b", "side"], tile))
    side = lambda s: clips.where(F.col("side") == s).select(*PAIR, *(F.col(c).alias(f"{c}_{s}") for c in ("ph", "pw", "data")))

    def find(row: dict) -> tuple | None:
        found = kernels.correlate(_plane(row, "a"), _plane(row, "b"), round(portion * min(row["ph_a"], row["pw_a"])))
        return None if found is None else (found[1], found[2])

    fine = _rows(side("a").join(side("b"), PAIR), find, "fx int, fy int")
    moves = rough.select(*PAIR, "dx", "dy").join(fine, PAIR, "left")
    moves = keep(moves.select(*PAIR, *((F.col(f"d{a}") + F.coalesce(f"f{a}", F.lit(0))).alias(f"d{a}") for a in ("x", "y"))))
    return difference(moves, tiles, sizes, tile).withColumn("overlaps", F.col("difference") < maximum)
