"""Rasters as tables of tiles.

A raster has a key (a collage, or an image of one, or a pair) and tiles of
``TILE`` by ``TILE`` pixels of its canvas. A row is a box of a tile:

    key..., ty, tx (tile), y, x, h, w (box inside the tile), data

``data`` packs the planes of the box, doubles in row order. Images become boxes
inside their tasks, boxes of one tile are merged in the task that makes them
and once more after the shuffle, one box at a time. So a pixel costs a few
bytes in the shuffle, not a row, and a task holds single tiles, however many
images cover one and however large a canvas is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

TILE = 256
#: Bytes of tiles that a task merges before it sends them off.
HELD_BYTES = 64 << 20
BOX = ["ty", "tx", "y", "x", "h", "w"]
Box = tuple[tuple, int, int, np.ndarray]  # key, top and left on the canvas, planes


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} int" for c in BOX), "data binary"])


def pieces(top: int, left: int, planes: np.ndarray, tile: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """A box of planes (at canvas pixel ``top``, ``left``) cut at the borders of tiles: ty, tx, y and x in the tile, planes."""
    _, h, w = planes.shape
    for ty in range(top // tile, (top + h - 1) // tile + 1 if h else top // tile):
        for tx in range(left // tile, (left + w - 1) // tile + 1 if w else left // tile):
            y0, x0 = max(top, ty * tile), max(left, tx * tile)
            part = planes[:, y0 - top : min(top + h, (ty + 1) * tile) - top, x0 - left : min(left + w, (tx + 1) * tile) - left]
            yield ty, tx, y0 - ty * tile, x0 - tx * tile, part


def add(have: np.ndarray, new: np.ndarray) -> None:
    """Sums of all planes."""
    have += new


def last(have: np.ndarray, new: np.ndarray) -> None:
    """The planes of the highest first plane; later ones win ties."""
    wins = new[0] >= have[0]
    have[:, wins] = new[:, wins]


class _Tiles:
    """Tiles under construction, each with the box that it fills."""

    def __init__(self, merge: Callable, tile: int, empty: float) -> None:
        self.merge, self.tile, self.empty, self.held, self.bytes = merge, tile, empty, {}, 0

    def put(self, key: tuple, y: int, x: int, planes: np.ndarray) -> None:
        n, h, w = planes.shape
        if key not in self.held:
            self.held[key] = [np.full((n, self.tile, self.tile), self.empty), y, x, y + h, x + w]
            self.bytes += self.held[key][0].nbytes
        have = self.held[key]
        self.merge(have[0][:, y : y + h, x : x + w], planes)
        have[1:] = [min(have[1], y), min(have[2], x), max(have[3], y + h), max(have[4], x + w)]

    def take(self) -> Iterator[tuple]:
        for key, (planes, y0, x0, y1, x1) in self.held.items():
            yield *key, y0, x0, y1 - y0, x1 - x0, planes[:, y0:y1, x0:x1].tobytes()
        self.held, self.bytes = {}, 0


def record(batch: pa.RecordBatch, k: int) -> dict:
    """Row ``k`` with arrays of numbers as NumPy arrays."""
    number = lambda t: pa.types.is_list(t) and (pa.types.is_floating(t.value_type) or pa.types.is_integer(t.value_type))
    cells = ((f.name, c[k], f.type) for f, c in zip(batch.schema, batch.columns, strict=True))
    return {name: cell.values.to_numpy(zero_copy_only=False) if number(kind) and cell.is_valid else cell.as_py() for name, cell, kind in cells}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _fields(keys: Sequence[str], like: pa.Schema) -> pa.Schema:
    return pa.schema([*(pa.field(k, like.field(k).type) for k in keys), *(pa.field(c, pa.int32()) for c in BOX), pa.field("data", pa.binary())])


def box_of(row: dict) -> np.ndarray:
    """The planes of a row."""
    return np.frombuffer(row["data"], float).reshape(-1, row["h"], row["w"])


def from_rows(rows: DataFrame, draw: Callable[[dict], Iterator[Box]], keys: Sequence[str], merge: Callable = add, tile: int = TILE, empty: float = 0.0) -> DataFrame:
    """The raster of what ``draw`` makes of each row: (key, top, left, planes), planes of equal number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, fields = _Tiles(merge, tile, empty), None
        for batch in batches:
            fields = _fields(keys, batch.schema)
            for k in range(batch.num_rows):
                for key, top, left, planes in draw(record(batch, k)):
                    for ty, tx, y, x, part in pieces(top, left, planes, tile):
                        tiles.put((*key, ty, tx), y, x, part)
                        if tiles.bytes > HELD_BYTES:
                            yield from (_batch([r], fields) for r in tiles.take())
        yield from (_batch([r], fields) for r in tiles.take())

    return merged(rows.mapInArrow(run, _schema(rows, keys)), keys, merge, tile, empty)


def merged(boxes: DataFrame, keys: Sequence[str], merge: Callable = add, tile: int = TILE, empty: float = 0.0) -> DataFrame:
    """One row for each tile, from any number of boxes; they come one after the other, so a tile that many images cover needs no more memory."""
    by = [*keys, "ty", "tx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, fields = _Tiles(merge, tile, empty), None
        for batch in batches:
            fields = batch.schema
            for k in range(batch.num_rows):
                row = record(batch, k)
                key = tuple(row[c] for c in by)
                if tiles.held and key not in tiles.held:
                    yield from (_batch([r], fields) for r in tiles.take())
                tiles.put(key, row["y"], row["x"], box_of(row))
        yield from (_batch([r], fields) for r in tiles.take())

    return boxes.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, boxes.schema)


def to_pixels(raster: DataFrame, keys: Sequence[str], read: Callable[[np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], columns: str, tile: int = TILE) -> DataFrame:
    """Rows (key, y, x, columns) of the pixels for which ``read`` of a box's planes gives true, with its values."""
    names = [c.split()[0] for c in columns.split(", ") if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = record(batch, k)
                there, values = read(box_of(row))
                y, x = np.nonzero(there)
                arrays = [*(pa.array([row[c]] * len(y), batch.schema.field(c).type) for c in keys), pa.array((y + row["y"] + row["ty"] * tile).astype(np.int32)), pa.array((x + row["x"] + row["tx"] * tile).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(values[c][there]) for c in names)], [*keys, "y", "x", *names])

    return raster.mapInArrow(run, ", ".join([*(f"{k} {raster.schema[k].dataType.simpleString()}" for k in keys), "y int, x int", *([columns] if columns else [])]))


def with_margin(raster: DataFrame, sizes: DataFrame, keys: Sequence[str], margin: int, tile: int = TILE) -> DataFrame:
    """Each tile of the raster, and each tile within ``margin`` of one, with the pixels up to ``margin`` beyond its borders.

    Tiles send each tile around them the strip that it needs. ``sizes`` has the
    canvas of each key (its columns among ``keys``, canvas_h, canvas_w). Pixels
    that no box has are 0, those beyond the canvas don't exist: the row's box
    ends there (y, x are negative where it begins before the tile).
    """
    on = [k for k in keys if k in sizes.columns]
    reach = -(-margin // tile)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _fields(keys, batch.schema).append(pa.field("canvas_h", pa.int64())).append(pa.field("canvas_w", pa.int64()))
            for k in range(batch.num_rows):
                row = record(batch, k)
                planes, out = box_of(row), []
                top, left = row["ty"] * tile + row["y"], row["tx"] * tile + row["x"]
                tops, lefts = range(max(0, row["ty"] - reach), row["ty"] + reach + 1), range(max(0, row["tx"] - reach), row["tx"] + reach + 1)
                for ty in tops:
                    y0, y1 = max(top, ty * tile - margin), min(top + row["h"], (ty + 1) * tile + margin)
                    for tx in lefts:
                        x0, x1 = max(left, tx * tile - margin), min(left + row["w"], (tx + 1) * tile + margin)
                        if y0 < y1 and x0 < x1 and ty * tile < row["canvas_h"] and tx * tile < row["canvas_w"]:
                            out.append((*(row[c] for c in keys), ty, tx, y0 - ty * tile, x0 - tx * tile, y1 - y0, x1 - x0, planes[:, y0 - top : y1 - top, x0 - left : x1 - left].tobytes(), row["canvas_h"], row["canvas_w"]))
                yield from (_batch([r], schema) for r in out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = wide = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = record(batch, k)
                planes = box_of(row)
                now = tuple(row[c] for c in [*keys, "ty", "tx"])
                if now != key:
                    if wide is not None:
                        yield packed(key, wide, at, batch.schema)  # noqa: F821
                    key = now
                    y0, x0 = max(-margin, -now[-2] * tile), max(-margin, -now[-1] * tile)
                    y1, x1 = min(tile + margin, row["canvas_h"] - now[-2] * tile), min(tile + margin, row["canvas_w"] - now[-1] * tile)
                    wide, at = np.zeros((len(planes), y1 - y0, x1 - x0)), (y0, x0, row["canvas_h"], row["canvas_w"])
                y, x = row["y"] - at[0], row["x"] - at[1]
                h, w = min(row["h"], wide.shape[1] - y), min(row["w"], wide.shape[2] - x)  # boxes may reach beyond the canvas
                wide[:, y : y + h, x : x + w] = planes[:, :h, :w]
        if wide is not None:
            yield packed(key, wide, at, batch.schema)

    def packed(key: tuple, wide: np.ndarray, at: tuple, schema: pa.Schema) -> pa.RecordBatch:
        return _batch([(*key, at[0], at[1], wide.shape[1], wide.shape[2], wide.tobytes(), at[2], at[3])], schema)

    by = [*keys, "ty", "tx"]
    schema = f"{_schema(raster, keys)}, canvas_h bigint, canvas_w bigint"
    known = raster.join(sizes.select(*on, F.col("canvas_h").cast("long").alias("canvas_h"), F.col("canvas_w").cast("long").alias("canvas_w")), on).select(*raster.columns, "canvas_h", "canvas_w")
    return known.mapInArrow(send, schema).repartition(*by).sortWithinPartitions(*by).mapInArrow(join, schema)


def smoothed(raster: DataFrame, sizes: DataFrame, keys: Sequence[str], n: int, tile: int = TILE) -> DataFrame:
    """H4: all planes smoothed n times over the whole canvas, clamped at its border; 0 where the raster has no pixels.

    A tile only needs the pixels up to n beyond it. Tiles that the smoothing reaches come out too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = _fields(keys, batch.schema)
            for k in range(batch.num_rows):
                row = record(batch, k)
                planes, y0, x0 = box_of(row), -row["y"], -row["x"]
                h, w = min(tile, row["h"] - y0), min(tile, row["w"] - x0)
                # What is wrong at the borders of the margin stays outside the tile.
                low = np.stack([kernels.smooth(p, n)[y0 : y0 + h, x0 : x0 + w] for p in planes])
                yield _batch([(*(row[c] for c in keys), row["ty"], row["tx"], 0, 0, h, w, low.tobytes())], fields)

    return with_margin(raster, sizes, keys, n, tile).mapInArrow(run, _schema(raster, keys))


def overview(raster: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """SNK5: the raster at half the size, sums of two by two pixels; means if the first plane is a number of values and the others are sums."""

    def draw(row: dict) -> Iterator[Box]:
        planes = box_of(row)
        top, left = row["ty"] * tile + row["y"], row["tx"] * tile + row["x"]
        wide = np.pad(planes, ((0, 0), (top % 2, (top + row["h"]) % 2), (left % 2, (left + row["w"]) % 2)))
        n, h, w = wide.shape
        yield tuple(row[k] for k in keys), top // 2, left // 2, wide.reshape(n, h // 2, 2, w // 2, 2).sum(axis=(2, 4))

    return from_rows(raster, draw, keys, add, tile)
