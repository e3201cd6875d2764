"""Planes as tiles beside the kernels on whole planes."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.jobs import collage
from tessera.operators import blocks, matching, orient, raster

TILE = 16
#: Places of the planes in one large picture, and their sizes: no multiples of the tile.
PLACES = {(0, 1): (0, 0, 61, 75), (0, 2): (9, 31, 58, 70), (0, 3): (33, 12, 70, 49), (1, 1): (5, 5, 40, 17), (1, 2): (12, 8, 37, 16)}
PAIRS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 1, 2)]


@pytest.fixture(scope="module")
def planes():
    picture = kernels.smooth(np.random.default_rng(3).standard_normal((130, 130)), 2)
    return {k: picture[y : y + h, x : x + w] for k, (y, x, h, w) in PLACES.items()}


@pytest.fixture(scope="module")
def images(spark, planes):
    rows = [(*k, *p.shape, p.ravel().tolist()) for k, p in planes.items()]
    return spark.createDataFrame(rows, "collage_id long, image_id int, height int, width int, data array<double>").cache()


@pytest.fixture(scope="module")
def tiles(images):
    return blocks.tiles_of(images, TILE).cache()


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "collage_id long, image_a int, image_b int")


def whole(tiles, shapes: dict) -> dict:
    out = {k: np.zeros(s) for k, s in shapes.items()}
    for r in tiles.collect():
        y, x = r["ty"] * TILE + r["y"], r["tx"] * TILE + r["x"]
        out[r["collage_id"], r["image_id"]][y : y + r["h"], x : x + r["w"]] += raster.box_of(r.asDict())[0]
    return out


def rows(df, *columns: str) -> dict:
    return {tuple(r[c] for c in matching.PAIR): tuple(r[c] for c in columns) for r in df.collect()}


def test_tiles_are_small_and_hold_all_pixels(tiles, planes):
    assert max(max(r["h"], r["w"]) for r in tiles.select("h", "w").collect()) == TILE
    for k, p in whole(tiles, {k: p.shape for k, p in planes.items()}).items():
        np.testing.assert_array_equal(p, planes[k])


def test_full_correlation_equals_one_fft(images, tiles, pairs, planes):
    found = rows(blocks.match_once(pairs, tiles, blocks.sizes_of(images), 0.25, TILE), "dx", "dy", "score", "difference")
    assert set(found) == set(PAIRS)
    for (c, a, b), (dx, dy, score, difference) in found.items():
        pa, pb = planes[c, a], planes[c, b]
        best = kernels.correlate(pa, pb, round(0.25 * min(*pa.shape, *pb.shape)))
        assert (dx, dy) == best[1:] and score == pytest.approx(best[0]) and difference == pytest.approx(kernels.rms(pa, pb, dx, dy))


def test_all_scores_equal_sums_of_products(tiles, pairs, planes):
    pa, pb = planes[1, 1], planes[1, 2]
    scores = {}
    for r in blocks.correlation(pairs.where("collage_id = 1"), tiles, TILE).collect():
        box = raster.box_of(r.asDict())[0]
        scores |= {(r["ty"] * TILE + r["y"] + i, r["tx"] * TILE + r["x"] + j): box[i, j] for i in range(r["h"]) for j in range(r["w"])}
    for dy in range(1 - pb.shape[0], pa.shape[0]):
        for dx in range(1 - pb.shape[1], pa.shape[1]):
            left, top, w, h = kernels.overlap(pa.shape, pb.shape, dx, dy)
            wanted = (pa[top : top + h, left : left + w] * pb[top - dy : top - dy + h, left - dx : left - dx + w]).sum()
            assert scores[dy, dx] == pytest.approx(wanted, abs=1e-9)


@pytest.mark.parametrize("pad", [24, 50, 200])
def test_coarse_to_fine_equals_whole_planes(images, tiles, pairs, planes, pad):
    found = rows(blocks.match(pairs, tiles, blocks.sizes_of(images), pad, 0.25, 0.2, TILE), "dx", "dy", "difference")
    wanted = {(c, a, b): kernels.coarse_to_fine(planes[c, a], planes[c, b], pad, 0.25) for c, a, b in PAIRS}
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in wanted.items() if v is not None}
    for k, v in found.items():
        assert v[2] == pytest.approx(wanted[k][2], abs=1e-9)


def test_a_true_displacement_is_found(images, tiles, pairs):
    found = rows(blocks.match(pairs, tiles, blocks.sizes_of(images), 50, 0.25, 0.05, TILE), "dx", "dy", "overlaps")
    for c, a, b in PAIRS[:2]:
        (ya, xa, *_), (yb, xb, *_) = PLACES[c, a], PLACES[c, b]
        assert found[c, a, b] == (xb - xa, yb - ya, True)


def test_planes_that_share_too_little_have_no_match(spark, images, tiles):
    pairs = spark.createDataFrame([(0, 1, 9), (7, 1, 2)], "collage_id long, image_a int, image_b int")
    assert blocks.match(pairs, tiles, blocks.sizes_of(images), 50, tile=TILE).count() == 0
    assert blocks.match(pairs.limit(0), tiles, blocks.sizes_of(images), 50, tile=TILE).count() == 0


def test_shrunk_planes(tiles, images, planes):
    from pyspark.sql import functions as F

    factors = blocks.sizes_of(images).withColumn("ky", F.lit(3)).withColumn("kx", F.lit(5))
    for r in blocks.shrunk(tiles, factors, TILE).collect():
        small = np.frombuffer(r["data"]).reshape(r["ph"], r["pw"])
        np.testing.assert_allclose(small, kernels.shrink(planes[r["collage_id"], r["image_id"]], 3, 5), atol=1e-12)


def test_highpass_equals_whole_planes(tiles, images, planes):
    high = whole(blocks.highpass(tiles, blocks.sizes_of(images), 20, TILE), {k: p.shape for k, p in planes.items()})
    for k, p in planes.items():
        np.testing.assert_allclose(high[k], p - kernels.smooth(p, 20), atol=1e-9)


@pytest.mark.parametrize("angle", [0.0, 0.7, -3.0, 40.0])
def test_turned_tiles_equal_turned_planes(tiles, images, planes, angle):
    from pyspark.sql import functions as F

    found, sizes = blocks.turned(tiles, blocks.sizes_of(images).withColumn("angle_deg", F.lit(angle)), TILE)
    sizes = {(r["collage_id"], r["image_id"]): r for r in sizes.collect()}
    got = whole(found, {k: (r["canvas_h"], r["canvas_w"]) for k, r in sizes.items()})
    for k, p in planes.items():
        v, left, top = kernels.turn(p, angle)
        np.testing.assert_allclose(got[k], v, atol=1e-9)
        assert (sizes[k]["left"], sizes[k]["top"]) == pytest.approx((left, top))


def test_few_angles_then_fine_ones(spark):
    """Pictures of lines, turned by known angles: the search by levels ends within two steps of the true angle and of the search of all angles."""
    wanted, rows_ = [], []
    for seed in (8, 9, 10):
        rng = np.random.default_rng(seed)
        lines = np.repeat(kernels.smooth(rng.random((220, 1)), 1), 200, axis=1) + 0.02 * rng.random((220, 200))
        for angle in (-0.85, -0.4, 0.0, 0.15, 0.6, 1.0):
            cut = kernels.turn(lines, -angle)[0][10:-10, 10:-10]
            rows_.append((0, len(wanted), *cut.shape, cut.ravel().tolist()))
            wanted.append(angle)
    images = spark.createDataFrame(rows_, "collage_id long, image_id int, height int, width int, data array<double>").cache()
    full, found = ({r["image_id"]: r["angle_deg"] for r in f(images).collect()} for f in (orient.find_angles, orient.find_angles_by_levels))
    assert found == pytest.approx(full, abs=0.1001)
    assert found == pytest.approx(dict(enumerate(wanted)), abs=0.1001)
    parts = images.selectExpr("collage_id", "image_id", "if(image_id = 0, 0.25D, null) as angle_deg")
    oriented = {r["image_id"]: r["angle_deg"] for r in collage.orient_images(parts, images, levels=3).collect()}
    assert oriented == {**found, 0: 0.25}
