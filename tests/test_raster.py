"""Tiled rasters beside whole canvases."""

from __future__ import annotations

import heapq

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import canvas, graph, raster, seams

TILE = 16
#: Two collages; in the first one, two pairs of images overlap far from each other.
PLACES = [(0, 1, 0.0, 3.0, 2.0), (0, 2, 1.0, 14.0, 9.0), (0, 3, 0.0, 60.0, 50.0), (0, 4, -2.0, 71.0, 55.5), (0, 5, 0.0, 30.0, 80.0), (1, 1, 0.5, 4.0, 4.0), (1, 2, 0.0, 20.0, 8.0), (1, 3, 0.0, 12.0, 19.0)]
SHAPE = (23, 27)


@pytest.fixture(scope="module")
def placed(spark):
    rng = np.random.default_rng(5)
    geometry, images = [], []
    for c, i, degrees, x, y in PLACES:
        a = np.radians(degrees)
        geometry.append((c, i, float(np.cos(a)), float(np.sin(a)), x, y, SHAPE[1], SHAPE[0]))
        v = kernels.smooth(rng.random(SHAPE), 2)
        images.append((c, i, *SHAPE, v.ravel().tolist(), (1 - v).ravel().tolist()))
    g = spark.createDataFrame(geometry, "collage_id long, image_id int, c double, s double, mx double, my double, w int, h int").cache()
    return g, spark.createDataFrame(images, "collage_id long, image_id int, height int, width int, data array<double>, cb array<double>").cache()


def whole(placed) -> dict:
    """By collage: canvas shape, and mask and values of each image on the whole canvas."""
    g, images = (df.collect() for df in placed)
    planes = {(r["collage_id"], r["image_id"]): np.array(r["data"]).reshape(SHAPE) for r in images}
    out = {}
    for c in (0, 1):
        mine = [r.asDict() for r in g if r["collage_id"] == c]
        boxes = [kernels.bounds(r["c"], r["s"], r["w"], r["h"]) for r in mine]
        shape = int(np.ceil(max(b[3] + r["my"] for b, r in zip(boxes, mine)))), int(np.ceil(max(b[2] + r["mx"] for b, r in zip(boxes, mine))))
        parts = {}
        for r in mine:
            y, x, sx, sy = kernels.grid(r)
            mask, v = np.zeros(shape, bool), np.zeros(shape)
            mask[y, x], v[y, x] = True, kernels.sample(planes[c, r["image_id"]], sx, sy)[0]
            parts[r["image_id"]] = mask, v
        out[c] = shape, parts
    return out


def passes(plane: np.ndarray, n: int) -> np.ndarray:
    """Smoothing by single passes over the whole canvas."""
    for _ in range(n):
        for axis in (0, 1):
            p = np.pad(plane, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], "edge")
            low, mid, high = (np.take(p, np.arange(k, k + plane.shape[axis]), axis) for k in range(3))
            plane = (low + 2 * mid + high) / 4
    return plane


def sequential(shape: tuple, parts: dict, n: int) -> dict:
    """Masks after one queue for the whole canvas, which smooths differences over the whole canvas."""
    count = sum(m.astype(int) for m, _ in parts.values())
    mean = sum(v for _, v in parts.values()) / np.maximum(count, 1)
    diffs = {i: np.round(passes(np.abs(v - mean) * m, n), seams.DIGITS) for i, (m, v) in parts.items()}
    masks = {i: m.copy() for i, (m, _) in parts.items()}
    queue, seen = [], set()

    def push(i, y, x):
        if 0 <= y < shape[0] and 0 <= x < shape[1] and masks[i][y, x] and (i, y, x) not in seen:
            seen.add((i, y, x))
            heapq.heappush(queue, (-diffs[i][y, x], i, y, x))

    for i, m in masks.items():
        for y, x in zip(*np.nonzero(m)):
            if y == np.nonzero(m[:, x])[0][0] or y == np.nonzero(m[:, x])[0][-1] or x == np.nonzero(m[y])[0][0] or x == np.nonzero(m[y])[0][-1]:
                push(i, int(y), int(x))
    while queue:
        _, i, y, x = heapq.heappop(queue)
        if count[y, x] > 1:
            masks[i][y, x] = False
            count[y, x] -= 1
            for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                push(i, v, u)
    return masks


def pixels(df, *values) -> dict:
    return {(r["collage_id"], r["y"], r["x"]): tuple(r[v] for v in values) for r in df.collect()}


@pytest.mark.parametrize("tile", [TILE, 256])
def test_mean_owner_and_distance_canvases(placed, tile):
    g, images = placed
    mean = pixels(canvas.average_pixels(canvas.average_tiles(g, images, tile=tile), tile=tile), "n", "v")
    owner = pixels(canvas.owner_pixels(canvas.owner_tiles(g, images, tile=tile), tile=tile), "image_id", "v")
    weighted = pixels(canvas.blend_by_distance(g, images, tile=tile), "v")
    rows = canvas.resample(g, images).cache()
    assert set(mean) == set(owner) == set(weighted) == set(pixels(rows))
    same = lambda a, b: np.allclose([v for k in sorted(a) for v in a[k]], [v for k in sorted(a) for v in b[k]], atol=1e-9)
    assert same(mean, pixels(canvas.average_canvas(rows), "n", "v"))
    assert same(owner, pixels(canvas.owner(rows), "image_id", "v"))
    assert same(weighted, pixels(canvas.weighted_canvas(rows, canvas.distance_map(g)), "v"))


def test_special_points_beside_joins(placed):
    g, _ = placed
    want: dict = {}
    for r in canvas.special_points(g).collect():
        want.setdefault((r["collage_id"], r["image_id"]), []).append((round(r["x"], 9), round(r["y"], 9)))
    for r in canvas._surrounded(g).collect():
        got = kernels.special_points(r.asDict(), [o.asDict() for o in r["others"] or []])
        assert sorted((round(x, 9), round(y, 9)) for x, y in got) == sorted(want.get((r["collage_id"], r["image_id"]), []))


@pytest.mark.parametrize("n", [1, 7, 40])
def test_smoothing_over_tiles(placed, n):
    g, images = placed
    on = seams.placed(g, images, tile=TILE)
    low = raster.smoothed(on, canvas.sizes(g), seams.IMAGE, n, TILE)
    got: dict = {}
    for r in low.collect():
        box = raster.box_of(r.asDict())
        for k in (0, 1):
            plane = got.setdefault((r["collage_id"], r["image_id"], k), np.zeros((120, 120)))
            plane[r["ty"] * TILE : r["ty"] * TILE + r["h"], r["tx"] * TILE : r["tx"] * TILE + r["w"]] = box[k]
    for c, (shape, parts) in whole(placed).items():
        for i, planes in parts.items():
            for k, plane in enumerate(planes):
                found = got[c, i, k]
                assert np.allclose(found[: shape[0], : shape[1]], passes(plane.astype(float), n), atol=1e-12)
                assert not found[shape[0] :].any() and not found[:, shape[1] :].any()


def test_labels():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        mask = rng.random((40, 33)) < share
        found = kernels.labels(mask)
        assert ((found > 0) == mask).all()
        left = set(zip(*(a.tolist() for a in np.nonzero(mask))))
        while left:
            group, open_ = set(), [left.pop()]
            while open_:
                y, x = open_.pop()
                group.add((y, x))
                for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if p in left:
                        left.remove(p)
                        open_.append(p)
            first = min(group)
            assert {int(found[p]) for p in group} == {first[0] * 33 + first[1] + 1}


def test_regions_are_joined_across_tiles(placed):
    g, images = placed
    covered = seams.cover(seams.placed(g, images, tile=TILE), TILE)
    found: dict = {}
    for r in raster.to_pixels(seams.regions(covered, TILE), seams.COLLAGE, lambda p: (p[0] > 0, {"region": p[0]}), "region double", TILE).collect():
        found.setdefault((r["collage_id"], r["region"]), set()).add((r["y"], r["x"]))
    want = []
    for c, (_, parts) in whole(placed).items():
        names = kernels.labels(sum(m.astype(int) for m, _ in parts.values()) > 1)
        want += [(c, {(int(y), int(x)) for y, x in zip(*np.nonzero(names == k))}) for k in np.unique(names[names > 0])]
    assert len(want) >= 3
    assert sorted((c, sorted(p)) for (c, _), p in found.items()) == sorted((c, sorted(p)) for c, p in want)


@pytest.mark.parametrize(("n", "tile"), [(3, TILE), (30, TILE), (200, 64)])
def test_peeled_masks_and_blends_beside_one_queue(placed, n, tile):
    g, images = placed
    kept: dict = {}
    for r in canvas.peel(g, images, n, tile).collect():
        kept.setdefault((r["collage_id"], r["image_id"]), set()).add((r["y"], r["x"]))
    soft = pixels(canvas.weighted_pixels(canvas.shaped_tiles(g, images, n, tile=tile), tile=tile), "v")
    hard = pixels(canvas.owner_pixels(canvas.shaped_tiles(g, images, n, True, ("v", "cb"), tile), ("v", "cb"), tile), "image_id", "v", "cb")
    for c, (shape, parts) in whole(placed).items():
        masks = sequential(shape, parts, n)
        for i, m in masks.items():
            assert kept[c, i] == set(zip(*(a.tolist() for a in np.nonzero(m))))
        weights = {i: passes(m.astype(float), n) * parts[i][0] for i, m in masks.items()}
        total = sum(weights.values())
        mean = sum(w * parts[i][1] for i, w in weights.items())
        for y, x in zip(*np.nonzero(sum(m.astype(int) for m, _ in parts.values()))):
            assert soft[c, int(y), int(x)][0] == pytest.approx(mean[y, x] / total[y, x], abs=1e-9)
            i = max(i for i, m in masks.items() if m[y, x])
            assert hard[c, int(y), int(x)] == pytest.approx((i, parts[i][1][y, x], 1 - parts[i][1][y, x]), abs=1e-9)


def test_a_mask_away_from_the_border_fades_on_all_sides(spark):
    """A single image on a larger canvas: zeros around it, not its mirror."""
    g = spark.createDataFrame([(0, 1, 1.0, 0.0, 100.0, 100.0, 60, 60), (0, 2, 1.0, 0.0, 260.0, 260.0, 60, 60)], "collage_id long, image_id int, c double, s double, mx double, my double, w int, h int")
    images = spark.createDataFrame([(0, k, 60, 60, [1.0] * 3600) for k in (1, 2)], "collage_id long, image_id int, height int, width int, data array<double>")
    low = raster.smoothed(seams.placed(g, images), canvas.sizes(g), seams.IMAGE, 200)
    rows = pixels(raster.to_pixels(low.where("image_id = 1"), seams.COLLAGE, lambda p: (p[0] > 0, {"v": p[0]}), "v double"), "v")
    assert rows[0, 100, 130][0] == pytest.approx(0.519, abs=2e-3) and rows[0, 100, 100][0] == pytest.approx(0.270, abs=2e-3)


def test_overviews(placed):
    g, images = placed
    tiles = canvas.average_tiles(g, images, tile=TILE)
    half = raster.overview(tiles, seams.COLLAGE, TILE)
    got = pixels(canvas.average_pixels(half, tile=TILE), "n", "v")
    for c, (shape, parts) in whole(placed).items():
        even = lambda p: np.pad(p, ((0, shape[0] % 2), (0, shape[1] % 2))).reshape((shape[0] + 1) // 2, 2, -1, 2).sum((1, 3))  # noqa: B023, E731
        n, s = even(sum(m.astype(float) for m, _ in parts.values())), even(sum(v for _, v in parts.values()))
        assert {k[1:] for k in got if k[0] == c} == set(zip(*(a.tolist() for a in np.nonzero(n))))
        for y, x in zip(*np.nonzero(n)):
            assert got[c, int(y), int(x)] == pytest.approx((n[y, x], s[y, x] / n[y, x]))


def test_components_of_structs(spark):
    rng = np.random.default_rng(3)
    edges = [((int(c), int(a)), (int(c), int(b))) for c, a, b in zip(rng.integers(0, 3, 200), rng.integers(0, 150, 200), rng.integers(0, 150, 200))] + [((5, k), (5, k + 1)) for k in range(60)]
    kind = "struct<c:int,k:int>"
    found = {tuple(r["id"]): tuple(r["component"]) for r in graph.components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()}
    parent: dict = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert found == {k: root(k) for k in parent if any(k in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
