"""Positions and rotations over a tree of blocks beside dense least squares."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import layout, placement

RNG = np.random.default_rng(11)


def tables(spark, parts, moves):
    return spark.createDataFrame(parts, "collage_id long, image_id int, x double, y double"), spark.createDataFrame(moves, "collage_id long, image_a int, image_b int, dx double, dy double")


def dense(parts, moves, k):
    """The least solution of one axis of one collage."""
    ids = [p[1] for p in parts]
    rows, right = np.zeros((len(moves), len(ids))), np.array([m[3 + k] for m in moves])
    for r, m in enumerate(moves):
        rows[r, ids.index(m[1])] -= 1
        rows[r, ids.index(m[2])] += 1
    known = np.array([np.nan if p[2 + k] is None else p[2 + k] for p in parts])
    free = np.isnan(known)
    out = known.copy()
    out[free] = np.linalg.lstsq(rows[:, free], right - rows[:, ~free] @ known[~free], rcond=None)[0]
    return out


def components(ids, moves):
    found = {i: i for i in ids}
    for _ in ids:
        for m in moves:
            found[m[1]] = found[m[2]] = min(found[m[1]], found[m[2]])
    return found


@pytest.mark.parametrize("block", [1, 4, 256])
def test_positions_of_mosaics_with_gaps_and_repeats(spark, block):
    parts, moves = [], []
    for c, (w, h) in enumerate([(5, 9), (3, 4), (1, 20), (1, 1)]):
        ids = sorted(RNG.choice(500, w * h, replace=False).tolist())
        at = lambda i, j: ids[j * w + i]  # noqa: B023, E731
        for i in range(w):
            for j in range(h):
                fixed = RNG.random() < 0.05
                parts.append((c, at(i, j), 10.0 * i if fixed else None, 7.0 * j if fixed or RNG.random() < 0.1 else None))
                for di, dj in ((1, 0), (0, 1), (1, 1)):
                    if i + di < w and j + dj < h and RNG.random() < 0.7:
                        pair = [at(i, j), at(i + di, j + dj)]
                        d = np.array([10.0 * di, 7.0 * dj]) + RNG.normal(0, 0.3, 2)
                        if RNG.random() < 0.5:
                            pair, d = pair[::-1], -d
                        moves += [(c, *pair, *map(float, d + RNG.normal(0, 0.1, 2))) for _ in range(RNG.integers(1, 3))]
    parts.append((7, 3, None, None))
    p, d = tables(spark, parts, [*moves, (0, 501, 502, 1.0, 1.0), (1, parts[50][1], 999, 1.0, 1.0), (7, 3, 3, 5.0, 5.0)])
    got = {(r["collage_id"], r["image_id"]): r for r in layout.solve_positions(p, d, block).collect()}
    assert len(got) == len(parts)
    for c in {q[0] for q in parts}:
        mine, of = [q for q in parts if q[0] == c], [m for m in moves if m[0] == c]
        names = components([q[1] for q in mine], of)
        for k, axis in enumerate(("x", "y")):
            want = dense(mine, of, k)
            assert np.allclose([got[c, q[1]][axis] for q in mine], want, atol=1e-7)
        assert all(got[c, i]["component"] == n for i, n in names.items())


def test_positions_without_moves_or_parts(spark):
    p, d = tables(spark, [(0, 1, None, 2.0)], [])
    assert [tuple(r) for r in layout.solve_positions(p, d).collect()] == [(0, 1, 0.0, 2.0, 1)]
    assert layout.solve_positions(p.limit(0), d).collect() == []


@pytest.mark.parametrize("block", [2, 256])
def test_layout_beside_dense_least_squares(spark, block):
    parts, points, rows, right = [], [], [], []
    n = 15
    truth = [(90.0 * (k % 5), 60.0 * (k // 5), *(np.array([np.cos(a), np.sin(a)]) * RNG.uniform(0.98, 1.02))) for k, a in enumerate(RNG.normal(0, 0.02, n))]
    for k in range(n):
        parts.append((0, k, *((truth[0][0], truth[0][1], 0.0) if k == 0 else (None, None, None))))
        for j in (k + 1 if k % 5 < 4 else None, k + 5):
            if j is not None and j < n:
                for _ in range(6):
                    x, y = RNG.uniform(0, 100, 2)
                    u, v = ((x - t[0], y - t[1]) for t in (truth[k], truth[j]))
                    back = lambda t, p: ((t[2] * p[0] + t[3] * p[1]) / (t[2] ** 2 + t[3] ** 2), (t[2] * p[1] - t[3] * p[0]) / (t[2] ** 2 + t[3] ** 2))
                    (xa, ya), (xb, yb) = back(truth[k], u), back(truth[j], v)
                    q = [float(z + e) for z, e in zip((xa, ya, xb, yb), RNG.normal(0, 0.2, 4))]
                    points.append((0, k, j, *q))
                    for first in ((1, 0, q[0], -q[1], 1, 0, q[2], -q[3]), (0, 1, q[1], q[0], 0, 1, q[3], q[2])):
                        row = np.zeros(4 * n)
                        row[4 * k : 4 * k + 4], row[4 * j : 4 * j + 4] = -np.array(first[:4]), first[4:]
                        rows.append(row)
    rows = np.array(rows)
    known = np.full(4 * n, np.nan)
    known[:4] = truth[0][0], truth[0][1], 1.0, 0.0
    free = np.isnan(known)
    known[free] = np.linalg.lstsq(rows[:, free], -rows[:, ~free] @ known[~free], rcond=None)[0]
    p = spark.createDataFrame([*parts, (0, 99, None, None, None), (1, 1, None, None, None)], "collage_id long, image_id int, x double, y double, dangle_deg double")
    got = {(r["collage_id"], r["image_id"]): r for r in layout.solve_layout(p, spark.createDataFrame(points, "collage_id long, image_a int, image_b int, xa double, ya double, xb double, yb double"), block).collect()}
    assert np.allclose([[got[0, k][c] for c in ("x", "y", "c", "s")] for k in range(n)], known.reshape(n, 4), atol=1e-6)
    assert all(got[k][c] == 0 for k in ((0, 99), (1, 1)) for c in ("x", "y", "c", "s"))


def test_a_long_strip_and_its_rims(spark):
    """3,000 parts in a row, each tied to the next three: a tree of many levels, with rims of a few parts."""
    n = 3000
    moves = [(0, k, k + j, 10.0 * j, -1.0 * j) for k in range(n) for j in (1, 2, 3) if k + j < n]
    p, d = tables(spark, [(0, k, 0.0 if k == 0 else None, 0.0 if k == 0 else None) for k in range(n)], moves)
    got = sorted((r["image_id"], r["x"], r["y"], r["component"]) for r in layout.solve_positions(p, d, 64).collect())
    assert np.allclose([g[1:] for g in got], [(10.0 * k, -1.0 * k, 0) for k in range(n)], atol=1e-5)


def test_numbers_within_groups(spark):
    rows = [(c, int(i)) for c in range(3) for i in RNG.choice(10_000, 40 * (c + 1), replace=False)]
    found = placement.numbered(spark.createDataFrame(rows, "collage_id long, image_id int").repartition(7), "collage_id", "image_id").collect()
    for c in range(3):
        ordered = sorted(i for k, i in rows if k == c)
        assert {r["image_id"]: r["position"] for r in found if r["collage_id"] == c} == {i: k for k, i in enumerate(ordered)}


def test_kernel_and_tree_agree_on_open_groups(spark):
    """What nothing fixes: the least solution, as conjugate gradients from 0 find it."""
    moves = [(0, 1, 2, 4.0, 0.0), (0, 2, 3, 4.0, 2.0), (0, 5, 6, 1.0, 1.0)]
    p, d = tables(spark, [(0, k, None, None) for k in (1, 2, 3, 5, 6)], moves)
    got = {r["image_id"]: (r["x"], r["y"]) for r in layout.solve_positions(p, d, 2).collect()}
    column = {1: 0, 2: 1, 3: 2, 5: 3, 6: 4}
    row = np.tile(np.arange(3), 2)
    for k in (0, 1):
        want, _ = kernels.least_squares(row, np.array([column[m[1]] for m in moves] + [column[m[2]] for m in moves]), np.repeat([-1.0, 1.0], 3), np.array([m[3 + k] for m in moves]), np.full(5, np.nan))
        assert np.allclose([got[i][k] for i in column], want)
