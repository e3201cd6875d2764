import numpy as np
import pytest

from tessera.functions import kernels as K

RNG = np.random.default_rng(5)


def passes(v, n):
    for _ in range(n):
        for axis in (0, 1):
            p = np.pad(v, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            take = lambda k: np.take(p, np.arange(k, k + v.shape[axis]), axis)  # noqa: E731,B023
            v = (take(0) + 2 * take(1) + take(2)) / 4
    return v


@pytest.mark.parametrize("n,shape", [(0, (4, 5)), (1, (7, 6)), (20, (9, 30)), (20, (3, 2))])
def test_one_convolution_equals_many_passes(n, shape):
    v = RNG.normal(size=shape)
    assert np.allclose(K.smooth(v, n), passes(v, n))


def test_cubic_weights_sum_to_one():
    assert np.allclose(sum(K.cubic(np.linspace(0, 1, 11))), 1)


def test_sampling_at_pixels_gives_the_pixels():
    v = RNG.normal(size=(5, 6))
    y, x = np.mgrid[0:5, 0:6]
    out, valid = K.sample(v, x.astype(float), y.astype(float))
    assert np.allclose(out, v) and valid.all()
    assert not K.sample(v, np.array([5.6]), np.array([0.0]))[1][0]


def test_correlation_finds_the_cut_and_mirrors():
    big = RNG.normal(size=(60, 70))
    a, b = big[:40, :50], big[15:55, 10:60]
    score, dx, dy = K.correlate(a, b, 10)
    assert (dx, dy) == (10, 15) and K.correlate(b, a, 10)[1:] == (-10, -15)
    left, top, w, h = K.overlap(a.shape, b.shape, dx, dy)
    assert np.isclose(score, (a[top:, left:] * b[:h, :w]).sum())
    assert K.rms(a, b, dx, dy) == pytest.approx(0)
    assert K.correlate(a[:3, :3], b[:3, :3], 10) is None


def test_coarse_to_fine_and_stamps():
    big = passes(RNG.normal(size=(160, 150)), 2)
    a, b = big[:110, :120], big[37:147, 21:141]
    assert K.coarse_to_fine(a, b, 64, 0.25)[:2] == (21, 37)
    points = K.stamps(a, b, 64, 0.25, 0.1, 5, 24, True)
    assert len(points) == 5 and all((xa - xb, ya - yb) == (21, 37) for xa, ya, xb, yb in points)
    # The test of the difference is made on shrunk planes, which agree if the displacement is a multiple of the factor.
    assert K.stamps(a, b, 64, 0.25, 0.1, 5, 24, False) == [] and len(K.stamps(a, big[36:146, 20:140], 64, 0.25, 0.1, 5, 24, False)) == 5


def sparse(rows):
    r, c = np.nonzero(np.ones_like(rows))
    return r, c, rows[r, c]


@pytest.mark.parametrize("scaled", [False, True])
def test_least_squares_keeps_known_values(scaled):
    rows = np.array([[-1.0, 1, 0], [0, -1, 1]])
    p, fitted = K.least_squares(*sparse(rows), np.array([2.0, 3.0]), np.array([np.nan, 10.0, np.nan]), scaled)
    assert np.allclose(p, [8, 10, 13]) and np.allclose(fitted, [2, 3])
    p, fitted = K.least_squares(*sparse(np.zeros((0, 2))), np.zeros(0), np.array([np.nan, 4.0]), scaled)
    assert p.tolist() == [0, 4] and len(fitted) == 0


def test_least_squares_takes_the_least_solution_as_a_dense_solver_does():
    p, _ = K.least_squares(*sparse(np.array([[-1.0, 1, 0]])), np.array([2.0]), np.full(3, np.nan))
    assert np.allclose(p, [-1, 1, 0])
    rows = np.zeros((400, 150))
    rows[np.arange(400), RNG.integers(0, 75, 400)] -= 1
    rows[np.arange(400), RNG.integers(75, 150, 400)] += 1
    right = RNG.normal(size=400) * 1000
    assert np.allclose(K.least_squares(*sparse(rows), right, np.full(150, np.nan))[0], np.linalg.lstsq(rows, right, rcond=None)[0], atol=1e-7)


def box(mask, diff):
    y, x = np.nonzero(mask)
    cut = np.s_[y.min() : y.max() + 1, x.min() : x.max() + 1]
    return int(y.min()), int(x.min()), mask[cut], diff[cut]


def peeled(masks, diff):
    """All masks at full size, the next pixel looked for among all of them."""
    masks, queue, done = masks.copy(), set(), set()
    n, h, w = masks.shape
    inside = lambda k, y, x: 0 <= y < h and 0 <= x < w and masks[k, y, x]
    around = lambda y, x: ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))
    for k, y, x in np.argwhere(masks).tolist():
        if not all(inside(k, *q) for q in around(y, x)):
            queue.add((k, y, x))
    done |= queue
    while queue:
        k, y, x = min(queue, key=lambda q: (-diff[q], q))
        queue.remove((k, y, x))
        if masks[:, y, x].sum() > 1:
            masks[k, y, x] = False
            new = {(k, *q) for q in around(y, x) if inside(k, *q)} - done
            queue |= new
            done |= new
    return masks


def test_peeling_removes_large_differences_first_and_keeps_owners():
    masks, diff = np.zeros((2, 3, 6), bool), np.zeros((2, 3, 6))
    masks[0, :, :4], masks[1, :, 2:] = True, True
    diff[1, :, 2:4] = 1
    a, b = K.peel([box(masks[0], diff[0]), box(masks[1], diff[1])])
    assert a.all() and not b[:, :2].any() and b[:, 2:].all()


def test_peeling_in_boxes_is_that_of_whole_masks():
    masks, diff = np.zeros((3, 12, 14), bool), RNG.normal(size=(3, 12, 14)) ** 2
    masks[0, 0:9, 0:9], masks[1, 3:12, 4:14], masks[2, 2:10, 6:12] = True, True, True
    masks[1, 3, 4] = masks[2, 9, 11] = False
    kept = K.peel([box(m, d) for m, d in zip(masks, diff, strict=True)])
    want = peeled(masks, diff)
    for m, k, w in zip(masks, kept, want, strict=True):
        y, x = np.nonzero(m)
        assert (k == w[y.min() : y.max() + 1, x.min() : x.max() + 1]).all()
    assert (want.any(0) == masks.any(0)).all() and want.sum() < masks.sum()


def test_distances_beside_loops():
    g = {"c": 0.99, "s": 0.1, "mx": 3.0, "my": 2.0, "w": 9, "h": 7}
    o = {"c": 1.0, "s": 0.0, "mx": 6.0, "my": 1.0, "w": 12, "h": 9}
    y, x, sx, sy = K.grid(g)
    assert len(y) > 40
    got = K.distances(g, [o], [(8.5, 3.0)], y, x, sx, sy)
    size = g["c"] ** 2 + g["s"] ** 2
    for k in range(len(y)):
        px, py = x[k] - g["mx"], y[k] - g["my"]
        u, v = (g["c"] * px + g["s"] * py) / size, (g["c"] * py - g["s"] * px) / size
        assert np.isclose(u, sx[k]) and np.isclose(v, sy[k])
        kept = []
        for d, fx, fy in ((u, 0, v), (9 - u, 9, v), (v, u, 0), (7 - v, u, 7)):
            ax, ay = g["c"] * fx - g["s"] * fy + g["mx"] - o["mx"], g["s"] * fx + g["c"] * fy + g["my"] - o["my"]
            if 0 <= ax < o["w"] and 0 <= ay < o["h"]:
                kept.append(max(0, d))
        assert np.isclose(got[k], min(min(kept, default=0), np.hypot(x[k] - 8.5, y[k] - 3.0)))


def test_spectral_angle_beside_loops():
    plane = passes(RNG.normal(size=(24, 60)), 1)
    h, w = plane.shape
    power = np.abs(np.fft.fft2(plane - plane.mean())) ** 2
    best = None
    reach = np.tan(np.radians(6.0)) * (h // 2)
    for slope in range(int(np.floor(-reach)), int(np.ceil(reach)) + 1):
        total = 0.0
        for y in range(h // 2):
            at = slope * y / (h // 2)
            i, t = int(np.floor(at)), at - np.floor(at)
            for k, share in ((i, 1 - t), (i + 1, t)):
                fx, fy = (k % w + w // 2) % w - w // 2, y  # whole waves across and down
                total += share * power[y, k % w] * (fx**2 + fy**2)
        if best is None or total >= best[0]:
            best = total, slope
    assert K.spectral_angle(plane, 6.0) == pytest.approx(np.degrees(np.arctan(best[1] / (h // 2))))


def test_spectral_angle_of_lines():
    y, x = np.mgrid[0:128, 0:128]
    plane = np.sin(2 * np.pi * (y * 20 + x) / 128)
    assert abs(K.spectral_angle(plane, 5.0)) == pytest.approx(np.degrees(np.arctan(1 / 20)), abs=0.5)
