"""Array kernels inside tasks: plain functions of NumPy arrays."""

from __future__ import annotations

import heapq

import numpy as np


def cubic(t: np.ndarray) -> list[np.ndarray]:
    q = t * (t - 1) / 2
    return [q * (1 - t), (1 - t) + q * (3 * t - 2), t + q * (1 - 3 * t), q * t]


def sample(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H1: cubic interpolation at (x, y) from four by four clamped neighbours, and whether the nearest pixel exists."""
    h, w = plane.shape
    i, j = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    wx, wy = cubic(x - i), cubic(y - j)
    out = np.zeros(x.shape)
    for b in range(4):
        rows = np.clip(j + b - 1, 0, h - 1)
        for a in range(4):
            out += wy[b] * wx[a] * plane[rows, np.clip(i + a - 1, 0, w - 1)]
    nx, ny = np.floor(x + 0.5), np.floor(y + 0.5)
    return out, (nx >= 0) & (nx < w) & (ny >= 0) & (ny < h)


def bounds(c: float, s: float, w: int, h: int) -> tuple[float, float, float, float]:
    xs, ys = (0.0, c * w, -s * h, c * w - s * h), (0.0, s * w, c * h, s * w + c * h)
    return min(xs), min(ys), max(xs), max(ys)


def turn(plane: np.ndarray, degrees: float) -> tuple[np.ndarray, float, float]:
    """H1: a plane turned into its bounding box, 0 outside the image, with left and top of the box."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    left, top, right, bottom = bounds(c, s, plane.shape[1], plane.shape[0])
    y, x = np.mgrid[0 : int(np.ceil(bottom - top)), 0 : int(np.ceil(right - left))]
    px, py = x + left, y + top
    v, valid = sample(plane, c * px + s * py, c * py - s * px)
    return np.where(valid, v, 0.0), left, top


def grid(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canvas pixels (y, x) that a placed image (c, s, mx, my, w, h) covers, and their places (sx, sy) in it."""
    left, top, right, bottom = bounds(g["c"], g["s"], g["w"], g["h"])
    y, x = np.mgrid[max(0, int(np.floor(g["my"] + top))) : int(np.ceil(g["my"] + bottom)) + 1, max(0, int(np.floor(g["mx"] + left))) : int(np.ceil(g["mx"] + right)) + 1]
    sx, sy = unplace(g, x, y)
    nx, ny = np.floor(sx + 0.5), np.floor(sy + 0.5)
    valid = (nx >= 0) & (nx < g["w"]) & (ny >= 0) & (ny < g["h"])
    return y[valid], x[valid], sx[valid], sy[valid]


def unplace(g: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """M1: places in an image of points of the canvas."""
    px, py, size = x - g["mx"], y - g["my"], g["c"] ** 2 + g["s"] ** 2
    return (g["c"] * px + g["s"] * py) / size, (g["c"] * py - g["s"] * px) / size


def place(g: dict, x: float, y: float) -> tuple[float, float]:
    """M1: the canvas point of a point of an image."""
    return g["c"] * x - g["s"] * y + g["mx"], g["s"] * x + g["c"] * y + g["my"]


def corners(g: dict) -> list[tuple[float, float]]:
    return [place(g, x, y) for x, y in ((0.0, 0.0), (g["w"], 0.0), (g["w"], g["h"]), (0.0, g["h"]))]


def special_points(g: dict, others: list[dict]) -> list[tuple[float, float]]:
    """Where edges of an image meet edges of others, and its corners that lie, to the nearest pixel, in another."""
    mine, out = corners(g), []
    for o in others:
        theirs = corners(o)
        for (px, py), (qx, qy) in zip(mine, mine[1:] + mine[:1], strict=True):
            dx, dy = qx - px, qy - py
            for (rx, ry), (sx, sy) in zip(theirs, theirs[1:] + theirs[:1], strict=True):
                ex, ey, ox, oy = sx - rx, sy - ry, rx - px, ry - py
                denominator = dx * ey - dy * ex
                if denominator:
                    t, u = (ox * ey - oy * ex) / denominator, (ox * dy - oy * dx) / denominator
                    if 0 <= t <= 1 and 0 <= u <= 1:
                        out.append((px + t * dx, py + t * dy))
    for x, y in mine:
        for o in others:
            ox, oy = (round(v) for v in unplace(o, x, y))
            if 0 <= ox < o["w"] and 0 <= oy < o["h"]:
                out.append((x, y))
                break
    return out


def distances(g: dict, others: list[dict], points: list[tuple[float, float]], y: np.ndarray, x: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """How far pixels of an image are from where it may end.

    The smaller of two distances: to the nearest side whose foot point lies in
    another image (0 if there is none), and to the nearest special point.
    """
    w, h = g["w"], g["h"]
    side = np.full(sx.shape, np.inf)
    for d, fx, fy in ((sx, 0.0, sy), (w - sx, float(w), sy), (sy, sx, 0.0), (h - sy, sx, float(h))):
        ax, ay = g["c"] * fx - g["s"] * fy + g["mx"], g["s"] * fx + g["c"] * fy + g["my"]
        inside = np.zeros(sx.shape, bool)
        for o in others:
            ox, oy = unplace(o, ax, ay)
            inside |= (ox >= 0) & (ox < o["w"]) & (oy >= 0) & (oy < o["h"])
        side = np.where(inside, np.minimum(side, np.maximum(d, 0)), side)
    out = np.where(np.isinf(side), 0.0, side)
    for px, py in points:
        out = np.minimum(out, np.hypot(x - px, y - py))
    return out


def smooth(plane: np.ndarray, n: int) -> np.ndarray:
    """H4: n passes of (1, 2, 1) / 4 along both axes with clamped borders, as one convolution with the binomial kernel."""
    if n <= 0:
        return plane.astype(float)
    kernel = np.ones(1)
    for _ in range(2 * n):
        kernel = np.convolve(kernel, [0.5, 0.5])
    out = plane.astype(float)
    for axis in (0, 1):
        size = out.shape[axis]
        at = np.arange(-n, size + n) % (2 * size)  # half-sample symmetry
        wide = np.take(out, np.where(at < size, at, 2 * size - 1 - at), axis)
        long = wide.shape[axis]
        weights = np.fft.rfft(kernel, long).reshape((-1, 1) if axis == 0 else (1, -1))
        out = np.take(np.fft.irfft(np.fft.rfft(wide, axis=axis) * weights, long, axis=axis), np.arange(2 * n, 2 * n + size), axis)
    return out


def labels(mask: np.ndarray) -> np.ndarray:
    """Connected pixels (side by side or one above the other) of a mask: 0 outside, else 1 more than the first pixel of theirs in row order."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] <= end[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int64)
    for r, s, e, k in zip(row.tolist(), start.tolist(), end.tolist(), range(len(parent)), strict=True):
        k = root(k)
        out[r, s:e] = row[k] * w + start[k] + 1
    return out


def _masked_best(scores: np.ndarray, a: tuple[int, int], b: tuple[int, int], least: int) -> tuple[float, int, int] | None:
    """The best displacement of cyclic correlation ``scores`` with enough overlap; later places win ties."""
    (ha, wa), (hb, wb), (height, width) = a, b, scores.shape
    dx, dy = np.arange(width), np.arange(height)
    dx = np.where(dx < (width - wb + wa) // 2, dx, dx - width)
    dy = np.where(dy < (height - hb + ha) // 2, dy, dy - height)
    ox, oy = np.minimum(wa, wb + dx) - np.maximum(0, dx), np.minimum(ha, hb + dy) - np.maximum(0, dy)
    ok = (ox >= max(least, 1))[None, :] & (oy >= max(least, 1))[:, None]
    if not ok.any():
        return None
    order_x, order_y = np.argsort(dx), np.argsort(dy)
    ranked = np.where(ok, scores, -np.inf)[order_y][:, order_x]
    k = ranked.size - 1 - int(np.argmax(np.round(ranked, 9).ravel()[::-1]))
    i, j = divmod(k, width)
    return float(ranked[i, j]), int(dx[order_x[j]]), int(dy[order_y[i]])


def correlate(a: np.ndarray, b: np.ndarray, least: int) -> tuple[float, int, int] | None:
    """H2: score and displacement (dx, dy) of the best match, or None if no overlap is large enough."""
    shape = (a.shape[0] + b.shape[0], a.shape[1] + b.shape[1])
    scores = np.fft.irfft2(np.fft.rfft2(a, shape) * np.conj(np.fft.rfft2(b, shape)), shape)
    return _masked_best(scores, a.shape, b.shape, least)


def shrink(plane: np.ndarray, ky: int, kx: int) -> np.ndarray:
    h, w = plane.shape[0] // ky * ky, plane.shape[1] // kx * kx
    return plane[:h, :w].reshape(h // ky, ky, w // kx, kx).mean(axis=(1, 3))


def overlap(a: tuple[int, int], b: tuple[int, int], dx: int, dy: int) -> tuple[int, int, int, int]:
    left, top = max(0, dx), max(0, dy)
    return left, top, min(a[1], b[1] + dx) - left, min(a[0], b[0] + dy) - top


def rms(a: np.ndarray, b: np.ndarray, dx: int, dy: int) -> float:
    left, top, w, h = overlap(a.shape, b.shape, dx, dy)
    if w <= 0 or h <= 0:
        return float("inf")
    return float(np.sqrt(np.mean((a[top : top + h, left : left + w] - b[top - dy : top - dy + h, left - dx : left - dx + w]) ** 2)))


def coarse(a: np.ndarray, b: np.ndarray, pad: int, portion: float) -> tuple[int, int, float] | None:
    """Displacement by a match of planes shrunk to the pad size (M15), and the RMS difference of these."""
    least = int(np.floor(portion * min(*a.shape, *b.shape)))
    ky, kx = (max(1, -(-(a.shape[k] + b.shape[k] - least) // pad)) for k in (0, 1))
    small_a, small_b = shrink(a, ky, kx), shrink(b, ky, kx)
    found = correlate(small_a, small_b, round(portion * min(*small_a.shape, *small_b.shape)))
    return None if found is None else (found[1] * kx, found[2] * ky, rms(small_a, small_b, *found[1:]))


def _clips(a: np.ndarray, b: np.ndarray, x: int, y: int, w: int, h: int, dx: int, dy: int, portion: float) -> tuple[float, int, int] | None:
    """The match of a rectangle of ``a`` with the one that ``b`` has there after a displacement."""
    clip_a, clip_b = a[y : y + h, x : x + w], b[y - dy : y - dy + h, x - dx : x - dx + w]
    return correlate(clip_a, clip_b, round(portion * min(w, h)))


def coarse_to_fine(a: np.ndarray, b: np.ndarray, pad: int, portion: float) -> tuple[int, int, float] | None:
    """Displacement and RMS difference by a match of shrunk planes, then of clips at full size, whose displacement is added."""
    found = coarse(a, b, pad, portion)
    if found is None:
        return None
    dx, dy, _ = found
    left, top, w, h = overlap(a.shape, b.shape, dx, dy)
    cw, ch = min(w, pad // 2), min(h, pad // 2)
    fine = _clips(a, b, left + (w - cw) // 2, top + (h - ch) // 2, cw, ch, dx, dy, portion) if cw > 0 and ch > 0 else None
    if fine is not None:
        dx, dy = dx + fine[1], dy + fine[2]
    return dx, dy, rms(a, b, dx, dy)


def stamps(a: np.ndarray, b: np.ndarray, pad: int, portion: float, maximum: float, n: int, side: int, certain: bool) -> list[tuple[float, float, float, float]]:
    """Corresponding points (xa, ya, xb, yb) from matches of stamps on the diagonal of the overlap after the coarse displacement; none if the shrunk planes differ too much."""
    found = coarse(a, b, pad, portion)
    if found is None or not (certain or found[2] < maximum):
        return []
    dx, dy, _ = found
    left, top, w, h = overlap(a.shape, b.shape, dx, dy)
    sw, sh, out = min(side, w), min(side, h), []
    if sw <= 0 or sh <= 0:
        return []
    for i in range(1, n + 1):
        x, y = round(left + (w - sw) * i / (n + 1)), round(top + (h - sh) * i / (n + 1))
        fine = _clips(a, b, x, y, sw, sh, dx, dy, portion)
        if fine is not None:
            fx, fy = fine[1], fine[2]
            cx, cy = (sw + fx) // 2, (sh + fy) // 2
            out.append((float(x + cx), float(y + cy), float(x - dx + cx - fx), float(y - dy + cy - fy)))
    return out


def least_squares(row: np.ndarray, column: np.ndarray, value: np.ndarray, right: np.ndarray, known: np.ndarray, scaled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """H3: unknowns (nan in ``known``) that fit the sparse rows (row, column, value) to ``right`` best; and the fitted right side.

    Conjugate gradients from 0 on the normal equations, which are never formed:
    memory follows the number of entries. The least solution in norm if the
    unknowns aren't determined; ``scaled`` measures them by their columns.
    """
    n, m = len(right), len(known)
    free = np.isnan(known)
    p = np.where(free, 0.0, known)
    times = lambda q, v: np.bincount(row, v * q[column], n)
    r = right - times(p, value)
    of_free = np.where(free[column], value, 0.0)
    scale = np.ones(m)
    if scaled:
        size = np.sqrt(np.bincount(column, of_free**2, m))
        scale = np.where(size > 0, 1 / np.where(size > 0, size, 1), 1.0)
        of_free = of_free * scale[column]
    back = lambda q: np.bincount(column, of_free * q[row], m)
    q, s = np.zeros(m), back(r)
    step, size = s.copy(), float(s @ s)
    goal, least, idle = size * 1e-28, size, 0
    while size > goal and idle < 200:  # no better for so long: as good as rounding allows
        moved = times(step, of_free)
        by = size / float(moved @ moved)
        q, r = q + by * step, r - by * moved
        s = back(r)
        size, before = float(s @ s), size
        idle = 0 if size < least else idle + 1
        least = min(least, size)
        step = s + (size / before) * step
    p = np.where(free, q * scale, p)
    return p, times(p, value)


def border(mask: np.ndarray) -> np.ndarray:
    """Pixels of a mask beside a pixel that isn't in it."""
    wide = np.pad(mask, 1)
    return mask & ~(wide[:-2, 1:-1] & wide[2:, 1:-1] & wide[1:-1, :-2] & wide[1:-1, 2:])


def peel(parts: list[tuple[int, int, np.ndarray, np.ndarray]], borders: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """H5: masks made smaller from their borders inwards, largest difference first, while every pixel keeps an owner.

    A part is (y, x, mask, differences) in a box of its own at (y, x); only the
    number of owners is held for the whole canvas. ``borders`` are where peeling
    begins, if that isn't the border of the masks.
    """
    masks = [m.copy() for _, _, m, _ in parts]
    count = np.zeros((max(y + m.shape[0] for y, _, m, _ in parts), max(x + m.shape[1] for _, x, m, _ in parts)), np.int32)
    for y, x, m, _ in parts:
        count[y : y + m.shape[0], x : x + m.shape[1]] += m
    queued = [np.zeros_like(m) for m in masks]
    queue: list[tuple[float, int, int, int]] = []

    def push(k: int, y: int, x: int) -> None:
        if masks[k][y, x] and not queued[k][y, x]:
            queued[k][y, x] = True
            heapq.heappush(queue, (-parts[k][3][y, x], k, y, x))

    for k, mask in enumerate(masks):
        for y, x in zip(*np.nonzero(border(mask) if borders is None else borders[k]), strict=True):
            push(k, int(y), int(x))
    while queue:
        _, k, y, x = heapq.heappop(queue)
        at = y + parts[k][0], x + parts[k][1]
        if count[at] > 1:
            masks[k][y, x] = False
            count[at] -= 1
            for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= v < masks[k].shape[0] and 0 <= u < masks[k].shape[1]:
                    push(k, v, u)
    return masks


def spectral_angle(plane: np.ndarray, maximum: float) -> float:
    """H6: the angle in degrees along which the power spectrum, weighted by squared frequency (in whole waves), is largest."""
    h, w = plane.shape
    fy, fx = np.fft.fftfreq(h, 1 / h)[:, None], np.fft.fftfreq(w, 1 / w)[None, :]
    power = np.abs(np.fft.fft2(plane - plane.mean())) ** 2 * (fx**2 + fy**2)
    half = h // 2
    reach = np.tan(np.radians(maximum)) * half
    slopes = np.arange(np.floor(-reach), np.ceil(reach) + 1)
    y = np.arange(half)
    at = slopes[:, None] * y[None, :] / max(half, 1)
    low = np.floor(at).astype(int)
    t = at - low
    sums = (power[y, low % w] * (1 - t) + power[y, (low + 1) % w] * t).sum(1)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return float(np.degrees(np.arctan(slopes[best] / max(half, 1))))
