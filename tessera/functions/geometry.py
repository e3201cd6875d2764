"""Scalars of plane geometry as column expressions.

Points are (x, y) pairs of columns. A placed image has rotation (c, s), a
movement (mx, my) and an extent (w, h).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rotate(c: Column, s: Column, p: Point) -> Point:
    """M1: a point turned (and stretched) by the complex number c + is."""
    return c * p[0] - s * p[1], s * p[0] + c * p[1]


def place(g: Column, p: Point) -> Point:
    """M1: a point of an image on the canvas; ``g`` is a struct with c, s, mx, my."""
    x, y = rotate(g["c"], g["s"], p)
    return x + g["mx"], y + g["my"]


def unplace(g: Column, p: Point) -> Point:
    """M1: the inverse of ``place``."""
    x, y = p[0] - g["mx"], p[1] - g["my"]
    r = g["c"] * g["c"] + g["s"] * g["s"]
    return (g["c"] * x + g["s"] * y) / r, (g["c"] * y - g["s"] * x) / r


def in_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """0 <= x < w and 0 <= y < h."""
    return (x >= 0) & (x < w) & (y >= 0) & (y < h)


def valid_coords(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether the nearest pixel of (x, y) exists."""
    return in_box(F.floor(x + 0.5), F.floor(y + 0.5), w, h)


def unit(degrees: Column) -> Point:
    """M2: cosine and sine of an angle in degrees."""
    return F.cos(F.radians(degrees)), F.sin(F.radians(degrees))


def test_angles(maximum: float, steps: int) -> Column:
    """M3: ``steps`` + 1 evenly spaced angles from -maximum to maximum, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.lit(-maximum) + i * (2.0 * maximum) / steps)


def linear(t: Column, a: Column, b: Column) -> Column:
    """M4: linear interpolation."""
    return a + t * (b - a)


def cubic_weights(t: Column) -> list[Column]:
    """M4: weights of the four samples around a place that is ``t`` after the second; they sum to 1."""
    q = t * (t - 1) / 2
    return [q * (1 - t), (1 - t) + q * (3 * t - 2), t + q * (1 - 3 * t), q * t]


def to_byte(v: Column) -> Column:
    """M6: 0..1 to 0..255, clamped and rounded half up."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int")


def from_byte(b: Column) -> Column:
    """M6: 0..255 to 0..1."""
    return b.cast("double") / 255


def box_bounds(c: Column, s: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """Left, top, right and bottom of a turned w by h rectangle with a corner at the origin."""
    zero = F.lit(0.0)
    xs, ys = [zero, c * w, -s * h, c * w - s * h], [zero, s * w, c * h, s * w + c * h]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def corners(g: Column) -> Column:
    """The four corners of a placed image in circular order, as an array of (x, y)."""
    zero, w, h = F.lit(0.0), g["w"].cast("double"), g["h"].cast("double")
    points = [place(g, p) for p in ((zero, zero), (w, zero), (w, h), (zero, h))]
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))


def edges(g: Column) -> Column:
    """The four edges of a placed image, as an array of (p0, p1)."""
    return F.transform(F.array(corners(g)), lambda c: F.array(*(F.struct(c[i].alias("p0"), c[(i + 1) % 4].alias("p1")) for i in range(4))))[0]


def intersect(e: Column, f: Column) -> Column:
    """M7: where two segments meet, as (x, y); null if they don't or are parallel."""
    dx, dy = e["p1"]["x"] - e["p0"]["x"], e["p1"]["y"] - e["p0"]["y"]
    ex, ey = f["p1"]["x"] - f["p0"]["x"], f["p1"]["y"] - f["p0"]["y"]
    ox, oy = f["p0"]["x"] - e["p0"]["x"], f["p0"]["y"] - e["p0"]["y"]
    denominator = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    t, u = (ox * ey - oy * ex) / denominator, (ox * dy - oy * dx) / denominator
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((e["p0"]["x"] + t * dx).alias("x"), (e["p0"]["y"] + t * dy).alias("y")))


def distance(p: Point, q: Point) -> Column:
    """M8."""
    return F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))


def foot(e: Column, p: Point) -> Column:
    """M9: the perpendicular foot of a point on the line of a segment: (r, x, y), r from 0 at p0 to 1 at p1; null for a segment of no length."""
    dx, dy = e["p1"]["x"] - e["p0"]["x"], e["p1"]["y"] - e["p0"]["y"]
    r = ((p[0] - e["p0"]["x"]) * dx + (p[1] - e["p0"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.when(r.isNotNull(), F.struct(r.alias("r"), (e["p0"]["x"] + r * dx).alias("x"), (e["p0"]["y"] + r * dy).alias("y")))


def sides(g: Column, p: Point) -> Column:
    """Distances from a canvas point to the four sides of a placed image and the foot points there, as an array of (d, x, y)."""
    x, y = unplace(g, p)
    zero, w, h = F.lit(0.0), g["w"].cast("double"), g["h"].cast("double")
    found = []
    for d, at in ((x, (zero, y)), (w - x, (w, y)), (y, (x, zero)), (h - y, (x, h))):
        fx, fy = place(g, at)
        found.append(F.struct(F.greatest(zero, d).alias("d"), fx.alias("x"), fy.alias("y")))
    return F.array(*found)


def overlap_area(wa: Column, ha: Column, wb: Column, hb: Column, dx: Column, dy: Column) -> dict[str, Column]:
    """The rectangle, in coordinates of the first image, that two images share at a displacement."""
    left, top = F.greatest(F.lit(0), dx), F.greatest(F.lit(0), dy)
    return {"left": left, "top": top, "width": F.least(wa, wb + dx) - left, "height": F.least(ha, hb + dy) - top}


def minimum_overlap(portion: float, *lengths: Column) -> Column:
    """The least overlap in pixels, a share of the smallest of the sides."""
    return F.bround(F.least(*lengths) * portion).cast("int")


def shrink_factor(a: Column, b: Column, minimum: Column, pad: int) -> Column:
    """By how much two sides have to shrink so that their sum less the least overlap fits the pad size."""
    return F.greatest(F.lit(1), F.ceil((a + b - minimum) / F.lit(float(pad))).cast("int"))


def multiply(a: Point, b: Point) -> Point:
    """Product of complex numbers."""
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def phase_degrees(z: Point) -> Column:
    """Angle of a complex number."""
    return F.degrees(F.atan2(z[1], z[0]))


def weight(d: Column, gamma: float = 2.0) -> Column:
    """Blending weight of a distance."""
    return F.pow(d, F.lit(gamma))


def view_scale(d: Column, w: Column, h: Column) -> Column:
    """A distance scaled for viewing, as a byte."""
    return to_byte(d * 4 / F.least(w, h))


def output_name(pattern: str, name: Column) -> Column:
    """A file name from a pattern with one %s."""
    return F.format_string(pattern, name)


def base_name(path: Column) -> Column:
    """A file name without folders and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def stamp_anchors(left: Column, top: Column, width: Column, height: Column, side: int, n: int) -> Column:
    """C4: ``n`` anchors of stamps on the diagonal of a rectangle, ends dropped, as an array of (x, y, w, h)."""
    sw, sh = F.least(F.lit(side), width), F.least(F.lit(side), height)
    at = lambda low, span, i: F.bround(low + span * i / F.lit(float(n + 1))).cast("int")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(at(left, width - sw, i).alias("x"), at(top, height - sh, i).alias("y"), sw.alias("w"), sh.alias("h")))
