"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations


def _with(*parts: str, then: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + then


_R = lambda c, name: f"round({c}, 6) + 0.0 as {name}"
PX = """px as (
  select cast(k // 4 as bigint) as collage_id, cast(k as bigint) as image_id, cast(vec_id - 40 * k as bigint) as y, cast(x as bigint) as x, cast(v as double) as v
  from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as x from embeddings) e,
       (select unnest(range(0, (select (max(vec_id) + 1 - 64) // 40 + 1 from embeddings))) as k) ks
  where vec_id between 40 * k and 40 * k + 63)"""
IMG = "img as (select distinct collage_id, image_id from px)"
SM = "sm as (select collage_id, image_id, y // 4 as y, x // 4 as x, avg(v) as v from px group by all)"
PR = "pr as (select a.collage_id, a.image_id as image_a, b.image_id as image_b from img a join img b on a.collage_id = b.collage_id and a.image_id < b.image_id)"
SC = """sc as (
  select pr.collage_id, image_a, image_b, a.x - b.x as dx, a.y - b.y as dy, sum(a.v * b.v) as score
  from pr join sm a on a.collage_id = pr.collage_id and a.image_id = image_a join sm b on b.collage_id = pr.collage_id and b.image_id = image_b group by all)"""
MK = """mk as (
  select collage_id, image_a, image_b, dx, dy, (least(16, 16 + dx) - greatest(0, dx) >= 4 and least(16, 16 + dy) - greatest(0, dy) >= 4) as wide,
  case when least(16, 16 + dx) - greatest(0, dx) >= 4 and least(16, 16 + dy) - greatest(0, dy) >= 4 then score else 0 end as score from sc)"""
BE = "be as (select collage_id, image_a, image_b, dx, dy, score from mk where wide qualify row_number() over (partition by collage_id, image_a, image_b order by score desc, dy desc, dx desc) = 1)"
OV = """ov as (
  select be.collage_id, image_a, image_b, dx, dy, a.y as ya, a.x as xa, b.y as yb, b.x as xb, a.v as va, b.v as vb
  from be join sm a on a.collage_id = be.collage_id and a.image_id = image_a join sm b on b.collage_id = be.collage_id and b.image_id = image_b and b.x = a.x - dx and b.y = a.y - dy)"""
RM = "rm as (select collage_id, image_a, image_b, dx, dy, sqrt(avg((va - vb) * (va - vb))) as difference, count(*) as n from ov group by all)"
MATCH = (PX, IMG, SM, PR, SC, MK, BE, OV, RM)
#: Clips of 16 by 16 in the middle of the overlap that the coarse displacement gives.
CLIPS = """mid as (
  select *, greatest(0, 4 * dx) + (64 - abs(4 * dx) - 16) // 2 as x0, greatest(0, 4 * dy) + (64 - abs(4 * dy) - 16) // 2 as y0 from be),
clip_a as (select mid.collage_id, image_a, image_b, a.x - x0 as x, a.y - y0 as y, v from mid join px a on a.collage_id = mid.collage_id and a.image_id = image_a and a.x between x0 and x0 + 15 and a.y between y0 and y0 + 15),
clip_b as (select mid.collage_id, image_a, image_b, b.x - x0 + 4 * dx as x, b.y - y0 + 4 * dy as y, v from mid join px b on b.collage_id = mid.collage_id and b.image_id = image_b and b.x + 4 * dx between x0 and x0 + 15 and b.y + 4 * dy between y0 and y0 + 15)"""


def _best_of(name: str, pairs: str, a: str, b: str, side: int, least: int) -> tuple[str, str]:
    """Correlation of square planes of pairs at all displacements, and the best of those wide enough."""
    on = lambda t, s: f"{t}.collage_id = pr.collage_id and {t}.image_id = pr.image_{s}" if a == "px" else f"{t}.collage_id = pr.collage_id and {t}.image_a = pr.image_a and {t}.image_b = pr.image_b"
    scores = f"{name}s as (select pr.collage_id, pr.image_a, pr.image_b, p.x - q.x as dx, p.y - q.y as dy, sum(p.v * q.v) as score from {pairs} pr join {a} p on {on('p', 'a')} join {b} q on {on('q', 'b')} group by all)"
    wide = f"{side} - abs(dx) >= {least} and {side} - abs(dy) >= {least}"
    return scores, f"{name}b as (select * from {name}s where {wide} qualify row_number() over (partition by collage_id, image_a, image_b order by score desc, dy desc, dx desc) = 1)"


def _rms_of(name: str) -> str:
    """Differences of full planes after the displacements of table ``<name>b``."""
    return f"{name}rm as (select m.collage_id, m.image_a, m.image_b, sqrt(avg((a.v - b.v) * (a.v - b.v))) as difference from {name}b m join px a on a.collage_id = m.collage_id and a.image_id = m.image_a join px b on b.collage_id = m.collage_id and b.image_id = m.image_b and b.x = a.x - m.dx and b.y = a.y - m.dy group by all)"


PROFILE = "pf as (select collage_id, image_id, y, sum(v) as s from px group by all)"
PARTS = """parts as (
  select cast(c_nationkey as bigint) as collage_id, cast(c_custkey as bigint) as image_id, 'scans/' || c_name || '.jpeg' as path,
  case when c_custkey % 3 <> 0 then round(cast(c_acctbal as double) / 10000, 4) end as angle_deg,
  case when c_custkey % 5 = 0 then round(cast(c_acctbal as double), 2) end as x, case when c_custkey % 7 = 0 then round(-cast(c_acctbal as double), 2) end as y from customer)"""
REL = """rel as (
  select cast(o_orderkey as bigint) as row_id, cast(o_custkey % 50 as bigint) as image_a, cast((o_custkey // 50) % 50 as bigint) as image_b,
  case o_orderstatus when 'P' then 'X' when 'F' then '-' end as rel,
  case when o_orderstatus = 'P' then round(cast(o_totalprice as double) / 1000, 5) end as dx, case when o_orderstatus = 'P' then floor(cast(o_totalprice as double) / 100) end as dy from orders)"""
MIRROR = "mi as (select image_a, image_b, rel, dx, dy from rel union all select image_b, image_a, rel, -dx, -dy from rel)"
CAND = "cand as (select a.collage_id, a.image_id as image_a, b.image_id as image_b from parts a join parts b on a.collage_id = b.collage_id and a.image_id < b.image_id where a.x is null or a.y is null or b.x is null or b.y is null)"
LOG = """log as (
  select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, case when turn = 0 then cast(conv_id as bigint) end as image_a, case when turn = 0 then cast(conv_id + 1 as bigint) end as image_b,
  case when turn <> 0 then cast(length(text) % 97 as double) end as xa, case when turn <> 0 then cast(length(text) % 89 as double) end as ya from conversations)"""
FILLED = "filled as (select conv_id, turn, xa, ya, image_a is not null as header, last_value(image_a ignore nulls) over w as image_a, last_value(image_b ignore nulls) over w as image_b from log window w as (partition by conv_id order by turn rows between unbounded preceding and current row))"
GEO = """geo as (
  select cast(0 as bigint) as collage_id, cast(s_suppkey as bigint) as image_id, round(cos(radians(((s_suppkey * 7) % 11 - 5) / 10.0)), 9) as c, round(sin(radians(((s_suppkey * 7) % 11 - 5) / 10.0)), 9) as s,
  cast((s_suppkey % 10) * 80 as double) as mx, cast((s_suppkey // 10) * 60 as double) as my, cast(100 as bigint) as w, cast(80 as bigint) as h from supplier)"""
PGEO = """geo as (
  select collage_id, image_id, round(cos(radians(((image_id * 7) % 11 - 5) / 10.0)), 9) as c, round(sin(radians(((image_id * 7) % 11 - 5) / 10.0)), 9) as s,
  8.0 as mx, cast((image_id % 4) * 40 + 8 as double) as my, cast(64 as bigint) as w, cast(64 as bigint) as h from img)"""
BOX = """box as (
  select *, least(0, c * w, -s * h, c * w - s * h) + mx as "left", least(0, s * w, c * h, s * w + c * h) + my as top, greatest(0, c * w, -s * h, c * w - s * h) + mx as "right", greatest(0, s * w, c * h, s * w + c * h) + my as bottom from geo)"""
CORNER = """corner as (
  select collage_id, image_id, k, c * px - s * py + mx as x, s * px + c * py + my as y from
  (select *, unnest([0, 1, 2, 3]) as k, unnest([0.0, w, w, 0.0]) as px, unnest([0.0, 0.0, h, h]) as py from geo))"""
EDGE = "edge as (select a.collage_id, a.image_id, a.k, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from corner a join corner b on a.collage_id = b.collage_id and a.image_id = b.image_id and b.k = (a.k + 1) % 4)"
CROSS = """crossed as (
  select collage_id, image_id, x0 + t * dx as x, y0 + t * dy as y from (
    select *, (ox * ey - oy * ex) / nullif(dx * ey - dy * ex, 0) as t, (ox * dy - oy * dx) / nullif(dx * ey - dy * ex, 0) as u from (
      select e.collage_id, e.image_id, e.x0, e.y0, e.x1 - e.x0 as dx, e.y1 - e.y0 as dy, f.x1 - f.x0 as ex, f.y1 - f.y0 as ey, f.x0 - e.x0 as ox, f.y0 - e.y0 as oy
      from edge e join edge f on e.collage_id = f.collage_id and e.image_id <> f.image_id))
  where t between 0 and 1 and u between 0 and 1)"""
INSIDE = """inside as (
  select c.collage_id, c.image_id, c.x, c.y from corner c where exists (select 1 from geo g where g.collage_id = c.collage_id and g.image_id <> c.image_id
    and round_even((g.c * (c.x - g.mx) + g.s * (c.y - g.my)) / (g.c * g.c + g.s * g.s), 0) between 0 and g.w - 1 and round_even((g.c * (c.y - g.my) - g.s * (c.x - g.mx)) / (g.c * g.c + g.s * g.s), 0) between 0 and g.h - 1))"""
POINTS = "points as (select * from crossed union all select * from inside)"
COVER = """cover as (
  select * from (select *, (c * (x - mx) + s * (y - my)) / (c * c + s * s) as sx, (c * (y - my) - s * (x - mx)) / (c * c + s * s) as sy from (
    select *, unnest(range(cast(floor("left") as bigint), cast(ceil("right") as bigint) + 1)) as x from (select *, unnest(range(cast(floor(top) as bigint), cast(ceil(bottom) as bigint) + 1)) as y from box)) where x >= 0 and y >= 0)
  where floor(sx + 0.5) >= 0 and floor(sx + 0.5) < w and floor(sy + 0.5) >= 0 and floor(sy + 0.5) < h)"""


def _weight(k: str, t: str) -> str:
    q = f"({t} * ({t} - 1) / 2)"
    return f"(case {k} when 0 then {q} * (1 - {t}) when 1 then (1 - {t}) + {q} * (3 * {t} - 2) when 2 then {t} + {q} * (1 - 3 * {t}) else {q} * {t} end)"


PLACED = f"""taps as (
  select collage_id, image_id, y as ty, x as tx, {_weight("a", "(sx - floor(sx))")} * {_weight("b", "(sy - floor(sy))")} as weight,
    cast(least(greatest(floor(sx) + a - 1, 0), w - 1) as bigint) as x, cast(least(greatest(floor(sy) + b - 1, 0), h - 1) as bigint) as y
  from cover, (select unnest(range(4)) as a) ka, (select unnest(range(4)) as b) kb),
placed as (select collage_id, image_id, ty as y, tx as x, sum(weight * v) as v from taps join px using (collage_id, image_id, y, x) group by all)"""
SIDES = """sides as (
  select collage_id, image_id, y, x, k, d, c * fx - s * fy + mx as ax, s * fx + c * fy + my as ay from (
    select *, unnest([0, 1, 2, 3]) as k, unnest([greatest(0, sx), greatest(0, w - sx), greatest(0, sy), greatest(0, h - sy)]) as d, unnest([0.0, w, sx, sx]) as fx, unnest([sy, sy, 0.0, h]) as fy from cover))"""
KEPT = """kept as (
  select s.collage_id, s.image_id, s.y, s.x, min(d) as d from sides s where exists (select 1 from geo g where g.collage_id = s.collage_id and g.image_id <> s.image_id
    and (g.c * (ax - g.mx) + g.s * (ay - g.my)) / (g.c * g.c + g.s * g.s) >= 0 and (g.c * (ax - g.mx) + g.s * (ay - g.my)) / (g.c * g.c + g.s * g.s) < g.w
    and (g.c * (ay - g.my) - g.s * (ax - g.mx)) / (g.c * g.c + g.s * g.s) >= 0 and (g.c * (ay - g.my) - g.s * (ax - g.mx)) / (g.c * g.c + g.s * g.s) < g.h) group by all)"""
NEAR = "near as (select q.collage_id, q.image_id, q.y, q.x, min(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2)) as d from cover q join points p on p.collage_id = q.collage_id and p.image_id = q.image_id group by all)"
DIST = "dist as (select q.collage_id, q.image_id, q.y, q.x, least(coalesce(k.d, 0), n.d) as d from cover q left join kept k using (collage_id, image_id, y, x) left join near n using (collage_id, image_id, y, x))"
ON_CANVAS = (PX, IMG, PGEO, BOX, COVER, PLACED)
DISTANCES = (PX, IMG, PGEO, BOX, COVER, CORNER, EDGE, CROSS, INSIDE, POINTS, SIDES, KEPT, NEAR, DIST)
NEIGHBOUR = "nb as (select a.collage_id, a.image_id as image_a, b.image_id as image_b, b.mx - a.mx as dx, b.my - a.my as dy from geo a join geo b on b.image_id = a.image_id + 10 or (b.image_id = a.image_id + 1 and a.image_id % 10 < 9))"


def _smooth(n: int) -> list[str]:
    """Tables l0 (the pixels) to l<n>, each smoothed once more along both axes."""
    out = ["l0 as (select * from px)"]
    for k in range(n):
        for name, source, along, across in ((f"m{k}", f"l{k}", "y", "x"), (f"l{k + 1}", f"m{k}", "x", "y")):
            out.append(f"{name} as (select collage_id, image_id, y, x, (coalesce(lag(v) over w, v) + 2 * v + coalesce(lead(v) over w, v)) / 4 as v from {source} window w as (partition by collage_id, image_id, {across} order by {along}))")
    return out


def _turned(degrees: float) -> str:
    """Sharpness of the row profiles of all planes turned by an angle."""
    geo = f"geo as (select collage_id, image_id, cos(radians({degrees})) as c, sin(radians({degrees})) as s, 0.0 as mx, 0.0 as my, cast(64 as bigint) as w, cast(64 as bigint) as h from img)"
    grid = """cover as (
      select *, (c * (x + "left") + s * (y + top)) as sx, (c * (y + top) - s * (x + "left")) as sy from (
        select *, unnest(range(cast(ceil("right" - "left") as bigint))) as x from (select *, unnest(range(cast(ceil(bottom - top) as bigint))) as y from box)))"""
    valid = "full_rows as (select q.collage_id, q.image_id, q.y, sum(case when floor(sx + 0.5) >= 0 and floor(sx + 0.5) < 64 and floor(sy + 0.5) >= 0 and floor(sy + 0.5) < 64 then p.v else 0 end) as s from cover q join placed p using (collage_id, image_id, y, x) group by all)"
    return _with(geo, BOX, grid, PLACED, valid, then="select collage_id, image_id, sum(d * d) as score from (select collage_id, image_id, lead(s) over (partition by collage_id, image_id order by y) - s as d from full_rows) group by all")


SQL: dict[str, str] = {
    "match_small": _with(*MATCH, then=f"select be.collage_id, be.image_a, be.image_b, be.dx * 4 as dx, be.dy * 4 as dy, {_R('score', 'score')}, {_R('difference', 'difference')}, coalesce(difference < 0.02, false) as overlaps from be left join rm using (collage_id, image_a, image_b)"),
    "p1_brightness": _with(PX, then=f"select collage_id, image_id, y, x, {_R('least(1, greatest(0, v + 0.5))', 'v')} from px"),
    "p4_clip": _with(PX, then=f"select collage_id, image_id, y - 16 as y, x - 8 as x, {_R('v', 'v')} from px where x between 8 and 39 and y between 16 and 55"),
    "a4_shrink": _with(PX, then=f"select collage_id, image_id, y // 4 as y, x // 6 as x, {_R('avg(v)', 'v')} from px where x < 60 group by collage_id, image_id, y // 4, x // 6"),
    "a5_scores": _with(*MATCH[:5], then=f"select collage_id, image_a, image_b, dx, dy, {_R('score', 'score')} from sc"),
    "p7_mask": _with(*MATCH[:6], then=f"select collage_id, image_a, image_b, dx, dy, {_R('score', 'score')}, wide from mk"),
    "a6_best": _with(*MATCH[:7], then=f"select collage_id, image_a, image_b, dx, dy, {_R('score', 'score')} from be"),
    "j5_overlap": _with(*MATCH[:8], then=f"select collage_id, image_a, image_b, ya, xa, yb, xb, {_R('va', 'va')}, {_R('vb', 'vb')} from ov"),
    "a7_rms": _with(*MATCH, then=f"select collage_id, image_a, image_b, dx, dy, {_R('difference', 'difference')}, n from rm"),
    "p8_verdict": _with(*MATCH, then="select collage_id, image_a, image_b, case image_a % 5 when 0 then '-' when 1 then 'X' end as rel, cast(case image_a % 5 when 0 then 0 when 1 then 1 else cast(difference < 0.02 as integer) end as bigint) as overlaps from rm"),
    "j6_pair_picture": _with(*MATCH[:7], then=f"""select collage_id, image_a, image_b, y, x, {_R('(coalesce(va, vb) + coalesce(vb, va)) / 2', 'v')} from
      (select be.collage_id, image_a, image_b, a.y, a.x, a.v as va from be join sm a on a.collage_id = be.collage_id and a.image_id = image_a) a full join
      (select be.collage_id, image_a, image_b, b.y + dy as y, b.x + dx as x, b.v as vb from be join sm b on b.collage_id = be.collage_id and b.image_id = image_b) b using (collage_id, image_a, image_b, y, x)"""),
    "p9_overlap_area": _with(*MATCH[:7], then='select collage_id, image_a, image_b, greatest(0, dx) as "left", greatest(0, dy) as top, least(16, 16 + dx) - greatest(0, dx) as width, least(16, 16 + dy) - greatest(0, dy) as height, cast(3 as bigint) as factor from be'),
    "a8_centred": _with(PX, then=f"select collage_id, image_id, y, x, {_R('v - avg(v) over (partition by collage_id, image_id)', 'v')} from px"),
    "t2_pad_sizes": _with(GEO, BOX, then="""select collage_id, axis, cast(sum(size) as bigint) as both, cast(min(size) as bigint) as smaller from (
      select collage_id, axis, size from (select collage_id, 'x' as axis, ceil("right" - "left") as size from box union all select collage_id, 'y', ceil(bottom - top) from box)
      qualify row_number() over (partition by collage_id, axis order by size desc) <= 2) group by all"""),
    "h2_match": _with(PX, IMG, PR, *_best_of("f", "pr", "px", "px", 64, 16), _rms_of("f"), then=f"select collage_id, image_a, image_b, dx, dy, {_R('score', 'score')}, {_R('difference', 'difference')} from fb join frm using (collage_id, image_a, image_b)"),
    "h2b_match": _with(*MATCH[:7], CLIPS, *_best_of("g", "pr", "clip_a", "clip_b", 16, 4), "fb as (select collage_id, image_a, image_b, 4 * be.dx + gb.dx as dx, 4 * be.dy + gb.dy as dy from be join gb using (collage_id, image_a, image_b))", _rms_of("f"), then=f"select collage_id, image_a, image_b, dx, dy, {_R('difference', 'difference')}, cast(difference < 0.1 as bigint) as overlaps from fb join frm using (collage_id, image_a, image_b)"),
    "h2c_stamps": _with(PX, IMG, PR, then="select collage_id, image_a, image_b, cast(i - 1 as bigint) as k, 8.0::double * i + 8 as xa, round_even(40 + 8 * i / 6.0::double, 0) + 8 as ya, 8.0::double * i + 8 as xb, round_even(40 + 8 * i / 6.0::double, 0) - 32 as yb from (select *, unnest(range(1, 6)) as i from pr where image_b = image_a + 1)"),
    "c4_stamps": _with(*MATCH[:7], then="""select collage_id, image_a, image_b, k - 1 as k, cast(round_even(l + (w0 - w) * k / 6.0, 0) as bigint) as x, cast(round_even(t + (h0 - h) * k / 6.0, 0) as bigint) as y, w, h from (
      select *, least(16, w0) as w, least(16, h0) as h, unnest(range(1, 6)) as k from (select *, greatest(0, 4 * dx) as l, greatest(0, 4 * dy) as t, least(64, 64 + 4 * dx) - greatest(0, 4 * dx) as w0, least(64, 64 + 4 * dy) - greatest(0, 4 * dy) as h0 from be))"""),
    "m3_angles": _with(PARTS, then=f"select image_id, k, {_R('k * 0.05::double - 1', 'angle')}, {_R('cos(radians(k * 0.05::double - 1))', 'c')}, {_R('sin(radians(k * 0.05::double - 1))', 's')} from parts, (select unnest(range(41)) as k)"),
    "a1_profile": _with(PX, PROFILE, then=f"select collage_id, image_id, y, {_R('s', 's')} from pf"),
    "w1_diff": _with(PX, PROFILE, then=f"select collage_id, image_id, y, {_R('d', 'd')} from (select *, lead(s) over (partition by collage_id, image_id order by y) - s as d from pf) where d is not null"),
    "a2_sharpness": _with(PX, PROFILE, then=f"select collage_id, image_id, {_R('sum(d * d)', 'score')} from (select *, lead(s) over (partition by collage_id, image_id order by y) - s as d from pf) group by all"),
    "a3_angle": _with(PX, IMG, then=f"""select collage_id, image_id, angle_deg, {_R('score', 'score')} from (
      select *, -1.0::double as angle_deg from ({_turned(-1.0)}) union all select *, 0.0::double from ({_turned(0.0)}) union all select *, 1.0::double from ({_turned(1.0)}))
      qualify row_number() over (partition by collage_id, image_id order by score desc, angle_deg desc) = 1"""),
    "w3_lowpass": _with(PX, *_smooth(2), then=f"select collage_id, image_id, y, x, {_R('v', 'v')} from l2"),
    "w4_highpass": _with(PX, *_smooth(1), then=f"select collage_id, image_id, y, x, {_R('px.v - l1.v', 'v')} from px join l1 using (collage_id, image_id, y, x)"),
    "h4_smooth": _with(PX, *_smooth(3), then=f"select collage_id, image_id, y, x, {_R('v', 'v')} from l3"),
    "j1_pairs": _with(PARTS, CAND, then="select * from cand"),
    "j2_mirror": _with(REL, MIRROR, then=f"select image_a, image_b, rel, {_R('dx', 'dx')}, {_R('dy', 'dy')} from mi"),
    "j3_known": _with(PARTS, CAND, REL, then=f"select collage_id, image_a, image_b, rel, {_R('dx', 'dx')}, {_R('dy', 'dy')} from cand left join (select * from rel where image_a <> image_b qualify row_number() over (partition by image_a, image_b order by row_id) = 1) r using (image_a, image_b)"),
    "j4_unmatched": _with(PARTS, REL, then="select distinct image_id from (select image_a as image_id from rel union all select image_b from rel) where image_id not in (select image_id from parts where image_id % 3 <> 0)"),
    "a15_dup": _with(PARTS, then="select 'scans/' || cast(image_id % 700 as varchar) as path, count(*) as n from parts group by 1 having count(*) > 1"),
    "a16_dup": _with(REL, MIRROR, then="select image_a, image_b, count(*) as n from mi group by all having count(*) > 1"),
    "v_faults": _with(REL, then="""select fault, count(*) as n from (select case when image_a is null or row_id % 17 = 0 then 'image missing' when row_id % 13 = 0 then 'unknown relation'
      when (dx is null) <> (dy is null or row_id % 11 = 0) then 'half a displacement' end as fault from rel) where fault is not null group by all"""),
    "u1_inputs": _with(PARTS, then=f"select path, {_R('angle_deg', 'angle_deg')}, cast(0 as bigint) as source_rank from parts union all select replace(path, 'scans/', 'more/'), null, 1 from parts"),
    "u4_diff": _with(REL, then="select image_id, count(*) as n from (select image_a as image_id from rel except all select distinct image_b from rel) group by all"),
    "w2_filldown": _with(LOG, FILLED, then="select conv_id, turn, image_a, image_b, cast(header as bigint) as header, cast(image_a is null as bigint) as orphan from filled"),
    "snk4_flat": _with(LOG, FILLED, then=f"""select image_a, image_b, 'X' as rel, cast(0 as bigint) as pos, null::double as xa, null::double as ya, null::double as xb, null::double as yb from filled where not header group by image_a, image_b
      union all select image_a, image_b, 'X', row_number() over (partition by image_a, image_b order by turn, xa, ya), {_R('xa', 'xa')}, {_R('ya', 'ya')}, {_R('xa', 'xb')}, {_R('ya', 'yb')} from filled where not header"""),
    "w5_pin": _with(PARTS, then="""select collage_id, image_id, """ + ", ".join(f"round(case when max(case when {c} is not null then 1 else 0 end) over (partition by collage_id) = 0 and row_number() over (partition by collage_id order by image_id) = 1 then 0.0 else {c} end, 6) + 0.0 as {n}" for c, n in (("x", "x"), ("y", "y"), ("a", "angle_deg"))) + ", row_number() over (partition by collage_id order by image_id) - 1 as position from (select *, case when collage_id > 12 then angle_deg end as a from parts)"),
    "c1_names": _with(PARTS, then="select image_id, 'out/' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '.csv' as name from parts"),
    "m6_bytes": _with(PX, then=f"select image_id, y, x, cast(floor(greatest(0.0, least(1.0, v + 0.5)) * 255 + 0.5) as bigint) as b, {_R('floor(greatest(0.0, least(1.0, v + 0.5)) * 255 + 0.5) / 255', 'back')} from px"),
    "m17_phase": _with(GEO, then=f"select image_id, {_R('c * c - s * s', 're')}, {_R('2 * c * s', 'im')}, {_R('degrees(atan2(2 * c * s, c * c - s * s))', 'deg')} from geo"),
    "a9_bbox": _with(GEO, BOX, then="select collage_id, image_id, " + ", ".join(f'round("{c}", 6) + 0.0 as "{c}"' for c in ("left", "top", "right", "bottom")) + " from box"),
    "a10_canvas": _with(GEO, BOX, then=f"""select collage_id, image_id, {_R('c', 'c')}, {_R('s', 's')}, {_R('mx - min("left") over ()', 'mx')}, {_R('my - min(top) over ()', 'my')}, w, h,
      cast(ceil(max("right") over () - min("left") over ()) as bigint) as canvas_w, cast(ceil(max(bottom) over () - min(top) over ()) as bigint) as canvas_h from box"""),
    "m1_inverse": _with(GEO, then=f"select image_id, {_R('c * 12.5 - s * 7.25 + mx', 'x')}, {_R('s * 12.5 + c * 7.25 + my', 'y')}, 12.5::double as bx, 7.25::double as by from geo"),
    "m10_edges": _with(GEO, CORNER, EDGE, then=f"""select image_id, cast(k as bigint) as k, {_R('x0', 'x0')}, {_R('y0', 'y0')}, {_R('x1', 'x1')}, {_R('y1', 'y1')}, {_R('r', 'r')}, {_R('sqrt((50 - x0 - r * (x1 - x0)) ** 2 + (40 - y0 - r * (y1 - y0)) ** 2)', 'd')} from
      (select *, ((50 - x0) * (x1 - x0) + (40 - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2) as r from edge)"""),
    "j8_cross": _with(GEO, CORNER, EDGE, CROSS, then=f"select collage_id, image_id, {_R('x', 'x')}, {_R('y', 'y')} from crossed"),
    "j9_corners": _with(GEO, CORNER, INSIDE, then=f"select collage_id, image_id, {_R('x', 'x')}, {_R('y', 'y')} from inside"),
    "u2_points": _with(GEO, CORNER, EDGE, CROSS, INSIDE, POINTS, then=f"select image_id, count(*) as n, {_R('sum(x)', 'sx')}, {_R('sum(y)', 'sy')} from points group by image_id"),
    "a18_positions": _with(GEO, then=f"select collage_id, image_id, {_R('mx - first_value(mx) over (order by image_id)', 'x')}, {_R('my - first_value(my) over (order by image_id)', 'y')}, min(image_id) over () as component from geo"),
    "a17_error": _with(GEO, NEIGHBOUR, then=f"select {_R('coalesce(max(abs(((image_a * 31 + image_b * 17) % 7 - 3) / 10.0)), 0)', 'error')} from nb"),
    "a19_layout": _with(PX, IMG, PGEO, then=f"""select collage_id, image_id, {_R('(fc * (mx - fx) + fs * (my - fy)) / n', 'x')}, {_R('(fc * (my - fy) - fs * (mx - fx)) / n', 'y')}, {_R('(c * fc + s * fs) / n', 'c')}, {_R('(s * fc - c * fs) / n', 's')} from (
      select *, fc * fc + fs * fs as n from (select *, first_value(c) over p as fc, first_value(s) over p as fs, first_value(mx) over p as fx, first_value(my) over p as fy from geo window p as (partition by collage_id order by image_id)))"""),
    "h1_resample": _with(*ON_CANVAS, then=f"select collage_id, image_id, y, x, {_R('v', 'v')} from placed"),
    "j7_gather": _with(*ON_CANVAS, then=f"select collage_id, image_id, y, x, {_R('v', 'v')} from placed"),
    "a11_average": _with(*ON_CANVAS, then=f"select collage_id, y, x, count(*) as n, {_R('avg(v)', 'v')} from placed group by collage_id, y, x"),
    "a14_cover": _with(*ON_CANVAS[:5], then="select collage_id, y, x, count(*) as n from cover group by collage_id, y, x"),
    "m12_distance": _with(*DISTANCES, then=f"select collage_id, image_id, y, x, {_R('d', 'd')} from dist"),
    "m13_weight": _with(*DISTANCES, then=f"select collage_id, image_id, y, x, {_R('d * d', 'weight')}, cast(floor(greatest(0.0, least(1.0, d * 4 / 64)) * 255 + 0.5) as bigint) as view from dist"),
    "a12_weighted": _with(*DISTANCES, PLACED, then=f"select collage_id, y, x, {_R('case when sum(d * d) > 0 then sum(d * d * v) / nullif(sum(d * d), 0) else avg(v) end', 'v')} from placed join dist using (collage_id, image_id, y, x) group by collage_id, y, x"),
    "j11_contained": _with(PX, IMG, PGEO, BOX, COVER, SIDES, then=f"""select s.collage_id, s.image_id, s.y, s.x, cast(k as bigint) as k, {_R('d', 'd')}, cast(exists (select 1 from geo g where g.collage_id = s.collage_id and g.image_id <> s.image_id
      and (g.c * (ax - g.mx) + g.s * (ay - g.my)) / (g.c * g.c + g.s * g.s) >= 0 and (g.c * (ax - g.mx) + g.s * (ay - g.my)) / (g.c * g.c + g.s * g.s) < g.w
      and (g.c * (ay - g.my) - g.s * (ax - g.mx)) / (g.c * g.c + g.s * g.s) >= 0 and (g.c * (ay - g.my) - g.s * (ax - g.mx)) / (g.c * g.c + g.s * g.s) < g.h) as bigint) as contained from sides s"""),
    "a11_colour": _with(*ON_CANVAS, then=f"select collage_id, y, x, count(*) as n, {_R('avg(v) + 0.5', 'luma')}, {_R('avg(v) / 2', 'cb')}, {_R('0.5 - avg(v) / 4', 'cr')} from placed group by collage_id, y, x"),
    "a12_colour": _with(*DISTANCES, PLACED, "mixed as (select collage_id, y, x, case when sum(d * d) > 0 then sum(d * d * v) / nullif(sum(d * d), 0) else avg(v) end as v from placed join dist using (collage_id, image_id, y, x) group by collage_id, y, x)", then="select collage_id, y, x, " + ", ".join(f"cast(floor(greatest(0.0, least(1.0, {e})) * 255 + 0.5) as bigint) as {c}" for c, e in (("luma", "v + 0.5"), ("cb", "v / 2"), ("cr", "0.5 - v / 4"))) + " from mixed"),
    "w8_owner": _with(*ON_CANVAS, then=f"select collage_id, y, x, image_id, {_R('v', 'v')} from placed qualify row_number() over (partition by collage_id, y, x order by image_id desc) = 1"),
    "m18_difference": _with(*ON_CANVAS, then=f"select collage_id, image_id, y, x, {_R('abs(v - avg(v) over (partition by collage_id, y, x))', 'v')} from placed"),
    "w7_border": _with(*ON_CANVAS[:5], then="""select collage_id, image_id, y, x from (select *, min(x) over r as x0, max(x) over r as x1, min(y) over k as y0, max(y) over k as y1 from cover
      window r as (partition by collage_id, image_id, y), k as (partition by collage_id, image_id, x)) where x in (x0, x1) or y in (y0, y1)"""),
    "job_collage": _with(PX, IMG, then="select collage_id, image_id, 0.0::double as x, 40.0::double * (image_id - min(image_id) over (partition by collage_id)) as y from img"),
    "job_match": _with(PX, IMG, PR, then="select collage_id, image_a, image_b, case when image_b = image_a + 1 then 'X' else '-' end as rel, case when image_b = image_a + 1 then 0.0::double end as dx, case when image_b = image_a + 1 then 40.0::double end as dy from pr"),
    "job_resume": _with(PX, IMG, PR, "st as (select *, (image_a + image_b) % 3 <> 0 as known, image_b % 2 = 0 as even, image_b = image_a + 1 as near from pr)", then="select collage_id, image_a, image_b, case when known and even or not known and near then 'X' else '-' end as rel, case when known and even then 1.5::double when not known and near then 0.0::double end as dx, case when known and even then -2.0::double when not known and near then 40.0::double end as dy from st"),
    "job_rotated": _with(PX, IMG, then="select collage_id, image_id, 0.0::double as x, 40.0::double * (image_id - min(image_id) over (partition by collage_id)) as y, 1.0::double as c, 0.0::double as s from img"),
    "job_process": _with(PX, IMG, then=f"select collage_id, y + 40 * (image_id - first) as y, x, {_R('avg(v)', 'v')} from px join (select collage_id, min(image_id) as first from img group by collage_id) using (collage_id) group by collage_id, y + 40 * (image_id - first), x"),
}

# Planes as tiles give what whole planes do.
SQL |= {f"{name}_blocks": SQL[f"{name}_match"] for name in ("h2", "h2b")}
