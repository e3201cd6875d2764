"""Registered queries: each applies one operator, or a job, to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .jobs import collage
from .operators import blocks, canvas, layout, matching, orient, placement
from .sources import states, tables
from .sources.storage import materialize, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PAIR = matching.PAIR
FACTOR, PORTION = 4, 0.25


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query. Whole numbers come out as long, doubles rounded to six places and without a negative zero."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        kinds = {"int": lambda c: c.cast("long"), "double": lambda c: F.round(c, 6) + F.lit(0.0)}
        return df.select(*(kinds.get(kind, lambda c: c)(F.col(name)).alias(name) for name, kind in df.dtypes))

    QUERIES[f.__name__] = run
    return run


def _small(spark, sf_dir):
    return matching.shrink(tables.mosaic(spark, sf_dir), FACTOR, FACTOR)


def _pairs(spark, sf_dir):
    return placement.candidate_pairs(tables.mosaic_parts(tables.mosaic_lines(spark, sf_dir)))


def _scores(spark, sf_dir):
    return matching.correlation_scores(_pairs(spark, sf_dir), _small(spark, sf_dir))


def _masked(spark, sf_dir):
    return matching.mask_scores(_scores(spark, sf_dir), matching.sizes(_small(spark, sf_dir)), PORTION)


def _best(spark, sf_dir):
    return matching.best_displacement(_masked(spark, sf_dir))


@query
def match_small(spark, sf_dir):
    return matching.match_shrunk(_pairs(spark, sf_dir), _planes(spark, sf_dir), FACTOR, PORTION)


@query
def p1_brightness(spark, sf_dir):
    pixels = tables.mosaic(spark, sf_dir)
    return matching.brightness(pixels.withColumn("luma", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") + 0.5))))


@query
def p4_clip(spark, sf_dir):
    return matching.clip(tables.mosaic(spark, sf_dir), 8, 16, 32, 40)


@query
def a4_shrink(spark, sf_dir):
    return matching.shrink(tables.mosaic(spark, sf_dir), 4, 6)


@query
def a5_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query
def p7_mask(spark, sf_dir):
    return _masked(spark, sf_dir)


@query
def a6_best(spark, sf_dir):
    return _best(spark, sf_dir)


@query
def j5_overlap(spark, sf_dir):
    return matching.overlap_pixels(_best(spark, sf_dir), _small(spark, sf_dir)).select(*PAIR, "ya", "xa", "yb", "xb", "va", "vb")


@query
def a7_rms(spark, sf_dir):
    return matching.overlap_difference(_best(spark, sf_dir), _small(spark, sf_dir))


@query
def p8_verdict(spark, sf_dir):
    rel = F.when(F.col("image_a") % 5 == 0, F.lit("-")).when(F.col("image_a") % 5 == 1, F.lit("X"))
    found = matching.overlap_difference(_best(spark, sf_dir), _small(spark, sf_dir))
    return found.select(*PAIR, rel.alias("rel"), matching.verdict(rel, F.col("difference"), 0.02).cast("int").alias("overlaps"))


@query
def j6_pair_picture(spark, sf_dir):
    return matching.compose_pair(_best(spark, sf_dir), _small(spark, sf_dir))


@query
def p9_overlap_area(spark, sf_dir):
    size = F.lit(16)
    area = G.overlap_area(size, size, size, size, F.col("dx"), F.col("dy"))
    return _best(spark, sf_dir).select(*PAIR, *(v.alias(k) for k, v in area.items()), G.shrink_factor(size * 4, size * 4, F.lit(16), 40).alias("factor"))


@query
def a8_centred(spark, sf_dir):
    return matching.centred(tables.mosaic(spark, sf_dir))


@query
def t2_pad_sizes(spark, sf_dir):
    g = canvas.bounding_boxes(tables.geometry(spark, sf_dir))
    dims = g.select("collage_id", "image_id", F.ceil(F.col("right") - F.col("left")).alias("w"), F.ceil(F.col("bottom") - F.col("top")).alias("h"))
    return matching.pad_sizes(dims)


def _planes(spark, sf_dir):
    return tables.mosaic_planes(tables.mosaic_lines(spark, sf_dir))


@query
def h2_match(spark, sf_dir):
    return matching.match_once(_pairs(spark, sf_dir), _planes(spark, sf_dir))


@query
def h2b_match(spark, sf_dir):
    return matching.match(_pairs(spark, sf_dir), _planes(spark, sf_dir), pad=32, maximum=0.1).withColumn("overlaps", F.col("overlaps").cast("int"))


@query
def h2_blocks(spark, sf_dir):
    planes = _planes(spark, sf_dir)
    tiles = materialize(blocks.tiles_of(planes, 32), "tiles")
    return blocks.match_once(_pairs(spark, sf_dir), tiles, blocks.sizes_of(planes), PORTION, 32)


@query
def h2b_blocks(spark, sf_dir):
    planes = _planes(spark, sf_dir)
    tiles = materialize(blocks.tiles_of(planes, 32), "tiles")
    found = blocks.match(_pairs(spark, sf_dir), tiles, blocks.sizes_of(planes), 32, PORTION, 0.1, 32, keep=lambda df: materialize(df, "job"))
    return found.withColumn("overlaps", F.col("overlaps").cast("int"))


@query
def a3_levels(spark, sf_dir):
    return orient.find_angles_by_levels(_planes(spark, sf_dir))


@query
def h2c_stamps(spark, sf_dir):
    found = matching.match_stamps(_pairs(spark, sf_dir), _planes(spark, sf_dir), pad=128, maximum=0.1, n=5, side=16)
    return found.select(*PAIR, F.posexplode("pts").alias("k", "p")).select(*PAIR, "k", "p.xa", "p.ya", "p.xb", "p.yb")


@query
def c4_stamps(spark, sf_dir):
    side = F.lit(64)
    area = G.overlap_area(side, side, side, side, F.col("dx") * 4, F.col("dy") * 4)
    anchors = G.stamp_anchors(area["left"], area["top"], area["width"], area["height"], 16, 5)
    return _best(spark, sf_dir).select(*PAIR, F.posexplode(anchors).alias("k", "s")).select(*PAIR, "k", "s.x", "s.y", "s.w", "s.h")


@query
def m3_angles(spark, sf_dir):
    angles = tables.parts(spark, sf_dir).select("image_id", F.posexplode(G.test_angles(1.0, 40)).alias("k", "angle"))
    c, s = G.unit(F.col("angle"))
    return angles.select("image_id", "k", "angle", c.alias("c"), s.alias("s"))


@query
def a1_profile(spark, sf_dir):
    return orient.row_profile(tables.mosaic(spark, sf_dir))


@query
def w1_diff(spark, sf_dir):
    return orient.differences(orient.row_profile(tables.mosaic(spark, sf_dir)))


@query
def a2_sharpness(spark, sf_dir):
    return orient.sharpness(orient.row_profile(tables.mosaic(spark, sf_dir)))


@query
def a3_angle(spark, sf_dir):
    return orient.find_angles(_planes(spark, sf_dir), 1.0, 2)


@query
def a3_full(spark, sf_dir):
    return orient.find_angles(_planes(spark, sf_dir))


@query
def h6_spectral(spark, sf_dir):
    return orient.spectral_angles(_planes(spark, sf_dir), 5.0)


@query
def w3_lowpass(spark, sf_dir):
    return orient.lowpass(tables.mosaic(spark, sf_dir), 2)


@query
def w4_highpass(spark, sf_dir):
    return orient.highpass(tables.mosaic(spark, sf_dir), 1)


@query
def h4_smooth(spark, sf_dir):
    return orient.pixels_of(orient.smoothed(_planes(spark, sf_dir), 3))


@query
def j1_pairs(spark, sf_dir):
    return placement.candidate_pairs(tables.parts(spark, sf_dir).withColumn("open", placement.is_open("x", "y")))


@query
def j2_mirror(spark, sf_dir):
    return placement.mirrored(tables.relations(spark, sf_dir))


@query
def j3_known(spark, sf_dir):
    pairs = placement.candidate_pairs(tables.parts(spark, sf_dir).withColumn("open", placement.is_open("x", "y")))
    clean = tables.relations(spark, sf_dir).where("image_a <> image_b")
    first = placement.first_of_pairs(clean, "row_id").drop("row_id")
    return placement.attach_known(pairs, first).select("collage_id", "image_a", "image_b", "rel", "dx", "dy")


@query
def j4_unmatched(spark, sf_dir):
    images = tables.parts(spark, sf_dir).where("image_id % 3 <> 0").select("image_id")
    return placement.unmatched_images(tables.relations(spark, sf_dir), images)


@query
def a15_dup(spark, sf_dir):
    p = tables.parts(spark, sf_dir)
    return placement.duplicate_images(p.withColumn("path", F.concat(F.lit("scans/"), (F.col("image_id") % 700).cast("string"))))


@query
def a16_dup(spark, sf_dir):
    return placement.duplicate_pairs(tables.relations(spark, sf_dir))


@query
def v_faults(spark, sf_dir):
    r = tables.relations(spark, sf_dir)
    spoilt = r.withColumn("dy", F.when(F.col("row_id") % 11 != 0, F.col("dy"))).withColumn("rel", F.when(F.col("row_id") % 13 == 0, F.lit("Y")).otherwise(F.col("rel"))).withColumn("image_b", F.when(F.col("row_id") % 17 != 0, F.col("image_b")))
    return placement.bad_relations(spoilt).groupBy("fault").agg(F.count("*").alias("n"))


@query
def u1_inputs(spark, sf_dir):
    listed = tables.parts(spark, sf_dir).select("path", "angle_deg")
    return placement.image_list(listed, listed.select(F.regexp_replace("path", "scans/", "more/").alias("path")))


@query
def u4_diff(spark, sf_dir):
    r = tables.relations(spark, sf_dir)
    return r.select(F.col("image_a").alias("image_id")).exceptAll(r.select("image_b").distinct()).groupBy("image_id").agg(F.count("*").alias("n"))


@query
def w2_filldown(spark, sf_dir):
    return placement.fill_down(tables.log(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "image_a", "image_b", F.col("header").cast("int").alias("header"), F.col("orphan").cast("int").alias("orphan"))


@query
def snk4_flat(spark, sf_dir):
    rows = placement.fill_down(tables.log(spark, sf_dir), "conv_id", "turn").where("not header")
    points = F.array_sort(F.collect_list(F.struct("turn", F.struct("xa", "ya", F.col("xa").alias("xb"), F.col("ya").alias("yb")).alias("p"))))
    grouped = rows.groupBy("image_a", "image_b").agg(F.lit("X").alias("rel"), F.transform(points, lambda p: p["p"]).alias("pts"))
    return placement.header_and_details(grouped)


@query
def w5_pin(spark, sf_dir):
    return placement.pin_first(tables.parts(spark, sf_dir).select("collage_id", "image_id", "x", "y", F.when(F.col("collage_id") > 12, F.col("angle_deg")).alias("angle_deg")), ["x", "y", "angle_deg"])


@query
def c1_names(spark, sf_dir):
    p = tables.parts(spark, sf_dir)
    return p.select("image_id", G.output_name("out/%s.csv", G.base_name(F.col("path"))).alias("name"))


@query
def m6_bytes(spark, sf_dir):
    v = F.col("v") + 0.5
    return tables.mosaic(spark, sf_dir).select("image_id", "y", "x", G.to_byte(v).alias("b"), G.from_byte(G.to_byte(v)).alias("back"))


@query
def m17_phase(spark, sf_dir):
    g = tables.geometry(spark, sf_dir)
    z = G.multiply((F.col("c"), F.col("s")), (F.col("c"), F.col("s")))
    return g.select("image_id", z[0].alias("re"), z[1].alias("im"), G.phase_degrees(z).alias("deg"))


@query
def a9_bbox(spark, sf_dir):
    return canvas.bounding_boxes(tables.geometry(spark, sf_dir))


@query
def a10_canvas(spark, sf_dir):
    return canvas.canvas(tables.geometry(spark, sf_dir))


@query
def m1_inverse(spark, sf_dir):
    g = tables.geometry(spark, sf_dir).select("image_id", F.struct("c", "s", "mx", "my", "w", "h").alias("g"))
    p = G.place(F.col("g"), (F.lit(12.5), F.lit(7.25)))
    q = G.unplace(F.col("g"), p)
    return g.select("image_id", p[0].alias("x"), p[1].alias("y"), q[0].alias("bx"), q[1].alias("by"))


@query
def m10_edges(spark, sf_dir):
    g = tables.geometry(spark, sf_dir)
    e = g.select("image_id", F.posexplode(G.edges(F.struct(*canvas.GEOMETRY[1:]))).alias("k", "e"))
    foot = G.foot(F.col("e"), (F.lit(50.0), F.lit(40.0)))
    return e.select("image_id", "k", F.col("e.p0.x").alias("x0"), F.col("e.p0.y").alias("y0"), F.col("e.p1.x").alias("x1"), F.col("e.p1.y").alias("y1"), foot["r"].alias("r"), G.distance((F.lit(50.0), F.lit(40.0)), (foot["x"], foot["y"])).alias("d"))


@query
def j8_cross(spark, sf_dir):
    return canvas.edge_intersections(tables.geometry(spark, sf_dir))


@query
def j9_corners(spark, sf_dir):
    return canvas.contained_corners(tables.geometry(spark, sf_dir))


@query
def u2_points(spark, sf_dir):
    return canvas.special_points(tables.geometry(spark, sf_dir)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query
def a18_positions(spark, sf_dir):
    g = tables.geometry(spark, sf_dir)
    open_ = g.select("collage_id", "image_id", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return layout.solve_positions(placement.pin_first(open_, ["x", "y"]), tables.neighbours(g))


@query
def a17_error(spark, sf_dir):
    g = tables.geometry(spark, sf_dir)
    moves = tables.neighbours(g).withColumn("dx", F.col("dx") + ((F.col("image_a") * 31 + F.col("image_b") * 17) % 7 - 3) / 10)
    return layout.layout_error(layout.residuals(g.select("collage_id", "image_id", F.col("mx").alias("x"), F.col("my").alias("y")), moves))


@query
def a19_layout(spark, sf_dir):
    g = tables.mosaic_geometry(tables.mosaic_lines(spark, sf_dir))
    side = lambda s: g.select("collage_id", F.col("image_id").alias(f"image_{s}"), F.struct("c", "s", "mx", "my").alias(f"g{s}"))
    pairs = side("a").withColumn("image_b", F.col("image_a") + 1).join(side("b"), ["collage_id", "image_b"])
    points = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((5, 45), (60, 44), (8, 62), (55, 60)))))
    q = pairs.withColumn("p", points)
    p = G.place(F.col("ga"), (F.col("p.x"), F.col("p.y")))
    b = G.unplace(F.col("gb"), p)
    found = q.select(*PAIR, F.col("p.x").alias("xa"), F.col("p.y").alias("ya"), b[0].alias("xb"), b[1].alias("yb"))
    open_ = g.select("collage_id", "image_id", *(F.lit(None).cast("double").alias(c) for c in ("x", "y", "dangle_deg")))
    return layout.solve_layout(placement.pin_first(open_, ["x", "y", "dangle_deg"]), found)


def _geometry(spark, sf_dir):
    return tables.mosaic_geometry(tables.mosaic_lines(spark, sf_dir))


def _placed(spark, sf_dir):
    return canvas.resample(_geometry(spark, sf_dir), _planes(spark, sf_dir))


@query
def h1_resample(spark, sf_dir):
    return _placed(spark, sf_dir)


@query
def j7_gather(spark, sf_dir):
    pixels = tables.mosaic(spark, sf_dir)
    places = canvas.cover(_geometry(spark, sf_dir)).select("collage_id", "image_id", F.col("y").alias("ty"), F.col("x").alias("tx"), "sx", "sy")
    found = orient.gather(pixels, places, matching.sizes(pixels)).where("valid")
    return found.select("collage_id", "image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


@query
def a11_average(spark, sf_dir):
    return collage.blend_average(_geometry(spark, sf_dir), _planes(spark, sf_dir))


@query
def a14_cover(spark, sf_dir):
    return canvas.cover_pixels(canvas.cover_tiles(_geometry(spark, sf_dir)))


@query
def m12_distance(spark, sf_dir):
    return canvas.distance_map(_geometry(spark, sf_dir))


@query
def m13_weight(spark, sf_dir):
    d = canvas.distance_map(_geometry(spark, sf_dir))
    return d.select("collage_id", "image_id", "y", "x", G.weight(F.col("d")).alias("weight"), G.view_scale(F.col("d"), F.lit(64), F.lit(64)).alias("view"))


@query
def j11_contained(spark, sf_dir):
    return canvas.side_points(_geometry(spark, sf_dir)).withColumn("contained", F.col("contained").cast("int"))


@query
def a12_weighted(spark, sf_dir):
    return canvas.blend_by_distance(_geometry(spark, sf_dir), _planes(spark, sf_dir))


def _coloured(spark, sf_dir):
    """Planes with channels derived from their values."""
    change = {"luma": lambda v: v + 0.5, "cb": lambda v: v / 2, "cr": lambda v: 0.5 - v / 4}
    return _planes(spark, sf_dir).withColumns({c: F.transform("data", f) for c, f in change.items()})


@query
def a11_colour(spark, sf_dir):
    return collage.blend_average(_geometry(spark, sf_dir), _coloured(spark, sf_dir), canvas.COLOUR)


@query
def a12_colour(spark, sf_dir):
    return canvas.as_bytes(collage.blend_weighted(_geometry(spark, sf_dir), _coloured(spark, sf_dir), channels=canvas.COLOUR), canvas.COLOUR)


@query
def w8_owner(spark, sf_dir):
    return canvas.owner_pixels(canvas.owner_tiles(_geometry(spark, sf_dir), _planes(spark, sf_dir)))


@query
def m18_difference(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    return canvas.difference_to_average(placed, canvas.average_canvas(placed))


@query
def w7_border(spark, sf_dir):
    return canvas.border(canvas.cover(_geometry(spark, sf_dir)).select("collage_id", "image_id", "y", "x"))


@query
def h5_peel(spark, sf_dir):
    return canvas.peel(_geometry(spark, sf_dir), _planes(spark, sf_dir))


@query
def blend_shaped(spark, sf_dir):
    return collage.blend_shaped(_geometry(spark, sf_dir), _planes(spark, sf_dir))


@query
def blend_shaped_hard(spark, sf_dir):
    return collage.blend_shaped(_geometry(spark, sf_dir), _planes(spark, sf_dir), hard=True)


@query
def job_collage(spark, sf_dir):
    lines = tables.mosaic_lines(spark, sf_dir)
    positions, _ = collage.collage(tables.mosaic_parts(lines), tables.mosaic_planes(lines), pad=128, maximum=0.1)
    return positions.select("collage_id", "image_id", "x", "y")


@query
def job_match(spark, sf_dir):
    parts = tables.mosaic_parts(tables.mosaic_lines(spark, sf_dir))
    return collage.match_pairs(parts, _planes(spark, sf_dir), pad=128, maximum=0.1)


@query
def job_resume(spark, sf_dir):
    """Some pairs are known from a state that was written before and keep what it says; the others are matched, share by share."""
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    parts = tables.mosaic_parts(tables.mosaic_lines(spark, sf_dir)).withColumn("path", F.concat(F.lit("scans/"), "image_id", F.lit(".jpeg")))
    pairs = placement.candidate_pairs(parts).where("(image_a + image_b) % 3 <> 0")
    known = pairs.select(*PAIR, F.when(F.col("image_b") % 2 == 0, F.lit("X")).otherwise(F.lit("-")).alias("rel"), *(F.when(F.col("image_b") % 2 == 0, F.lit(v)).alias(c) for c, v in (("dx", 1.5), ("dy", -2.0))))
    collage.write_state(folder, parts, states.relations_by_path(known, parts))
    listed, relations = collage.resume(spark, folder)
    again = listed.join(parts.select("collage_id", "path", "image_id"), ["collage_id", "path"])
    return collage.match_in_steps(f"{folder}/matched", again, _planes(spark, sf_dir), states.relations_by_id(relations, again), steps=2, pad=128, maximum=0.1)


@query
def job_rotated(spark, sf_dir):
    parts = tables.mosaic_parts(tables.mosaic_lines(spark, sf_dir)).withColumn("dangle_deg", F.lit(None).cast("double"))
    matched = collage.match_pairs_rotated(parts, _planes(spark, sf_dir), pad=128, maximum=0.1, n=5, side=16)
    return collage.place_parts_rotated(parts, matched).select("collage_id", "image_id", "x", "y", "c", "s")


@query
def job_process(spark, sf_dir):
    """From upright scans to the weighted canvas."""
    parts = tables.mosaic_parts(tables.mosaic_lines(spark, sf_dir))
    _, _, blended = collage.process(parts, _planes(spark, sf_dir), pad=128, maximum=0.1, smooth=3, keep=lambda df: materialize(df, "job"))
    return blended
