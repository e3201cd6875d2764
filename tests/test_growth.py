"""Steps whose rows are many more than Spark takes them for."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import canvas, orient, placement
from tessera.sources import tables


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def _shuffled(spark) -> dict[int, int]:
    """Bytes that stages wrote for shuffles, by stage; Spark forgets old stages."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_pixels_of_images_are_made_in_several_tasks(spark, sf_dir):
    g = tables.mosaic_geometry(tables.mosaic_lines(spark, sf_dir))
    for images in (g, canvas._surrounded(g)):
        assert canvas.cover(images).select(F.spark_partition_id()).distinct().count() > 1


def test_images_around_are_joined_before_pixels_are_made(spark, sf_dir):
    plan = _plan(queries.QUERIES["j11_contained"](spark, sf_dir))
    pixels = [k for k, line in enumerate(plan) if re.search(r"Generate explode\(.*\[x#", line)]
    assert pixels and max(pixels) < min(k for k, line in enumerate(plan) if "Join " in line)


def test_a_large_collage_is_paired_block_by_block(spark):
    parts = spark.range(60).selectExpr("id div 40 as collage_id", "cast(id as int) as image_id", "id % 4 = 0 as open")
    parts = parts.union(spark.sql("select 0L, cast(null as int), true"))
    got = placement.candidate_pairs(parts, block=5).withColumn("task", F.spark_partition_id()).toPandas()
    assert got["task"].nunique() > 2  # one collage each in two tasks at most, if not by block
    want = [(c, a, b) for c, ids in ((0, range(40)), (1, range(40, 60))) for a in ids for b in ids if a < b and (a % 4 == 0 or b % 4 == 0)]
    assert sorted(map(tuple, got[["collage_id", "image_a", "image_b"]].to_numpy().tolist())) == want


def test_what_pairs_shuffle_grows_with_the_parts_and_not_with_their_square(spark):
    sent = []
    for n in (500, 2000):
        before = max(_shuffled(spark), default=-1)
        pairs = placement.candidate_pairs(spark.range(n).selectExpr("0L as collage_id", "cast(id as int) as image_id", "true as open"), block=5)
        assert pairs.where("image_a < image_b").count() == n * (n - 1) // 2
        sent.append(sum(size for stage, size in _shuffled(spark).items() if stage > before))
    assert 0 < sent[1] < 6 * sent[0]


def test_pairs_of_blocks_of_several_arrays(spark):
    parts = spark.range(3000).selectExpr("'c' as collage_id", "concat('p', id) as image_id", "if(id % 50 = 0, true, if(id % 3 = 0, null, false)) as open")
    parts = parts.union(spark.sql("select 'c', 'p50', false")).union(spark.sql("select cast(null as string), 'p1', true"))  # listed twice; in no collage
    got = placement.candidate_pairs(parts, block=3000)
    rows = [(f"p{k}", k % 50 == 0) for k in range(3000)] + [("p50", False)]
    want = Counter((min(a, b), max(a, b)) for a, is_open in rows if is_open for b, other in rows if a != b and (not other or a < b))
    assert Counter(map(tuple, got.select("image_a", "image_b").toPandas().to_numpy().tolist())) == want


def test_pairs_stay_where_they_are_made_when_little_is_known_of_them(spark):
    pairs = spark.range(1000).selectExpr("0L as collage_id", "cast(id as int) as image_a", "cast(id + 1 as int) as image_b")
    many = spark.range(2_000_000).selectExpr("cast(id % 7 as int) as image_a", "cast(id % 7 + 1 as int) as image_b", "id")
    known = placement.attach_known(pairs, many.groupBy("image_a", "image_b").agg(F.min("id").alias("rel")))
    assert "BroadcastHashJoin" in known._jdf.queryExecution().sparkPlan().toString()
    assert known.count() == 1000 and known.where("rel = image_a").count() == 7


def test_the_first_rows_of_pairs_are_found_without_a_sort_of_all(spark):
    rows = [(7, 1, 2, "X", 7.0), (3, 1, 2, "-", 3.0), (3, 2, 3, None, 1.0), (None, 2, 3, "X", 2.0), (None, 5, 6, "X", 9.0), (4, 2, 1, "X", 4.0)]
    got = placement.first_of_pairs(spark.createDataFrame(rows * 2, "row_id long, image_a int, image_b int, rel string, dx double"), "row_id")
    assert sorted(map(tuple, got.select("image_a", "image_b", "rel", "dx").collect())) == [(1, 2, "-", 3.0), (2, 1, "X", 4.0), (2, 3, None, 1.0), (5, 6, "X", 9.0)]


def test_only_lowest_rows_of_known_relations_are_ranked(spark, sf_dir, monkeypatch):
    plans, kept = {}, placement.materialize

    def watched(df, name):
        plans[name] = _plan(df)
        return kept(df, name)

    monkeypatch.setattr(placement, "materialize", watched)
    queries.QUERIES["j3_known"](spark, sf_dir)
    above = next(k for k, line in enumerate(plans["known"]) if "Window" in line)
    assert any("Join" in line for line in plans["known"][above:])


def test_borders_need_the_ends_of_lines_only(spark):
    pixels = [(0, 1, 2, x) for x in (1, 2, 3, 5)] + [(0, 1, 3, 3), (0, 1, 4, 3), (0, 2, 3, 3)]
    found = canvas.border(spark.createDataFrame(pixels + pixels[:2], "collage_id long, image_id int, y int, x int"))
    assert not any("Window" in line for line in _plan(found))
    assert sorted(map(tuple, found.collect())) == sorted(set(pixels))
    block = spark.range(25).selectExpr("0L as collage_id", "1 as image_id", "cast(id div 5 as int) as y", "cast(id % 5 as int) as x")
    assert {(r["y"], r["x"]) for r in canvas.border(block).collect()} == {(y, x) for y in range(5) for x in range(5) if {y, x} & {0, 4}}


def test_covers_are_counted_by_tiles(spark, sf_dir):
    assert not any(re.search(r"Aggregate \[collage_id#\d+L?, y#\d+, x#", line) for line in _plan(queries.QUERIES["a14_cover"](spark, sf_dir)))
    g = tables.mosaic_geometry(tables.mosaic_lines(spark, sf_dir))
    want = canvas.cover(g).groupBy("collage_id", "y", "x").count()
    got = canvas.cover_pixels(canvas.cover_tiles(g, 50), 50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_neighbours_are_no_rows(spark, sf_dir):
    assert not any("Generate explode([0,1,2,3])" in line for line in _plan(queries.QUERIES["j7_gather"](spark, sf_dir)))


def test_gathered_values_leave_missing_pixels_out(spark):
    pixels = [(0, 1, y, x, None if (y, x) == (0, 0) else float(10 * y + x)) for y in range(8) for x in range(8) if (y, x) != (3, 3)]
    pixels = spark.createDataFrame(pixels, "collage_id long, image_id int, y int, x int, v double")
    places = spark.createDataFrame([(0, 1, 5, 6, 6.0, 5.0), (0, 1, 0, 0, 0.0, 0.0), (0, 1, 3, 3, 3.5, 3.0), (0, 2, 0, 0, 0.0, 0.0)], "collage_id long, image_id int, ty int, tx int, sx double, sy double")
    dims = pixels.groupBy("collage_id", "image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    got = {(r["image_id"], r["ty"], r["tx"]): (r["valid"], r["v"]) for r in orient.gather(pixels, places, dims).collect()}
    assert got == {(1, 5, 6): (True, 56.0), (1, 0, 0): (True, 0.0), (1, 3, 3): (True, 0.5625 * 34 - 0.0625 * 32 - 0.0625 * 35)}
