import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.jobs import collage
from tessera.operators import canvas, layout, orient, placement, seams
from tessera.sources import images, states


def put(path, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / "t.csv").write_text(text)
    return str(path)


def test_parts_by_name_with_optional_columns(spark, tmp_path):
    p = states.read_parts(spark, put(tmp_path / "a", "Y,Other,Image,Angle\n1,q,a.jpeg,0.5\n,r,b.jpeg,\n")).orderBy("path").collect()
    assert [tuple(r) for r in p] == [("a.jpeg", 0.5, 0.0, None, 1.0), ("b.jpeg", None, None, None, None)]
    p = states.read_parts(spark, put(tmp_path / "b", "Image,Angle,DAngle\na,0.5,\n")).collect()
    assert p[0]["dangle_deg"] is None
    with pytest.raises(ValueError):
        states.read_parts(spark, put(tmp_path / "c", "Angle\n1\n"))


@pytest.mark.parametrize("row", ["a,,X,1,2", "a,b,Y,1,2", "a,b,X,1,"])
def test_invalid_relations_fail(spark, tmp_path, row):
    with pytest.raises(PySparkException):
        states.read_relations(spark, put(tmp_path / "r", f"ImageA,ImageB,Rel,DX,DY\n{row}\n")).collect()


def test_relations_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "X", 1.5, 2.0), ("a", "c", "-", None, None)], "image_a string, image_b string, rel string, dx double, dy double")
    states.write_relations(rows, str(tmp_path / "w"))
    back = states.read_relations(spark, str(tmp_path / "w"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in placement.mirrored(rows).collect()}
    with pytest.raises(ValueError):
        states.read_relations(spark, put(tmp_path / "x", "ImageA,ImageB\na,b\n"))


def test_correspondences_round_trip(spark, tmp_path):
    point = "struct<xa: double, ya: double, xb: double, yb: double>"
    rows = spark.createDataFrame([("a", "b", "X", [(1.0, 2.0, 3.0, 4.0), (5.0, 6.0, 7.0, 8.0)]), ("a", "c", "-", [])], f"image_a string, image_b string, rel string, pts array<{point}>")
    states.write_correspondences(rows, str(tmp_path / "w"))
    assert sorted(map(str, states.read_correspondences(spark, str(tmp_path / "w")).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(PySparkException):
        states.read_correspondences(spark, put(tmp_path / "x", "ImageA,ImageB,Rel,XA,YA,XB,YB\n,,,1,2,3,4\n")).collect()


def test_positions_and_angles_are_written(spark, tmp_path):
    parts = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 0.0, 1.0)], "path string, angle_deg double, x double, y double, c double, s double")
    states.write_positions(parts, str(tmp_path / "p"))
    states.write_angles(parts, str(tmp_path / "q"))
    assert states.read_parts(spark, str(tmp_path / "p")).first()["angle_deg"] == 91.0
    assert states.read_parts(spark, str(tmp_path / "q")).first()["x"] is None


def test_images_are_decoded(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(8, 4, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for x in range(8):
        for y in range(4):
            picture.setRGB(x, y, 0xC8C8C8)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    p = images.read_images(spark, str(tmp_path)).toPandas()
    assert len(p) == 32 and p["luma"].sub(200 / 255).abs().max() < 0.03 and p["cb"].sub(0.5).abs().max() < 0.03
    images.write_raster(spark.createDataFrame([(1, 300, 5, 7)], "collage_id long, y int, x int, v int"), str(tmp_path / "raster"))
    assert spark.read.parquet(str(tmp_path / "raster")).first()["tile_y"] == 1


def test_unconnected_parts_are_told_apart(spark):
    parts = spark.createDataFrame([(0, i, 0.0 if i == 0 else None, 0.0 if i == 0 else None) for i in range(4)], "collage_id long, image_id int, x double, y double")
    moves = spark.createDataFrame([(0, 0, 1, 5.0, 0.0), (0, 2, 3, 2.0, 2.0)], "collage_id long, image_a int, image_b int, dx double, dy double")
    p = layout.solve_positions(parts, moves).toPandas().sort_values("image_id")
    assert p["component"].tolist() == [0, 0, 2, 2] and p["x"].tolist() == pytest.approx([0, 5, -1, 1])
    assert layout.layout_error(layout.residuals(spark.createDataFrame(p), moves.where("dx > 100"))).first()["error"] == 0


def test_corner_meeting_parts_fall_back_to_the_mean(spark):
    placed = spark.createDataFrame([(0, 1, 0, 0, 2.0), (0, 2, 0, 0, 4.0)], "collage_id long, image_id int, y int, x int, v double")
    zero = placed.select("collage_id", "image_id", "y", "x", F.lit(0.0).alias("d"))
    assert canvas.weighted_canvas(placed, zero).first()["v"] == 3.0


def picture(spark, path, width, height, colour):
    """A JPEG file whose pixels have colours by place."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for x in range(width):
        for y in range(height):
            image.setRGB(x, y, colour(x, y))
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def test_parts_are_joined_to_their_files(spark, tmp_path):
    for k in range(2):
        picture(spark, tmp_path / f"p{k}.jpg", 8, 6, lambda x, y: 0x404040 if k == 0 else 0xC01010)
    parts = spark.createDataFrame([(0, 0, "scans/p0.jpg"), (0, 1, "scans/p1.jpg"), (0, 2, "scans/lost.jpg")], "collage_id long, image_id int, path string")
    planes = images.read_planes(spark, str(tmp_path), parts).orderBy("image_id").collect()
    assert [(r["image_id"], r["height"], r["width"], len(r["data"])) for r in planes] == [(0, 6, 8, 48), (1, 6, 8, 48)]
    assert planes[0]["data"][0] == pytest.approx(0x40 / 255, abs=0.03) and planes[0]["cr"][0] == pytest.approx(0.5, abs=0.03)
    assert planes[1]["cr"][0] > 0.8 and planes[1]["luma"] == planes[1]["data"]
    geometry = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 0.0, 8, 6), (0, 1, 1.0, 0.0, 0.0, 4.0, 8, 6)], "collage_id long, image_id int, c double, s double, mx double, my double, w int, h int")
    blended = collage.blend_weighted(geometry, images.read_planes(spark, str(tmp_path), parts), channels=canvas.COLOUR).collect()
    assert len(blended) == 80 and {r["cr"] > 0.7 for r in blended if r["y"] >= 7} == {True}


def test_state_is_written_and_resumed(spark, tmp_path):
    parts = spark.createDataFrame([(0, i, f"p{i}.jpg", 0.0, 0.0, 40.0 * i) for i in range(3)], "collage_id long, image_id int, path string, angle_deg double, x double, y double")
    matched = spark.createDataFrame([(0, 0, 1, "X", 0.0, 40.0), (0, 0, 2, "-", None, None), (0, 1, 2, "X", 0.0, 40.0)], "collage_id long, image_a int, image_b int, rel string, dx double, dy double")
    collage.write_state(str(tmp_path / "s"), parts, states.relations_by_path(matched, parts))
    back, relations = collage.resume(spark, str(tmp_path / "s"))
    assert sorted(r["path"] for r in back.collect()) == ["p0.jpg", "p1.jpg", "p2.jpg"] and relations.count() == 6
    known = states.relations_by_id(relations, parts)
    # Planes too small to match: what is known must be enough.
    planes = spark.createDataFrame([(0, i, 1, 1, [0.0]) for i in range(3)], "collage_id long, image_id int, height int, width int, data array<double>")
    again = collage.match_pairs(parts.withColumn("x", F.lit(None).cast("double")), planes, known)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, matched.collect()))
    points = spark.createDataFrame([(0, 0, 1, "X", [(1.0, 2.0, 1.0, -38.0)]), (0, 1, 2, "-", [])], "collage_id long, image_a int, image_b int, rel string, pts array<struct<xa: double, ya: double, xb: double, yb: double>>")
    collage.write_state(str(tmp_path / "r"), parts, states.relations_by_path(points, parts))
    _, both = collage.resume(spark, str(tmp_path / "r"), rotated=True)
    assert {(r["image_a"], r["image_b"]): [tuple(p) for p in r["pts"]] for r in both.collect()} == {("p0.jpg", "p1.jpg"): [(1.0, 2.0, 1.0, -38.0)], ("p1.jpg", "p0.jpg"): [(1.0, -38.0, 1.0, 2.0)], ("p1.jpg", "p2.jpg"): [], ("p2.jpg", "p1.jpg"): []}


def test_resuming_refuses_pairs_listed_twice_and_warns_of_the_rest(spark, tmp_path):
    put(tmp_path / "s" / "position", "Image,Angle,X,Y\na,0,,\nb,0,,\n")
    put(tmp_path / "s" / "relation", "ImageA,ImageB,Rel,DX,DY\na,b,X,1,2\nb,a,X,-1,-2\n")
    with pytest.raises(ValueError):
        collage.resume(spark, str(tmp_path / "s"))
    put(tmp_path / "t" / "position", "Image,Angle,X,Y,Other\na,0,,,1\nb,0,,,2\n")
    put(tmp_path / "t" / "relation", "ImageA,ImageB,Rel,DX,DY\na,c,X,1,2\n")
    with pytest.warns(UserWarning) as found:
        collage.resume(spark, str(tmp_path / "t"))
    assert len([w for w in found if "reads" in str(w.message) or "lacks" in str(w.message)]) == 2


def test_the_spectral_angle_is_an_option(spark):
    parts = spark.createDataFrame([(0, 0, None), (0, 1, 0.7)], "collage_id long, image_id int, angle_deg double")
    planes = spark.createDataFrame([(0, i, 8, 8, [float((k * 7) % 5) for k in range(64)]) for i in range(2)], "collage_id long, image_id int, height int, width int, data array<double>")
    got = {r["image_id"]: r["angle_deg"] for r in collage.orient_images(parts, planes, 5.0, spectral=True).collect()}
    want = orient.spectral_angles(planes, 5.0).where("image_id = 0").first()["angle_deg"]
    assert got == {0: want, 1: 0.7}


def test_images_far_from_each_other_don_t_meet(spark):
    rows = [(0, i, 0.0, 1.0, 100.0 * (i % 5), 70.0 * (i // 5), 80, 120) for i in range(25)]
    geometry = spark.createDataFrame(rows, "collage_id long, image_id int, c double, s double, mx double, my double, w int, h int")
    boxes = {r["image_id"]: (r["left"], r["top"], r["right"], r["bottom"]) for r in canvas.bounding_boxes(geometry).collect()}
    meet = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    got = sorted((r["ga"]["image_id"], r["gb"]["image_id"]) for r in canvas.near_pairs(geometry).collect())
    assert got == sorted((i, j) for i in boxes for j in boxes if i != j and meet(boxes[i], boxes[j]))


def test_collages_may_share_image_ids(spark, tmp_path):
    """Two collages whose images are numbered alike and whose files have one name each."""
    parts = spark.createDataFrame([(c, i, f"c{c}/p{i}.jpg", 0.0, None, None) for c in range(2) for i in range(12)], "collage_id long, image_id int, path string, angle_deg double, x double, y double")
    matched = spark.createDataFrame([(0, 1, 2, "X", 5.0, 1.0), (1, 1, 2, "-", None, None), (1, 2, 3, "X", 7.0, 7.0), (0, 2, 10, "-", None, None)], "collage_id long, image_a int, image_b int, rel string, dx double, dy double")
    collage.write_state(str(tmp_path / "s"), parts, states.relations_by_path(matched, parts))
    back, relations = collage.resume(spark, str(tmp_path / "s"))
    assert back.groupBy("collage_id").count().count() == 2 and relations.count() == 8
    # In the order of the inputs: p2 comes before p10.
    listed = [r["Image"] for r in spark.read.option("header", True).csv(str(tmp_path / "s" / "position")).where("Collage = 0").collect()]
    assert listed == [f"c0/p{i}.jpg" for i in range(12)]
    known = states.relations_by_id(relations, parts)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in placement.attach_known(placement.candidate_pairs(parts.withColumn("open", F.lit(True))), known.select("collage_id", "image_a", "image_b", "rel", "dx", "dy")).where("rel is not null").collect()}
    assert got == {tuple(r)[:3]: tuple(r)[3:] for r in matched.collect()}
    assert placement.duplicate_pairs(matched).count() == 0 and placement.duplicate_pairs(matched.drop("collage_id")).count() == 2
    points = spark.createDataFrame([(c, 1, 2, "X", [(1.0 + c, 2.0, 3.0, 4.0)]) for c in range(2)], "collage_id long, image_a int, image_b int, rel string, pts array<struct<xa: double, ya: double, xb: double, yb: double>>")
    collage.write_state(str(tmp_path / "r"), parts, states.relations_by_path(points, parts))
    _, both = collage.resume(spark, str(tmp_path / "r"), rotated=True)
    assert {(r["collage_id"], r["image_a"]): tuple(r["pts"][0])[0] for r in both.collect() if r["image_a"].endswith("p1.jpg")} == {(0, "c0/p1.jpg"): 1.0, (1, "c1/p1.jpg"): 2.0}


def test_points_of_several_files_are_one_table(spark, tmp_path):
    head = "ImageA,ImageB,Rel,XA,YA,XB,YB\n"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.csv").write_text(head + "a,b,X,,,,\n,,,1,2,3,4\n")
    (tmp_path / "t" / "part-1.csv").write_text(head + ",,,5,6,7,8\na,c,-,,,,\nb,c,X,,,,\n")
    (tmp_path / "t" / "part-2.csv").write_text(head)
    (tmp_path / "t" / "part-3.csv").write_text(head + ",,,9,9,9,9\n")
    got = {(r["image_a"], r["image_b"]): (r["rel"], [p["xa"] for p in r["pts"]]) for r in states.read_correspondences(spark, str(tmp_path / "t")).collect()}
    assert got == {("a", "b"): ("X", [1.0, 5.0]), ("a", "c"): ("-", []), ("b", "c"): ("X", [9.0])}
    (tmp_path / "t" / "part-4.csv").write_text("ImageB,ImageA,Rel,XA,YA,XB,YB\nd,e,-,,,,\n")
    with pytest.raises(Exception, match="part-4"):  # columns in another order than in the first file
        states.read_correspondences(spark, str(tmp_path / "t")).collect()


def test_large_files_are_split_in_order(spark, tmp_path):
    rows = "".join(f"a{k},b,X,,,,\n" + "".join(f",,,{k},{j},0,0\n" for j in range(300)) for k in range(40))
    path = put(tmp_path / "t", "ImageA,ImageB,Rel,XA,YA,XB,YB\n" + rows)
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "5000")
    try:
        got = {r["image_a"]: [(p["xa"], p["ya"]) for p in r["pts"]] for r in states.read_correspondences(spark, path).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {f"a{k}": [(float(k), float(j)) for j in range(300)] for k in range(40)}


def test_matching_goes_on_where_it_was_broken_off(spark, tmp_path, monkeypatch):
    parts = spark.createDataFrame([(c, i, None, None) for c in range(2) for i in range(4)], "collage_id long, image_id int, x double, y double")
    planes = spark.createDataFrame([(c, i, 16, 16, [float((k * (c + 3) * (i + 7)) % 11) for k in range(256)]) for c in range(2) for i in range(4)], "collage_id long, image_id int, height int, width int, data array<double>")
    whole = sorted(map(tuple, collage.match_pairs(parts, planes, pad=32).collect()), key=str)
    calls, real = [], collage.match_pairs

    def breaks(*args, **how):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("broken off")
        return real(*args, **how)

    monkeypatch.setattr(collage, "match_pairs", breaks)
    with pytest.raises(RuntimeError):
        collage.match_in_steps(str(tmp_path / "m"), parts, planes, steps=5, pad=32)
    (tmp_path / "m" / "step-1-of-5" / "_SUCCESS").unlink()  # as if it had been broken off while writing
    calls.clear()
    calls += [1] * 10
    again = collage.match_in_steps(str(tmp_path / "m"), parts, planes, steps=5, pad=32)
    assert len(calls) == 14 and sorted(map(tuple, again.collect()), key=str) == whole


def test_files_of_one_name_in_several_folders(spark, tmp_path):
    for c, colour in (("a", 0x202020), ("b", 0xE0E0E0)):
        (tmp_path / c).mkdir()
        picture(spark, tmp_path / c / "1.jpeg", 8, 6, lambda x, y, v=colour: v)
    parts = spark.createDataFrame([(0, 1, "scans/a/1.jpeg"), (1, 1, "b/1.jpeg"), (2, 1, "1.jpeg")], "collage_id long, image_id int, path string")
    got = {r["collage_id"]: r["data"][0] for r in images.read_planes(spark, str(tmp_path), parts).collect()}
    assert got == {0: pytest.approx(0x20 / 255, abs=0.03), 1: pytest.approx(0xE0 / 255, abs=0.03)}


def test_rasters_of_any_key_are_written_and_read(spark, tmp_path):
    g = spark.createDataFrame([(0, k, 1.0, 0.0, 30.0 * k, 5.0, 40, 20) for k in range(3)], "collage_id long, image_id int, c double, s double, mx double, my double, w int, h int")
    planes = spark.createDataFrame([(0, k, 20, 40, [((k + 1) * j % 100) / 100 for j in range(800)]) for k in range(3)], "collage_id long, image_id int, height int, width int, data array<double>")
    on = seams.placed(g, planes, tile=256)
    images.write_tiles(on, seams.IMAGE, lambda p: (p[0] > 0, [p[1]]), str(tmp_path / "masks"))
    back = images.read_tiles(spark, str(tmp_path / "masks"), seams.IMAGE, ["v"])
    want = canvas.as_bytes(canvas.resample(g, planes)).select("collage_id", "image_id", "y", "x", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    images.write_tiles(canvas.average_tiles(g, planes), seams.COLLAGE, lambda p: (p[0] > 0, [p[1] / np.maximum(p[0], 1)]), str(tmp_path / "mean"))
    mean = images.read_tiles(spark, str(tmp_path / "mean"), seams.COLLAGE, ["v"])
    want = canvas.as_bytes(canvas.average_canvas(canvas.resample(g, planes))).select("collage_id", "y", "x", "v")
    assert all(abs(a[-1] - b[-1]) <= 1 and a[:-1] == b[:-1] for a, b in zip(sorted(map(tuple, mean.collect())), sorted(map(tuple, want.collect())), strict=True))


def test_the_whole_job_from_turned_scans(spark):
    """Scans of a lined sheet, turned by angles that nobody tells: angles and places are found."""
    rng = np.random.default_rng(8)
    sheet = kernels.smooth(rng.normal(size=(260, 420)), 1) * 3 + np.repeat(kernels.smooth(rng.normal(size=(260, 1)), 1) * 2, 420, axis=1) * 0.7
    sheet = (sheet - sheet.min()) / (sheet.max() - sheet.min())
    truth = {0: (20.0, 30.0, 0.6), 1: (150.0, 45.0, -0.4)}
    planes = []
    for k, (x, y, degrees) in truth.items():
        a = np.radians(-degrees)  # the scan lies turned, and turning it by ``degrees`` puts it upright
        v, u = np.mgrid[0:170, 0:220]
        values, _ = kernels.sample(sheet, np.cos(a) * u + np.sin(-a) * v + x, np.sin(a) * u + np.cos(a) * v + y)
        planes.append((0, k, 170, 220, values.ravel().tolist()))
    images_ = spark.createDataFrame(planes, "collage_id long, image_id int, height int, width int, data array<double>").cache()
    parts = spark.createDataFrame([(0, k, None, None, None) for k in truth], "collage_id long, image_id int, angle_deg double, x double, y double")
    oriented, positions, blended = collage.process(parts, images_, pad=512, maximum=0.4, keep=lambda df: df.cache())
    angles = {r["image_id"]: r["angle_deg"] for r in oriented.collect()}
    assert {k: abs(angles[k]) for k in truth} == {k: pytest.approx(abs(t[2]), abs=0.25) for k, t in truth.items()}
    assert angles[0] * angles[1] < 0
    p = {r["image_id"]: (r["x"], r["y"]) for r in positions.collect()}
    assert p[1][0] - p[0][0] == pytest.approx(130, abs=4) and p[1][1] - p[0][1] == pytest.approx(15, abs=4)
    assert blended.count() > 170 * 330
