"""Every query that has SQL returns the SQL's rows."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera import oracle, queries
from tessera.functions import kernels
from tessera.jobs import collage
from tessera.operators import canvas, matching
from tessera.sources import tables as sources

from .compare import same, tables


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, sf_dir, con, name):
    same(queries.QUERIES[name](spark, sf_dir), con, oracle.SQL[name])


def test_peeled_masks_keep_every_pixel_once_at_least(spark, sf_dir):
    kept = queries.QUERIES["h5_peel"](spark, sf_dir).toPandas()
    cover = queries.QUERIES["a14_cover"](spark, sf_dir).toPandas()
    owners = kept.groupby(["collage_id", "y", "x"]).size()
    assert len(owners) == len(cover) and len(kept) < cover["n"].sum()


def test_shaped_blend_covers_the_canvas(spark, sf_dir):
    blend = queries.QUERIES["blend_shaped"](spark, sf_dir).toPandas()
    assert len(blend) == queries.QUERIES["a14_cover"](spark, sf_dir).count() and blend["v"].notna().all()


def test_shrunk_planes_match_like_joined_pixels(spark, sf_dir):
    pixels = sources.mosaic(spark, sf_dir)
    want = matching.match_relational(sources.mosaic_parts(pixels), pixels).toPandas().sort_values(["collage_id", "image_a", "image_b"])
    got = queries.QUERIES["match_small"](spark, sf_dir).toPandas().sort_values(["collage_id", "image_a", "image_b"])
    assert got[["image_a", "image_b", "dx", "dy", "overlaps"]].to_numpy().tolist() == want[["image_a", "image_b", "dx", "dy", "overlaps"]].to_numpy().tolist()
    assert np.allclose(got[["score", "difference"]], want[["score", "difference"]], atol=2e-6)


def test_hard_shaped_blend_shows_one_kept_image(spark, sf_dir):
    hard = queries.QUERIES["blend_shaped_hard"](spark, sf_dir).toPandas()
    kept = queries.QUERIES["h5_peel"](spark, sf_dir).toPandas()
    last = kept.groupby(["collage_id", "y", "x"])["image_id"].max()
    assert hard.set_index(["collage_id", "y", "x"])["image_id"].sort_index().equals(last.sort_index())
    placed = queries.QUERIES["h1_resample"](spark, sf_dir).toPandas().set_index(["collage_id", "image_id", "y", "x"])["v"]
    assert np.allclose(hard["v"], placed.loc[list(zip(hard["collage_id"], hard["image_id"], hard["y"], hard["x"]))])


def test_soft_shaped_blend_weighs_by_smoothed_masks(spark, sf_dir):
    keys = ["collage_id", "image_id", "y", "x"]
    placed = queries.QUERIES["h1_resample"](spark, sf_dir).toPandas()
    kept = set(map(tuple, queries.QUERIES["h5_peel"](spark, sf_dir).toPandas()[keys].to_numpy().tolist()))
    total, s = {}, {}
    size = {r["collage_id"]: (r["canvas_h"], r["canvas_w"]) for r in canvas.sizes(sources.mosaic_geometry(sources.mosaic_lines(spark, sf_dir))).collect()}
    for (c, _), part in placed.groupby(["collage_id", "image_id"]):
        mask = np.zeros(size[c])  # the whole canvas: smoothing is clamped at its border only
        for r in part[keys].to_numpy().tolist():
            mask[r[2], r[3]] = tuple(r) in kept
        for _ in range(200):
            for axis in (0, 1):
                p = np.pad(mask, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], "edge")
                low, mid, high = (np.take(p, np.arange(k, k + mask.shape[axis]), axis) for k in range(3))
                mask = (low + 2 * mid + high) / 4
        for y, x, v in part[["y", "x", "v"]].itertuples(index=False):
            w = mask[y, x]
            total[c, y, x], s[c, y, x] = total.get((c, y, x), 0) + w, s.get((c, y, x), 0) + w * v
    blend = queries.QUERIES["blend_shaped"](spark, sf_dir).toPandas()
    want = [s[k] / total[k] for k in zip(blend["collage_id"], blend["y"], blend["x"])]
    assert len(blend) == len(total) and np.allclose(blend["v"], want, atol=2e-6)


def test_the_whole_job_corrects_rotations(spark, sf_dir):
    pixels = sources.mosaic(spark, sf_dir).where("collage_id = 0").cache()
    parts = sources.mosaic_parts(pixels).withColumn("dangle_deg", F.lit(None).cast("double"))
    _, positions, _ = collage.process(parts, matching.planes(pixels).cache(), pad=128, maximum=0.1, smooth=3, rotated=True, side=16, keep=lambda df: df.cache())
    got = positions.orderBy("image_id").toPandas()
    assert np.allclose(got[["x", "y", "c", "s"]], [(0, 40 * k, 1, 0) for k in range(4)], atol=1e-6)


def test_spectral_angle_stays_within_the_maximum(spark, sf_dir):
    assert queries.QUERIES["h6_spectral"](spark, sf_dir).toPandas()["angle_deg"].abs().max() <= 6


def test_angles_of_all_steps_against_brute_force(spark, sf_dir):
    got = {(r["collage_id"], r["image_id"]): r["angle_deg"] for r in queries.QUERIES["a3_full"](spark, sf_dir).collect()}
    planes = matching.planes(sources.mosaic(spark, sf_dir)).collect()
    assert len(got) == len(planes)
    for r in planes:
        plane = np.asarray(r["data"], float).reshape(r["height"], r["width"])
        scores = [(np.diff(kernels.turn(plane, -1 + k / 20)[0].sum(1)) ** 2).sum() for k in range(41)]
        k = round((got[r["collage_id"], r["image_id"]] + 1) * 20)
        assert abs(-1 + k / 20 - got[r["collage_id"], r["image_id"]]) < 1e-6 and scores[k] >= max(scores) * (1 - 1e-9)


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
