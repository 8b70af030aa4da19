"""Packed tiles against the same operators on pixel rows, and against numpy on whole images."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import boundary, kernels, labels, pixels, tiles


def rows_of(spark, images, kind="long"):
    flat = [(i, y, x, a[y, x].item()) for i, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(flat, f"img long, y int, x int, v {kind}")


def whole(df, shape, n, v="v"):
    got = df.toPandas()
    out = np.zeros((n, *shape), got[v].to_numpy().dtype)
    out[got["img"], got["y"], got["x"]] = got[v]
    return out


@pytest.fixture(scope="module")
def maps():
    rng = np.random.default_rng(0)
    coarse = rng.integers(0, 4, (3, 8, 11))
    return np.repeat(np.repeat(coarse, 4, 1), 5, 2)[:, :29, :51]  # no multiple of the tile on any side


@pytest.mark.parametrize("size", [8, 13, 64])
def test_tiles_hold_the_image(spark, maps, size):
    t = tiles.of_pixels(rows_of(spark, maps), "v", 29, 51, size)
    assert t.count() == 3 * -(-29 // size) * -(-51 // size)
    assert (whole(tiles.pixels(t, "v", "long"), (29, 51), 3) == maps).all()


def test_tiles_of_arrays_need_no_shuffle(spark):
    a = np.arange(70.0).reshape(7, 10)
    rows = spark.createDataFrame([(0, a.ravel().tolist())], "img long, e array<double>")
    t = tiles.of_arrays(rows, "e", 7, 10, 4)
    assert "Exchange" not in t._jdf.queryExecution().toString()
    assert (whole(tiles.pixels(t), (7, 10), 1)[0] == a).all()


@pytest.mark.parametrize("size", [8, 13])
def test_operators_equal_those_on_pixels(spark, maps, size):
    rows = rows_of(spark, maps)
    t = tiles.of_pixels(rows, "v", 29, 51, size)
    inner = labels.erode(rows, "v").select("img", "y", "x", F.when(F.col("inner"), F.col("v")).otherwise(0).alias("v"))
    assert (whole(tiles.pixels(tiles.inner(t), "v", "long"), (29, 51), 3) == whole(inner, (29, 51), 3)).all()
    marked = boundary.bordered(rows, {"m": "v"}, boundary.CROSS).select("img", "y", "x", F.col("m").cast("long").alias("v"))
    assert (whole(tiles.pixels(tiles.bordered(t), "v", "long"), (29, 51), 3) == whole(marked, (29, 51), 3)).all()
    grown = labels.dilate(labels.dilate(rows, "v", 29, 51), "v", 29, 51)
    assert (whole(tiles.pixels(tiles.dilated(t, 2), "v", "long"), (29, 51), 3) == whole(grown, (29, 51), 3)).all()
    pool = pixels.max_pool(rows, "v", 3).select("img", "y", "x", F.col("pool").alias("v"))
    assert (whole(tiles.pixels(tiles.pooled(t, 3), "v", "long"), (29, 51), 3) == whole(pool, (29, 51), 3)).all()


def test_means_and_gradients_over_faces(spark):
    rng = np.random.default_rng(1)
    a = rng.random((1, 30, 26))
    t = tiles.of_pixels(rows_of(spark, a, "double"), "v", 30, 26, 9, kind="<f8")
    assert np.allclose(whole(tiles.pixels(tiles.gradient(t)), (30, 26), 1), whole(pixels.gradient(rows_of(spark, a, "double"), "v").select("img", "y", "x", F.col("grad").alias("v")), (30, 26), 1))
    p, n = np.pad(a[0], 2), np.pad(np.ones(a[0].shape), 2)
    sums = [sum(q[i : i + 30, j : j + 26] for i in range(5) for j in range(5)) for q in (p, n)]
    assert np.allclose(whole(tiles.pixels(tiles.smoothed(t, 2)), (30, 26), 1)[0], sums[0] / sums[1])


def test_only_tiles_and_strips_are_shuffled(spark, maps):
    t = tiles.of_pixels(rows_of(spark, maps), "v", 29, 51, 13).checkpoint()
    plan = tiles.inner(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    strips = tiles._with_strips(t, 1, ("img",)).where("not own").select(F.sum(F.length("data")).alias("n")).first()["n"]
    assert strips < 0.4 * t.select(F.sum(F.length("data")).alias("n")).first()["n"]  # tiles of 13: perimeters are a third


def test_a_halo_wider_than_a_tile_is_an_error(spark, maps):
    t = tiles.of_pixels(rows_of(spark, maps), "v", 29, 51, 8)
    with pytest.raises(Exception, match="wider than a tile"):
        tiles.pooled(t, 9).count()


def test_missing_tiles_and_empty_tables(spark, maps):
    t = tiles.of_pixels(rows_of(spark, maps), "v", 29, 51, 13)
    some = t.where("not (by = 1 and bx = 1)")
    assert tiles.inner(some).count() == t.count() - 3
    assert tiles.joined(t.where("false")).count() == 0 and tiles.inner(t.where("false")).count() == 0


@pytest.mark.parametrize("size", [7, 16, 64])
def test_components_across_tiles(spark, maps, size):
    t = tiles.run_blocks(tiles.of_pixels(rows_of(spark, maps), "v", 29, 51, size), lambda a: kernels.components(a > 1, kernels.FOUR))
    joined = tiles.joined(t)
    got = whole(tiles.pixels(joined, "v", "long"), (29, 51), 3)
    for a, b in zip(maps, got, strict=True):
        want = kernels.components(a > 1, kernels.FOUR)
        assert ((want > 0) == (b > 0)).all()
        pairs = set(zip(want[want > 0].tolist(), b[b > 0].tolist(), strict=True))
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    boxes = tiles.measured(joined).toPandas()
    for r in boxes.itertuples():
        y, x = np.nonzero(got[r.img] == r.label) if r.label else (np.zeros(0), np.zeros(0))
        assert (r.area, r.r0, r.r1, r.c0, r.c1) == (len(y), y.min(), y.max() + 1, x.min(), x.max() + 1)


def test_ids_never_clash(spark):
    """A hundred thousand labels in a block, two images of different sizes, and labels that do not fit."""
    wide, small = np.arange(1, 102_401).reshape(320, 320), np.arange(1, 26).reshape(5, 5)
    t = tiles.of_pixels(rows_of(spark, [wide]), "v", 320, 320, 320).unionByName(tiles.of_pixels(rows_of(spark, [small]).withColumn("img", F.lit(1).cast("long")), "v", 5, 5, 3))
    ids = tiles.pixels(tiles.global_labels(t, 2, 2), "v", "long")
    assert ids.select("v").distinct().count() == ids.count() == 320 * 320 + 25
    one = tiles.mapped(t.where("img = 1"), lambda a: a + (1 << 32))
    with pytest.raises(Exception, match="does not fit"):
        tiles.global_labels(one, 2, 2).count()
