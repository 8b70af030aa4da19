"""Distances, scan lines, volumes, overlaps and holes as plans, against whole-image versions."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import distance, holes, kernels, overlaps, scan, tiles, volumes
from tessella.operators import pixels as p
from tests.test_tiles import rows_of, whole


def blobs(rng, shape, n):
    """A map of round labels, later ones over earlier ones."""
    y, x = np.indices(shape)
    out = np.zeros(shape, np.int64)
    for k in range(1, n + 1):
        cy, cx, r = rng.integers(0, shape[0]), rng.integers(0, shape[1]), rng.integers(2, 9)
        out[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = k
    return out


def border(a):
    same = [np.pad(a, 1, constant_values=-1)[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] == a for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0))]
    return (a > 0) & ~np.logical_and.reduce(same)


def test_distance_to_own_border(spark):
    rng = np.random.default_rng(0)
    maps = [blobs(rng, (40, 50), 12) for _ in range(3)]
    got = whole(distance.to_own_border(rows_of(spark, maps), "v"), (40, 50), 3, "d2")
    for a, d in zip(maps, got, strict=True):
        edge = border(a)
        for y, x in np.argwhere(a > 0):
            b = np.argwhere(edge & (a == a[y, x]))
            assert d[y, x] == ((b - (y, x)) ** 2).sum(1).min()


def test_distance_is_linear_in_pixels(spark):
    """One label of n² pixels: four times the pixels take far less than sixteen times the time of the quadratic join."""

    def seconds(n):
        rows = spark.range(n * n).select(F.lit(0).alias("img"), F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), F.lit(1).alias("v"))
        began = time.time()
        far, total = distance.to_own_border(rows, "v").agg(F.max("d2"), F.count("*")).first()
        assert (far, total) == ((n // 2 - 1) ** 2, n * n)
        return time.time() - began

    seconds(64)
    assert seconds(512) < 8 * max(2.0, seconds(256))


def test_scan_lines_equal_crossings(spark):
    rng = np.random.default_rng(1)
    images = [[rng.uniform(-5, 40, (rng.integers(1, 9), 2)).round(rng.integers(0, 3)).tolist() for _ in range(4)] for _ in range(6)]
    points = [(i, k, v, x, y) for i, many in enumerate(images) for k, shape in enumerate(many, 1) for v, (x, y) in enumerate(shape)]
    points += [(9, 1, 0, None, 1.0), (9, 1, 1, 2.0, float("nan")), (9, 1, 2, 3.0, 3.0)]
    frame = spark.createDataFrame(points, "img int, polygon int, vertex int, x double, y double")
    for last in (False, True):
        got = whole(scan.rasterised(frame, 30, 35, last), (30, 35), 10, "label")
        for i, many in enumerate(images):
            assert (got[i] == kernels.rasterise(many, 30, 35, last)).all()
        assert not got[9].any()


def test_planes_stitched_as_by_kernel(spark):
    rng = np.random.default_rng(2)
    volumes_ = []
    for _ in range(4):
        planes = [blobs(rng, (24, 24), 5)]
        for _ in range(9):
            moved = np.roll(planes[-1], rng.integers(-1, 2, 2), (0, 1)) if rng.random() < 0.8 else blobs(rng, (24, 24), 5)
            names = rng.permutation(40)[: moved.max() + 1]
            names[0] = 0
            planes.append(np.array([names[v] if v else 0 for v in moved.ravel()]).reshape(24, 24))
        volumes_.append(planes)
    flat = [(v, z, y, x, int(a[y, x])) for v, planes in enumerate(volumes_) for z, a in enumerate(planes) for y in range(24) for x in range(24)]
    rows = spark.createDataFrame(flat, "vol int, z int, y int, x int, label long")
    got = volumes.stitched(rows, "label").toPandas()
    for v, planes in enumerate(volumes_):
        out = np.zeros((10, 24, 24), np.int64)
        part = got[got["vol"] == v]
        out[part["z"], part["y"], part["x"]] = part["label"]
        assert (out == np.stack(kernels.stitch(planes))).all()


def shrunk(face):
    """Labels of a face of a block without those at a slope, or next to one, of both directions."""
    slope = [np.gradient(face.astype(float), axis=k) for k in (0, 1)]
    flat = np.where((slope[0] == 0) & (slope[1] == 0), face, 0)
    around = [np.pad(flat, 1, mode="edge")[1 + dy : 1 + dy + flat.shape[0], 1 + dx : 1 + dx + flat.shape[1]] for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0))]
    return np.where(np.logical_and.reduce([n > 0 for n in around]), flat, 0)


@pytest.mark.parametrize("shrink", [True, False])
def test_faces_of_volumes(spark, shrink):
    rng = np.random.default_rng(3)
    coarse = rng.integers(0, 3, (6, 6, 6))
    a = np.repeat(np.repeat(np.repeat(coarse, 4, 0), 4, 1), 4, 2)
    a[rng.random(a.shape) < 0.02] = 0
    size = 8
    flat = [(0, *map(int, at), int(a[tuple(at)])) for at in np.argwhere(a >= 0)]
    rows = spark.createDataFrame(flat, "vol int, z int, y int, x int, label long")
    from tessella.operators.labels import global_ids

    voxels = rows.select("vol", "z", "y", "x", global_ids(volumes.block_number(size, 3, 3, 3), F.col("label")).alias("id"))
    got = {(r["a"], r["b"]) for r in volumes.block_faces(voxels, size, shrink=shrink).collect()}
    want = set()
    for axis in range(3):
        for block in np.ndindex(3, 3, 3):
            if block[axis] == 2:
                continue
            def one(which, at, axis=axis):
                part = a[tuple(slice(b * size, b * size + size) for b in which)].take(at, axis)
                number = (which[0] * 3 + which[1]) * 3 + which[2]
                face = np.where(part > 0, (number << 32) | part, 0)
                return shrunk(face) if shrink else face
            after = tuple(b + (k == axis) for k, b in enumerate(block))
            u, v = one(block, size - 1), one(after, 0)
            want |= {(int(x), int(y)) for x, y in zip(u[(u > 0) & (v > 0)], v[(u > 0) & (v > 0)], strict=True)}
    assert got == want and got
    roots = volumes.joined(voxels, size, shrink=shrink).where("id > 0")
    assert roots.select("id").distinct().count() < voxels.where("id > 0").select("id").distinct().count()


def test_ids_that_do_not_fit(spark):
    from tessella.operators.labels import global_ids

    one = spark.range(1)
    assert one.select(global_ids(F.lit(0), F.lit(100_001)).alias("a"), global_ids(F.lit(1), F.lit(1)).alias("b")).first() == (100_001, (1 << 32) + 1)
    for block, label in ((0, 1 << 32), (1 << 31, 1), (-1, 1), (1, -1)):
        with pytest.raises(Exception, match="no id holds label"):
            one.select(global_ids(F.lit(block), F.lit(label))).collect()


def test_overlaps_in_rounds(spark):
    rng = np.random.default_rng(4)
    images = []
    for _ in range(8):
        masks = []
        for _ in range(rng.integers(1, 12)):
            y, x = np.indices((20, 20))
            cy, cx, r = rng.integers(3, 17, 2).tolist() + [rng.integers(1, 7)]
            masks.append((y - cy) ** 2 + (x - cx) ** 2 <= r * r)
        images.append(masks)
    flat = [(i, k, int(y), int(x)) for i, masks in enumerate(images) for k, m in enumerate(masks, 1) for y, x in np.argwhere(m)]
    rows = spark.createDataFrame(flat, "img int, mask int, y int, x int")
    got = whole(overlaps.without_covered(rows), (20, 20), 8, "label")
    for masks, out in zip(images, got, strict=True):
        assert (out == kernels.without_covered(masks)).all()
    assert overlaps.without_covered(rows.where("false")).count() == 0


def ringed(rng):
    """A map of blobs with holes in them, some across the faces of tiles and some at the edge of the image."""
    a = blobs(rng, (60, 70), 20)
    y, x = np.indices(a.shape)
    for k in range(21, 25):
        cy, cx, r = rng.integers(0, 60), rng.integers(0, 70), rng.integers(9, 20)
        a[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = k
    for _ in range(40):
        cy, cx, r = rng.integers(0, 60), rng.integers(0, 70), rng.integers(0, 3)
        a[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = 0
    return a


def expected(a):
    """Holes with one label around them, filled."""
    out = a.copy()
    parts = kernels.components(a == 0, kernels.FOUR)
    for k in range(1, parts.max() + 1):
        hole = parts == k
        if hole[0].any() or hole[-1].any() or hole[:, 0].any() or hole[:, -1].any():
            continue
        near = np.zeros_like(hole)
        near[1:] |= hole[:-1]
        near[:-1] |= hole[1:]
        near[:, 1:] |= hole[:, :-1]
        near[:, :-1] |= hole[:, 1:]
        names = np.unique(a[near & (a > 0)])
        if len(names) == 1:
            out[hole] = names[0]
    return out


@pytest.mark.parametrize("size", [9, 32, 100])
def test_holes_across_tiles(spark, size):
    rng = np.random.default_rng(5)
    maps = [ringed(rng) for _ in range(3)]
    t = tiles.of_pixels(rows_of(spark, maps), "v", 60, 70, size)
    got = whole(tiles.pixels(holes.filled(t), "v", "long"), (60, 70), 3)
    for a, b in zip(maps, got, strict=True):
        assert (b == expected(a)).all()
    assert all((expected(a) != a).sum() > 10 for a in maps)
    kept = whole(holes.cleaned(t, 12), (60, 70), 3, "label")
    for a, b in zip(maps, kept, strict=True):
        names, n = np.unique(a, return_counts=True)
        want = expected(np.where(np.isin(a, names[(n < 12) & (names > 0)]), 0, a))
        names, n = np.unique(want, return_counts=True)
        want = np.where(np.isin(want, names[(n < 12) & (names > 0)]), 0, want)
        assert (b == kernels.renumber(want)).all()


@pytest.mark.parametrize("to", [(12, 5), (5, 12), (3, 3), (40, 7), (8, 8)])
def test_resizing_by_ranges(spark, to):
    rng = np.random.default_rng(6)
    a = rng.random((9, 11))
    rows = rows_of(spark, [a], "double")
    near = p.resize_nearest(rows, 9, 11, *to).select("img", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")
    assert (whole(near, to, 1)[0] == a[np.arange(to[0]) * 9 // to[0]][:, np.arange(to[1]) * 11 // to[1]]).all() and near.count() == to[0] * to[1]

    def weights(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(n)[None]))

    smooth = p.resize_bilinear(rows, "v", 9, 11, *to).select("img", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")
    assert np.allclose(whole(smooth, to, 1)[0], weights(9, to[0]) @ a @ weights(11, to[1]).T)


@pytest.mark.parametrize(("size", "step"), [(4, 2), (5, 3), (7, 7), (3, 1)])
def test_tiles_that_cover_a_pixel(spark, size, step):
    rows = rows_of(spark, [np.zeros((9, 11))], "double")
    got = {(r["y"], r["x"], r["ty"], r["tx"]) for r in p.tiles(rows, size, step, 9, 11).collect()}
    want = {(y, x, ty, tx) for ty in range(0, 9 - size + 1, step) for tx in range(0, 11 - size + 1, step) for y in range(ty, ty + size) for x in range(tx, tx + size)}
    assert got == want
