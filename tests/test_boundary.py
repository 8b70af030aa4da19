"""Thick boundaries near each other, tile by tile, against plain numpy; and plans that do not join pixels with disks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella import plans
from tessella.operators import boundary as b
from tests.conftest import SMALL


def thick(a):
    out = np.zeros(a.shape, bool)
    for y, x in np.ndindex(a.shape):
        out[y, x] = any(a[v, u] != a[y, x] for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= v < a.shape[0] and 0 <= u < a.shape[1])
    return np.argwhere(out)


def hits(p, q, r):
    return int(sum(len(q) > 0 and (((q - s) ** 2).sum(1) <= r * r).any() for s in p))


def test_counts_over_tiles_equal_plain_ones(spark):
    rng = np.random.default_rng(0)
    frames, want = [], {}
    for img, (h, w, r) in enumerate([(23, 37, 2), (23, 37, 6), (9, 5, 1), (1, 1, 3), (40, 12, 11)]):
        gt, pr = (np.kron(rng.integers(0, 3, (-(-h // 6), -(-w // 6))), np.ones((6, 6), int))[:h, :w] for _ in range(2))
        y, x = np.indices((h, w))
        frames.append(pd.DataFrame({"img": img, "y": y.ravel(), "x": x.ravel(), "gt": gt.ravel(), "pr": pr.ravel(), "r": r}))
        g, p = thick(gt), thick(pr)
        want[img] = (len(g), len(p), hits(g, p, r), hits(p, g, r))
    rows = spark.createDataFrame(pd.concat(frames)).withColumns({c: F.col(c).cast("int") for c in ("y", "x", "r")}).repartition(5)
    got = b.near_counts(rows, tile=4).groupBy("img").agg(*[F.sum(c).alias(c) for c in ("ng", "np", "hg", "hp")]).collect()
    assert {r["img"]: tuple(r)[1:] for r in got} == want


def test_boundaries_meet_without_joins_of_pixels(spark):
    for name in ("br_pooled", "boundary_scales"):
        plan = plans.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" not in plan and "Cross" not in plan
        assert plan.count("MapInPandas") == 1
