"""Boundary metrics. Distances within a tolerance are equi-joins on the offsets of a disk, not theta joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.kernels import by_groups, stacks
from tessella.operators.labels import largest_overlap, shapes
from tessella.operators.metrics import ratio, region_f


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


#: Neighbours that make a pixel a thick boundary, and those that make it a contour.
CROSS, CORNER = ((-1, 0), (0, -1), (0, 1), (1, 0)), ((0, 1), (1, 0), (1, 1))


def bordered(rows: DataFrame, marks: dict[str, str], near: Sequence[tuple[int, int]], keys: Sequence[str] = ("img",)) -> DataFrame:
    """rows (keys, y, x, …) with a mark for each label: does a neighbour inside the map have another label.

    Every pixel tells those that it is a neighbour of, and one grouped pass takes the extremes of what a pixel was told.
    That is one shuffle, after most of it is summed where it is: pixels of an image are stored together.
    """
    rest = [c for c in rows.columns if c not in (*keys, "y", "x")]
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), *((-dy, -dx) for dy, dx in near))]))
    told = rows.withColumn("_s", step).withColumn("_own", (F.col("_s.dy") == 0) & (F.col("_s.dx") == 0))
    told = told.select(*keys, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), "_own", *rest)
    labels = sorted(set(marks.values()))
    ends = [f(F.when(~F.col("_own"), F.col(c))).alias(f"_{n}_{c}") for c in labels for n, f in (("lo", F.min), ("hi", F.max))]
    met = told.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("_own"), F.col(c))).alias(c) for c in rest], *ends, F.count_if("_own").alias("_n")).where("_n > 0")
    differs = {m: F.coalesce((F.col(f"_lo_{c}") != F.col(c)) | (F.col(f"_hi_{c}") != F.col(c)), F.lit(False)) for m, c in marks.items()}
    return met.withColumns(differs).select(*rows.columns, *marks)


def within(points: DataFrame, others: DataFrame, radius: int, keys: Sequence[str] = ("img",)) -> DataFrame:
    """The points that have another point at a distance of at most ``radius``: offsets exploded, then a semi join."""
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk(radius)]))
    near = others.withColumn("s", step).select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return points.join(near, [*keys, "y", "x"], "left_semi")


def disks(marks: np.ndarray, radius: int) -> np.ndarray:
    """The places of a stack of masks within a distance of ``radius`` of a marked one: a window of each row's sums for each row of the disk."""
    n, h, w = marks.shape
    sums = np.zeros((n, h, w + 1), np.int32)
    np.cumsum(marks, 2, out=sums[:, :, 1:])
    out, x = np.zeros(marks.shape, bool), np.arange(w)
    for dy in range(-min(radius, h - 1), min(radius, h - 1) + 1):
        half = math.isqrt(radius * radius - dy * dy)
        met = sums[:, :, np.minimum(w, x + half + 1)] > sums[:, :, np.maximum(0, x - half)]
        out[:, max(0, -dy) : h - max(0, dy)] |= met[:, max(0, dy) : h - max(0, -dy)]
    return out


def _thick(labels: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Where a neighbour of four that is there has another label."""
    out = np.zeros(labels.shape, bool)
    for axis in (1, 2):
        low, high = ((slice(None),) * axis + (x,) for x in (slice(None, -1), slice(1, None)))
        differ = (labels[low] != labels[high]) & there[low] & there[high]
        out[low] |= differ
        out[high] |= differ
    return out


def near_counts(pair: DataFrame, keys: Sequence[str] = ("img",), tile: int = 64) -> DataFrame:
    """(keys, ng, np, hg, hp) by tile of images (keys, y, x, gt, pr, r): pixels on thick boundaries of both maps, and how many of them have one of the other map within r.

    Pixels are dealt once, to each tile whose square widened by r + 1 holds them; numpy does the rest for many tiles at
    once. What a task holds is a batch and a tile, which is as wide as r at least. r is the same for all pixels of an image.
    """
    names = list(keys)
    kinds = dict(pair.dtypes)
    size = F.greatest(F.lit(tile), F.col("r"))

    def held(c: str) -> Column:
        own = F.floor(F.col(c) / size)
        first = F.floor((F.col(c) - F.col("r") - 1) / size)
        return F.explode(F.sequence(F.greatest(first, F.least(own, F.lit(0))).cast("int"), F.floor((F.col(c) + F.col("r") + 1) / size).cast("int")))

    def run(pdf: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        first = np.flatnonzero(np.diff(of, prepend=-1))
        out = {c: np.zeros(len(first), np.int64) for c in ("ng", "np", "hg", "hp")}
        radius = pdf["r"].to_numpy()[first]
        at_y, at_x, own = (pdf[c].to_numpy() for c in ("y", "x", "own"))
        for at, place, shape, these in stacks(of, at_y, at_x):
            inner = np.zeros(shape, bool)
            inner[place] = own[at]
            thick = []
            for c in ("gt", "pr"):
                labels, there = np.zeros(shape, pdf[c].to_numpy().dtype), np.zeros(shape, bool)
                labels[place], there[place] = pdf[c].to_numpy()[at], pdf[c].notna().to_numpy()[at]
                thick.append(_thick(labels, there))
            for r in np.unique(radius[these]).tolist():
                same = radius[these] == r
                g, p, kept = (a[same] for a in (*thick, inner))
                for name, found in (("ng", g), ("np", p), ("hg", g & disks(p, r)), ("hp", p & disks(g, r))):
                    out[name][these[same]] = (found & kept).sum((1, 2))
        return pd.DataFrame({**{c: pdf[c].iloc[first].to_numpy() for c in names}, **out})

    dealt = pair.withColumn("by", held("y")).withColumn("bx", held("x"))
    dealt = dealt.withColumn("own", (F.floor(F.col("y") / size) == F.col("by")) & (F.floor(F.col("x") / size) == F.col("bx")))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", ng long, np long, hg long, hp long"
    return by_groups(dealt.select(*names, "by", "bx", "y", "x", "gt", "pr", "r", "own"), [*names, "by", "bx"], run, schema)


def pooled(pair: DataFrame, radius: int = 2) -> DataFrame:
    """Recall, precision and F of thick boundaries over all images together; null if either side has no boundary."""
    one = near_counts(pair.select("img", "y", "x", "gt", "pr", F.lit(radius).alias("r"))).agg(*[F.sum(c).alias(c) for c in ("ng", "np", "hg", "hp")])
    some = (F.col("ng") > 0) & (F.col("np") > 0)
    r, q = F.when(some, F.col("hg") / F.col("ng")), F.when(some, F.col("hp") / F.col("np"))
    return one.select(r.alias("recall"), q.alias("precision"), F.when(r + q > 0, 2 * r * q / (r + q)).when(some, 0.0).alias("f"))


#: Side of the tiles on which pixels and boxes of cells meet.
TILE = 32


def cells(pair: DataFrame, table: DataFrame, margin: int, height: int, width: int, tile: int = TILE) -> DataFrame:
    """Rows (img, gt, y, x, g, p) of the crop around every label: is the pixel in it, and in its matched prediction.

    Boxes are repeated for the tiles that they touch, and pixels meet the boxes of their own tile: an equi-join, whose
    work grows with the area of the boxes rather than with pixels times cells of an image.
    """
    box = shapes(pair, "gt").select("img", "gt", "r0", "r1", "c0", "c1").join(largest_overlap(table), ["img", "gt"], "left")
    box = box.select(F.col("img"), F.col("gt").alias("cell"), F.coalesce("pr", F.lit(-1)).alias("match"), F.greatest(F.lit(0), F.col("r0") - margin).alias("r0"), F.least(F.lit(height), F.col("r1") + margin).alias("r1"), F.greatest(F.lit(0), F.col("c0") - margin).alias("c0"), F.least(F.lit(width), F.col("c1") + margin).alias("c1"))
    of = lambda c: F.floor(c / tile).cast("int")
    touched = box.withColumn("ty", F.explode(F.sequence(of(F.col("r0")), of(F.col("r1") - 1)))).withColumn("tx", F.explode(F.sequence(of(F.col("c0")), of(F.col("c1") - 1))))
    inside = pair.withColumns({"ty": of(F.col("y")), "tx": of(F.col("x"))}).join(touched, ["img", "ty", "tx"]).where("y >= r0 and y < r1 and x >= c0 and x < c1")
    return inside.select("img", "cell", "y", "x", (F.col("gt") == F.col("cell")).cast("int").alias("g"), (F.col("pr") == F.col("match")).cast("int").alias("p"), (F.col("r1") - F.col("r0")).alias("h"), (F.col("c1") - F.col("c0")).alias("w"))


def recall_by_cell(crops: DataFrame, radius: int = 2) -> DataFrame:
    """Share of each cell's thick boundary near its prediction's; null without a boundary, 0 without a predicted one."""
    keys = ["img", "cell"]
    marked = bordered(crops, {"bg": "g", "bp": "p"}, CROSS, keys)
    g, p = marked.where("bg").select(*keys, "y", "x"), marked.where("bp").select(*keys, "y", "x")
    hit = within(g, p, radius, keys).groupBy(*keys).agg(F.count("*").alias("hit"))
    every = marked.groupBy(*keys).agg(F.count_if("bg").alias("n"))
    return every.join(hit, keys, "left").select(*keys, F.when(F.col("n") > 0, F.coalesce("hit", F.lit(0)) / F.col("n")).alias("br"))


def contour_f_by_cell(crops: DataFrame, share: float = 0.0075) -> DataFrame:
    """Contour precision, recall and F of each cell within a tolerance that grows with the diagonal of its crop."""
    keys = ["img", "cell"]
    radius = F.greatest(F.lit(1), F.ceil(share * F.sqrt(F.col("h") * F.col("h") + F.col("w") * F.col("w")))).cast("int")
    marked = bordered(crops, {"bg": "g", "bp": "p"}, CORNER, keys).withColumn("r", radius)
    disk_of = F.expr("flatten(transform(sequence(-r, r), dy -> transform(sequence(-r, r), dx -> struct(dy, dx))))")

    def near(points: DataFrame, others: DataFrame) -> DataFrame:
        step = F.explode(F.filter(disk_of, lambda s: s["dy"] * s["dy"] + s["dx"] * s["dx"] <= F.col("r") * F.col("r")))
        moved = others.withColumn("s", step).select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
        return points.join(moved, [*keys, "y", "x"], "left_semi").groupBy(*keys).agg(F.count("*").alias("hit"))

    g, p = marked.where("bg"), marked.where("bp")
    every = marked.groupBy(*keys).agg(F.count_if("bg").alias("ng"), F.count_if("bp").alias("np"))
    rows = every.join(near(g, p).withColumnRenamed("hit", "hg"), keys, "left").join(near(p, g).withColumnRenamed("hit", "hp"), keys, "left").fillna(0, ["hg", "hp"])
    precision = F.when(F.col("np") > 0, F.col("hp") / F.col("np")).otherwise(1.0)
    recall = F.when(F.col("ng") > 0, F.col("hg") / F.col("ng")).otherwise(1.0)
    precision, recall = F.when((F.col("ng") == 0) & (F.col("np") > 0), 0.0).otherwise(precision), F.when((F.col("np") == 0) & (F.col("ng") > 0), 0.0).otherwise(recall)
    return rows.select(*keys, precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall, 0.0).alias("f"))


def region_f_by_cell(crops: DataFrame) -> DataFrame:
    sums = crops.groupBy("img", "cell").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    return sums.select("img", "cell", *[c.alias(k) for k, c in region_f(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def window_border(label: str, radius: int, keys: Sequence[str] = ("img",)) -> tuple[Column, Column]:
    """Smallest and largest label along x in a window of 2 * radius + 1, for the first of two separable passes."""
    row = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius)
    return F.min(label).over(row), F.max(label).over(row)


def window_recall(pair: DataFrame, radius: int = 1, img: Sequence[str] = ("img",)) -> DataFrame:
    """Share of border pixels of gt (another label within the window) that are such of pr too; 1 if there are none."""
    rows = pair
    for k in ("gt", "pr"):
        lo, hi = window_border(k, radius, img)
        rows = rows.withColumns({f"{k}_lo": lo, f"{k}_hi": hi})
    column = Window.partitionBy(*img, "x").orderBy("y").rangeBetween(-radius, radius)
    border = {k: F.min(f"{k}_lo").over(column) != F.max(f"{k}_hi").over(column) for k in ("gt", "pr")}
    rows = rows.withColumns({"bg": border["gt"], "bp": border["pr"]})
    return rows.groupBy(*img).agg(F.count_if("bg").alias("n"), F.count_if(F.col("bg") & F.col("bp")).alias("tp")).select(*img, ratio(F.col("tp"), F.col("n"), 1.0).alias("br"))


def scales(pair: DataFrame, table: DataFrame, factors: Sequence[float] = (0.05, 0.1, 0.2), img: Sequence[str] = ("img",)) -> DataFrame:
    """(factor, precision, recall, f) of thick boundaries per image, within tolerances that are shares of the median diameter."""
    areas = table.where("gt > 0").groupBy(*img, "gt").agg(F.sum("n").alias("a"))
    size = areas.groupBy(*img).agg((F.percentile(F.sqrt("a"), 0.5) / (F.sqrt(F.pi()) / 2)).alias("d"))
    spread = pair.select(*img, "y", "x", "gt", "pr").join(size, list(img)).withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    spread = spread.withColumn("r", F.greatest(F.lit(1), F.ceil(F.col("factor") * F.col("d"))).cast("int"))
    keys = [*img, "factor"]
    rows = near_counts(spread, keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("ng", "np", "hg", "hp")])
    precision, recall = ratio(F.col("hp"), F.col("np"), 0.0), ratio(F.col("hg"), F.col("ng"), 0.0)
    return rows.select(*keys, precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall, 0.0).alias("f"))
