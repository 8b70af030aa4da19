"""Choices between labels, candidates and maps: the one with most seeds, the best scale, the winner's region, what lies within reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.labels import components, contingency, iou_pairs, shapes


def clipped_to_dilated(pair: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """(img, y, x, label): pixels of gt that lie on the same label of pr, dilated once by a square."""
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    allowed = pair.where("pr > 0").withColumn("s", step).select(*img, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("pr").alias("gt"))
    return pair.where("gt > 0").join(allowed, [*img, "y", "x", "gt"], "left_semi").select(*img, "y", "x", F.col("gt").alias("label"))


def merged_by_winner(pair: DataFrame, least: float = 0.5, img: Sequence[str] = ("img",)) -> DataFrame:
    """(img, y, x, label): each label of gt takes the region of its best match in pr where their IoU is above ``least``, else its own; later labels overwrite."""
    best = iou_pairs(contingency(pair, img), img).groupBy(*img, "gt").agg(F.max_by(F.struct("pr", "iou"), F.struct("iou", -F.col("pr"))).alias("b")).select(*img, F.col("gt").alias("label"), "b.*")
    other = pair.where("pr > 0").select(*img, "y", "x", "pr").join(best.where(F.col("iou") > least), [*img, "pr"]).select(*img, "y", "x", "label")
    own = pair.where("gt > 0").select(*img, "y", "x", F.col("gt").alias("label")).join(best.where(F.col("iou") <= least).select(*img, "label"), [*img, "label"]).select(*img, "y", "x", "label")
    return other.unionByName(own).groupBy(*img, "y", "x").agg(F.max("label").alias("label"))


def area_in_box(pair: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """(img, gt, area, in_box, ratio, agrees): the area of a label of gt and that of the same label of pr within its box."""
    box = shapes(pair, "gt", img)
    inside = pair.where("pr > 0").select(*img, F.col("pr").alias("gt"), "y", "x").join(box, [*img, "gt"]).where("y >= r0 and y < r1 and x >= c0 and x < c1").groupBy(*img, "gt").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return box.join(inside, [*img, "gt"], "left").select(*img, "gt", "area", n.alias("in_box"), (n / F.col("area")).alias("ratio"), (n == F.col("area")).alias("agrees"))


def largest_component(edges: DataFrame, nodes: DataFrame, img: Sequence[str] = ("img",), near: Column | None = None) -> DataFrame:
    """(img, root, n): the component with the most of an image's nodes (img, node), the one with the smallest root of equal ones; ``near`` as in ``components``."""
    sizes = components(edges, nodes, near=near).join(nodes.select("node", *img), "node").groupBy(*img, "root").agg(F.count("*").alias("n"))
    return sizes.groupBy(*img).agg(F.max_by(F.struct("root", "n"), F.struct("n", -F.col("root"))).alias("b")).select(*img, "b.root", "b.n")


def seed_label(pair: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """(img, label): the label of pr with the most seed pixels (gt above 0), the smaller id of equal ones; null where no seed lies on one."""
    votes = pair.where("gt > 0 and pr > 0").groupBy(*img, "pr").agg(F.count("*").alias("n"))
    found = votes.groupBy(*img).agg(F.max_by("pr", F.struct("n", -F.col("pr"))).alias("label"))
    return pair.select(*img).distinct().join(found, list(img), "left").select(*img, "label")


def centrality(rows: DataFrame, label: str, height: int, width: int, img: Sequence[str] = ("img",)) -> DataFrame:
    """(img, label, c): the distance of each label's mean place from the middle of the image, as a share of the way to a corner."""
    half = (height**2 + width**2) ** 0.5 / 2
    return rows.where(F.col(label) > 0).groupBy(*img, label).agg((F.hypot(F.avg("y") - height / 2, F.avg("x") - width / 2) / half).alias("c"))


def flow_error(rows: DataFrame, label: str, given: tuple[str, str], found: tuple[str, str], most: float = 0.4, scale: float = 5.0, img: Sequence[str] = ("img",)) -> DataFrame:
    """(img, label, err) of labels whose flow (dy, dx) differs from the one that a network gives, which is ``scale`` times as long, by at most ``most`` in the mean square."""
    off = [F.col(a) - F.col(b) / scale for a, b in zip(found, given, strict=True)]
    return rows.where(F.col(label) > 0).groupBy(*img, label).agg(F.avg(off[0] * off[0] + off[1] * off[1]).alias("err")).where(F.col("err") <= most)


def best_scale(candidates: DataFrame, images: DataFrame, last: int, least: float = 0.3, img: Sequence[str] = ("img",)) -> DataFrame:
    """(img, scale, score): of candidates (img, scale, solidity, iou) that are solid enough the best by both, the first of equal ones; else the last scale, -1."""
    rows = candidates.where(F.col("solidity") >= least).withColumn("s", F.round(F.col("solidity") * (0.35 + 0.65 * F.col("iou")), 9))
    best = rows.groupBy(*img).agg(F.max_by("scale", F.struct("s", -F.col("scale"))).alias("scale"), F.max("s").alias("s"))
    return images.select(*img).join(best, list(img), "left").select(*img, F.coalesce("scale", F.lit(last)).alias("scale"), F.coalesce("s", F.lit(-1.0)).alias("score"))
