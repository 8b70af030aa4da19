"""Overlap metrics of label maps, all from one contingency table per image."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.kernels import best_pairs, by_group, matching_scores
from tessella.operators.labels import iou_pairs, with_areas

#: The ten thresholds as they come out of floating-point steps of 0.05 (fixed values): 0.75 is not one of them.
STEPS = (0.5, 0.55, 0.6000000000000001, 0.6500000000000001, 0.7000000000000002, 0.7500000000000002, 0.8000000000000003, 0.8500000000000003, 0.9000000000000004, 0.9500000000000004)


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def foreground(table: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Pixel counts tp, fp, fn of the foregrounds, with Dice and IoU (1 if both are empty)."""
    sums = table.groupBy(*img).agg(*[F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0)).alias(k) for k, c in (("tp", "gt > 0 and pr > 0"), ("fp", "gt = 0 and pr > 0"), ("fn", "gt > 0 and pr = 0"))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"dice": ratio(2 * tp, 2 * tp + fp + fn, 1.0), "iou": ratio(tp, tp + fp + fn, 1.0)})


def region_f(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 of regions; nothing predicted is precise only if nothing was missed."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(fn == 0, 1.0).otherwise(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r, 0.0)}


def counts(table: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Number of instances n_gt and n_pr of every image, zero included."""
    return table.groupBy(*img).agg(F.count_distinct(F.when(F.col("gt") > 0, F.col("gt"))).alias("n_gt"), F.count_distinct(F.when(F.col("pr") > 0, F.col("pr"))).alias("n_pr"))


def matched(pairs: DataFrame, thresholds: Sequence[float], img: Sequence[str] = ("img",)) -> DataFrame:
    """(img, t, gt, pr, iou) of a largest matching at IoU >= t, of the largest sum of IoU among those of equal size.

    From a half on two predictions can both reach it with one label only if both equal it, so candidates form stars: the
    best prediction of each label, then the best label of each prediction, is a largest matching. The pairs are few;
    they are repeated by threshold and ranked by two windows. Below a half, pairs that have neither label in common with
    another are taken as they are, and only the rest of an image's candidates goes to an assignment.
    """
    at = pairs.where(F.col("iou") >= min(thresholds)).select(*img, "gt", "pr", "iou", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t")).where("iou >= t")
    by_gt, by_pr = Window.partitionBy(*img, "t", "gt"), Window.partitionBy(*img, "t", "pr")
    found = []
    if max(thresholds) >= 0.5:
        first = at.where("t >= 0.5").withColumn("k", F.row_number().over(by_gt.orderBy(F.desc("iou"), "pr"))).where("k = 1")
        found.append(first.withColumn("k", F.row_number().over(by_pr.orderBy(F.desc("iou"), "gt"))).where("k = 1"))
    if min(thresholds) < 0.5:
        low = at.where("t < 0.5").withColumns({"g": F.count("*").over(by_gt), "p": F.count("*").over(by_pr)}).withColumn("alone", (F.col("g") == 1) & (F.col("p") == 1))
        found += [low.where("alone"), _assigned(low.where("not alone").select(*img, "t", "gt", "pr", "iou"), img)]
    out = [f.select(*img, "t", "gt", "pr", "iou") for f in found]
    return reduce(DataFrame.unionByName, out)


def _assigned(candidates: DataFrame, img: Sequence[str]) -> DataFrame:
    """The candidates of an assignment for each image and threshold; a group is what competes in one image."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        iou = rows["iou"].to_numpy()
        return rows[best_pairs(rows["gt"].to_numpy(), rows["pr"].to_numpy(), 1 + iou / (2 * len(rows)))]

    return by_group(candidates, [*img, "t"], choose, candidates.schema)


def optimal(table: DataFrame, threshold: float = 0.5, img: Sequence[str] = ("img",)) -> DataFrame:
    """tp, iou_sum and aji_fused of every image, by assignments over its overlapping pairs, those below the threshold included.

    Pixels are counted before the shuffle; a group is the pairs of labels that overlap in one image.
    """
    areas = table.groupBy(*img).agg(F.coalesce(F.sum(F.when(F.expr("gt > 0 or pr > 0"), F.col("n"))), F.lit(0)).alias("together"))
    pairs = iou_pairs(table, img).join(counts(table, img), list(img)).select(*img, "gt", "pr", "n", "iou", F.least("n_gt", "n_pr").alias("fewest"))
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        found = matching_scores(*(rows[c].to_numpy() for c in ("gt", "pr", "n", "iou")), int(rows["fewest"].iloc[0]), threshold)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in img}, **dict(zip(("tp", "iou_sum", "overlap"), found, strict=True))}])

    scored = by_group(pairs, img, score, ", ".join(f"`{k}` {kinds[k]}" for k in img) + ", tp long, iou_sum double, overlap long")
    rows = areas.join(scored, list(img), "left").fillna(0, ["tp", "overlap"]).fillna(0.0, ["iou_sum"])
    return rows.select(*img, "tp", "iou_sum", ratio(F.col("overlap"), F.col("together"), 1.0).alias("aji_fused"))


def detection(table: DataFrame, thresholds: Sequence[float], img: Sequence[str] = ("img",)) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and average precision by image and threshold; images without instances included."""
    hits = matched(iou_pairs(table, img), thresholds, img).groupBy(*img, "t").agg(F.count("*").alias("tp"))
    grid = counts(table, img).withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    rows = grid.join(hits, [*img, "t"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    rows = rows.withColumns({"fp": F.col("n_pr") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})
    none = (F.col("n_gt") == 0) & (F.col("n_pr") == 0)
    p, r = ratio(F.col("tp"), F.col("n_pr"), 0.0), ratio(F.col("tp"), F.col("n_gt"), 0.0)
    return rows.withColumns({
        "precision": F.when(none, 1.0).otherwise(p), "recall": F.when(none, 1.0).otherwise(r), "f1": F.when(none, 1.0).otherwise(ratio(2 * p * r, p + r, 0.0)),
        "ap": F.when(~none, F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))), "error_rate": F.when(F.col("n_gt") > 0, (F.col("fp") + F.col("fn")) / F.col("n_gt")),
    })


def panoptic(table: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """sq, rq and pq; pairs above a half are unique, so no ranking is needed. (1, 1, 1) if there is nothing at all."""
    hits = iou_pairs(table, img).where("iou > 0.5").groupBy(*img).agg(F.count("*").alias("tp"), F.sum("iou").alias("s"))
    rows = counts(table, img).join(hits, list(img), "left").fillna(0, ["tp"]).fillna(0.0, ["s"])
    none = (F.col("n_gt") == 0) & (F.col("n_pr") == 0)
    sq, rq = ratio(F.col("s"), F.col("tp"), 0.0), ratio(2 * F.col("tp"), F.col("n_gt") + F.col("n_pr"), 0.0)
    return rows.select(*img, "n_gt", "n_pr", "tp", *[F.when(none, 1.0).otherwise(c).alias(k) for k, c in (("sq", sq), ("rq", rq), ("pq", sq * rq))])


def aggregated_jaccard(table: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """AJI: each label with its best prediction (several may share one); unmatched labels and unused predictions add area."""
    pairs = iou_pairs(table, img)
    best = pairs.groupBy(*img, "gt").agg(F.max_by(F.struct("pr", "n", "ga", "pa"), F.struct("iou", -F.col("pr"))).alias("b")).select(*img, "gt", "b.*")
    areas = with_areas(table, img)
    lone_gt = areas.where("gt > 0").select(*img, "gt", "ga").distinct().join(best.select(*img, "gt"), [*img, "gt"], "left_anti")
    lone_pr = areas.where("pr > 0").select(*img, "pr", "pa").distinct().join(best.select(*img, "pr").distinct(), [*img, "pr"], "left_anti")
    parts = best.select(*img, F.col("n").alias("i"), (F.col("ga") + F.col("pa") - F.col("n")).alias("u"))
    parts = parts.unionByName(lone_gt.select(*img, F.lit(0).cast("long").alias("i"), F.col("ga").alias("u"))).unionByName(lone_pr.select(*img, F.lit(0).cast("long").alias("i"), F.col("pa").alias("u")))
    sums = parts.groupBy(*img).agg(F.sum("i").alias("i"), F.sum("u").alias("u"))
    both = counts(table, img).join(sums, list(img), "left")
    return both.select(*img, F.when((F.col("n_gt") == 0) & (F.col("n_pr") == 0), 1.0).when((F.col("n_gt") == 0) | (F.col("n_pr") == 0), 0.0).otherwise(F.col("i") / F.col("u")).alias("aji"))


def mean_precision(table: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Mean over the ten ``STEPS`` of tp / (tp + fp + fn); 0 if either map is empty, even if both are."""
    at = detection(table, STEPS, img)
    return at.groupBy(*img).agg(F.avg(F.when((F.col("n_gt") > 0) & (F.col("n_pr") > 0), F.col("ap")).otherwise(F.lit(0.0))).alias("map"))


def evaluate(table: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """One wide row per image: foreground, F1 at .5 and .75, panoptic, AJI and mean precision."""
    f1 = detection(table, (0.5, 0.75), img).groupBy(*img).agg(*[F.max(F.when(F.col("t") == t, F.col("f1"))).alias(k) for t, k in ((0.5, "f1_050"), (0.75, "f1_075"))])
    out = foreground(table, img).select(*img, "dice", "iou")
    for part in (f1, panoptic(table, img), aggregated_jaccard(table, img), mean_precision(table, img)):
        out = out.join(part, list(img))
    return out


def class_aware(table: DataFrame, gt_class: DataFrame, pr_class: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """tp, fp, fn by class: pairs above a half count if the classes agree; unmatched instances by their own class."""
    hits = iou_pairs(table, img).where("iou > 0.5").select(*img, "gt", "pr").join(gt_class, [*img, "gt"]).join(pr_class, [*img, "pr"]).where("gt_class = pr_class")
    tp = hits.groupBy(F.col("gt_class").alias("class")).agg(F.count("*").alias("tp"))
    n_gt, n_pr = (c.groupBy(F.col(k).alias("class")).agg(F.count("*").alias(n)) for c, k, n in ((gt_class, "gt_class", "n_gt"), (pr_class, "pr_class", "n_pr")))
    rows = n_gt.join(n_pr, "class", "full").join(tp, "class", "left").fillna(0)
    return rows.select("class", "tp", (F.col("n_pr") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
