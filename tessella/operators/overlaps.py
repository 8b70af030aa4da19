"""Masks that overlap made one map: which of them go is decided in rounds on a table of the sets that share pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.labels import settle


def covered(masks: DataFrame, threshold: float = 0.75, img: str = "img", rounds: int = 1000) -> DataFrame:
    """(img, mask, size, dropped) of pixel rows (img, mask, y, x): from small to large, a mask goes if at least the threshold of its pixels lies in masks that stay.

    Masks are taken by size, then by number, and each sees the larger ones and those smaller ones that stay. A mask is
    decided once all smaller ones that share a pixel with it are, so all masks of a round are decided at once; rounds are
    as many as the longest chain of overlapping masks needs. Pixels are counted once, by the set of masks that hold them.
    """
    sizes = masks.groupBy(img, "mask").agg(F.count("*").alias("size"))
    sets = masks.groupBy(img, "y", "x").agg(F.array_sort(F.collect_set("mask")).alias("masks")).where("size(masks) > 1").groupBy(img, "masks").agg(F.count("*").alias("n"))
    members = settle(sets.withColumn("set", F.xxhash64("masks")).select(img, "masks", "n", F.explode("masks").alias("mask")))
    state = settle(sizes.withColumn("dropped", F.when(F.col("size") == 0, True)))  # null: not decided
    alone = state.join(members.select(img, "mask").distinct(), [img, "mask"], "left_anti").withColumn("dropped", F.lit(False))
    state = settle(alone.unionByName(state.join(members.select(img, "mask").distinct(), [img, "mask"], "left_semi")))
    order = F.struct("size", "mask")
    for _ in range(rounds):
        if state.where("dropped is null").isEmpty():
            return state
        w = Window.partitionBy(img, "masks")
        seen = members.join(state, [img, "mask"]).withColumns({"first": F.min(F.when(F.col("dropped").isNull(), order)).over(w), "live": F.count_if(~F.coalesce("dropped", F.lit(False))).over(w)})
        due = seen.where("dropped is null").groupBy(img, "mask", "size").agg(F.every(F.col("first") == order).alias("due"), F.sum(F.when(F.col("live") > 1, F.col("n")).otherwise(0)).alias("shared")).where("due")
        decided = due.select(img, "mask", (F.col("shared") >= threshold * F.col("size")).alias("verdict"))
        state = settle(state.join(decided, [img, "mask"], "left").select(img, "mask", "size", F.coalesce("dropped", "verdict").alias("dropped")))
    raise RuntimeError(f"masks were not decided in {rounds} rounds")


def without_covered(masks: DataFrame, threshold: float = 0.75, img: str = "img") -> DataFrame:
    """Label rows (img, y, x, label) of the masks that stay: a shared pixel goes to the mask whose centre, by medians, is nearest, then to the smallest number."""
    live = covered(masks, threshold, img).where("not dropped").select(img, "mask")
    kept = masks.join(live, [img, "mask"])
    centre = kept.groupBy(img, "mask").agg(F.median("y").alias("my"), F.median("x").alias("mx"))
    far = F.pow(F.col("y") - F.col("my"), 2) + F.pow(F.col("x") - F.col("mx"), 2)
    return kept.join(centre, [img, "mask"]).groupBy(img, "y", "x").agg(F.min_by("mask", F.struct(far, "mask")).alias("label"))
