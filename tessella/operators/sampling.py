"""Seeded samples by weight, epoch by epoch: the same rows at every run, whatever the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.compare import before, ranged


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from the first 13 hexadecimal digits of the MD5 of the parts, joined by colons."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")
    return (digits.cast("double") + 0.5) / float(1 << 52)


def drawn(rows: DataFrame, key: str, weight: str, epochs: int, k: int, seed: int = 0) -> DataFrame:
    """(epoch, place, key): k different rows for each epoch, drawn one after the other by their weights; place counts from 1.

    A row's key in an epoch is exponential with its weight as rate, and the k smallest are the sample (all, if there are
    fewer). Weights that are null, no number, or not above 0 are never drawn. Rows are told apart by ``key``, which has to
    be unique. Each part of the rows gives its own k first, so what meets is k rows for each part.
    """
    sound = rows.where(F.col(weight).isNotNull() & ~F.isnan(F.col(weight).cast("double")) & (F.col(weight) > 0)).select(F.col(key).alias("key"), F.col(weight).cast("double").alias("_w"))
    each = sound.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else sound.withColumn("epoch", F.lit(0)).where("false")
    timed = each.withColumn("_at", -F.log(uniform(F.lit(seed), F.col("epoch"), F.col("key"))) / F.col("_w")).withColumn("_part", F.spark_partition_id())
    for keys in (["epoch", "_part"], ["epoch"]):
        timed = timed.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "key"))).where(F.col("place") <= k)
    return timed.select("epoch", "place", F.col("key").alias(key))


def drawn_again(rows: DataFrame, key: str, weight: str, epochs: int, n: int, seed: int = 0, order: Sequence[str] | None = None) -> DataFrame:
    """(epoch, draw, key): n draws for each epoch with replacement, each row as often as its weight is a part of all.

    Weights are whole numbers of any size: rows lie one after the other on a line as long as all weights, in the order of
    ``order`` (else of the key), and a draw is a place on it. The line is summed up range by range. A draw meets the rows
    near it in cells of the mean weight, of which all rows together touch at most twice as many as there are rows.
    """
    sound = rows.where(F.col(weight) > 0).select(F.col(key).alias("key"), *[F.col(c) for c in order or [] if c != key], F.col(weight).cast("long").alias("_w"))
    laid = ranged(sound, list(order or ["key"]))
    within = F.sum("_w").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    line = laid.join(F.broadcast(before(laid, F.col("_w"))), "_part").withColumn("_from", F.col("_before") + F.coalesce(within, F.lit(0)))  # a sum for each part
    total, count = laid.agg(F.coalesce(F.sum("_w"), F.lit(0)), F.count("*")).first()
    if not total:
        return line.select(F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("draw"), F.col("key").alias(key)).where("false")
    cell = max(1, total // count)
    spread = line.select("key", "_from", (F.col("_from") + F.col("_w")).alias("_to")).withColumn("_cell", F.explode(F.sequence(F.expr(f"_from div {cell}"), F.expr(f"(_to - 1) div {cell}"))))
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    place = F.floor(uniform(F.lit(seed), F.col("epoch"), F.col("draw")) * float(total)).cast("long")
    draws = draws.withColumn("_place", F.least(place, F.lit(total - 1))).withColumn("_cell", F.expr(f"_place div {cell}"))
    return draws.join(spread, "_cell").where("_place >= _from and _place < _to").select("epoch", "draw", F.col("key").alias(key))
