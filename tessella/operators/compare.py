"""Comparisons of methods over score tables: rows (dataset, category, sample_id, method, metrics)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.functions.distributions import signed_rank_two_sided, t_two_sided
from tessella.operators.durable import checkpoint

#: What counts as a tie between methods on a sample, and between two methods on a cell.
SAMPLE_TIE, CELL_TIE = 0.01, 0.02


def finite(v: Column) -> Column:
    """The number if it is one (and finite), else null; "" and NaN count as missing."""
    d = v.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def means(scores: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("method",)) -> DataFrame:
    return scores.groupBy(*by).agg(*[F.avg(finite(F.col(m))).alias(m) for m in metrics], F.count("*").alias("n"))


def winner(means_: DataFrame, metric: str, order: str) -> DataFrame:
    """The method of the largest mean; of equal ones the first by ``order``."""
    return means_.agg(F.max_by("method", F.struct(metric, -F.col(order))).alias("method"), F.max(metric).alias("mean"))


def paired(scores: DataFrame, a: str, b: str, metric: str, keys: Sequence[str]) -> DataFrame:
    """Samples that have both methods, as (keys, a, b): one grouped pass instead of a self join."""
    both = scores.where(F.col("method").isin(a, b)).groupBy(*keys).agg(*[F.max(F.when(F.col("method") == m, F.col(metric))).alias(k) for m, k in ((a, "a"), (b, "b"))])
    return both.where("a is not null and b is not null")


def head_to_head(pairs: DataFrame, tie: float = SAMPLE_TIE) -> DataFrame:
    d = F.col("a") - F.col("b")
    return pairs.agg(F.count_if(d > tie).alias("wins"), F.count_if(d < -tie).alias("losses"), F.count_if(F.abs(d) <= tie).alias("ties"))


def best_on_sample(scores: DataFrame, metric: str, keys: Sequence[str], tie: float = SAMPLE_TIE) -> DataFrame:
    """Samples on which a method alone is within ``tie`` of the best; else a tie; samples of one method don't count."""
    w = Window.partitionBy(*keys)
    seen = scores.where(F.col(metric).isNotNull()).withColumns({"top": F.max(metric).over(w), "n": F.count("*").over(w)})
    near = seen.where((F.col("n") >= 2) & (F.abs(F.col(metric) - F.col("top")) <= tie)).groupBy(*keys).agg(F.count("*").alias("k"), F.min("method").alias("method"))
    return near.groupBy(F.when(F.col("k") == 1, F.col("method")).otherwise("tie").alias("winner")).agg(F.count("*").alias("n"))


def multiway(scores: DataFrame, metric: str, keys: Sequence[str], methods: Sequence[str], eps: float = CELL_TIE, skip_empty: bool = False) -> DataFrame:
    """Wins by more than eps over the second best of all methods, missing ones counted as 0; else ties.

    skip_empty leaves out samples on which no method is above 0.
    """
    wide = scores.groupBy(*keys).pivot("method", list(methods)).agg(F.max(metric))
    ranked = wide.withColumn("r", F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(f"`{m}`"), F.lit(0.0))).alias("v"), F.lit(i).alias("i")) for i, m in enumerate(methods)])))
    if skip_empty:
        ranked = ranked.where(F.col("r")[0]["v"] < 0)
    first = F.element_at(F.array(*[F.lit(m) for m in methods]), F.col("r")[0]["i"] + 1)
    return ranked.groupBy(F.when(F.col("r")[1]["v"] - F.col("r")[0]["v"] > eps, first).otherwise("tie").alias("winner")).agg(F.count("*").alias("n"))


def cell_winner(a: Column, b: Column, eps: float = CELL_TIE, least: float | None = None) -> Column:
    """a, b or tie by more than eps; with ``least``, both_missed where both are below it."""
    out = F.when(a - b > eps, "a").when(b - a > eps, "b").otherwise("tie")
    return out if least is None else F.when((a < least) & (b < least), "both_missed").otherwise(out)


def paired_statistics(pairs: DataFrame) -> DataFrame:
    """n, mean difference, paired t and effect size with the sample deviation; 0 or null where there is no spread."""
    s = pairs.select((F.col("a") - F.col("b")).alias("d")).agg(F.count("*").alias("n"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"))
    return s.select("n", "delta", F.when(F.col("sd") > 0, F.col("delta") / (F.col("sd") / F.sqrt("n"))).alias("t"), F.when(F.col("sd") > 0, F.col("delta") / F.col("sd")).otherwise(0.0).alias("cohens_d"))


def ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows in ranges of an order, one range per partition, with the number ``_part`` of the range and ``_at`` within it.

    What counts on through all rows counts within each range by a window of its own, and adds what ``before`` says of
    the ranges before it, which are few. The ranges are checkpointed, so that all that use them see the same.
    """
    laid = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return checkpoint(laid).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def before(laid: DataFrame, amount: Column) -> DataFrame:
    """(_part, _before): the sum of an amount over all ranges before each; a row for each range."""
    sums = laid.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    return sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, order: Sequence[str], out: str = "at") -> DataFrame:
    """rows with their number from 0 in an order, without a window over all of them."""
    laid = ranged(rows, order)
    return laid.join(F.broadcast(before(laid, F.lit(1))), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")  # as many rows as partitions


def signed_ranks(pairs: DataFrame, digits: int = 9) -> DataFrame:
    """One row: n differences that are not zero, rank sums of the positive and negative ones, ties (sum of t**3 - t), zeros.

    Differences are rounded to ``digits``, so that equal ones tie. They are counted by size before they are ranked, and
    ranked range by range.
    """
    d = pairs.select(F.round(F.col("a") - F.col("b"), digits).alias("d"))
    zeros = F.count_if(F.col("d") == 0)
    sizes = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"), zeros.alias("zero"))
    own, laid = F.col("t") - F.col("zero"), ranged(sizes, ["size"])
    within = F.coalesce(F.sum(own).over(Window.partitionBy("_part").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = laid.withColumn("_within", within).join(F.broadcast(before(laid, own)), "_part").withColumn("rank", F.col("_before") + F.col("_within") + (F.col("t") + 1) / 2)
    down = F.col("t") - F.col("up") - F.col("zero")
    total = [F.sum(own).alias("n"), F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum(down * F.col("rank")).alias("minus")]
    tied = F.sum(F.when(F.col("zero") == 0, F.col("t") * F.col("t") * F.col("t") - F.col("t")).otherwise(0)).alias("ties")
    sums = ranked.agg(*total, tied, F.sum("zero").alias("zeros"))
    return sums.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "plus", "minus", "ties", "zeros")])


@F.pandas_udf(DoubleType())
def _p_t(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else t_two_sided(x, k - 1) for x, k in zip(t, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _p_w(plus: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_two_sided(*x) for x in zip(plus, n, ties, zeros, strict=True)], dtype="float64")


def paired_tests(pairs: DataFrame) -> DataFrame:
    """``paired_statistics`` with two-sided p-values: p_t of the paired t, p_w of the signed ranks; null where undefined."""
    ranks = signed_ranks(pairs).select(_p_w("plus", "n", "ties", "zeros").alias("p_w"))
    return paired_statistics(pairs).withColumn("p_t", _p_t("t", "n")).crossJoin(F.broadcast(ranks))  # both are one row


def bootstrap(pairs: DataFrame, order: Sequence[str], rounds: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentiles of resampled mean differences; draws come from a hash of round and place, so they are repeatable.

    Rows are numbered range by range; every row draws once in each round, and draws meet rows on the number drawn.
    """
    places = numbered(pairs.select(*order, (F.col("a") - F.col("b")).alias("d")), order, "i").select("d", (F.col("i") + 1).cast("int").alias("i"))
    total = places.agg(F.count("*").alias("n"))  # one row
    draws = places.crossJoin(F.broadcast(total)).select("n", "i", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    draws = draws.withColumn("pick", (1 + F.conv(F.substr(F.md5(F.concat_ws("-", "round", "i")), F.lit(1), F.lit(8)), 16, 10).cast("long") % F.col("n")).cast("int"))
    taken = draws.join(places.select(F.col("i").alias("pick"), "d"), "pick").groupBy("round").agg(F.avg("d").alias("m"))
    return taken.agg(F.percentile("m", low).alias("lo"), F.percentile("m", high).alias("hi"))


def spread(scores: DataFrame, metrics: Sequence[str], reference: str, keys: Sequence[str]) -> DataFrame:
    """(method, metric, n, mean, sd, pairs, delta, t): each method's mean and spread, and its paired difference from a reference.

    One pass over the scores, widened by metric; the reference's values meet all others on the sample.
    """
    long = scores.select(*keys, "method", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m)).alias("v")) for m in metrics])).alias("s")).select(*keys, "method", "s.metric", "s.v").where("v is not null")
    base = long.where(F.col("method") == reference).groupBy(*keys, "metric").agg(F.max("v").alias("base"))
    both = long.join(base, [*keys, "metric"], "left").withColumn("d", F.col("v") - F.col("base"))
    rows = both.groupBy("method", "metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("d").alias("pairs"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("dd"))
    return rows.withColumn("t", F.when(F.col("dd") > 0, F.col("delta") / (F.col("dd") / F.sqrt("pairs")))).drop("dd")


def against(means_: DataFrame, reference: str, metric: str) -> DataFrame:
    """Means with their difference from the reference method's."""
    base = means_.where(F.col("method") == reference).select(F.col(metric).alias("base"))
    return means_.crossJoin(F.broadcast(base)).withColumn("delta", F.col(metric) - F.col("base")).drop("base")  # base is one row


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order: the larger struct wins, partly aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def shard(rows: DataFrame, order: str, shards: int, number: int, most: int | None = None) -> DataFrame:
    """Every ``shards``-th row by order from ``number`` on, at most ``most`` of them."""
    out = numbered(rows, [order]).where(F.col("at") % shards == number)
    return out.where(F.col("at") < shards * most) if most is not None else out


def progress(done: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """Percent done, rate per second and seconds left; 0 where nothing is known yet."""
    rate = F.when(elapsed > 0, done / elapsed).otherwise(0.0)
    return {"pct": F.round(F.when(total > 0, 100 * done / total).otherwise(0.0), 2), "rate": rate, "eta": F.round(F.when(rate > 0, (total - done) / rate).otherwise(0.0), 1)}
