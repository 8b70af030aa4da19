"""Exact interpolated percentiles of groups of any size, by histograms that are refined where the ranks lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.labels import settle

#: Bins of a histogram, and values that may be sorted together at the end.
BINS, LIMIT = 4096, 10_000


def percentiles(rows: DataFrame, v: str, shares: Sequence[float], keys: Sequence[str] = ("img",), bins: int = BINS, limit: int = LIMIT, rounds: int = 40) -> DataFrame:
    """(keys, p): the percentiles of each group, an array in the order of ``shares``, interpolated between neighbouring values.

    Nulls and values that are no numbers are left out; a group without any value has no row. A group starts as one bin from
    its smallest to its largest value. A bin that holds a rank and more than ``limit`` values that differ is divided by a
    histogram of ``bins`` bins, whose counts and ends are summed before they are shuffled; then only the bins that hold the
    ranks go on, with the ends of their own values. At the end the few values of each bin are sorted. Small groups need
    one pass to count and one to sort; state is bounded by ``bins`` and ``limit``, however many values differ.
    """
    names = list(keys)
    given = rows.select(*names, F.col(v).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    whole = given.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.array(*[F.lit(float(s)) for s in shares])
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda s: F.array(F.floor(s * (F.col("_n") - 1)), F.ceil(s * (F.col("_n") - 1))))))
    # each rank is sought in a bin: the count of what is below it, of what is in it, and the ends of that
    state = settle(whole.select(*names, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"), "_lo", "_hi"))
    wide = (F.col("_in") > limit) & (F.col("_lo") < F.col("_hi"))
    for _ in range(rounds):
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        # ranks that share a bin share its histogram
        spans = open_.select(*names, "_lo", "_hi").distinct()
        inside = given.join(spans, names).where("_v between _lo and _hi")
        at = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).cast("int")
        counted = inside.groupBy(*names, "_lo", "_hi", at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = F.sum("_c").over(Window.partitionBy(*names, "_lo", "_hi").orderBy("_bin"))  # at most ``bins`` rows
        hits = open_.join(counted.withColumn("_upto", upto), [*names, "_lo", "_hi"]).where("_rank >= _below + _upto - _c and _rank < _below + _upto")
        finer = hits.select(*names, "_rank", (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_in"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"))
        state = settle(state.where(~wide).unionByName(finer))
    else:
        raise RuntimeError(f"percentiles did not settle in {rounds} rounds")
    flat = state.where("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_value"))
    rest = state.where("_lo < _hi")
    spans = rest.select(*names, "_lo", "_hi").distinct()
    sorted_ = given.join(spans, names).where("_v between _lo and _hi").groupBy(*names, "_lo", "_hi").agg(F.array_sort(F.collect_list("_v")).alias("_all"))
    found = rest.join(sorted_, [*names, "_lo", "_hi"]).select(*names, "_rank", F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_value"))
    listed = flat.unionByName(found).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_of"))

    def between(s: F.Column) -> F.Column:
        at = s * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.element_at("_of", low), F.element_at("_of", high)
        return F.when(low == high, a).otherwise((high - at) * a + (at - low) * b)

    return whole.join(listed, names).select(*names, F.transform(places, between).alias("p"))
