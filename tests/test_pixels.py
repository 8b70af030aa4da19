"""Scalar maps on values that the tables do not have."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import pixels as p


def test_colours_are_rounded_before_they_are_cut_and_null_where_the_flow_is(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.4), (2, None, 0.4), (3, 0.4, None), (4, -1.0, 0.0)], "k int, dy double, dx double")
    size = F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    got = rows.select("k", *[c.alias(n) for n, c in p.cyclic_colours(F.col("dy"), F.col("dx"), size).items()]).orderBy("k").collect()
    # a quarter of a turn: the cosine is a last bit below 0, the channel 50.99999999999999
    assert [tuple(r) for r in got] == [(1, 51, 95, 6), (2, None, None, None), (3, None, None, None), (4, 255, 63, 63)]
