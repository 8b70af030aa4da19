"""Polygons to pixels by scan lines: edges cross rows, sorted crossings pair up into runs, runs into labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(points: DataFrame, height: int, width: int, keys: Sequence[str] = ("img", "polygon")) -> DataFrame:
    """(keys, y, x0, x1): the pixels x0 to x1 of each row whose centres lie in a polygon of points (keys, vertex, x, y).

    A centre is inside by the parity of the crossings to its right; polygons close by themselves, and those of fewer than
    three points, or whose edges cross no row, have no runs. Points without a number are left out. A task holds one
    polygon's points or its crossings of one row.
    """
    given = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    along, whole = Window.partitionBy(*keys).orderBy("vertex"), Window.partitionBy(*keys).orderBy("vertex").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = {c: F.coalesce(F.lead(c).over(along), F.first(c).over(whole)) for c in ("x", "y")}
    edges = given.select(*keys, F.col("x").alias("xa"), F.col("y").alias("ya"), to["x"].alias("xb"), to["y"].alias("yb")).where("ya <> yb")
    first = F.greatest(F.lit(0.0), F.ceil(F.least("ya", "yb"))).cast("int")
    last = (F.least(F.lit(float(height)), F.ceil(F.greatest("ya", "yb"))) - 1).cast("int")
    lines = edges.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("line", F.explode(F.sequence("_first", "_last")))
    crossed = lines.select(*keys, F.col("line").alias("y"), ((F.col("xb") - F.col("xa")) * (F.col("line") - F.col("ya")) / (F.col("yb") - F.col("ya")) + F.col("xa")).alias("at"))
    row = Window.partitionBy(*keys, "y").orderBy("at")
    paired = crossed.withColumns({"n": F.row_number().over(row), "next": F.lead("at").over(row)}).where("n % 2 = 1")
    # from the first centre at or right of a crossing to the last one left of the next
    x0, x1 = F.greatest(F.lit(0.0), F.ceil("at")).cast("int"), (F.least(F.lit(float(width)), F.ceil("next")) - 1).cast("int")
    return paired.select(*keys, "y", x0.alias("x0"), x1.alias("x1")).where("x0 <= x1")


def rasterised(points: DataFrame, height: int, width: int, last: bool = False, polygon: str = "polygon", keys: Sequence[str] = ("img",)) -> DataFrame:
    """Label rows (keys, y, x, label) of polygons, labelled by their number; where they overlap the first, or the last, wins."""
    found = runs(points, height, width, [*keys, polygon])
    spread = found.select(*keys, polygon, "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return spread.groupBy(*keys, "y", "x").agg((F.max if last else F.min)(polygon).alias("label"))
