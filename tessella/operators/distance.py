"""Exact distances within labels, in two passes of one axis each, with work linear in the pixels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tessella.operators.labels import erode


def _envelope(x: list[int], label: list[int], gap: list[int]) -> list[int]:
    """The smallest (x - u)² + gap(u)² over the places u of each run of one label: the lower envelope of their parabolas.

    All numbers are whole, so the place from which on one parabola is below another is exact.
    """
    out, n, lo = [0] * len(x), len(x), 0
    while lo < n:
        hi = lo + 1
        while hi < n and label[hi] == label[lo] and x[hi] == x[hi - 1] + 1:
            hi += 1
        stack, since = [lo], [x[lo]]
        for q in range(lo + 1, hi):
            while stack:
                u = stack[-1]
                at, new = since[-1], x[q]
                if (at - x[u]) ** 2 + gap[u] ** 2 > (at - new) ** 2 + gap[q] ** 2:
                    stack.pop(), since.pop()
                else:
                    break
            if not stack:
                stack, since = [q], [x[lo]]
            else:
                u = stack[-1]
                first = 1 + (x[q] ** 2 - x[u] ** 2 + gap[q] ** 2 - gap[u] ** 2) // (2 * (x[q] - x[u]))
                if first <= x[hi - 1]:
                    stack.append(q), since.append(first)
        for p in range(hi - 1, lo - 1, -1):
            u = stack[-1]
            out[p] = (x[p] - x[u]) ** 2 + gap[u] ** 2
            if x[p] == since[-1]:
                stack.pop(), since.pop()
        lo = hi
    return out


@F.arrow_udf(ArrayType(LongType()))
def _rows(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in lines:
        yield pa.array([_envelope(*([c[k] for c in line] for k in ("x", "label", "gap"))) for line in batch.to_pylist()], pa.list_(pa.int64()))


def to_own_border(rows: DataFrame, label: str, keys: Sequence[str] = ("img",)) -> DataFrame:
    """(keys, y, x, d2): the squared distance of each labelled pixel to the nearest border pixel of its own label.

    A border pixel has a neighbour, of four, of another label or none. The disk around a pixel that ends at the nearest
    border pixel lies within the label; so the way there, first along the row and then along the column, does too, and it
    is enough to know the nearest border pixel of each column and to search along runs of rows. One shuffle of pixels by
    label and column, one by row; a row of an image is what a task holds.
    """
    at = erode(rows.select(*keys, "y", "x", label), label, keys).where(F.col(label) > 0)
    column = Window.partitionBy(*keys, label, "x").orderBy("y")
    edge = F.when(~F.col("inner"), F.col("y"))
    above = F.max(edge).over(column.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.min(edge).over(column.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = at.withColumn("gap", F.least(F.col("y") - above, below - F.col("y")).cast("long"))
    lines = near.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("long").alias("x"), F.col(label).cast("long").alias("label"), "gap"))).alias("line"))
    done = lines.withColumn("d2", _rows("line"))
    return done.select(*keys, "y", F.explode(F.arrays_zip(F.col("line.x").alias("x"), "d2")).alias("p")).select(*keys, "y", F.col("p.x").cast("int").alias("x"), F.col("p.d2").alias("d2"))
