"""Holes of labels in images of any size: components of background across tiles, given to the label around them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import tiles as t
from tessella.operators.kernels import FOUR, components
from tessella.operators.labels import relabel, settle


def filled(tiles: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Tiles of labels with each hole filled: background that no path of four-neighbours joins with the edge of the image.

    A hole goes to the label around it; one between several labels stays. Background is numbered tile by tile and joined
    across faces. What travels besides is a row for each component and label that touch in a tile, or across a face.
    """
    background = t.joined(t.run_blocks(tiles, lambda a: components(a == 0, FOUR), keys=keys), keys)
    both = settle(background.select(*keys, "by", "bx", F.col("data").alias("_holes")).join(tiles, [*keys, "by", "bx"]))
    lined = t.over(_stacked(both, keys), 1, _next_to, keys, outside=None)
    touched = settle(_touching(lined, keys))
    around = touched.groupBy(*keys, "hole").agg(F.max("edge").alias("edge"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("not edge and lo = hi")
    fills = touched.select(*keys, "by", "bx", "hole").distinct().join(around.select(*keys, "hole", F.col("lo").alias("label")), [*keys, "hole"])
    listed = fills.groupBy(*keys, "by", "bx").agg(F.collect_list(F.struct("hole", "label")).alias("_fills"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a, pairs = t._array(batch, k), batch.column("_fills")[k].values
                if pairs is not None:
                    holes = np.frombuffer(batch.column("_holes")[k].as_buffer(), "<i8").reshape(a.shape)
                    of, to = pairs.field("hole").to_numpy(), pairs.field("label").to_numpy()
                    order = np.argsort(of)
                    at = np.minimum(np.searchsorted(of[order], holes), len(of) - 1)
                    a = np.where(of[order][at] == holes, to[order][at], a)
                out.append(a)
            yield t._batch(batch, range(batch.num_rows), keys, out)

    return both.join(listed, [*keys, "by", "bx"], "left").mapInArrow(run, t._packed(tiles, keys))


#: Labels and components of background share the values of a tile: background is stored below zero.
def _stacked(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [t._array(batch, k).astype("<i8") for k in range(batch.num_rows)]
            holes = [np.frombuffer(batch.column("_holes")[k].as_buffer(), "<i8").reshape(a.shape) for k, a in enumerate(arrays)]
            yield t._batch(batch, range(batch.num_rows), keys, [np.where(a > 0, a, -h) for a, h in zip(arrays, holes, strict=True)])

    return both.mapInArrow(run, t._packed(both, keys))


def _next_to(a: np.ndarray) -> np.ndarray:
    """For places of background, the component, and the smallest and largest label next to it, one above the other in a record."""
    near = np.stack([t.shifted(a, dy, dx, 0) for dy, dx in t.CROSS])
    hi = near.max(0)
    lo = np.where(near > 0, near, np.iinfo("<i8").max).min(0)
    out = np.zeros(a.shape, [("hole", "<i8"), ("lo", "<i8"), ("hi", "<i8")])
    out["hole"] = np.where(a < 0, -a, 0)
    out["lo"], out["hi"] = np.where(hi > 0, lo, 0), np.maximum(hi, 0)
    return out


def _touching(lined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, by, bx, hole, edge, lo, hi) of each component of background in each tile."""
    schema = lined.select(*keys, "by", "bx").schema.add("hole", "long").add("edge", "boolean").add("lo", "long").add("hi", "long")
    kind = np.dtype([("hole", "<i8"), ("lo", "<i8"), ("hi", "<i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                height, width, top, left, high, wide = (batch.column(c)[k].as_py() for c in ("height", "width", "top", "left", "full_height", "full_width"))
                a = np.frombuffer(batch.column("data")[k].as_buffer(), kind).reshape(height, width)
                y, x = np.nonzero(a["hole"])
                got = a[y, x]
                names, at = np.unique(got["hole"], return_inverse=True)
                edge = np.zeros(len(names), bool)
                edge[at[(y + top == 0) | (y + top == high - 1) | (x + left == 0) | (x + left == wide - 1)]] = True
                lo, hi = np.full(len(names), np.iinfo("<i8").max), np.zeros(len(names), np.int64)
                some = got["hi"] > 0
                np.minimum.at(lo, at[some], got["lo"][some]), np.maximum.at(hi, at[some], got["hi"][some])
                taken = pa.array(np.full(len(names), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in (*keys, "by", "bx")), pa.array(names), pa.array(edge), pa.array(lo), pa.array(hi)], schema.names)

    return lined.mapInArrow(run, schema)


def cleaned(tiles: DataFrame, least: int, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Label rows (keys, y, x, label) with small labels dropped and holes filled, numbered from 1 in each image; pixels of background have no row.

    Sizes are counted over all tiles before and after filling.
    """
    def large(of: DataFrame) -> DataFrame:
        return t.measured(of, keys).where((F.col("label") > 0) & (F.col("area") >= least)).select(*keys, "label")

    def only(of: DataFrame) -> DataFrame:
        return t.pixels(of, "label", "long", keys).join(large(of), [*keys, "label"], "left_semi")

    tiles = settle(tiles)  # each of these is read in several branches, which would each make it anew
    first = large(tiles)
    dropped = t.measured(tiles, keys).where("label > 0").join(first, [*keys, "label"], "left_anti").select(*keys, "label")
    holes = settle(filled(settle(_without(tiles, dropped, keys)), keys))
    return relabel(only(holes), "label", "new", keys).select(*keys, "y", "x", F.col("new").cast("long").alias("label"))


def _without(tiles: DataFrame, dropped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles without some labels, each of which is sent to the tiles that hold it."""
    held = t.measured(tiles.withColumns({"_by": F.col("by"), "_bx": F.col("bx")}), [*keys, "_by", "_bx"]).select(*keys, "_by", "_bx", "label")
    listed = held.join(dropped, [*keys, "label"]).groupBy(*keys, F.col("_by").alias("by"), F.col("_bx").alias("bx")).agg(F.collect_list("label").alias("_dropped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a, gone = t._array(batch, k), batch.column("_dropped")[k].values
                out.append(a if gone is None else np.where(np.isin(a, gone.to_numpy()), 0, a))
            yield t._batch(batch, range(batch.num_rows), keys, out)

    return tiles.join(listed, [*keys, "by", "bx"], "left").mapInArrow(run, t._packed(tiles, keys))
