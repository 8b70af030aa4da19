"""Segmentation of large images block by block: blocks with a halo run on their own, and their labels are joined across faces.

A block and its halo is what a task holds, whatever the size of the image.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.kernels import by_groups, stacks
from tessella.operators.labels import LABEL_BITS, block_faces, components, global_ids, merge_boxes, settle, shrunk_faces


def in_blocks(rows: DataFrame, size: int, halo: int, height: int, width: int) -> DataFrame:
    """Each pixel once for every block (by, bx) whose square, widened by the halo, holds it; ``own`` in its own block."""
    def held(c: str, n: int) -> F.Column:
        first, last = F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)
        return F.explode(F.sequence(F.greatest(F.lit(0), first).cast("int"), F.least(F.lit((n - 1) // size), last).cast("int")))

    out = rows.withColumn("by", held("y", height)).withColumn("bx", held("x", width))
    return out.withColumn("own", (F.floor(F.col("y") / size) == F.col("by")) & (F.floor(F.col("x") / size) == F.col("bx")))


def run_blocks(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], v: str, size: int, halo: int, height: int, width: int, keys: Sequence[str] = ("img",), steps: Sequence[Callable[[np.ndarray], np.ndarray]] = (), stacked: bool = False) -> DataFrame:
    """(keys, by, bx, y, x, label) of a kernel run on every block with its halo, after the preprocessing steps in turn.

    Only the pixels of the block itself come back. A stacked kernel, and its steps, take a stack of blocks of one shape.
    """
    names = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def each(block: np.ndarray) -> np.ndarray:
        for step in steps:
            block = step(block)
        return np.asarray(kernel(block))

    def run(pdf: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        y, x, own = (pdf[c].to_numpy() for c in ("y", "x", "own"))
        labels, values = np.empty(len(pdf), np.int64), pdf[v].to_numpy()
        for at, place, shape, _ in stacks(of, y, x):
            stack = np.zeros(shape, values.dtype)
            stack[place] = values[at]
            labels[at] = (each(stack) if stacked else np.stack([each(a) for a in stack]))[place]
        return pdf.loc[own, [*names, "by", "bx", "y", "x"]].assign(label=labels[own])

    spread = in_blocks(rows.select(*names, "y", "x", v), size, halo, height, width)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", by int, bx int, y int, x int, label long"
    return by_groups(spread, [*names, "by", "bx"], run, schema)


#: Blocks in a row whose numbers differ in these last bits only are joined together first.
BAND = 10


def join_blocks(parts: DataFrame, size: int, across: int, shrink: bool = False, keys: Sequence[str] = ("img",)) -> tuple[DataFrame, DataFrame]:
    """(keys, y, x, label) and (label, r0, r1, c0, c1): block labels joined where they touch across faces.

    ``across`` is the larger number of blocks along a side of an image; the first key is the number of the image. A joined
    label is the smallest global id of its parts. With ``shrink``, labels are shrunk along faces before they are joined.
    """
    block = F.col(keys[0]).cast("long") * (across * across) + F.col("by") * across + F.col("bx")
    ids = settle(parts.select(*keys, "y", "x", global_ids(block, F.col("label")).alias("id")))
    edges = shrunk_faces(ids, size, keys) if shrink else block_faces(ids, size, keys)
    roots = components(edges.select("a", "b"), ids.where("id > 0").select(F.col("id").alias("node")).distinct(), near=F.shiftright("a", LABEL_BITS + BAND))
    boxes = ids.where("id > 0").groupBy("id").agg(F.min("y").alias("r0"), (F.max("y") + 1).alias("r1"), F.min("x").alias("c0"), (F.max("x") + 1).alias("c1")).join(roots, F.col("id") == F.col("node"))
    # background has no root, and all of it would meet in one task
    joined = ids.where("id > 0").join(roots, F.col("id") == F.col("node")).select(*keys, "y", "x", F.col("root").cast("long").alias("label")).unionByName(ids.where("id = 0").select(*keys, "y", "x", F.lit(0).cast("long").alias("label")))
    return joined, merge_boxes(boxes, "root").withColumnRenamed("root", "label")
