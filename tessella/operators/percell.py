"""A method run cell by cell: each cell's crop is a packed row, and a cell on which the method gives nothing keeps its own mask.

Crops overlap, so an image is not kept as pixels by cell: a row has the values and the labels of a cell's box with a margin.
What came of a cell is its status:

* small: fewer pixels than ``least``; the method is not run
* unseeded: nothing of the mask is left after ``erosion`` steps; the method is not run
* failed: the method raised an error, which is kept
* ragged: the result does not pass the check of its shape
* placed: the result is used, within the cell's mask or, with ``beyond``, as it is

Defined results: labels overwrite each other in ascending order, kept masks included; an image without a label has no
rows; labels below 1 are background; null values reach the method as nan; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.kernels import FOUR, _moved, boxes, shape_statistics

#: From the values of a crop and the mask of its cell to a mask of the crop.
Method = Callable[[np.ndarray, np.ndarray], np.ndarray]
CROP = "label long, top int, left int, height int, width int, values binary, labels binary"


def solid(least: float) -> Callable[[np.ndarray, np.ndarray], bool]:
    """A check that the result covers at least so much of its hull."""
    return lambda result, mask: shape_statistics(result)["solidity"] >= least


def crops(images: DataFrame, margin: int, img: str = "img") -> DataFrame:
    """(img, …) a packed crop for each cell of images (img, height, width, values array<double>, labels array<long>).

    Crops are cut where the image is read and dealt out evenly, so an image of many cells is not one task's work.
    """
    schema = images.select(img).schema
    for c in CROP.split(", "):
        name, kind = c.split()
        schema = schema.add(name, "integer" if kind == "int" else kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shape = batch.column("height")[k].as_py(), batch.column("width")[k].as_py()
                values = batch.column("values")[k].values.to_numpy(zero_copy_only=False).astype("<f8").reshape(shape)
                labels = batch.column("labels")[k].values.to_numpy(zero_copy_only=False).astype("<i8").reshape(shape)
                names, found = boxes(labels)
                places = [tuple(slice(max(0, s.start - margin), min(n, s.stop + margin)) for s, n in zip(box, shape, strict=True)) for box in found]
                cut = [(p[0].start, p[1].start, p[0].stop - p[0].start, p[1].stop - p[1].start, np.ascontiguousarray(values[p]).tobytes(), np.ascontiguousarray(labels[p]).tobytes()) for p in places]
                columns = [batch.column(img).take(pa.array(np.full(len(cut), k))), pa.array(names.astype(np.int64))]
                columns += [pa.array([c[n] for c in cut], t) for n, t in enumerate([pa.int32()] * 4 + [pa.binary()] * 2)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return images.select(img, "height", "width", "values", "labels").mapInArrow(run, schema).repartition(img, "label")


def run(cells: DataFrame, method: Method, least: int = 1, erosion: int = 0, check: Callable[[np.ndarray, np.ndarray], bool] | None = None, beyond: bool = False, img: str = "img") -> DataFrame:
    """(img, label, top, left, height, width, status, error, mask) of crops: the pixels that each cell ends up with, packed."""
    schema = cells.select(img, "label", "top", "left", "height", "width").schema.add("status", "string").add("error", "string").add("mask", "binary")

    def one(values: np.ndarray, mask: np.ndarray) -> tuple[str, str | None, np.ndarray]:
        if mask.sum() < least:
            return "small", None, mask
        seeds = mask
        for _ in range(erosion):
            seeds = np.logical_and.reduce(_moved(seeds, FOUR))
        if not seeds.any():
            return "unseeded", None, mask
        try:
            result = np.asarray(method(values, mask)).astype(bool)
        except Exception as e:  # whatever a method does, its cell keeps its mask, and the error is a result
            return "failed", f"{type(e).__name__}: {e}"[:500], mask
        if check is not None and not check(result, mask):
            return "ragged", None, mask
        return "placed", None, result if beyond else result & mask

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for k in range(batch.num_rows):
                shape = batch.column("height")[k].as_py(), batch.column("width")[k].as_py()
                values = np.frombuffer(batch.column("values")[k].as_buffer(), "<f8").reshape(shape)
                labels = np.frombuffer(batch.column("labels")[k].as_buffer(), "<i8").reshape(shape)
                status, error, mask = one(values, labels == batch.column("label")[k].as_py())
                done.append((status, error, np.packbits(mask).tobytes()))
            kept = [batch.column(c) for c in (img, "label", "top", "left", "height", "width")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([d[n] for d in done], t) for n, t in enumerate((pa.string(), pa.string(), pa.binary())))], schema.names)

    return cells.mapInArrow(work, schema)


def merged(done: DataFrame, img: str = "img") -> DataFrame:
    """Label rows (img, y, x, label) of the cells: the largest label of a pixel wins, summed before the shuffle."""
    schema = done.select(img).schema.add("y", "integer").add("x", "integer").add("label", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                height, width, top, left, label = (batch.column(c)[k].as_py() for c in ("height", "width", "top", "left", "label"))
                mask = np.unpackbits(np.frombuffer(batch.column("mask")[k].as_buffer(), np.uint8), count=height * width).reshape(height, width)
                y, x = np.nonzero(mask)
                yield pa.RecordBatch.from_arrays([batch.column(img).take(pa.array(np.full(len(y), k))), pa.array((y + top).astype(np.int32)), pa.array((x + left).astype(np.int32)), pa.array(np.full(len(y), label, np.int64))], schema.names)

    return done.mapInArrow(work, schema).groupBy(img, "y", "x").agg(F.max("label").alias("label"))
