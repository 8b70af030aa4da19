"""Annotations and score tables: polygons, image annotations, result files with resumption, reports."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Sequence
from xml.parsers import expat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import markdown_row, mean_cell
from tessella.operators.compare import finite
from tessella.operators.kernels import boxes, by_group, outline

#: Columns of result files, the metrics among them, and the shape of a tile's bounds (fixed values).
SCORE_SCHEMA = "dataset string, sample_id string, category string, method string, br_mean_strict string, br_seraph string, boundary_precision_seraph string, boundary_f_seraph string, fb_mean_strict string, f_area_mean_strict string, pixel_dice string"
METRICS = ("br_mean_strict", "br_seraph", "boundary_precision_seraph", "boundary_f_seraph", "fb_mean_strict", "f_area_mean_strict", "pixel_dice")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A result file as typed rows: what is empty, not a number or not finite is null."""
    rows = spark.read.schema(SCORE_SCHEMA).csv(path, header=True)
    return rows.withColumns({m: finite(F.col(m)) for m in METRICS})


def complete(rows: DataFrame, exempt_dataset: str = "pannuke") -> DataFrame:
    """Rows whose metrics are all there; one dataset does without the pooled boundary metrics."""
    needed = F.lit(True)
    for m in METRICS:
        needed = needed & (F.col(m).isNotNull() | ((F.col("dataset") == exempt_dataset) & F.lit("seraph" in m)))
    return rows.where(needed)


def write_scores(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, header=True)


def _vertices(regions: pd.Series) -> pd.Series:
    """The X and Y of each Vertex of a region's XML, in order; one pass of a parser."""

    def one(text: str | None) -> list[dict[str, str | None]] | None:
        if text is None:
            return None
        found = []
        parser = expat.ParserCreate()
        parser.StartElementHandler = lambda name, of: found.append({"x": of.get("X"), "y": of.get("Y")}) if name == "Vertex" else None
        parser.Parse(text, True)
        return found

    return regions.map(one)


def polygons(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """(…, region, vertex, x, y) of the Region/Vertices/Vertex elements of an XML column, numbered from 1."""
    regions = rows.select("*", F.posexplode(F.expr(f"regexp_extract_all({xml}, '(?s)<Region[ >].*?</Region>', 0)")).alias("region", "_region"))
    spread = regions.select("*", F.posexplode(F.pandas_udf(_vertices, "array<struct<x string, y string>>")("_region")).alias("vertex", "_p")).drop("_region", xml)
    return spread.select(*[c for c in spread.columns if c not in ("region", "vertex", "_p")], (F.col("region") + 1).alias("region"), (F.col("vertex") + 1).alias("vertex"), F.col("_p")["x"].cast("double").alias("x"), F.col("_p")["y"].cast("double").alias("y"))


def tile_rectangle(xml: str = "xml") -> dict[str, F.Column]:
    pattern = r'<bounds\s+x1="(\d+)"\s+y1="(\d+)"\s+x2="(\d+)"\s+y2="(\d+)"'
    return {n: F.nullif(F.regexp_extract(xml, pattern, k), F.lit("")).cast("int") for k, n in ((1, "x1"), (2, "y1"), (3, "x2"), (4, "y2"))}


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, annotation_id, ring, points) of an annotation file: exploded annotations joined with their images."""
    doc = spark.read.json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    notes = doc.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("image_id"), F.col("a.id").alias("annotation_id"), F.posexplode("a.segmentation").alias("ring", "points"))
    return notes.join(images, "image_id")


def outlines(labels: DataFrame, label: str = "label", width: int = 4) -> DataFrame:
    """One line per label: its padded number and the points of its border in reading order."""
    line = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("y", "x"))), lambda p: F.concat_ws(",", p["x"], p["y"])))
    return labels.groupBy("img", label).agg(line.alias("points")).withColumn("name", F.lpad(F.col(label).cast("string"), width, "0"))


def traced(labels: DataFrame, label: str = "label", width: int = 4, least: int = 5) -> DataFrame:
    """(img, label, name, points, n) of label rows: the outer border of each label traced in order, as "x,y,x,y,...".

    A group is the labelled pixels of one image. Borders of fewer than ``least`` points are left empty.
    """
    kind = dict(labels.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        grid = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), np.int64)
        grid[y - y.min(), x - x.min()] = rows[label].to_numpy()
        names, found = [], []
        for name, box in zip(*boxes(grid), strict=True):
            points = outline(grid[box] == name) + (int(x.min()) + box[1].start, int(y.min()) + box[0].start)
            names.append(name)
            found.append(points if len(points) >= least else points[:0])
        return pd.DataFrame({"img": rows["img"].iloc[0], label: names, "points": [",".join(map(str, p.ravel().tolist())) for p in found], "n": [len(p) for p in found]})

    done = by_group(labels.where(F.col(label) > 0).select("img", label, "y", "x"), ["img"], run, f"img {kind['img']}, `{label}` {kind[label]}, points string, n int")
    return done.select("img", label, F.lpad(F.col(label).cast("string"), width, "0").alias("name"), "points", "n")


def records(labels: DataFrame, outlines_: DataFrame, label: str = "label") -> DataFrame:
    """(img, height, width, n_labels, masks, outlines) of label rows: one nested row per image, for Parquet.

    masks holds the labels of all pixels in reading order, outlines the points of each label as of ``traced``.
    """
    lines = outlines_.groupBy("img").agg(F.array_sort(F.collect_list(F.struct(label, "points"))).alias("outlines"))
    cells = F.array_sort(F.collect_list(F.struct("y", "x", label)))
    grids = labels.groupBy("img").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count_distinct(F.when(F.col(label) > 0, F.col(label))).alias("n_labels"), cells.alias("cells"))
    return grids.join(lines, "img", "left").select("img", "height", "width", "n_labels", F.transform("cells", lambda c: c[label]).alias("masks"), "outlines")


#: Layout of a polygon in the region files of a common image editor (fixed values): magic, version, kind, length of the header.
ROI_MAGIC, ROI_VERSION, ROI_POLYGON, ROI_HEADER = b"Iout", 227, 0, 64

#: The largest number that a field of 16 bits holds.
ROI_MOST = 32767


def roi(points: Sequence[tuple[int, int]]) -> bytes:
    """The bytes of a region file of a polygon of (x, y) points: a big-endian header with the box, then places within it."""
    xs, ys = [x for x, _ in points], [y for _, y in points]
    top, left = min(ys), min(xs)
    if len(points) > ROI_MOST or max(ys) > ROI_MOST or max(xs) > ROI_MOST:
        raise ValueError(f"a region file holds at most {ROI_MOST} points and places, not {max(len(points), *xs, *ys)}")
    head = ROI_MAGIC + struct.pack(">hBBhhhhh", ROI_VERSION, ROI_POLYGON, 0, top, left, max(ys), max(xs), len(points))
    return head.ljust(ROI_HEADER, b"\0") + struct.pack(f">{2 * len(points)}h", *(x - left for x in xs), *(y - top for y in ys))


def roi_archives(outlines_: DataFrame) -> DataFrame:
    """(img, content): of each image an archive with a region file for each label of ``traced``, named by its padded number."""
    kind = dict(outlines_.dtypes)["img"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, points in sorted(zip(rows["name"], rows["points"], strict=True)):
                flat = [int(v) for v in points.split(",")]
                try:
                    region = roi(list(zip(flat[::2], flat[1::2], strict=True)))
                except ValueError as e:
                    raise ValueError(f"image {rows['img'].iloc[0]}, label {name}: {e}") from e
                archive.writestr(zipfile.ZipInfo(f"{name}.roi"), region)
        return pd.DataFrame({"img": [rows["img"].iloc[0]], "content": [data.getvalue()]})

    return outlines_.where("n > 0").select("img", "name", "points").groupBy("img").applyInPandas(run, f"img {kind}, content binary")


def report(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Report lines (dataset, n, line): means by dataset and method, then over all datasets, by one pass of grouping sets."""
    grouped = scores.groupingSets([["dataset", "method"], ["method"]], "dataset", "method").agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n"))
    named = grouped.withColumn("dataset", F.coalesce("dataset", F.lit("ALL")))
    return named.select("dataset", "method", "n", markdown_row("method", *[mean_cell(F.col(m)) for m in metrics], F.col("n").cast("string")).alias("line"))


def progress_line(done: int, total: int, elapsed: float, sample: str, at: str) -> str:
    """One JSON line of progress, as ``operators.compare.progress`` computes it on columns."""
    import json

    rate = done / elapsed if elapsed > 0 else 0.0
    return json.dumps({"sample": sample, "current": done, "total": total, "pct": round(100 * done / total, 2) if total else 0.0, "eta_s": round((total - done) / rate, 1) if rate else 0.0, "at": at})


def cell_pack(cells: DataFrame) -> DataFrame:
    """(category, roi, n, manifest) of per-cell rows: how many there are, and the rows themselves as JSON in order of gt_id."""
    fields = F.struct(*[c for c in cells.columns if c not in ("category", "roi")])
    rows = cells.groupBy("category", "roi").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("gt_id", fields.alias("cell")))).alias("all"))
    return rows.select("category", "roi", "n", F.to_json(F.transform("all", lambda a: a["cell"])).alias("manifest"))


def latex_rows(rows: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Lines of a table: an escaped name, means with four digits, and the line's end."""
    from tessella.functions.text import latex_escape

    return rows.select(F.concat(F.concat_ws(" & ", latex_escape(F.col(name)), *[mean_cell(F.col(v)) for v in values]), F.lit(r" \\")).alias("line"))
