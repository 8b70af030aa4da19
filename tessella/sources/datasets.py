"""Data sets in the layouts in which they are published, as label rows: instance files, arrays of folds, polygons with classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import slug, stem
from tessella.sources.arrays import read_planes
from tessella.sources.images import image_files, read_images
from tessella.sources.tables import polygons, tile_rectangle


def instance_masks(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(case_id, instance, y, x) of folders case/masks/file, one file per instance; instances count from 1 in order of names.

    Files are numbered by their names before any is decoded; the numbers meet the pixels on the path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path")
    cases = files.where(F.col("path").rlike("/masks/[^/]+$")).withColumn("case_id", F.regexp_extract("path", r"([^/]+)/masks/[^/]+$", 1))
    named = cases.withColumn("instance", F.row_number().over(Window.partitionBy("case_id").orderBy("path")))  # the files of one case
    pixels = read_images(spark, path, glob=glob, recurse=True)
    return pixels.where("v > 0").select("path", "y", "x").distinct().join(named, "path").select("case_id", "instance", "y", "x")


def fold_samples(spark: SparkSession, path: str, glob: str = "*.npy", pattern: str = r"fold_?(\d+)", first: int = 0, end: int | None = None) -> DataFrame:
    """(sample_id, y, x, c, v) of array files of samples, rows, columns and channels; ids tell the fold and the place in it.

    Files of any size are read by ranges of samples, and only the samples from ``first`` to before ``end`` of each.
    """
    rows = read_planes(spark, path, glob, first=first, end=end)
    named = F.format_string("fold%s_%05d", F.regexp_extract("path", pattern, 1).cast("int"), F.col("z"))
    return rows.select(named.alias("sample_id"), "y", "x", "c", "v")


def slice_layers(spark: SparkSession, slices: str, tiles: str) -> DataFrame:
    """(slice, tile, layer, polygon, points) of a file of slices with tiles, layers and polygons, for tiles that have a file of bounds.

    Tiles meet their files on the rectangle.
    """
    schema = "path string, tiles array<struct<rects:array<array<int>>, segmentation_layers:array<struct<name:string, polygons:array<array<array<double>>>>>>>"
    doc = spark.read.schema(schema).json(slices, multiLine=True).select("path", F.explode("tiles").alias("t")).where("size(t.rects) > 0 and size(t.rects[0]) = 4")
    rect = F.struct(*[F.col("t.rects")[0][k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    layers = doc.select("path", rect.alias("rect"), F.posexplode("t.segmentation_layers").alias("at", "l"))
    shapes = layers.select("path", "rect", "at", slug(F.coalesce("l.name", F.lit("layer"))).alias("layer"), F.posexplode("l.polygons").alias("polygon", "points"))
    notes = spark.read.format("binaryFile").option("pathGlobFilter", "*_tile.xml").load(tiles).select("path", F.col("content").cast("string").alias("xml"))
    named = notes.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"_tile\.xml$", "").alias("tile"), F.struct(*[c.alias(n) for n, c in tile_rectangle("xml").items()]).alias("rect"))
    return shapes.join(named, "rect").select(F.col("path").alias("slice"), "tile", "layer", (F.col("polygon") + 1).alias("polygon"), "points")


def class_polygons(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """(…, class, region, vertex, x, y) of annotations that name their class in an attribute, regions numbered within each."""
    notes = rows.select("*", F.posexplode(F.expr(f"regexp_extract_all({xml}, '(?s)<Annotation[ >].*?</Annotation>', 0)")).alias("annotation", "_note")).drop(xml)
    named = notes.withColumn("class", F.expr("xpath_string(_note, '//Attribute/@Name')"))
    return polygons(named, "_note")


def annotated_images(spark: SparkSession, images: str, notes: str) -> DataFrame:
    """(stem, path, xml) of images that have an annotation file of the same stem; notes without an image are left out."""
    files = image_files(spark, images).select("path", F.regexp_extract(stem(F.col("path")), r"([^/]+)$", 1).alias("stem"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(notes).select(F.regexp_extract(stem(F.col("path")), r"([^/]+)$", 1).alias("stem"), F.col("content").cast("string").alias("xml"))
    return files.join(found, "stem").select("stem", "path", "xml")
