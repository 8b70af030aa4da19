"""A store of images in blocks: Parquet with one row per block, in folders by block row, so that a part of an image is a partition-pruned scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(pixels: DataFrame, path: str, size: int, img: str = "img", v: str = "v") -> None:
    """Stores pixel rows (img, y, x, v) as blocks: a row holds the box of a square's pixels and their values, row by row.

    Only a block whose box has pixels without a row also stores their places. Blocks are dealt by image and block row.
    """
    placed = pixels.withColumns({"by": F.floor(F.col("y") / size).cast("int"), "bx": F.floor(F.col("x") / size).cast("int")})
    box = [F.min("y").alias("top"), F.min("x").alias("left"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width")]
    blocks = placed.groupBy(img, "by", "bx").agg(*box, F.array_sort(F.collect_list(F.struct("y", "x", v))).alias("cells"))
    partial = F.size("cells") < F.col("height") * F.col("width")
    places = [F.when(partial, F.col(f"cells.{n}")).alias(n) for n in ("y", "x")]
    kept = blocks.select(img, "by", "bx", F.lit(size).alias("size"), "top", "left", "height", "width", *places, F.col(f"cells.{v}").alias(v))
    kept.repartition(img, "by").write.mode("overwrite").partitionBy("by").parquet(path)


def read_blocks(spark: SparkSession, path: str, v: str = "v", rows: tuple[int, int] | None = None) -> DataFrame:
    """Pixel rows of a store; with ``rows`` (first, end) only of the blocks that hold those rows of pixels, from their folders alone."""
    blocks = spark.read.parquet(path)
    if rows is not None:
        size = blocks.select("size").first()["size"]
        blocks = blocks.where((F.col("by") >= rows[0] // size) & (F.col("by") <= (rows[1] - 1) // size))
    own = [c for c in blocks.columns if c not in ("by", "bx", "size", "top", "left", "height", "width", "y", "x", v)]
    cells = blocks.select(*own, "top", "left", "width", "y", "x", F.posexplode(v).alias("_at", "_v"))
    y = F.coalesce(F.get("y", F.col("_at")), (F.col("top") + F.floor(F.col("_at") / F.col("width"))).cast("int"))
    x = F.coalesce(F.get("x", F.col("_at")), (F.col("left") + F.col("_at") % F.col("width")).cast("int"))
    out = cells.select(*own, y.alias("y"), x.alias("x"), F.col("_v").alias(v))
    return out if rows is None else out.where((F.col("y") >= rows[0]) & (F.col("y") < rows[1]))


def blocks_of_files(files: DataFrame, pattern: str = r"_Z(\d+)Y(\d+)X(\d+)") -> DataFrame:
    """Files (path, …) that hold one block each, with the block's place (bz, by, bx) from their names; other files are left out."""
    return files.where(F.col("path").rlike(pattern)).withColumns({n: F.regexp_extract("path", pattern, k).cast("int") for k, n in ((1, "bz"), (2, "by"), (3, "bx"))})
