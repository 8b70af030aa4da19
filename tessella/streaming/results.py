"""Score rows as a stream: the latest row of each key, and progress by window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.compare import latest


def keep_latest(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Writes what each batch changes to a folder of its own number, so that a repeated batch overwrites only itself.

    The latest row of each key is state of the stream; a batch writes the keys that it touched. ``current`` reads the
    latest of all batches.
    """
    rest = [c for c in rows.columns if c not in keys]
    state = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key over all batches that ``keep_latest`` wrote."""
    return latest(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def progress(events: DataFrame, at: str, by: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by window and kind; state for windows older than the watermark is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n"))
