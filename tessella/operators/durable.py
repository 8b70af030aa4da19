"""Intermediate results that survive lost executors: reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the session's checkpoint folder, else ``spark.checkpoint.dir``.

    Where neither is set, a session within one process (tests) gets a temporary one; on a cluster that is an error, as
    its machines do not share such a folder.
    """
    context = spark.sparkContext
    if (known := context.getCheckpointDir()) is not None:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and its lineage cut, by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate data, wherever Spark wrote it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
