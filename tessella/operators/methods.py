"""Methods that make label maps: a registry of functions, run over what is still to be done.

Networks and native programs are not part of this engine; a method is any function from an image array to a label array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.compare import pending
from tessella.operators.durable import checkpoint
from tessella.operators.kernels import classical
from tessella.operators.labels import contingency
from tessella.operators.metrics import foreground

Method = Callable[[np.ndarray], np.ndarray]
METHODS: dict[str, Method] = {"watershed": classical}


def add_method(name: str, method: Method) -> None:
    METHODS[name] = method


def grid(samples: DataFrame, methods: list[str]) -> DataFrame:
    """Every sample with every method: the methods are a short list, exploded in place."""
    return samples.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


def run(images: DataFrame, methods: list[str], done: DataFrame | None = None) -> DataFrame:
    """(sample_id, method, height, width, labels) for images (sample_id, height, width, data array<double>).

    Pairs in ``done`` (sample_id, method) are skipped. An image that a method fails on has null labels and the error.
    """
    known = {m: METHODS[m] for m in methods}
    wanted = grid(images, methods)
    todo = wanted if done is None else pending(wanted, done, ["sample_id", "method"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    out = known[r.method](np.asarray(r.data, float).reshape(r.height, r.width))
                    rows.append((r.sample_id, r.method, r.height, r.width, np.asarray(out, np.int64).ravel(), None))
                except Exception as e:  # one image must not end the run
                    rows.append((r.sample_id, r.method, r.height, r.width, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["sample_id", "method", "height", "width", "labels", "error"])

    kind = dict(images.dtypes)["sample_id"]
    return todo.select("sample_id", "method", "height", "width", "data").mapInPandas(work, f"sample_id {kind}, method string, height int, width int, labels array<bigint>, error string")


def benchmark(samples: DataFrame, pixels_: DataFrame, methods: dict[str, Column], done: DataFrame) -> DataFrame:
    """(sample_id, method, dice, iou, fresh): scores of every sample with every method, those in ``done`` kept as they are.

    pixels_ has sample_id, v and gt; a method is an expression that says which pixels are object. Only pairs that are not
    done are run: pairs are a short list of methods by sample, and what is read are the pixels of samples that still need one.
    """
    todo = pending(grid(samples.select("sample_id"), list(methods)), done, ["sample_id", "method"])
    chosen = F.lit(False)
    for name, made in methods.items():
        chosen = F.when(F.col("method") == name, made).otherwise(chosen)
    run_ = pixels_.join(todo, "sample_id").select("sample_id", "method", (F.col("gt") > 0).cast("int").alias("gt"), chosen.cast("int").alias("pr"))
    fresh = foreground(contingency(run_, ("sample_id", "method")), ("sample_id", "method")).select("sample_id", "method", "dice", "iou", F.lit(True).alias("fresh"))
    return fresh.unionByName(done.select("sample_id", "method", "dice", "iou", F.lit(False).alias("fresh")))


def resume(spark: SparkSession, path: str, samples: DataFrame, pixels_: DataFrame, methods: dict[str, Column]) -> DataFrame:
    """``benchmark`` over a folder of scores: what is there is done, what is new is appended; the latest scores of all."""
    kinds = f"sample_id {dict(samples.dtypes)['sample_id']}, method string, dice double, iou double"
    try:
        done = spark.read.schema(kinds).parquet(path)
    except AnalysisException:  # nothing is there yet
        done = spark.createDataFrame([], kinds)
    made = checkpoint(benchmark(samples, pixels_, methods, done))
    made.where("fresh").drop("fresh").write.mode("append").parquet(path)
    return made.drop("fresh")


def pixels(made: DataFrame) -> DataFrame:
    """Label rows (sample_id, method, y, x, label) of arrays of labels."""
    rows = made.select("sample_id", "method", "width", F.posexplode("labels").alias("pos", "label"))
    return rows.select("sample_id", "method", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).alias("x"), "label")
