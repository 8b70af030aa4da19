"""A bounded sample of labelled documents with their statistics, for the learned models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import share
from tessella.llm.textstats import features, stats

#: Labelled documents that a model is learned from, at most.
SAMPLE_ROWS = 16_000


def sample(docs: DataFrame, labels: DataFrame, where: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """(doc_id, label, features) of at most ``rows`` labelled documents, ordered by doc_id, for the driver.

    ``where`` is on the labels' doc_id. Labels other than 0 and 1 are left out, contradictory ones count as 0; of
    repeated documents with one id, the smallest statistics count. The sample is chosen by a hash of the id: a share
    that leaves about so many, of those the first by another hash. Its size bounds the broadcast of ids and what comes
    to the driver. All texts of the sample are read whole; no labelled rows give an empty sample.
    """
    known = labels.where(where & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    n = known.count()
    if not n:
        return pd.DataFrame(columns=["doc_id", "label", *features()])
    chosen = known.where(share(min(1.0, rows / n), F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = texts.select("doc_id", "label", stats(F.col("text")).alias("s")).groupBy("doc_id", "label").agg(F.min("s").alias("s"))
    return found.select("doc_id", "label", *[c.alias(k) for k, c in features("s").items()]).toPandas().sort_values("doc_id", ignore_index=True)
