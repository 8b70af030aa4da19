"""A corpus pipeline: language, quality, near duplicates, privacy and packing, each stage by one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next one's docs. All
but the last return the columns of documents; what a stage rejects is gone.

Near duplicates are those of the SimHash operator, fingerprints that differ in at most three bits. That is stricter than
a similarity of 0.8 of five-word shingles; the README says what that leaves and why.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import language, packing, pii, simhash
from tessella.llm.common import checkpoint, free_name, remainder, table
from tessella.llm.queries import quality_rules
from tessella.operators.durable import remove, shared_folder

#: Share of a text's n-grams that its language has to explain; far below what prose of a known language shows.
MIN_LANGUAGE_SCORE = 0.2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts that are null, empty or without a letter, or in none, go.

    Without any row with a language nothing is learned and all go. Repeated rows are judged alike, null ids like any
    other, texts of any length whole; an empty table gives none.
    """
    learned = language.learn(docs, F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(True)))
    found = free_name(docs, "found")
    judged = docs.withColumn(found, language.predict(F.col("text"), learned))
    return judged.where((F.col(f"{found}.lang_pred") != language.UNDETERMINED) & (F.col(f"{found}.score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list; null and empty texts fail the base rule and go.

    Without labelled rows the base rule decides alone. Repeated rows are judged alike; an empty table gives none.
    """
    rows, judged = quality_rules(spark, docs, sf_dir)
    return rows.where(f"{judged}.kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the smallest doc_id, then the smallest hash of the text; null ids come last.

    Rows that share an id, or have none, but not a text are rows of their own; of equal rows one stays. Null and empty
    texts are one group; an empty table gives none.
    """
    kept = checkpoint(simhash.representatives(docs)).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "n")
    repeated = not kept.where("n > 1").isEmpty()
    mark = free_name(docs, "text_hash")
    rows = docs.withColumn(mark, F.xxhash64("text"))
    # The keys of a partition are hashed and its texts stream past them, so texts are dealt once and never sorted.
    single = rows.join(kept.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows[mark] == kept["kept_hash"]), "left_semi")
    if repeated:
        single = single.dropDuplicates(["doc_id", mark])
    return single.select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars, if there, counts the new text.

    Null and empty texts, and texts without finds, stay as they are; repeated rows change alike; an empty table gives none.
    """
    found = free_name(docs, "found")
    out = docs.withColumn(found, pii.pseudonyms(F.col("text"))).withColumn("text", F.coalesce(F.col(f"{found}.text"), "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{found}.text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts are the end id alone.

    Repeated rows are packed each, long texts cut into pieces; an empty table gives none.
    """
    pieces = packing.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_languages),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: The stages learn models and count tokens, which SQL does not express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is written between them lies in the shared folder and is removed when it has been used.

    The last stage's rows stay there, as the result reads them.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
