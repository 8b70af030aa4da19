"""The pipeline's stages against plain versions, on small and odd inputs."""

from __future__ import annotations

import re

import pyarrow.parquet as pq

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import MIDDLE
from tests.llm.test_operators import DOCS, brute_components, brute_simhash, plain_stats


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MIDDLE).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.toPandas())
    texts = pq.read_table(f"{MIDDLE}/documents.parquet").to_pandas()
    language, quality, single, private, packed = kept
    assert all(list(k.columns) == list(texts.columns) for k in kept[:4])
    assert len(language) >= 0.99 * len(texts)
    for t in quality["text"]:
        n, _, _, _, repeat = plain_stats(t)
        assert n >= 50 and 100 * repeat <= 50 * n
    labels = pq.read_table(f"{MIDDLE}/labels.parquet").to_pandas()
    good = labels.loc[labels["quality"] == 1, ["doc_id"]].merge(texts, on="doc_id")
    fit = {d for d, t in good[["doc_id", "text"]].itertuples(index=False) if plain_stats(t)[0] >= 50 and 2 * plain_stats(t)[4] <= plain_stats(t)[0]}
    assert len(fit & set(quality["doc_id"])) >= 0.99 * len(fit)
    rows = quality.sort_values("doc_id")
    roots = brute_components(list(rows["doc_id"]), brute_simhash(rows["text"]))
    assert sorted(single["doc_id"]) == sorted(set(roots))
    assert set(private["doc_id"]) == set(single["doc_id"]) and (private["n_chars"] == private["text"].str.len()).all()
    mails = r"[\w.]+@[\w.]+\.com"
    before, after = (set(x for t in k["text"] for x in re.findall(mails, t)) for k in (single, private))
    assert len(before) == len(after) > 5 and not before & after
    assert set(packed["doc_id"]) == set(single["doc_id"])


def test_run_on_odd_rows(spark, tmp_path):
    prose = [r.as_py() for r in pq.read_table(f"{MIDDLE}/documents.parquet")["text"][:40]]
    rows = [(i, t, "en", "s", len(t), 7) for i, t in enumerate(prose)] + [(100, None, None, None, None, None), (101, "", "en", None, 0, 1), (1, prose[1], "en", "s", 1, 2), (None, prose[6], "en", "s", 1, 2), (102, "1234", "xx", "s", 4, 3)]
    docs = spark.createDataFrame(rows, DOCS + ", shard int").withColumns({"stats": F.lit(1), "kept": F.lit(2), "judged": F.lit(3), "found": F.lit(4)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{MIDDLE}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:  # columns of clashing names come through as they are
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {tuple(r) for r in out.select("stats", "kept", "judged", "found").distinct().collect()} == {(1, 2, 3, 4)}
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert 102 not in set(found["doc_id"]) and 100 not in set(found["doc_id"])
    whole = found[found["doc_id"] == 1]
    assert len(whole) == whole["piece"].nunique()
    empty = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c, d = (r.as_py() for r in pq.read_table(f"{MIDDLE}/documents.parquet")["text"].slice(0, 4))
    assert len(set(brute_components([0, 1, 2, 3], brute_simhash([a, b, c, d])))) == 4
    rows = [(1, a), (1, b), (1, a), (2, b), (None, a), (None, c), (None, c), (3, d), (None, d), (0, d), (3, c + " "), (4, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({"text_hash": F.lit(1), "n": F.lit(2), "kept_id": F.lit(3)})
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, MIDDLE)
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(found, key=str) == sorted([(1, a), (1, b), (3, c + " "), (0, d), (4, None)], key=str)
    alone = spark.createDataFrame([(None, t, "en", "s", 1) for t in (a, b, a, b, c)], DOCS)
    assert sorted(r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, alone, MIDDLE).collect()) == sorted([a, b, c])


def test_entry_lists_eleven():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11)) and "pipeline" in names
