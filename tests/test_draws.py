"""Percentiles of large groups, weighted samples and runs as a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import sampling
from tessella.operators.percentiles import percentiles
from tessella.streaming.runs import run_progress

SHARES = (0.0, 0.01, 0.25, 0.5, 0.999, 1.0)


@pytest.mark.parametrize(("bins", "limit"), [(4096, 10_000), (256, 20)])
def test_percentiles_equal_numpy(spark, bins, limit):
    rng = np.random.default_rng(0)
    groups = [rng.normal(size=500), np.exp(rng.normal(size=777) * 8), np.full(40, 3.25), rng.integers(0, 4, 300).astype(float), np.array([7.0]), np.array([1.0, 2.0]), np.concatenate([np.zeros(200), [1e300, -1e300]])]
    rows = [(k, float(x)) for k, g in enumerate(groups) for x in g] + [(0, None), (1, float("nan")), (9, None)]
    got = {r["img"]: r["p"] for r in percentiles(spark.createDataFrame(rows, "img int, v double"), "v", SHARES, bins=bins, limit=limit).collect()}
    assert sorted(got) == list(range(len(groups)))
    for k, g in enumerate(groups):
        assert np.allclose(got[k], np.quantile(g, SHARES), rtol=1e-12)


def test_ten_million_different_values(spark):
    n = 10_000_000
    rows = spark.range(n).select(F.lit(1).alias("img"), ((F.col("id") * 7_654_321 % n).cast("double")).alias("v"))
    assert np.allclose(percentiles(rows, "v", (0.01, 0.5, 0.99)).first()["p"], np.array([0.01, 0.5, 0.99]) * (n - 1))


def test_epochs_are_repeatable_and_follow_weights(spark):
    rows = spark.createDataFrame([(k, float(1 + 9 * (k < 100))) for k in range(1000)] + [(2000, 0.0), (2001, None), (2002, float("nan")), (2003, -1.0)], "id int, w double")
    a = sampling.drawn(rows.repartition(7), "id", "w", 40, 50).collect()
    assert sorted(a) == sorted(sampling.drawn(rows.repartition(2), "id", "w", 40, 50).collect())
    for e in range(40):
        part = [r for r in a if r["epoch"] == e]
        assert [r["place"] for r in sorted(part, key=lambda r: r["place"])] == list(range(1, 51)) and len({r["id"] for r in part}) == 50
    heavy = sum(r["id"] < 100 for r in a) / len(a)
    assert abs(heavy - 0.495) < 0.05 and max(r["id"] for r in a) < 1000  # 100 of weight 10 against 900 of weight 1
    assert sampling.drawn(rows, "id", "w", 2, 5000).count() == 2000 and sampling.drawn(rows.where("false"), "id", "w", 2, 5).count() == 0


def test_draws_with_replacement(spark):
    rows = spark.createDataFrame([(k, w) for k, w in enumerate([0, 5, 1, 0, 94, 10**12])], "id int, w long").where("id < 5")
    got = sampling.drawn_again(rows.repartition(3), "id", "w", 3, 4000, seed=1).collect()
    assert len(got) == 12_000 and sorted(got) == sorted(sampling.drawn_again(rows, "id", "w", 3, 4000, seed=1).collect())
    share = {k: sum(r["id"] == k for r in got) / len(got) for k in range(5)}
    assert share[0] == share[3] == 0 and abs(share[4] - 0.94) < 0.02 and abs(share[1] - 0.05) < 0.02
    assert sampling.drawn_again(rows.where("w = 0"), "id", "w", 3, 5).count() == 0


def test_runs_finish_stall_come_back_and_expire(spark, tmp_path):
    began = datetime(2024, 1, 1)
    at = lambda s: began + timedelta(seconds=s)
    schema = "run string, case_id string, total long, at timestamp"
    batches = [
        [("a", "1", 3, at(0)), ("a", "2", 3, at(10)), ("a", "2", 3, at(20)), ("b", "1", 5, at(0)), ("b", "2", 5, at(5)), (None, "1", 1, at(0)), ("c", None, 1, at(0))],
        [("a", "3", 3, at(30)), ("d", "1", 9, at(2000))],
        [("d", "2", 9, at(2001))],  # the watermark has passed b's silence
        [("b", "3", 5, at(1998)), ("b", "1", 5, at(1)), ("d", "3", 9, at(2002))],  # b comes back, with an event too late
        [("d", "4", 9, at(200_000))],
        [("d", "5", 9, at(200_001))],
    ]
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = run_progress(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="10 seconds", silent=600, forget=5000)

        def keep(batch, number, k=k):
            seen.extend((k, r["run"], r["done"], r["total"], r["status"], r["rate"], r["seconds_left"]) for r in batch.collect())

        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
    of = lambda run: [(s[2], s[3], s[4]) for s in seen if s[1] == run]
    assert of("a") == [(2, 3, "running"), (3, 3, "finished")]
    assert of("b")[:3] == [(2, 5, "running"), (2, 5, "stalled"), (3, 5, "running")] and all(s == (3, 5, "stalled") for s in of("b")[3:])
    assert of("d")[0] == (1, 9, "running") and of("c") == []
    first = next(s for s in seen if s[1] == "b")
    assert first[5] == pytest.approx(0.2) and first[6] == pytest.approx(15)
