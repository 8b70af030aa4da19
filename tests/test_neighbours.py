"""Labels by nearest vectors against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessella import plans
from tessella.operators import neighbours
from tests.conftest import SMALL


def brute(rows, k=5):
    """(id, label) of each row (id, label, vector), one by one."""
    out = []
    for i, _, v in rows:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 9), j, lab) for j, lab, w in rows if j != i and lab is not None and len(w) == len(v))[:k]
        votes = Counter(lab for _, _, lab in near)
        if votes:
            out.append((i, min(votes, key=lambda lab: (-votes[lab], lab))))
    return sorted(out)


def test_every_vector_is_labelled_from_all_others(spark):
    t = pq.read_table(f"{SMALL}/embeddings.parquet").to_pydict()
    got = sorted(tuple(r) for r in plans.queries()["style_labels"](spark, SMALL).collect())
    assert got == brute(list(zip(t["vec_id"], t["label"], t["embedding"], strict=True))) and len(got) == len(t["vec_id"])


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)) if i % 7 else None, [float(x) for x in rng.integers(0, 3, 3)]) for i in range(150)]
    rows += [(i, 1, [1.0, 1.0, 1.0]) for i in range(200, 260)] + [(300, 0, [1.0, 2.0]), (301, 2, [1.0, 2.5]), (302, 1, [4.0])] + [(5, 2, rows[9][2]), (5, 1, rows[9][2])]
    odd = [(400, 1, None), (401, 1, []), (402, 1, [1.0, None, 1.0]), (403, 1, [1.0, float("nan"), 1.0]), (404, 1, [float("inf"), 0.0, 0.0]), (None, 2, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")
    for size in (7, 64, 2048):
        assert sorted(tuple(r) for r in neighbours.nearest_labels(frame, rows=size).collect()) == brute(rows)
    assert neighbours.nearest_labels(frame.where(F.lit(False))).count() == 0
