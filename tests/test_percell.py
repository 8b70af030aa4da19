"""The run cell by cell, with every way in which a cell keeps its own mask."""

from __future__ import annotations

import numpy as np

from tessella.operators import percell


def method(values, mask):
    if values[mask].max() > 90:
        raise RuntimeError("too bright")
    return values > 5


def test_every_fallback_and_the_order_of_labels(spark):
    labels, values = np.zeros((20, 30), np.int64), np.zeros((20, 30))
    labels[0, 0:2] = 1  # small
    labels[5:6, 5:15] = 2  # a line: nothing left after erosion
    labels[8:13, 0:6] = 3
    values[9, 3] = 99  # fails
    labels[8:14, 8:14] = 4
    values[8, 8:14] = values[8:14, 8] = 9  # ragged: an angle
    labels[8:14, 16:22] = 7
    values[7:13, 16:24] = 9  # placed, and beyond its mask over label 5
    labels[8:14, 23:29] = 5
    values[9:12, 24:28] = 9
    images = spark.createDataFrame([(1, 20, 30, values.ravel().tolist(), labels.ravel().tolist()), (2, 20, 30, values.ravel().tolist(), [0] * 600)], "img int, height int, width int, values array<double>, labels array<long>")
    for beyond in (False, True):
        done = percell.run(percell.crops(images, 3), method, least=3, erosion=1, check=percell.solid(0.8) if not beyond else percell.solid(0.6), beyond=beyond)
        got = {r["label"]: (r["status"], r["error"]) for r in done.collect()}
        assert got == {1: ("small", None), 2: ("unseeded", None), 3: ("failed", "RuntimeError: too bright"), 4: ("ragged", None), 5: ("placed" if not beyond else got[5][0], None), 7: ("placed" if not beyond else got[7][0], None)}
        want = np.where(np.isin(labels, (1, 2, 3, 4)), labels, 0)
        for k in (5, 7):
            y, x = np.nonzero(labels == k)
            box = np.zeros(labels.shape, bool)
            box[max(0, y.min() - 3) : y.max() + 4, max(0, x.min() - 3) : x.max() + 4] = True
            mask = labels == k
            if got[k][0] == "placed":
                mask = box & (values > 5) & (mask | beyond)
            want[mask] = k
        out = np.zeros_like(labels)
        for r in percell.merged(done).collect():
            assert r["img"] == 1
            out[r["y"], r["x"]] = r["label"]
        assert (out == want).all()
    assert percell.crops(images.where("false"), 1).count() == 0
