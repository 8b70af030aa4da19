"""Components joined first where their edges are dealt, against a plain search; what remains for the rounds is what several parts hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import labels as l


def plain(nodes, edges):
    root = {n: n for n in nodes}
    while True:
        old = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == old:
            return root


@pytest.mark.parametrize("bits", [0, 3, 40])
@pytest.mark.parametrize("most", [1, 1 << 20])
def test_components_do_not_depend_on_how_edges_are_dealt(spark, monkeypatch, bits, most):
    monkeypatch.setattr(l, "EDGES", most)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(a + d)) for a, d in zip(rng.integers(0, 200, 110), rng.integers(1, 9, 110), strict=True)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = l.components(rows, spark.range(220).withColumnRenamed("id", "node"), near=F.shiftright("a", bits)).collect()
    assert {r["node"]: r["root"] for r in got} == plain(range(220), edges) and len(got) == 220


def test_chains_within_a_part_need_no_rounds(spark):
    rows = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = l.components(rows, spark.range(301).withColumnRenamed("id", "node"), rounds=0, near=F.shiftright("a", 20)).collect()
    assert {r["root"] for r in got} == {0}


def test_vertices_keep_their_own_coordinates(spark):
    from tessella.sources import tables

    xml = '<A><Region Id="1"><Vertices><Vertex X="1"/><Vertex X="2" Y="3"/></Vertices></Region></A>'
    got = tables.polygons(spark.createDataFrame([(7, xml), (8, None)], "k int, xml string")).orderBy("vertex").collect()
    assert [tuple(r) for r in got] == [(7, 1, 1, 1.0, None), (7, 1, 2, 2.0, 3.0)]
