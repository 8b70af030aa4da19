"""Every query with SQL against that SQL, run by DuckDB on the same tables; all others for rows and repeatability."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessella import plans
from tests.conftest import MIDDLE, SMALL


def connection(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def small():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    want = small.execute(plans.oracle_sql()[name]).df()
    got = plans.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:5]
    assert len(a) > 0


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    query = plans.queries()[name]
    assert rows(query(spark, SMALL).toPandas()) == rows(query(spark, SMALL).toPandas()) != []


def test_scores_grid_is_as_surveyed(spark):
    from tessella.plans.fixtures import scores

    assert scores(spark, MIDDLE).count() == 625
