"""Every query against its DuckDB oracle at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from terrazone.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"create view {name[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    told = duck.execute(ORACLES[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in told.fetchall())


def test_entry(spark):
    import __spark_entry__

    counts = {r.cls: r.pixels for r in __spark_entry__.entry(spark).collect()}
    assert counts == {0: 200, 1: 299, 2: 201, 3: 298}
