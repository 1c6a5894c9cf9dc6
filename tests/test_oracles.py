"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from rollsmith import plans

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(frame):
    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, name):
    ours = plans.QUERIES[name](spark, str(FOLDER)).toPandas()
    theirs = duck.sql(plans.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs_without_sql(spark, name):
    first = plans.QUERIES[name](spark, str(FOLDER)).toPandas()
    again = plans.QUERIES[name](spark, str(FOLDER)).toPandas()
    assert len(first) and rows(first) == rows(again)
