"""Every registered query with SQL, against DuckDB on the small tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from marque.plans import case_queries, driver_queries, source_queries, step_queries, stored_queries  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("query", sorted(driver_queries.SQL))
def test_equals_duckdb(spark, duck, query):
    df = driver_queries.QUERIES[query](spark, str(SF))
    cur = duck.execute(driver_queries.SQL[query])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(e.oracle_sql()) <= set(e.queries())
