"""Driver contract: entry() runs, and every query equals its DuckDB oracle
on sf0.001 (the driver repeats this at sf0.01)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from encore.plans.catalog import REGISTRY
from conftest import SF0001
from encore.sources.tables import TABLES


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:4] == ["artist_id", "name", "status", "high_priority"]


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(entry.queries())
    assert set(REGISTRY) == set(entry.oracle_sql()) & set(REGISTRY)


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(cols, orows)
