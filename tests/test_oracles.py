"""Every registered query against its DuckDB counterpart on the smallest tables."""

import math

import duckdb
import pytest

from palimpsest import catalog
from palimpsest.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 75
    assert set(entry.oracle_sql()) <= set(entry.queries())
