"""Every registered query with SQL: Spark's rows equal DuckDB's, column by column."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracegraph.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted(([dict(zip(rel.columns, r))[c] for c in cols] for r in rel.fetchall()), key=key)
    have = sorted(([r[c] for c in cols] for r in got), key=key)
    assert len(have) == len(want)
    for x, y in zip(have, want):
        assert all(map(same, x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
