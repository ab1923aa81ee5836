"""The queries that have SQL: Spark's rows equal DuckDB's, column by column."""

import math
import os

import duckdb
import pytest

from tracegraph.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    rel = con.sql(q.oracle_sql()[name])
    df = q.queries()[name](spark, SF)
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted(([dict(zip(rel.columns, r))[c] for c in cols] for r in rel.fetchall()), key=key)
    have = sorted(([r[c] for c in cols] for r in df.collect()), key=key)
    assert len(have) == len(want) > 0
    for x, y in zip(have, want):
        assert all(a == b or isinstance(a, float) and math.isclose(a, b, rel_tol=1e-12) for a, b in zip(x, y)), (x, y)


def test_mix_keeps_near_its_weights_from_the_start(spark):
    """Every prefix of the schedule: each source's words are within two blocks and a bit of its share."""
    from tracegraph.llm.mixing import schedule

    targets = {"=a": 500_000.0, "=b": 90_000.0, "=c": 200_001.0, "=d": 3_000.0, "null": 40.0}
    rows = schedule(spark.createDataFrame(list(targets.items()), "skey string, target double")).orderBy("slot").collect()
    taken, total = dict.fromkeys(targets, 0), sum(targets.values())
    regular = [r for r in rows if r["slot"] < len(rows)]
    assert len(regular) > 0.99 * len(rows)
    for r in regular:
        taken[r["skey"]] += r["words"]
        done = sum(taken.values())
        assert all(abs(taken[s] - done * targets[s] / total) <= 5 * 256 for s in targets), r
    for r in rows[len(regular) :]:
        taken[r["skey"]] += r["words"]
    assert taken == {s: int(v) for s, v in targets.items()}
    firsts = {s: min(r["slot"] for r in rows if r["skey"] == s) for s in ("=a", "=b", "=c")}
    assert max(firsts.values()) < 20  # all large sources from the start, not one after the other
