"""Scans in buckets give what one window over a key gives, at any width; one session is many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracegraph.operators import events as E
from tracegraph.operators import frames as FR
from tracegraph.operators import scan as S

SCHEMA = "session_id string, node_id string, idx long, event string, weight long, ret string, epoch long"


def rows(n=900, seed=0):
    rng = random.Random(seed)
    out = []
    for s in ("hot", "hot", "hot", "b", None):
        for _ in range(n // 5):
            out.append([s, rng.choice(["x"] * 8 + ["y", "z", None]), 0, rng.choice(["call", "return", "exception"]), rng.choice([None, 1, 5]), rng.choice([None, "r"]), rng.choice([None, *range(9)])])
    rng.shuffle(out)
    at = {}
    for r in out:
        at[r[0]] = at.get(r[0], -1) + rng.choice([1, 1, 1, 40])
        r[2] = at[r[0]]
    return [tuple(r) for r in out]


def key(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16])
def test_scans(spark, df, width):
    w = Window.partitionBy("session_id", "node_id").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    values = {"a": S.running_sum(F.col("weight")), "b": S.last_value(F.col("epoch")), "c": S.row_before(F.col("epoch")), "d": S.row_after(F.struct("idx", "ret"))}
    got = S.scan(df, ["session_id", "node_id"], "idx", values, width)
    want = df.withColumns({"a": F.coalesce(F.sum("weight").over(upto), F.lit(0)), "b": F.last("epoch", True).over(upto), "c": F.lag("epoch").over(w), "d": F.lead(F.struct("idx", "ret")).over(w)})
    assert key(got) == key(want)
    assert S.scan(df.limit(0), ["session_id"], "idx", values, width).collect() == []
    n = 30
    slide = Window.partitionBy("session_id", "node_id").orderBy("idx").rangeBetween(-(n - 1), 0)
    assert key(S.trailing_count(df, ["session_id", "node_id"], "idx", n, "k", width)) == key(df.withColumn("k", F.count("*").over(slide)))


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_operators(spark, df, width):
    w = Window.partitionBy("session_id", "node_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    known = df.where("node_id <> ''")
    assert key(E.heat_timeline(df, width)) == key(known.select("session_id", "node_id", "idx", F.coalesce(F.sum("weight").over(w), F.lit(0)).alias("heat")))
    want = df.withColumn("ret", F.when(F.count("ret").over(w) <= 4, F.col("ret")))
    assert key(E.limit_captures(df, 4, width)) == key(want)
    s = Window.partitionBy("session_id").orderBy("idx")
    ends = df.where("event <> 'exception'").select("session_id", "idx")
    assert key(FR.boundaries(df, width)) == key(ends.select("*", F.lag("idx").over(s), F.lead("idx").over(s)))
    points = df.select("session_id", "idx", "epoch")
    runs = points.withColumn("run", F.sum(F.when(F.col("epoch") <= F.lag("epoch").over(s), 1).otherwise(0)).over(s))
    assert key(E.segment_runs(points, width)) == key(runs)


@pytest.mark.parametrize("width", [2, 1 << 16])
def test_as_of_with_hot_places(spark, width):
    rng = random.Random(4)
    series = [(rng.choice("kl"), rng.randrange(60), rng.randrange(9)) for _ in range(80)] + [(None, 5, 3), ("k", None, 8)]
    probes = [(i, rng.choice("klm"), rng.choice([7, 7, 7, rng.randrange(-3, 70)])) for i in range(400)] + [(900, None, 9), (901, "k", None), (901, "k", None)]
    got = E.as_of(spark.createDataFrame(probes, "p long, k string, line long"), spark.createDataFrame(series, "k string, line long, v long"), ["k"], "line", "v", width)
    assert got.columns == ["p", "k", "line", "v"]

    def plain(k, line):
        before = [(x, v) for j, x, v in series if j == k and (x is None or line is not None and x <= line)]
        return max(before, key=lambda b: (b[0] is not None, b[0] or 0, b[1]))[1] if before else None

    assert key(got) == sorted(((p, k, line, plain(k, line)) for p, k, line in probes), key=repr)


def test_one_session_is_many_tasks(spark):
    """The plan deals rows by key and bucket, and no window over a whole key holds more than its buckets."""
    one = spark.range(20_000).selectExpr("'s' session_id", "'n' node_id", "id idx", "1L weight")
    out = E.heat_timeline(one, width=500)
    spread = out.withColumn("part", F.spark_partition_id())
    assert spread.agg(F.sum("heat")).first()[0] == 20_000 * 20_001 // 2
    parts = {r.n for r in E.S.scan(one, ["session_id", "node_id"], "idx", {"h": S.running_sum(F.col("weight"))}, 500).groupBy(F.floor(F.col("idx") / 500).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert parts == {500}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and "_bucket" in plan
