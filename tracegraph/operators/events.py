"""Operators over trace events: heat, coverage, windows, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DIFF_ORDER
from ..storage import cut
from . import scan as S

KEY = ["session_id", "node_id"]


def dense_index(df: DataFrame, session: str, order: str, width: int = 1 << 16) -> DataFrame:
    """``idx``: dense position per session by ``order`` (a unique long). Buckets of ``width`` values are counted and only the counts are
    added up in order, so a session of any size is numbered in parallel."""
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    before = Window.partitionBy(session).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(session, "_b").agg(F.count("*").alias("_n")).select(session, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(session, "_b").orderBy(order)
    return rows.withColumn("_r", F.row_number().over(inside) - 1).join(base, [session, "_b"]).withColumn("idx", F.col("_base") + F.col("_r")).drop("_b", "_r", "_base")


def heat(events: DataFrame, at_index: int | None = None, weighted: bool = True, sparse_k: int = 1) -> DataFrame:
    """Sum of weights per session and node over ``idx < at_index``; ``sparse_k`` counts every k-th event only."""
    e = events.where("node_id <> ''")
    if at_index is not None:
        e = e.where(F.col("idx") < (at_index // sparse_k) * sparse_k)
    if sparse_k > 1:
        e = e.where(F.col("idx") % sparse_k == 0)
    return e.groupBy(*KEY).agg((F.sum("weight") if weighted else F.count("*")).cast("long").alias("heat")).where("heat > 0")


def heat_timeline(events: DataFrame, width: int = S.WIDTH) -> DataFrame:
    """Running heat of the event's own node at every event. A node that takes all events of a session is many tasks."""
    rows = events.where("node_id <> ''").select(*KEY, "idx", "weight")
    return S.scan(rows, KEY, "idx", {"heat": S.running_sum(F.col("weight"))}, width).drop("weight")


def coverage(events: DataFrame, at_index: int) -> DataFrame:
    first = events.where("node_id <> ''").groupBy(*KEY).agg(F.min("idx").alias("first"))
    return first.groupBy("session_id").agg(F.count_if(F.col("first") < at_index).alias("covered"))


def coverage_curve(events: DataFrame, bucket: int = 100) -> DataFrame:
    """Distinct nodes seen up to the end of each index bucket in which new ones appear."""
    first = events.where("node_id <> ''").groupBy(*KEY).agg(F.min("idx").alias("first"))
    new = first.groupBy("session_id", F.floor(F.col("first") / bucket).alias("bucket")).agg(F.count("*").alias("new_nodes"))
    w = Window.partitionBy("session_id").orderBy("bucket")
    return new.select("session_id", "bucket", "new_nodes", F.sum("new_nodes").over(w).alias("covered"))


def top_k(events: DataFrame, k: int = 20, at_index: int | None = None) -> DataFrame:
    """The k hottest nodes of each session, ties by node id; none for k <= 0."""
    w = Window.partitionBy("session_id").orderBy(F.desc("heat"), "node_id")
    return heat(events, at_index).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= max(k, 0))


def seek(events: DataFrame, start: int, count: int, cap: int = 1000) -> DataFrame:
    a = max(0, start)
    return events.where((F.col("idx") >= a) & (F.col("idx") < a + max(0, min(count, cap))))


def filter_kinds(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.where(F.col("event").isin(kinds)) if kinds else events


def windowed_heat(events: DataFrame, playhead: int, window_size: int | None = None, kinds: list[str] = ()) -> DataFrame:
    """Counts per node before the playhead, of all events or the last ``window_size``; the window counts events of every kind."""
    low = 0 if window_size is None else max(0, playhead - window_size)
    out = filter_kinds(events.where((F.col("idx") >= low) & (F.col("idx") < playhead)), list(kinds)).groupBy(*KEY).agg(F.count("*").alias("heat"))
    most = out.groupBy("session_id").agg(F.max("heat").alias("max_heat"))
    return out.join(most, "session_id")


def sliding_heat(events: DataFrame, n: int, width: int = S.WIDTH) -> DataFrame:
    """How many of the last ``n`` events of its session each event's node has."""
    return S.trailing_count(events.select(*KEY, "idx"), KEY, "idx", n, "heat", width)


def runtime_coverage(nodes: DataFrame, events: DataFrame, floor: int = 2) -> DataFrame:
    """``id, n, state`` (cold, touched, hot) of graph nodes. Hot: at least the value at position floor(0.75 n) of the ascending counts, and
    ``floor``. That value comes from a histogram of counts."""
    hits = events.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n"))
    counts = nodes.select("id").distinct().join(hits, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    histogram = counts.where("n > 0").groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n")
    upto = histogram.select("n", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("all"))
    limit = upto.where(F.col("upto") > F.floor(F.col("all") * 0.75)).agg(F.greatest(F.min("n"), F.lit(floor)).alias("limit"))
    state = F.when(F.col("n") == 0, "cold").when(F.col("n") >= F.col("limit"), "hot").otherwise("touched")
    return counts.join(F.broadcast(limit)).select("id", "n", state.alias("state"))  # limit is one row


def merge_heat(events: DataFrame, nodes: DataFrame, sessions: list[str]) -> DataFrame:
    """Heat summed over distinct sessions, unresolved ids left out, with whether the graph knows the node."""
    e = events.where(F.col("session_id").isin(sorted(set(sessions)))).where("node_id not in ('', '<unresolved>')")
    total = e.groupBy("node_id").agg(F.sum("weight").cast("long").alias("heat"))
    known = nodes.select(F.col("id").alias("node_id")).distinct().withColumn("known", F.lit(True))
    return total.join(known, "node_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def limit_captures(events: DataFrame, first_n: int = 100, width: int = S.WIDTH) -> DataFrame:
    """``ret`` only for the first ``first_n`` captures of a node; the events stay."""
    counted = S.scan(events, KEY, "idx", {"_nth": S.running_sum(F.col("ret").isNotNull())}, width)
    return counted.withColumn("ret", F.when(F.col("_nth") <= first_n, F.col("ret"))).drop("_nth")


def rank_status(col="status") -> F.Column:
    return F.array_position(F.array(*map(F.lit, DIFF_ORDER)), F.col(col)).cast("long")


def _weights(events: DataFrame, at: int | None) -> DataFrame:
    e = events.where("node_id <> ''")
    e = e if at is None else e.where(F.col("idx") < at)
    return e.groupBy("node_id").agg(F.sum("weight").cast("long").alias("n"))


def diff_traces(a: DataFrame, b: DataFrame, nodes: DataFrame | None = None, at_a: int | None = None, at_b: int | None = None, only: list[str] = ()) -> DataFrame:
    """Status of every node of two runs: new, gone, hotter, colder or same; ``nodes(id)`` adds ids that neither run touched."""
    both = _weights(a, at_a).toDF("node_id", "count_a").join(_weights(b, at_b).toDF("node_id", "count_b"), "node_id", "full_outer")
    if nodes is not None:
        both = both.join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "full_outer")
    x, y = F.coalesce("count_a", F.lit(0)).cast("long"), F.coalesce("count_b", F.lit(0)).cast("long")
    status = F.when((x == 0) & (y > 0), "new").when((x > 0) & (y == 0), "gone").when(y > x, "hotter").when(y < x, "colder").otherwise("same")
    out = both.select("node_id", status.alias("status"), x.alias("count_a"), y.alias("count_b"), (y - x).alias("delta"))
    out = out.where(F.col("status").isin(list(only))) if only else out
    return out.withColumn("status_rank", rank_status())


def diff_vs_static(nodes: DataFrame, events: DataFrame, at_index: int | None = None) -> DataFrame:
    hits = _weights(events, at_index).withColumnRenamed("node_id", "id")
    n = F.coalesce("n", F.lit(0)).cast("long")
    out = nodes.select("id").join(hits, "id", "left")
    return out.select(F.col("id").alias("node_id"), F.when(n > 0, "touched").otherwise("cold").alias("status"), n.alias("count_a"), F.lit(0).cast("long").alias("count_b"), F.lit(0).cast("long").alias("delta"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """Number of nodes of each of the seven statuses, zeros included."""
    every = diff.sparkSession.createDataFrame([(s,) for s in DIFF_ORDER], "status string")
    return every.join(diff.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def has_regression(diff: DataFrame) -> DataFrame:
    return diff.agg(F.coalesce(F.bool_or(F.col("status") == "hotter"), F.lit(False)).alias("regression"))


def as_of(probes: DataFrame, series: DataFrame, by: list[str], at: str, value: str, width: int = S.WIDTH) -> DataFrame:
    """Each probe with the last ``value`` at or before it, no range join. Ties in ``at`` (a whole number): the greatest value.

    Places are looked up, not probes: of each key and place there is one row, with the series' greatest value there if it has one, so that a bucket of ``width`` places
    is at most that many rows however many probes a place has. Answers go back to the probes by an equal join. A probe without a place gets the greatest
    value of those without one, as nothing stands before it.
    """
    v = F.col(value)
    there = series.select(*by, at, v.alias("_v")).unionByName(probes.select(*by, at, F.lit(None).cast(series.schema[value].dataType).alias("_v")))
    places = there.groupBy(*by, at).agg(F.max("_v").alias("_v"))
    found = S.scan(places, by, at, {"_last": S.last_value(F.col("_v"))}, width).select(F.struct(*by, at).alias("_place"), "_last")
    out = probes.withColumn("_place", F.struct(*by, at)).join(found, "_place", "left")
    return out.select(*probes.columns, F.col("_last").alias(value))


def coverage_deltas(polls: DataFrame, width: int = S.WIDTH) -> DataFrame:
    """Positive growth of each key against the poll just before; a key absent there starts at 0 again.
    ``polls(script, start, poll, n)``."""
    rows = S.scan(polls, ["script", "start"], "poll", {"_before": S.row_before(F.struct("poll", "n"))}, width)
    base = F.when(F.col("_before.poll") == F.col("poll") - 1, F.col("_before.n")).otherwise(0)
    return rows.withColumn("delta", F.col("n") - base).where("delta > 0").drop("_before")


def segment_runs(series: DataFrame, width: int = S.WIDTH) -> DataFrame:
    """``run`` of each point: a run starts where the epoch does not rise. ``series(session_id, idx, epoch)``."""
    before = cut(S.scan(series, ["session_id"], "idx", {"_before": S.row_before(F.col("epoch"))}, width))  # a second scan reads it twice
    return S.scan(before, ["session_id"], "idx", {"run": S.running_sum(F.col("epoch") <= F.col("_before"))}, width).drop("_before")
