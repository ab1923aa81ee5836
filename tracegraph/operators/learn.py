"""Ranks, rank correlation, structural features, targets, and heat prediction with Spark ML."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_dunder, is_private, is_test, path_depth
from ..schemas import EDGE_BUCKETS
from ..storage import cut
from . import graph

# The version, kinds and names of the feature columns that stored models expect.
FEATURE_VERSION = 1
KINDS = ["function", "method", "class", "file"]
FEATURES = (
    ["log1p_in_degree", "log1p_out_degree"] + [f"log1p_{s}_{b}" for s in ("in", "out") for b in EDGE_BUCKETS] + [f"kind_{k}" for k in [*KINDS, "other"]]
    + ["in_cycle", "log1p_scc_size", "in_degree_percentile", "out_degree_percentile", "log1p_file_fan_in", "log1p_file_fan_out", "log1p_bfs_depth", "reachable"]
    + ["log1p_name_len", "is_dunder", "is_private", "is_test", "is_async", "has_decorators", "log1p_path_depth", "log1p_line"]
)


def avg_rank(df: DataFrame, col: str, by: str, name: str = "rank", few: bool = False) -> DataFrame:
    """0-based rank within ``by``, ties averaged. Ordered work is done on the histogram of values only; where that is a small table (``few``), no rows move to be joined with it."""
    h = df.groupBy(by, col).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    h = h.select(by, col, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") - 1) / 2).cast("double").alias(name))
    return df.join(F.broadcast(h) if few else h, [by, col])


def percentile_rank(df: DataFrame, col: str, by: str, name: str = "percentile", few: bool = False) -> DataFrame:
    n = df.groupBy(by).agg(F.count("*").alias("_all"))
    out = avg_rank(df, col, by, "_r", few).join(F.broadcast(n) if few else n, by)
    return out.withColumn(name, F.when(F.col("_all") > 1, F.col("_r") / (F.col("_all") - 1)).otherwise(0.0)).drop("_r", "_all")


def spearman(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks per group; 0 for constant columns."""
    r = avg_rank(avg_rank(df, a, by, "_ra"), b, by, "_rb")
    return r.groupBy(by).agg(F.coalesce(F.nanvl(F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb")), F.lit(0.0)), F.lit(0.0)).alias("spearman"))


def top_overlap(df: DataFrame, a: str, b: str, ord_: str, k: int) -> DataFrame:
    """Share of the k greatest by ``a`` that are among the k greatest by ``b``, ties by row order."""
    if k <= 0:
        raise ValueError("k must be positive")
    x, y = (df.orderBy(F.desc(c), ord_).limit(k).select(ord_) for c in (a, b))
    return x.join(y.withColumn("hit", F.lit(1)), ord_, "left").agg(F.coalesce(F.sum("hit") / F.count("*"), F.lit(0.0)).alias("overlap"))


def targets(nodes: DataFrame, heat: DataFrame) -> DataFrame:
    """log1p(count) / log1p(largest count) per graph; 0 for untouched nodes and where nothing was hit."""
    n = nodes.select("graph_id", "id").join(heat.select(F.col("node_id").alias("id"), "heat"), "id", "left").withColumn("heat", F.coalesce("heat", F.lit(0)))
    most = n.groupBy("graph_id").agg(F.max("heat").alias("most"))
    return n.join(most, "graph_id").select("graph_id", "id", F.when(F.col("most") > 0, F.log1p("heat") / F.log1p("most")).otherwise(0.0).alias("target"))


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population deviation (1e-8 at least) of each column, in long form."""
    s = df.agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.greatest(F.col(f"s_{c}"), F.lit(1e-8)).alias("std")) for c in cols])
    return s.select(F.inline(rows))


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The 35 structural columns per node of one graph, in fixed order; edges with unknown ends are left out.

    Ends are looked up once, and a table of the edges left is what all columns are made of. Different degrees are few: n of them take n * n / 2 edges.
    """
    e = cut(graph.resolved_edges(nodes, edges.select("source", "target", "kind")))
    deg = cut(graph.degree_buckets(nodes, e, resolved=True))
    total = lambda s: sum((F.col(f"{s}_{b}") for b in EDGE_BUCKETS[1:]), F.col(f"{s}_{EDGE_BUCKETS[0]}"))
    deg = deg.withColumns({"in_degree": total("in"), "out_degree": total("out"), "_g": F.lit(0)})
    for side in ("in", "out"):
        deg = percentile_rank(deg, f"{side}_degree", "_g", f"{side}_degree_percentile", few=True)
    deg = deg.drop("_g")
    loops = e.where("source = target").select(F.col("source").alias("id")).distinct().withColumn("loop", F.lit(True))
    f = nodes.withColumn("path", F.coalesce("path", F.lit(""))).join(deg, "id")
    f = f.join(graph.scc(nodes, e, resolved=True).select("id", "size"), "id").join(loops, "id", "left").join(graph.bfs_depth(nodes, e, resolved=True), "id")
    f = f.join(graph.file_fan(nodes.withColumn("path", F.coalesce("path", F.lit(""))), e), "path", "left").na.fill(0, ["fan_in", "fan_out"])
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    name, path = F.col("name"), F.col("path")
    cols = {
        "log1p_in_degree": F.log1p("in_degree"), "log1p_out_degree": F.log1p("out_degree"),
        **{f"log1p_{s}_{b}": F.log1p(f"{s}_{b}") for s in ("in", "out") for b in EDGE_BUCKETS},
        **{f"kind_{k}": one(F.col("kind") == k) for k in KINDS}, "kind_other": one(~F.col("kind").isin(KINDS)),
        "in_cycle": one((F.col("size") > 1) | F.coalesce("loop", F.lit(False))), "log1p_scc_size": F.log1p("size"),
        "in_degree_percentile": F.col("in_degree_percentile"), "out_degree_percentile": F.col("out_degree_percentile"),
        "log1p_file_fan_in": F.log1p("fan_in"), "log1p_file_fan_out": F.log1p("fan_out"), "log1p_bfs_depth": F.log1p(F.greatest("depth", F.lit(0))),
        "reachable": one(F.col("reachable")), "log1p_name_len": F.log1p(F.length(name)), "is_dunder": one(is_dunder(name)),
        "is_private": one(is_private(name)), "is_test": one(is_test(name, path)), "is_async": one(F.col("is_async")),
        "has_decorators": one(F.col("has_decorators")), "log1p_path_depth": F.log1p(path_depth(path)),
        "log1p_line": F.log1p(F.coalesce("line", F.lit(0))),
    }
    return f.select("id", *[cols[c].cast("double").alias(c) for c in FEATURES])


def train_heat(rows: DataFrame, path: str | None = None):
    """Gradient-boosted trees on the feature columns and ``target``; saved with version and width beside it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="x"), GBTRegressor(featuresCol="x", labelCol="target", predictionCol="raw", maxIter=30, seed=1)]).fit(rows)
    if path:
        model.write().overwrite().save(path)
        rows.sparkSession.createDataFrame([(json.dumps({"version": FEATURE_VERSION, "width": len(FEATURES)}),)], "meta string").coalesce(1).write.mode("overwrite").text(path + "-meta")
    return model


def load_heat_model(spark, path: str):
    from pyspark.ml import PipelineModel

    meta = json.loads(spark.read.text(path + "-meta").first()[0])
    if meta != {"version": FEATURE_VERSION, "width": len(FEATURES)}:
        raise ValueError(f"the model has feature version {meta.get('version')} and width {meta.get('width')}")
    return PipelineModel.load(path)


def predict_heat(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw"))), 4).alias("score"))


def prediction_status(scores: DataFrame, heat: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Predicted against actual heat, both scaled to their largest value: on-target, over or under. ``scores(id, score)``, ``heat(id, heat)``."""
    both = scores.join(heat.where("heat > 0"), "id", "full_outer").na.fill({"score": 0.0, "heat": 0})
    most = both.agg(F.max("score").alias("ms"), F.max("heat").alias("mh"))
    both = both.join(F.broadcast(most))  # one row
    p = F.when(F.col("ms") > 0, F.col("score") / F.col("ms")).otherwise(0.0)
    a = F.when(F.col("mh") > 0, F.log1p("heat") / F.log1p("mh")).otherwise(0.0)
    status = F.when(F.abs(p - a) <= tolerance, "on-target").when(p > a, "over").otherwise("under")
    return both.select("id", "heat", "score", status.alias("status"))


def surprise_hotspots(status: DataFrame, k: int = 10) -> DataFrame:
    """``list, rank, id, value``: the ``k`` under-predicted nodes with the most heat, and the ``k`` with the highest score; ties by id."""
    def top(name: str, rows: DataFrame, by: str) -> DataFrame:
        best = rows.select("id", F.col(by).cast("double").alias("value")).orderBy(F.desc("value"), "id").limit(k)
        order = Window.orderBy(F.desc("value"), "id")  # k rows
        return best.select(F.lit(name).alias("list"), F.row_number().over(order).cast("long").alias("rank"), "id", "value")

    return top("under", status.where("status = 'under'"), "heat").unionByName(top("predicted", status, "score"))


def baseline_spearman(rows: DataFrame, target: str = "heat", by: str = "graph_id") -> DataFrame:
    """Rank correlation of the target with the in-degree feature: what a model has to beat."""
    return spearman(rows, "log1p_in_degree", target, by)


def learn_report(rows: DataFrame, predicted: DataFrame, final_loss: float | None = None, history: str | None = None) -> DataFrame:
    """One row: ``examples`` (graphs), ``nodes``, ``final_loss``, ``train_spearman`` and ``baseline_spearman`` (means over graphs); what is not finite is null.

    ``rows(graph_id, id, heat, log1p_in_degree)``, ``predicted(graph_id, id, score)``. With ``history`` the row is appended to that table too.
    """
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    mean = lambda df, name: df.agg(F.avg("spearman").alias(name))
    both = rows.join(predicted.select("graph_id", "id", "score"), ["graph_id", "id"])
    counts = rows.agg(F.countDistinct("graph_id").alias("examples"), F.count("*").alias("nodes"))
    one = counts.join(F.broadcast(mean(spearman(both, "score", "heat", "graph_id"), "train_spearman"))).join(F.broadcast(mean(baseline_spearman(rows), "baseline_spearman")))
    loss = finite(F.lit(None if final_loss is None else float(final_loss)).cast("double"))
    report = one.select("examples", "nodes", loss.alias("final_loss"), finite(F.col("train_spearman")).alias("train_spearman"), finite(F.col("baseline_spearman")).alias("baseline_spearman"))
    if history:
        report.coalesce(1).write.mode("append").parquet(history)
    return report


def split_by_graph(df: DataFrame, val_count: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Whole graphs to validation: the ``val_count`` first by a seeded hash of their id."""
    ids = df.select("graph_id").distinct()
    if ids.limit(val_count + 1).count() <= val_count:
        raise ValueError("val_count must be under the number of graphs")
    val = ids.orderBy(F.xxhash64("graph_id", F.lit(seed)), "graph_id").limit(val_count)
    return df.join(val, "graph_id", "left_anti"), df.join(val, "graph_id", "left_semi")
