"""What the operators share: reading tables, names that cannot clash, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Rounds, cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it one that no column of ``df`` has (in any case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``doc``, so that columns put beside it cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")


def host_key(col) -> F.Column:
    """A non-null grouping key: null and any string stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows ``(node, label)``, label the smallest node reachable.

    Alternating large-star and small-star steps; each is one aggregate with map-side
    combine and one join whose large side may be split, so a hub of millions of links
    is never gathered in one task. Nodes that are their own label are left out.
    Null ends and self links are ignored; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rounds = Rounds(edges.sparkSession)
    e, before = rounds.cut(e), None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = rounds.cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now
