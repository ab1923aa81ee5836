"""Registries for analyses, kinds and sources that users add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .operators import graph as G

Analysis = Callable[[DataFrame, DataFrame], DataFrame]

_analyses: dict[str, Analysis] = {}
_sources: dict[str, Callable] = {}
_kinds: dict[str, dict[str, str]] = {"node": {}, "edge": {}}


def _once(registry: dict, name: str, value) -> None:
    key = canonical(name)
    if key in registry:
        raise ValueError(f"{key!r} is registered already")
    registry[key] = value


def canonical(name: str) -> str:
    """Stripped and lower-cased; empty names and control characters are errors."""
    key = name.strip().lower()
    if not key or not key.isprintable():
        raise ValueError(f"{name!r} is no name")
    return key


def register_analysis(name: str, compute: Analysis) -> None:
    _once(_analyses, name, compute)


def register_source(name: str, reader: Callable) -> None:
    """``reader(spark, path)`` gives trace events or a graph's tables."""
    _once(_sources, name, reader)


def register_kind(of: str, name: str, label: str = "") -> None:
    """A further kind of ``node`` or ``edge``."""
    _once(_kinds[of], name, label or name)


def kinds(spark: SparkSession, of: str) -> DataFrame:
    """Registered kinds as a small table to join with: ``kind, label``."""
    return spark.createDataFrame(sorted(_kinds[of].items()), "kind string, label string")


def read(spark: SparkSession, source: str, path: str):
    return _sources[canonical(source)](spark, path)


def analyse(name: str, nodes: DataFrame, edges: DataFrame, cache: str | None = None) -> DataFrame:
    """The named analysis; with ``cache``, a folder, the result of an equal graph is read from there, also by other and later drivers.

    A result's table lies under the analysis's name and the graph's signature and is complete once the table ``done`` beside it is there.
    """
    compute = _analyses[canonical(name)]
    if cache is None:
        return compute(nodes, edges)
    spark = nodes.sparkSession
    signature = "-".join(str(x) for x in G.graph_signature(nodes, edges).first())
    folder = f"{cache}/analysis={canonical(name)}/signature={signature}"
    try:
        if not spark.read.schema("id long").parquet(folder + "/done").isEmpty():
            return spark.read.parquet(folder + "/rows")
    except AnalysisException:  # no such folder yet
        pass
    compute(nodes, edges).write.mode("overwrite").parquet(folder + "/rows")
    spark.range(1).write.mode("overwrite").parquet(folder + "/done")
    return spark.read.parquet(folder + "/rows")


for _name in ("class", "enum", "file", "function", "interface", "method", "struct", "type_alias"):
    register_kind("node", _name)
for _name in ("call", "cross_language_call", "cross_language_spawn", "implements", "import", "inherit"):
    register_kind("edge", _name)
register_analysis("count-by-kind", lambda nodes, edges: G.count_by_kind(nodes))
register_analysis("top-in-degree", G.top_in_degree)
register_analysis("orphans", G.orphans)
register_analysis("hub-score", G.hub_score)
register_analysis("cycles", G.cycles)
