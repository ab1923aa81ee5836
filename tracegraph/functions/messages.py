"""Messages and payloads that stand in JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_envelopes(lines: DataFrame, types: list[str]) -> DataFrame:
    """``value`` rows with ``id, type, payload`` (its JSON) and ``error``. An envelope is an object of just ``id`` and ``type`` (strings) and ``payload`` (an object);
    others have an ``error``. Envelopes of types that are not in ``types`` are left out."""
    v = F.try_parse_json("value")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    keys = F.array_sort(F.json_object_keys(F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.col("value"))))
    right = (keys == F.array(F.lit("id"), F.lit("payload"), F.lit("type"))) & (kind("$.id") == "STRING") & (kind("$.type") == "STRING") & F.startswith(kind("$.payload"), F.lit("OBJECT"))
    text = lambda path: F.try_variant_get(v, path, "string")
    out = lines.withColumn("_ok", F.coalesce(right, F.lit(False)))
    ok = F.col("_ok")
    out = out.withColumns({"id": F.when(ok, text("$.id")), "type": F.when(ok, text("$.type")), "payload": F.when(ok, F.to_json(F.try_variant_get(v, "$.payload", "variant"))), "error": F.when(~ok, F.when(v.isNull(), "invalid JSON").otherwise("invalid envelope"))})
    return out.where(~ok | F.col("type").isin(types)).drop("_ok")


def parse_scores(graphs: DataFrame) -> DataFrame:
    """``graph_id, model_version, node_id, score, max_score`` of ``graphs(graph_id, metadata)``. Entries without a node id or a finite score are skipped, the last of a
    node counts; a graph whose largest score is not above 0 gives no row. A version that is no number is 0."""
    schema = "predicted_heat struct<model_version variant, scores array<struct<node_id variant, score variant>>>"
    heat = graphs.select("graph_id", F.from_json("metadata", schema)["predicted_heat"].alias("h"))
    numeric = lambda c: F.schema_of_variant(c).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    version = F.coalesce(F.when(numeric(F.col("h.model_version")), F.try_variant_get("h.model_version", "$", "double")), F.lit(0.0))
    e = heat.select("graph_id", version.alias("model_version"), F.posexplode("h.scores").alias("pos", "e")).select("graph_id", "model_version", "pos", "e.*")
    score = F.when(numeric(F.col("score")), F.try_variant_get("score", "$", "double"))
    node = F.when(F.schema_of_variant("node_id") == "STRING", F.try_variant_get("node_id", "$", "string"))
    e = e.select("graph_id", "model_version", "pos", node.alias("node_id"), score.alias("score")).where("node_id <> '' and score is not null")
    top = e.groupBy("graph_id").agg(F.max("score").alias("max_score")).where("max_score > 0")
    last = e.groupBy("graph_id", "model_version", "node_id").agg(F.max_by("score", "pos").alias("score"))
    return last.join(top, "graph_id")
