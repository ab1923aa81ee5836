"""Metric series and phases read from a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import matches_method, matches_node
from ..storage import cut
from . import scan as S
from .events import as_of
from .frames import build_frames

# A number as a captured tuple shows it.
FLOAT = r"(?:-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|-?inf|nan)"

# The calls that phases are read from; a pair is a file and a method.
PHASE_NODES = {
    "step": "train.py:train_step", "evaluate": "train.py:evaluate", "forward": "model.py:Sequential.forward", "backward": "model.py:Sequential.backward",
    "reset": "model.py:Sequential.zero_grad", "layer_forward": ("layers.py", "forward"), "layer_backward": ("layers.py", "backward"),
    "loss": ("losses.py", "forward"), "loss_grad": ("losses.py", "backward"), "update": ("optim.py", "step"),
}


def metric_tuples(events: DataFrame, suffix: str, arity: int) -> DataFrame:
    """``session_id, idx, epoch, numbers, finite`` of returned tuples ``(epoch, x1, ..., x_arity)`` of a node. Truncated values and tuples of
    another shape are no points; ``finite`` is false where a number is ``inf`` or ``nan``."""
    shape = rf"^\((\d+)(?:, {FLOAT}){{{arity}}}\)$"
    rows = events.where("event = 'return' and ret is not null and not coalesce(ret_truncated, false)").where(matches_node(F.col("node_id"), suffix) & F.col("ret").rlike(shape))
    words = F.split(F.regexp_replace("ret", r"^\(\d+, |\)$", ""), ", ")
    number = lambda w: F.when(w == "inf", float("inf")).when(w == "-inf", float("-inf")).when(w == "nan", float("nan")).otherwise(w.try_cast("double"))
    out = rows.select("session_id", "idx", F.regexp_extract("ret", shape, 1).cast("long").alias("epoch"), F.transform(words, number).alias("numbers"))
    return out.withColumn("finite", F.forall("numbers", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))


def metric_series(events: DataFrame, suffix: str = "metrics.py:record_epoch") -> DataFrame:
    """``session_id, idx, epoch, loss, accuracy, dropped``: finite points, with the session's count of dropped ones on each row."""
    all_ = metric_tuples(events, suffix, 2)
    dropped = all_.groupBy("session_id").agg(F.count_if(~F.col("finite")).alias("dropped"))
    points = all_.where("finite").select("session_id", "idx", "epoch", F.col("numbers")[0].alias("loss"), F.col("numbers")[1].alias("accuracy"))
    return points.join(dropped, "session_id")


def layer_stats(events: DataFrame, layers: int, suffix: str = "metrics.py:record_layer_stats") -> DataFrame:
    """``session_id, idx, epoch, layer, w, dw``: one row per layer of each finite point of ``1 + 2 * layers`` numbers."""
    points = metric_tuples(events, suffix, 2 * layers).where("finite")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda i: F.struct(F.get("numbers", i * 2).alias("w"), F.get("numbers", i * 2 + 1).alias("dw")))
    return points.select("session_id", "idx", "epoch", F.posexplode(pairs).alias("layer", "p")).select("session_id", "idx", "epoch", "layer", "p.w", "p.dw")


def series_maxima(stats: DataFrame) -> DataFrame:
    """Largest ``w`` and ``dw`` of each layer."""
    return stats.groupBy("session_id", "layer").agg(F.max("w").alias("max_w"), F.max("dw").alias("max_dw"))


def _role(nodes: dict) -> Column:
    node = F.col("node_id")
    is_ = lambda k: matches_method(node, *nodes[k]) if isinstance(nodes[k], tuple) else matches_node(node, nodes[k])
    role = F.when((F.col("event") == "return") & is_("step"), "idle")
    for k in ("evaluate", "forward", "layer_forward", "loss", "loss_grad", "backward", "layer_backward", "update", "reset"):
        role = role.when((F.col("event") == "call") & is_(k), k)
    return role


def phase_segments(events: DataFrame, token_count: int, nodes: dict = PHASE_NODES, chunk: int = 1 << 16) -> DataFrame:
    """``session_id, idx, phase, token``: where phases of training begin.

    The latest call of a marker (evaluate, forward, backward) is open until an event of its thread, of any kind, has its depth or less. A layer's call counts
    only inside its open marker and takes its ordinal there as token (from the right for backward). Where markers close is read off the frames of a trace in which only they
    are calls; what is open, and the ordinals, are scans in buckets, so neither a deep marker nor a long session is one task.
    """
    markers = ["evaluate", "forward", "backward"]
    e = events.select("session_id", "thread_id", "idx", "frame_depth", _role(nodes).alias("role"))
    mark = F.coalesce(F.col("role").isin(markers), F.lit(False))
    only = e.select("session_id", "thread_id", "idx", F.when(mark, "call").otherwise("return").alias("event"), F.col("role").alias("node_id"), "frame_depth", F.lit(0).cast("long").alias("ts_ns"))
    close = build_frames(only, chunk=chunk).select("session_id", F.col("call_idx").alias("idx"), F.col("close_idx").alias("close"))
    rows = e.where("role is not null").join(close.hint("merge"), ["session_id", "idx"], "left")
    slots = {f"_{m}": S.last_value(F.when(F.col("role") == m, F.struct(F.col("idx").alias("open"), "close"))) for m in markers}
    rows = S.scan(rows, ["session_id"], "idx", slots, chunk)
    for m in markers:
        still = F.col(f"_{m}.close").isNull() | (F.col(f"_{m}.close") > F.col("idx"))
        rows = rows.withColumn("in_" + m, F.when(still, F.col(f"_{m}.open"))).drop(f"_{m}")
    inside = F.when(F.col("role") == "layer_forward", F.col("in_forward")).when(F.col("role") == "layer_backward", F.col("in_backward"))
    rows = rows.withColumn("inside", inside).where("role not like 'layer%' or inside is not null").where(~F.col("role").isin(markers))
    rows = cut(rows)  # a scan reads it twice
    rows = S.scan(rows, ["session_id", "role", "inside"], "idx", {"nth": S.running_sum(F.lit(1))}, chunk)
    phase = (
        F.when(F.col("role") == "layer_forward", F.when(F.col("in_evaluate").isNull(), "forward-train").otherwise("forward-eval"))
        .when(F.col("role") == "layer_backward", "backward").when(F.col("role") == "loss_grad", "loss-grad").otherwise(F.col("role"))
    )
    token = F.when(F.col("role") == "layer_forward", F.col("nth") - 1).when(F.col("role") == "layer_backward", token_count - F.col("nth")).otherwise(-1)
    return rows.select("session_id", "idx", phase.alias("phase"), token.cast("int").alias("token"))


def phase_at(segments: DataFrame, playheads: DataFrame) -> DataFrame:
    """``playheads(session_id, idx)`` with the phase active there; idle before the first."""
    return as_of(playheads, segments, ["session_id"], "idx", "phase").withColumn("phase", F.coalesce("phase", F.lit("idle")))
