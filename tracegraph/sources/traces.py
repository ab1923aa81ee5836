"""Reading and writing traces, graphs, coverage text and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import event_weight
from ..schemas import TRACE_LINE
from ..storage import KeyedTable


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with dense ``idx`` per file: positions inside a file block plus the counts of the blocks before it."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("session_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ).where(F.trim("line") != "")
    inside = Window.partitionBy("session_id", "block").orderBy("at")
    before = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = raw.groupBy("session_id", "block").agg(F.count("*").alias("n")).select("session_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = raw.withColumn("r", F.row_number().over(inside) - 1).join(base, ["session_id", "block"])
    return rows.select("session_id", (F.col("base") + F.col("r")).alias("idx"), "line")


def finite(line: Column) -> Column:
    """Bare NaN and Infinity as null: some writers put them where numbers stand."""
    plain = F.regexp_replace(line, r"([:\[,]\s*)-?(?:NaN|Infinity)(?=\s*[,\]}])", "$1null")
    return F.when(line.rlike("NaN|Infinity"), plain).otherwise(line)


def whole_json(line: Column) -> Column:
    """The line as a variant if all of it is one JSON value; the parser itself passes over what follows the first value."""
    inside = lambda a, z: F.try_parse_json(F.concat(F.lit(a), line, F.lit(z)))
    return F.when(inside('{"v":', "}").isNotNull(), F.try_variant_get(inside("[", "]"), "$[0]", "variant"))


def read_trace(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Trace events of JSON lines. A malformed line uses up an index but gives no event; FAILFAST makes it an error; DROPMALFORMED also drops
    what is no object or has no string node id."""
    lines = read_lines(spark, path).withColumn("line", finite(F.col("line"))).withColumn("v", whole_json(F.col("line")))
    v = F.col("v")
    if mode == "FAILFAST":
        lines = lines.withColumn("v", F.when(F.assert_true(v.isNotNull(), F.concat(F.lit("malformed line "), F.col("idx").cast("string"))).isNull(), v))
    if mode == "DROPMALFORMED":
        lines = lines.where(F.schema_of_variant(v).startswith("OBJECT") & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.node_id", "variant")) == "STRING", F.lit(False)))
    e = lines.where("v is not null").withColumn("e", F.from_json("line", TRACE_LINE))
    return e.select(
        "session_id", "idx", "e.event", F.coalesce("e.node_id", F.lit("")).alias("node_id"), "e.ts_ns", "e.thread_id", "e.frame_depth",
        event_weight(F.col("e.metadata")).alias("weight"), F.get_json_object("e.metadata", "$.exc_type").alias("exc_type"), "e.values.args", "e.values.ret", "e.values.ret_truncated", "e.metadata",
    )


def write_trace(events: DataFrame, path: str) -> None:
    """One compact JSON object a line, absent keys left out; the committer publishes all files at once."""
    values = F.when(F.col("args").isNotNull() | F.col("ret").isNotNull(), F.struct("args", "ret", "ret_truncated"))
    line = F.to_json(F.struct("event", "node_id", "ts_ns", "thread_id", "frame_depth", F.try_parse_json("metadata").alias("metadata"), values.alias("values")), {"ignoreNullFields": "true"})
    events.repartitionByRange("session_id", "idx").sortWithinPartitions("session_id", "idx").select(line.alias("value")).write.text(path)


NODE = "struct<id:string,kind:string,name:string,path:string,line:int,metadata:struct<receiver:string>>"
EDGE = "struct<source:string,target:string,kind:string,metadata:struct<line:int,resolved:boolean,names:array<string>,alias:string,`default`:string,aliases:map<string,string>>>"


def read_graph(spark: SparkSession, path: str, part: int | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph documents, ordinals kept, with the metadata that ``resolve_symbols`` reads.

    A document is a file, its ``graph_id`` the file's path; with ``lines`` it is a line that holds its ``graph_id`` (what ``write_graph`` writes with ``lines``), so many graphs are few files.
    It is one row while it is parsed; with ``part``, so many bytes, files are read in parts instead (see ``documents.elements``), an element a row from the start.
    """
    if lines and part is not None:
        raise ValueError("lines are read whole, files by parts")
    if lines:
        g = spark.read.schema(f"graph_id string, nodes array<{NODE}>, edges array<{EDGE}>").json(path)
        nodes, edges = (g.select("graph_id", F.posexplode(c).alias("ord", "e")) for c in ("nodes", "edges"))
    elif part is None:
        g = spark.read.schema(f"nodes array<{NODE}>, edges array<{EDGE}>").option("multiLine", True).json(path).withColumn("graph_id", F.col("_metadata.file_path"))
        nodes, edges = (g.select("graph_id", F.posexplode(c).alias("ord", "e")) for c in ("nodes", "edges"))
    else:
        from .documents import elements

        of = lambda name, kind: elements(spark, path, name, part).select(F.col("doc").alias("graph_id"), "ord", F.from_json("value", kind).alias("e"))
        nodes, edges = of("nodes", NODE), of("edges", EDGE)
    nodes = nodes.select("graph_id", F.col("ord").alias("node_ord"), "e.id", "e.kind", "e.name", "e.path", "e.line", "e.metadata.receiver")
    meta = ["e.metadata.line", "e.metadata.resolved", "e.metadata.names", "e.metadata.alias", F.col("e.metadata.default").alias("default_name"), "e.metadata.aliases"]
    return nodes, edges.select("graph_id", F.col("ord").alias("edge_ord"), "e.source", "e.target", "e.kind", *meta)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, version: str = "1", lines: bool = False) -> None:
    """One JSON document per ``graph_id``, nodes and edges by their ordinals, absent keys left out; what ``read_graph`` reads. A document is one row and as large as its graph.

    Each is a file of its own, for tools that want one. Files cost time each, when they are written, listed and opened; with ``lines`` a document is a line with its ``graph_id``, and a task writes one file,
    gzipped, as the same keys stand in every element. Nodes and edges that are both dealt by ``graph_id`` are not shuffled again.
    """
    node_meta = F.when(F.col("receiver").isNotNull(), F.struct("receiver"))
    node = F.struct("id", "kind", "name", "path", "line", node_meta.alias("metadata"))
    edge = F.struct("source", "target", "kind", F.struct("line", "resolved", "names", "alias", F.col("default_name").alias("default"), "aliases").alias("metadata"))
    # elements are JSON before they are gathered: maps cannot be compared, texts can
    one = lambda df, o, x, side: df.select("graph_id", F.lit(side).alias("side"), F.struct(F.col(o).cast("long").alias("o"), F.to_json(x).alias("j")).alias("x"))
    gathered = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("x")))).alias(side)
    docs = one(nodes, "node_ord", node, "nodes").union(one(edges, "edge_ord", edge, "edges")).groupBy("graph_id").agg(gathered("nodes"), gathered("edges"))
    head = F.to_json(F.struct(*([F.col("graph_id").cast("string").alias("graph_id")] if lines else []), F.lit(version).alias("version")))
    array = lambda side: F.concat(F.lit(f',"{side}":['), F.array_join(F.transform(side, lambda x: x["j"]), ","), F.lit("]"))
    value = F.concat(F.left(head, F.length(head) - 1), array("nodes"), array("edges"), F.lit("}")).alias("value")
    if lines:
        docs.select(value).write.option("compression", "gzip").text(path)
    else:
        docs.select(value, "graph_id").repartition("graph_id").write.partitionBy("graph_id").text(path)


def parse_line_coverage(lines: DataFrame) -> DataFrame:
    """``path:sl.sc,el.ec statements count`` lines; others are skipped. ``lines(value, ord)``."""
    pattern = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.col("value").rlike(pattern)).select("ord", part(1).alias("path"), part(2).cast("int").alias("start_line"), part(4).cast("int").alias("end_line"), part(7).cast("long").alias("n"))


def fold_entry_block(blocks: DataFrame) -> DataFrame:
    """Count of each node's block with the smallest start line (the first of several); zeros go. ``blocks(node_id, start_line, ord, n)``."""
    return blocks.groupBy("node_id").agg(F.min_by("n", F.struct("start_line", "ord")).alias("n")).where("n > 0")


def fold_sum(functions: DataFrame) -> DataFrame:
    return functions.groupBy("node_id").agg(F.sum("n").alias("n")).where("n > 0")


def to_chrome_trace(frames: DataFrame) -> DataFrame:
    """One ``X`` row per frame, microseconds from the session's earliest start."""
    zero = frames.groupBy("session_id").agg(F.min("start_ns").alias("zero"))
    return frames.join(zero, "session_id").select("session_id", F.col("node_id").alias("name"), F.lit("X").alias("ph"), ((F.col("start_ns") - F.col("zero")) / 1000).alias("ts"), (F.col("total_ns") / 1000).alias("dur"), F.lit(1).alias("pid"), F.col("thread_id").alias("tid"))


def save_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id: rows of ``new`` replace those of ``old``."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


class SessionStore:
    """Sessions in a table under ``folder``: a save rewrites only the parts of the table that its ids fall in, and a lookup reads one part."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = KeyedTable(spark, folder, ["id"])

    def save(self, sessions: DataFrame, batch: int | None = None) -> None:
        self.table.upsert(sessions, batch)

    def newest_first(self) -> DataFrame | None:
        rows = self.table.read()
        return None if rows is None else rows.orderBy(F.desc("started_ns"), "id")

    def get(self, session_id: str) -> DataFrame | None:
        return self.table.get(session_id)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys added, removed or changed between two ``(key, hash)`` tables."""
    both = old.select("key", F.col("hash").alias("a")).join(new.select("key", F.col("hash").alias("b")), "key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("key", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
