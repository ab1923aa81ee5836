"""The given tables as traces and graphs, in Spark and (``SQL``) as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import dense_index

MAX_DEPTH = 5  # of the derived trace


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.when(F.col("event_type").isin("view", "click"), "call").when(F.col("event_type").isin("purchase", "signup"), "return").otherwise("exception")
    e = t(spark, sf, "events").select(
        "event_id", F.concat(F.lit("s"), F.col("user_id") % 4).alias("session_id"), F.col("user_id").alias("thread_id"), kind.alias("event"),
        (k % 6).alias("frame_depth"), F.concat(F.lit("mod"), k % 10, F.lit(".py:fn"), k).alias("node_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.greatest(F.lit(1), F.floor("value")).cast("long").alias("weight"), F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).alias("ret"), k.alias("k"),
    )
    return dense_index(e, "session_id", "event_id")


TE = """te AS (SELECT *, 'mod' || (k % 10) || '.py:fn' || k AS node_id, k % 6 AS frame_depth,
  row_number() OVER (PARTITION BY session_id ORDER BY event_id) - 1 AS idx FROM (
  SELECT event_id, 's' || (user_id % 4) AS session_id, user_id AS thread_id,
   CASE WHEN event_type IN ('view', 'click') THEN 'call' WHEN event_type IN ('purchase', 'signup') THEN 'return' ELSE 'exception' END AS event,
   CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, epoch_us(ts) * 1000 AS ts_ns,
   CAST(greatest(1, floor(value)) AS BIGINT) AS weight, CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END AS ret FROM events))"""

FR = f"""{TE}, st AS (SELECT * FROM te WHERE event IN ('call', 'return')),
 cl AS (SELECT c.session_id, c.thread_id, c.idx AS call_idx, c.node_id, c.frame_depth AS depth, c.ts_ns AS start_ns,
   (SELECT min(x.idx) FROM st x WHERE x.session_id = c.session_id AND x.thread_id = c.thread_id AND x.idx > c.idx AND x.frame_depth <= c.frame_depth) AS close_idx
   FROM st c WHERE c.event = 'call'),
 lt AS (SELECT session_id, thread_id, max(ts_ns) AS last_ns FROM te GROUP BY ALL),
 f1 AS (SELECT cl.*, greatest(cl.start_ns, coalesce(x.ts_ns, lt.last_ns)) AS end_ns,
   NOT coalesce(x.event = 'return' AND x.frame_depth = cl.depth, false) AS synthetic,
   (SELECT max(p.call_idx) FROM cl p WHERE p.session_id = cl.session_id AND p.thread_id = cl.thread_id AND p.call_idx < cl.call_idx
      AND (p.close_idx IS NULL OR p.close_idx > cl.call_idx)) AS parent_idx
   FROM cl JOIN lt USING (session_id, thread_id) LEFT JOIN st x ON x.session_id = cl.session_id AND x.thread_id = cl.thread_id AND x.idx = cl.close_idx),
 f2 AS (SELECT *, end_ns - start_ns AS total_ns FROM f1),
 fr AS (SELECT f2.*, greatest(0, f2.total_ns - coalesce((SELECT CAST(sum(c.total_ns) AS BIGINT) FROM f2 c WHERE c.session_id = f2.session_id AND c.thread_id = f2.thread_id
   AND c.parent_idx = f2.call_idx), 0)) AS self_ns FROM f2)"""

PATHS = f"""{FR}, pa AS (SELECT c.session_id, c.thread_id, c.call_idx, list(p.node_id ORDER BY p.call_idx) AS path FROM fr c
 JOIN fr p ON p.session_id = c.session_id AND p.thread_id = c.thread_id AND p.call_idx <= c.call_idx AND (p.close_idx IS NULL OR p.close_idx > c.call_idx) GROUP BY ALL)"""


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    part = t(spark, sf, "part").selectExpr("concat('p', p_partkey) id", "'function' kind", "p_name name", "concat('src/', p_brand, '/a.py') path", "p_size line")
    supp = t(spark, sf, "supplier").selectExpr("concat('s', s_suppkey)", "'class'", "s_name", "concat('supp/', s_nationkey, '.py')", "1")
    cust = t(spark, sf, "customer").selectExpr("concat('c', c_custkey)", "'method'", "c_name", "concat('cust/', c_mktsegment, '.py')", "c_nationkey")
    nat = t(spark, sf, "nation").selectExpr("concat('n', n_nationkey)", "'file'", "n_name", "concat('n', n_nationkey)", "1")
    reg = t(spark, sf, "region").selectExpr("concat('r', r_regionkey)", "'file'", "r_name", "concat('r', r_regionkey)", "1")
    out = part
    for x in (supp, cust, nat, reg):
        out = out.union(x)
    return out.withColumns({"node_ord": F.lit(0), "graph_id": F.lit("g"), "is_async": F.col("line") > 40, "has_decorators": F.col("line") < 5})


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").selectExpr("concat('c', c_custkey) source", "concat('n', c_nationkey) target", "'import' kind", "1 line", "c_custkey edge_ord")
    s = t(spark, sf, "supplier").selectExpr("concat('s', s_suppkey)", "concat('n', s_nationkey)", "'import'", "1", "s_suppkey")
    n = t(spark, sf, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "'inherit'", "1", "cast(n_nationkey as bigint)")
    p = t(spark, sf, "lineitem").selectExpr(
        "concat('s', l_suppkey)", "concat('p', l_partkey)", "case when l_returnflag = 'R' then 'cross_language_call' else 'call' end", "cast(l_quantity as int)", "l_orderkey * 10 + l_linenumber"
    )
    return c.union(s).union(n).union(p)


G = """gn AS (SELECT 'p' || p_partkey AS id, 'function' AS kind, p_name AS name, 'src/' || p_brand || '/a.py' AS path, p_size AS line FROM part
 UNION ALL SELECT 's' || s_suppkey, 'class', s_name, 'supp/' || s_nationkey || '.py', 1 FROM supplier
 UNION ALL SELECT 'c' || c_custkey, 'method', c_name, 'cust/' || c_mktsegment || '.py', c_nationkey FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'file', n_name, 'n' || n_nationkey, 1 FROM nation
 UNION ALL SELECT 'r' || r_regionkey, 'file', r_name, 'r' || r_regionkey, 1 FROM region),
 ge AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'import' AS kind, 1 AS line, c_custkey AS edge_ord FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'import', 1, s_suppkey FROM supplier
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'inherit', 1, n_nationkey FROM nation
 UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, CASE WHEN l_returnflag = 'R' THEN 'cross_language_call' ELSE 'call' END, CAST(l_quantity AS INT), l_orderkey * 10 + l_linenumber FROM lineitem)"""


def call_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes: the users of the events, in blocks of ten. Edges: one per event, from its user; in every third block around a ring, else up the block; some to themselves, some to
    the next block, in fives of blocks. So there are rings, chains and loops at every scale."""
    e = t(spark, sf, "events").selectExpr("user_id u", "user_id div 10 b", "user_id % 10 p", "event_id e", "event_id % 3 + 1 step", "if(event_type in ('view', 'click'), 'call', 'import') kind")
    to = "case when e % 97 = 0 then u when e % 11 = 0 and b % 5 <> 4 then u + 10 when b % 3 = 0 then b * 10 + (p + step) % 10 else least(b * 10 + 9, u + step) end"
    nodes = e.selectExpr("concat('u', u) id", "if(p = 0, 'file', 'function') kind").distinct()
    return nodes, e.selectExpr("concat('u', u) source", f"concat('u', {to}) target", "kind")


CG = """ev AS (SELECT user_id AS u, user_id // 10 AS b, user_id % 10 AS p, event_id AS e, event_id % 3 + 1 AS step, CASE WHEN event_type IN ('view', 'click') THEN 'call' ELSE 'import' END AS kind FROM events),
 cn AS (SELECT DISTINCT 'u' || u AS id, CASE WHEN p = 0 THEN 'file' ELSE 'function' END AS kind FROM ev),
 ce0 AS (SELECT DISTINCT 'u' || u AS source, 'u' || (CASE WHEN e % 97 = 0 THEN u WHEN e % 11 = 0 AND b % 5 <> 4 THEN u + 10 WHEN b % 3 = 0 THEN b * 10 + (p + step) % 10 ELSE least(b * 10 + 9, u + step) END) AS target, kind FROM ev),
 ce AS (SELECT * FROM ce0 WHERE source IN (SELECT id FROM cn) AND target IN (SELECT id FROM cn)),
 rc AS (SELECT source AS a, target AS b FROM ce UNION SELECT rc.a, ce.target FROM rc JOIN ce ON ce.source = rc.b)"""
