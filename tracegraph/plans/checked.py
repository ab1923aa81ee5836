"""Queries of the operators that the other plans leave out: crates, corpora, causal hops, captured arguments, cached analyses, splits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import extend
from ..functions import scalars as S
from ..operators import events as E
from ..operators import frames as FR
from ..operators import graph as G
from ..operators import learn as L
from ..operators import resolve as RS
from ..sources import files as FL
from ..sources import traces as R
from ..storage import new_folder
from . import derived as D
from .registry import events_query, graph_query, query

# -- graphs ---------------------------------------------------------------------------------------------------------------------------------------

_GHOSTS = "UNION ALL SELECT source, 'ghost' || (line % 7) FROM ge"
graph_query(
    "hub_score_nodes", lambda n, e: G.hub_score(n, e.select("source", "target").union(e.select("source", F.concat(F.lit("ghost"), F.col("line") % 7))), universe="nodes"),
    f", a AS (SELECT source, target FROM ge {_GHOSTS}) SELECT id, CAST(coalesce(sum(d), 0) AS BIGINT) AS score FROM gn LEFT JOIN (SELECT target AS x, 1 AS d FROM a UNION ALL SELECT source, -1 FROM a) ON x = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
)


def _analysed(spark, sf):
    """The registered analysis with its result kept by the graph's signature: what is read is the second answer."""
    folder, nodes, edges = new_folder(spark), D.graph_nodes(spark, sf), D.graph_edges(spark, sf)
    extend.analyse("top-in-degree", nodes, edges, folder)
    return extend.analyse("top-in-degree", nodes, edges, folder)


query("analyse_cached", f"WITH {D.G} SELECT id, count(target) AS in_degree FROM gn LEFT JOIN ge ON target = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(_analysed)


def _crates(spark, sf):
    part, cust, line = (D.t(spark, sf, n) for n in ("part", "customer", "lineitem"))
    path = "concat('c', {0} % 3, '/src/m', {0} % 5, '.rs')"
    nodes = part.selectExpr("concat('p', p_partkey) id", "if(p_partkey % 4 = 0, 'struct', 'function') kind", "concat('F', p_size) name", path.format("p_partkey") + " path", "p_partkey node_ord")
    crate = "element_at(array('alpha', 'beta', 'gamma'), cast((c_custkey + 1) % 3 + 1 as int))"
    uses = cust.selectExpr(path.format("c_custkey") + " source", f"concat({crate}, '::m::F', c_nationkey) target", "'import' kind", "cast(null as boolean) resolved", "c_custkey edge_ord", "if(c_custkey % 2 = 0, concat('al', c_nationkey), null) alias")
    calls = line.selectExpr("concat(" + path.format("l_partkey") + ", ':f')", "if(l_linenumber % 2 = 0, concat('F', l_suppkey % 60), concat('al', l_suppkey % 25))", "if(l_linenumber % 3 = 0, 'inherit', 'call')", "false", "l_orderkey * 10 + l_linenumber", "cast(null as string)")
    out = RS.resolve_symbols(nodes, uses.union(calls), "crate", crates=[("alpha", "c0"), ("beta", "c1"), ("gamma", "c2")]).where("kind <> 'import'")
    return out.groupBy("source", "target", "kind", F.col("resolved").isNull().alias("followed")).agg(F.count("*").alias("n"))


_RS = "'c' || ({0} % 3) || '/src/m' || ({0} % 5) || '.rs'"
query("resolve_crate", f"""WITH n AS (SELECT p_partkey AS o, 'F' || p_size AS name, {_RS.format("p_partkey")} AS path, p_partkey % 3 AS crate FROM part),
 ex AS (SELECT crate, name, 'p' || min(o) AS id FROM n GROUP BY 1, 2), here AS (SELECT path, name, 'p' || min(o) AS id FROM n GROUP BY 1, 2), anyw AS (SELECT name, 'p' || min(o) AS id FROM n GROUP BY 1),
 b AS (SELECT {_RS.format("c_custkey")} AS file, CASE WHEN c_custkey % 2 = 0 THEN 'al' || c_nationkey ELSE 'F' || c_nationkey END AS name, arg_max(ex.id, c_custkey) AS id FROM customer JOIN ex ON ex.crate = (c_custkey + 1) % 3 AND ex.name = 'F' || c_nationkey GROUP BY 1, 2),
 c AS (SELECT {_RS.format("l_partkey")} AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'F' || (l_suppkey % 60) ELSE 'al' || (l_suppkey % 25) END AS name, CASE WHEN l_linenumber % 3 = 0 THEN 'inherit' ELSE 'call' END AS kind FROM lineitem),
 r AS (SELECT c.*, coalesce(b.id, here.id, CASE WHEN c.kind = 'inherit' THEN anyw.id END) AS found FROM c LEFT JOIN b ON b.file = c.file AND b.name = c.name LEFT JOIN here ON here.path = c.file AND here.name = c.name LEFT JOIN anyw ON anyw.name = c.name)
 SELECT file || ':f' AS source, coalesce(found, name) AS target, kind, found IS NOT NULL AS followed, count(*) AS n FROM r GROUP BY ALL""")(_crates)  # fmt: skip

# -- texts and files ------------------------------------------------------------------------------------------------------------------------------

graph_query("clamp_flag", lambda n, e: n.select("id", S.is_clamped(F.col("path"), 12).alias("clamped")), "SELECT id, length(path) > 12 AS clamped FROM gn")


def _arguments(spark, sf):
    """Each customer's account, segment and nation as captured arguments, some with names that are not to be shown."""
    cust = D.t(spark, sf, "customer")
    arg = lambda name, value: f"struct({name} as name, {value} as repr, c_custkey % 11 = 0 as redacted, false as truncated)"
    args = f"array({arg(chr(39) + 'account' + chr(39), 'c_name')}, {arg('if(c_custkey % 3 = 0, ' + repr('Api-Key') + ', ' + repr('segment') + ')', 'c_mktsegment')}, {arg('if(c_custkey % 5 = 0, ' + repr('user_password') + ', null)', 'cast(c_nationkey as string)')})"
    return cust.select("c_custkey", F.posexplode(S.redact_args(F.expr(args))).alias("pos", "a")).select(F.col("c_custkey").alias("key"), F.col("pos").cast("int").alias("pos"), "a.name", "a.repr", "a.redacted")


query("redact_args", """WITH a AS (SELECT c_custkey AS key, 0 AS pos, 'account' AS name, c_name AS repr FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 3 = 0 THEN 'Api-Key' ELSE 'segment' END, c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 5 = 0 THEN 'user_password' END, CAST(c_nationkey AS VARCHAR) FROM customer), h AS (SELECT *, coalesce(name IN ('Api-Key', 'user_password'), false) AS hide FROM a)
 SELECT key, CAST(pos AS INT) AS pos, name, CASE WHEN hide THEN '<redacted>' ELSE repr END AS repr, hide OR key % 11 = 0 AS redacted FROM h""")(_arguments)  # fmt: skip

query("pair_corpus", "SELECT 's' || p_partkey AS stem, 'graphs/' || p_brand || '/s' || p_partkey || '.graph.json' AS graph, 'runs/s' || p_partkey || '.trace.jsonl' AS trace FROM part")(
    lambda spark, sf: FL.pair_corpus(
        D.t(spark, sf, "part").selectExpr("concat('graphs/', p_brand, '/s', p_partkey, '.graph.json') path").union(D.t(spark, sf, "part").selectExpr("concat('runs/s', p_partkey, '.trace.jsonl')")).union(D.t(spark, sf, "part").selectExpr("concat('notes/s', p_partkey, '.md')"))
    )
)


def _kept_sessions(spark, sf):
    """Sessions saved in two batches into a keyed table: the second replaces those of even threads."""
    store = R.SessionStore(spark, new_folder(spark))
    rows = D.trace_events(spark, sf).groupBy(F.concat(F.lit("t"), "thread_id").alias("id"), "thread_id").agg(F.min("ts_ns").alias("started_ns"), F.count("*").alias("event_count"))
    store.save(rows.drop("thread_id"))
    store.save(rows.where("thread_id % 2 = 0").select("id", (F.col("started_ns") + 1).alias("started_ns"), F.lit(0).cast("long").alias("event_count")))
    return store.newest_first().select("id", "started_ns", "event_count")


query("session_store", f"WITH {D.TE} SELECT 't' || thread_id AS id, min(ts_ns) + CASE WHEN thread_id % 2 = 0 THEN 1 ELSE 0 END AS started_ns, CASE WHEN thread_id % 2 = 0 THEN 0 ELSE count(*) END AS event_count FROM te GROUP BY thread_id")(_kept_sessions)

# -- stacks and learning --------------------------------------------------------------------------------------------------------------------------


def _hops(spark, sf):
    """Every call with the frames it is reached through; a node calls the next one by number at a line of its own."""
    e = D.trace_events(spark, sf)
    node = "concat('mod', {0} % 10, '.py:fn', {0})"
    sites = e.select("k").distinct().selectExpr(node.format("k") + " source", node.format("(k + 1)") + " target", "'call' kind", "k line", "cast(k as bigint) edge_ord")
    return FR.causal_hops(e.withColumn("args", F.col("ret")), sites)


query("causal_hops", f"""WITH {D.FR}, h AS (SELECT c.session_id, c.thread_id, c.call_idx, p.call_idx AS hop_idx, p.node_id, row_number() OVER (PARTITION BY c.session_id, c.thread_id, c.call_idx ORDER BY p.call_idx) - 1 AS hop,
  lag(p.node_id) OVER (PARTITION BY c.session_id, c.thread_id, c.call_idx ORDER BY p.call_idx) AS caller FROM fr c JOIN fr p ON p.session_id = c.session_id AND p.thread_id = c.thread_id AND p.call_idx <= c.call_idx AND (p.close_idx IS NULL OR p.close_idx > c.call_idx))
 SELECT session_id, CAST(thread_id AS BIGINT) AS thread_id, call_idx, hop, hop_idx, node_id, CAST(NULL AS VARCHAR) AS args, k AS line FROM h LEFT JOIN (SELECT DISTINCT k FROM te) s ON caller = 'mod' || (k % 10) || '.py:fn' || k AND node_id = 'mod' || ((k + 1) % 10) || '.py:fn' || (k + 1)""")(_hops)  # fmt: skip


def _learned(e):
    """Nodes of each session: heat, the number of threads that call them as in-degree, a score from their number."""
    threads = e.groupBy(F.col("session_id").alias("graph_id"), F.col("node_id").alias("id")).agg(F.sum("weight").alias("heat"), F.log1p(F.countDistinct("thread_id").cast("double")).alias("log1p_in_degree"), F.first("k").alias("k"))
    return threads.withColumn("score", (F.col("k") * 7 % 31).cast("double"))


_RANKED = """, n AS (SELECT session_id AS graph_id, node_id AS id, CAST(sum(weight) AS BIGINT) AS heat, count(DISTINCT thread_id) AS d, any_value(k) * 7 % 31 AS score FROM te GROUP BY 1, 2),
 r AS (SELECT *, rank() OVER (PARTITION BY graph_id ORDER BY heat) + (count(*) OVER (PARTITION BY graph_id, heat) - 1) / 2 AS rh, rank() OVER (PARTITION BY graph_id ORDER BY d) + (count(*) OVER (PARTITION BY graph_id, d) - 1) / 2 AS rd,
  rank() OVER (PARTITION BY graph_id ORDER BY score) + (count(*) OVER (PARTITION BY graph_id, score) - 1) / 2 AS rs FROM n), s AS (SELECT graph_id, coalesce(corr(rd, rh), 0) AS base, coalesce(corr(rs, rh), 0) AS own FROM r GROUP BY 1)"""
events_query("baseline_spearman", lambda e: L.baseline_spearman(_learned(e)).select("graph_id", F.round("spearman", 6).alias("spearman")), _RANKED + " SELECT graph_id, round(base, 6) AS spearman FROM s")
events_query(
    "learn_report", lambda e: L.learn_report(_learned(e).drop("score"), _learned(e), 0.25).select("examples", "nodes", "final_loss", F.round("train_spearman", 6).alias("train_spearman"), F.round("baseline_spearman", 6).alias("baseline_spearman")),
    _RANKED + " SELECT count(*) AS examples, (SELECT count(*) FROM n) AS nodes, CAST(0.25 AS DOUBLE) AS final_loss, round(avg(own), 6) AS train_spearman, round(avg(base), 6) AS baseline_spearman FROM s",
)


def _split(e):
    """Each thread is a graph: a tenth of them goes to validation, whole, and nothing is lost."""
    rows = e.select(F.col("thread_id").cast("string").alias("graph_id"), "idx")
    n = rows.select("graph_id").distinct().count() // 10
    train, val = L.split_by_graph(rows, n, 3)
    both = train.select("graph_id").distinct().join(val.select("graph_id").distinct(), "graph_id")
    sides = train.withColumn("v", F.lit(0)).union(val.withColumn("v", F.lit(1)))
    return sides.agg(F.count("*").alias("n_rows"), F.count_distinct(F.when(F.col("v") == 1, F.col("graph_id"))).alias("n_val"), F.count_distinct("graph_id").alias("n_graphs")).join(F.broadcast(both.agg(F.count("*").alias("n_both"))))


events_query("split_by_graph", _split, "SELECT count(*) AS n_rows, count(DISTINCT thread_id) // 10 AS n_val, count(DISTINCT thread_id) AS n_graphs, CAST(0 AS BIGINT) AS n_both FROM te")


def _kept_heat(spark, sf):
    """Running heat of two halves of the trace in a keyed table: the second upsert brings the sums of the nodes that it touches."""
    from ..storage import KeyedTable

    e = D.trace_events(spark, sf)
    table = KeyedTable(spark, new_folder(spark), ["session_id", "node_id"])
    first, whole = E.heat(e.where("event_id % 2 = 0")), E.heat(e)
    table.upsert(first)
    moved = E.heat(e.where("event_id % 2 = 1")).select("session_id", "node_id")
    table.upsert(whole.join(moved, ["session_id", "node_id"], "left_semi"))
    return table.read().select("session_id", "node_id", "heat")


query("heat_kept", f"WITH {D.TE} SELECT session_id, node_id, CAST(sum(weight) AS BIGINT) AS heat FROM te GROUP BY 1, 2")(_kept_heat)
