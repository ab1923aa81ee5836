"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import frames as FR_
from ..operators import graph as G_
from ..operators import learn as L
from ..sources import traces as R
from ..storage import cut
from . import derived as D

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def events_query(name: str, build, sql: str):
    query(name, f"WITH {D.TE} {sql}")(lambda spark, sf: build(D.trace_events(spark, sf)))


def frames_query(name: str, build, sql: str, ctes: str = D.FR):
    def run(spark, sf):
        e = D.trace_events(spark, sf)
        return build(e, FR_.build_frames(e))

    query(name, f"WITH {ctes} {sql}")(run)


def graph_query(name: str, build, sql: str):
    query(name, f"WITH {D.G} {sql}")(lambda spark, sf: build(D.graph_nodes(spark, sf), D.graph_edges(spark, sf)))


def ab(e):
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")


DIFF = """a AS (SELECT node_id, CAST(sum(weight) AS BIGINT) AS n FROM te WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT node_id, CAST(sum(weight) AS BIGINT) AS n FROM te WHERE event_id % 2 = 1 GROUP BY 1),
 d0 AS (SELECT coalesce(a.node_id, b.node_id) AS node_id, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b FROM a FULL JOIN b USING (node_id)),
 d AS (SELECT *, count_b - count_a AS delta, CASE WHEN count_a = 0 AND count_b > 0 THEN 'new' WHEN count_a > 0 AND count_b = 0 THEN 'gone' WHEN count_b > count_a THEN 'hotter' WHEN count_b < count_a THEN 'colder' ELSE 'same' END AS status FROM d0)"""

query("diff_traces", f"WITH {D.TE}, {DIFF} SELECT node_id, status, count_a, count_b, delta, CAST(list_position(['hotter','new','gone','colder','same','cold','touched'], status) AS BIGINT) AS status_rank FROM d")(
    lambda spark, sf: E.diff_traces(*ab(D.trace_events(spark, sf)))
)
query("diff_counts", f"WITH {D.TE}, {DIFF} SELECT s.status, count(d.status) AS n FROM (SELECT unnest(['hotter','new','gone','colder','same','cold','touched']) AS status) s LEFT JOIN d ON d.status = s.status GROUP BY 1")(
    lambda spark, sf: E.diff_counts(E.diff_traces(*ab(D.trace_events(spark, sf))))
)
query("has_regression", f"WITH {D.TE}, {DIFF} SELECT bool_or(status = 'hotter') AS regression FROM d")(lambda spark, sf: E.has_regression(E.diff_traces(*ab(D.trace_events(spark, sf)))))
query("diff_universe", f"WITH {D.TE} SELECT node_id FROM te UNION SELECT 'p' || p_partkey FROM part")(
    lambda spark, sf: D.trace_events(spark, sf).select("node_id").union(D.t(spark, sf, "part").selectExpr("concat('p', p_partkey)")).distinct()
)
H = "SELECT session_id, node_id, CAST(sum(weight) AS BIGINT) AS heat FROM te {} GROUP BY 1, 2"
events_query("heat", E.heat, H.format(""))
events_query("heat_at", lambda e: E.heat(e, 1000), H.format("WHERE idx < 1000"))
events_query("heat_of_node", lambda e: E.heat(e, 2000).where("node_id = 'mod7.py:fn7'"), H.format("WHERE idx < 2000 AND node_id = 'mod7.py:fn7'"))
events_query("heat_sparse", lambda e: E.heat(e, 1003, sparse_k=10), H.format("WHERE idx < 1000 AND idx % 10 = 0"))
events_query("event_counts", lambda e: E.heat(e, weighted=False), "SELECT session_id, node_id, count(*) AS heat FROM te GROUP BY 1, 2")
events_query("heat_timeline", E.heat_timeline, "SELECT session_id, node_id, idx, CAST(sum(weight) OVER (PARTITION BY session_id, node_id ORDER BY idx) AS BIGINT) AS heat FROM te")
events_query("coverage", lambda e: E.coverage(e, 50), "SELECT session_id, count(*) FILTER (f < 50) AS covered FROM (SELECT session_id, node_id, min(idx) AS f FROM te GROUP BY 1, 2) GROUP BY 1")
events_query(
    "coverage_curve", E.coverage_curve,
    "SELECT session_id, bucket, new_nodes, CAST(sum(new_nodes) OVER (PARTITION BY session_id ORDER BY bucket) AS BIGINT) AS covered FROM (SELECT session_id, f // 100 AS bucket, count(*) AS new_nodes FROM (SELECT session_id, node_id, min(idx) AS f FROM te GROUP BY 1, 2) GROUP BY 1, 2)",
)
events_query("top_k", E.top_k, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY heat DESC, node_id) AS rank FROM ({H.format('')})) WHERE rank <= 20")
events_query("windowed_heat", lambda e: E.windowed_heat(e, 1500, 400, ["call"]), "SELECT *, max(heat) OVER (PARTITION BY session_id) AS max_heat FROM (SELECT session_id, node_id, count(*) AS heat FROM te WHERE idx >= 1100 AND idx < 1500 AND event = 'call' GROUP BY 1, 2)")
events_query("sliding_heat", lambda e: E.sliding_heat(e, 500), "SELECT session_id, node_id, idx, count(*) OVER (PARTITION BY session_id, node_id ORDER BY idx RANGE BETWEEN 499 PRECEDING AND CURRENT ROW) AS heat FROM te")
events_query("seek", lambda e: E.seek(e, 100, 5000).select("session_id", "idx", "event", "node_id"), "SELECT session_id, idx, event, node_id FROM te WHERE idx >= 100 AND idx < 1100")
events_query("filter_kinds", lambda e: E.filter_kinds(e, ["return", "exception"]).groupBy("session_id", "event").agg(F.count("*").alias("n")), "SELECT session_id, event, count(*) AS n FROM te WHERE event <> 'call' GROUP BY 1, 2")
events_query("event_kinds", lambda e: e.select("event").distinct(), "SELECT DISTINCT event FROM te")
events_query("limit_captures", lambda e: E.limit_captures(e, 3).select("session_id", "idx", "ret"), "SELECT session_id, idx, CASE WHEN count(ret) OVER (PARTITION BY session_id, node_id ORDER BY idx ROWS UNBOUNDED PRECEDING) <= 3 THEN ret END AS ret FROM te")
events_query("merge_heat", lambda e: E.merge_heat(e, e.where("k < 50").select(F.col("node_id").alias("id")), ["s1", "s2", "s1"]), "SELECT node_id, CAST(sum(weight) AS BIGINT) AS heat, node_id IN (SELECT node_id FROM te WHERE k < 50) AS known FROM te WHERE session_id IN ('s1', 's2') GROUP BY 1")
events_query("frame_label", lambda e: e.select(S.frame_label(F.col("node_id")).alias("label")).groupBy("label").agg(F.count("*").alias("n")), "SELECT split_part(node_id, ':', 2) AS label, count(*) AS n FROM te GROUP BY 1")
events_query("matches_node", lambda e: e.select(F.concat(F.lit("src/"), "node_id").alias("n")).where(S.matches_node(F.col("n"), "mod3.py:fn13")).groupBy("n").agg(F.count("*").alias("c")), "SELECT 'src/' || node_id AS n, count(*) AS c FROM te WHERE node_id = 'mod3.py:fn13' GROUP BY 1")
events_query("matches_method", lambda e: e.select(F.concat(F.lit("a/"), F.replace("node_id", F.lit(":fn"), F.lit(":C.fn"))).alias("n")).where(S.matches_method(F.col("n"), "mod3.py", "fn13")).groupBy("n").agg(F.count("*").alias("c")), "SELECT 'a/mod3.py:C.fn13' AS n, count(*) AS c FROM te WHERE node_id = 'mod3.py:fn13' GROUP BY 1")
events_query("runtime_coverage", lambda e: E.runtime_coverage(e.selectExpr("node_id id").union(e.selectExpr("concat('x', k) id")), e), """, u AS (SELECT node_id AS id FROM te UNION SELECT 'x' || k FROM te), h AS (SELECT node_id AS id, count(*) AS n FROM te GROUP BY 1),
 l AS (SELECT greatest(2, list_sort(list(n))[CAST(floor(count(*) * 0.75) AS INT) + 1]) AS v FROM h) SELECT id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'cold' WHEN n >= (SELECT v FROM l) THEN 'hot' ELSE 'touched' END AS state FROM u LEFT JOIN h USING (id)""")
events_query("diff_vs_static", lambda e: E.diff_vs_static(e.selectExpr("node_id id").union(e.selectExpr("concat('x', k) id")).distinct(), e, 40), ", u AS (SELECT node_id AS id FROM te UNION SELECT 'x' || k FROM te), h AS (SELECT node_id, CAST(sum(weight) AS BIGINT) AS n FROM te WHERE idx < 40 GROUP BY 1) SELECT id AS node_id, CASE WHEN n > 0 THEN 'touched' ELSE 'cold' END AS status, coalesce(n, 0) AS count_a, CAST(0 AS BIGINT) AS count_b, CAST(0 AS BIGINT) AS delta FROM u LEFT JOIN h ON node_id = id")
events_query("last_at_or_before", lambda e: E.as_of(e.select("session_id", "idx"), e.where("event = 'return'").select("session_id", "idx", F.col("event_id").alias("last_id")), ["session_id"], "idx", "last_id"), "SELECT session_id, idx, max(CASE WHEN event = 'return' THEN event_id END) OVER (PARTITION BY session_id ORDER BY idx) AS last_id FROM te")
events_query("segment_runs", lambda e: E.segment_runs(e.select("session_id", "idx", (F.col("event_id") % 37).alias("epoch"))), ", s AS (SELECT session_id, idx, event_id % 37 AS epoch FROM te) SELECT session_id, idx, epoch, CAST(sum(CASE WHEN epoch <= p THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS BIGINT) AS run FROM (SELECT *, lag(epoch) OVER (PARTITION BY session_id ORDER BY idx) AS p FROM s)")
events_query("coverage_deltas", lambda e: E.coverage_deltas(e.where("event = 'call'").groupBy(F.col("node_id").alias("script"), F.col("frame_depth").cast("long").alias("start"), F.expr("idx div 500").alias("poll")).agg(F.max("weight").alias("n"))), ", p AS (SELECT node_id AS script, CAST(frame_depth AS BIGINT) AS start, idx // 500 AS poll, max(weight) AS n FROM te WHERE event = 'call' GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, n - CASE WHEN lag(poll) OVER w = poll - 1 THEN lag(n) OVER w ELSE 0 END AS delta FROM p WINDOW w AS (PARTITION BY script, start ORDER BY poll)) WHERE delta > 0")
events_query("boundaries", FR_.boundaries, "SELECT session_id, idx, lag(idx) OVER w AS prev_idx, lead(idx) OVER w AS next_idx FROM te WHERE event IN ('call', 'return') WINDOW w AS (PARTITION BY session_id ORDER BY idx)")
events_query("firings", lambda e: FR_.firings(e, 5), "SELECT * FROM (SELECT session_id, node_id, idx, row_number() OVER (PARTITION BY session_id, node_id ORDER BY idx) AS nth, count(*) OVER (PARTITION BY session_id, node_id) > 5 AS capped FROM te WHERE event = 'call') WHERE nth <= 5")
events_query("nearest_firing", lambda e: FR_.nearest_firing(e, 500), "SELECT session_id, node_id, coalesce(max(idx) FILTER (idx <= 500), min(idx)) AS idx FROM te WHERE event = 'call' GROUP BY 1, 2")
events_query("entry_block", lambda e: R.fold_entry_block(e.select("node_id", F.col("frame_depth").alias("start_line"), F.col("event_id").alias("ord"), F.expr("weight - 1").alias("n"))), "SELECT * FROM (SELECT node_id, arg_min(weight - 1, CAST(frame_depth AS BIGINT) * 1000000000 + event_id) AS n FROM te GROUP BY 1) WHERE n > 0")
events_query("fold_sum", lambda e: R.fold_sum(e.select("node_id", F.expr("weight - 1").alias("n"))), "SELECT node_id, CAST(sum(weight - 1) AS BIGINT) AS n FROM te GROUP BY 1 HAVING sum(weight - 1) > 0")
events_query("average_rank", lambda e: L.percentile_rank(L.avg_rank(e.select("session_id", "event_id", "weight"), "weight", "session_id"), "weight", "session_id"), "SELECT session_id, event_id, weight, r AS rank, r / (count(*) OVER (PARTITION BY session_id) - 1) AS percentile FROM (SELECT session_id, event_id, weight, rank() OVER (PARTITION BY session_id ORDER BY weight) - 1 + (count(*) OVER (PARTITION BY session_id, weight) - 1) / 2 AS r FROM te)")
events_query("spearman", lambda e: L.spearman(e, "weight", "k", "session_id").select("session_id", F.round("spearman", 6).alias("spearman")), ", r AS (SELECT session_id, rank() OVER (PARTITION BY session_id ORDER BY weight) + (count(*) OVER (PARTITION BY session_id, weight) - 1) / 2 AS a, rank() OVER (PARTITION BY session_id ORDER BY k) + (count(*) OVER (PARTITION BY session_id, k) - 1) / 2 AS b FROM te) SELECT session_id, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
events_query("top_overlap", lambda e: L.top_overlap(e, "weight", "k", "event_id", 200), ", x AS (SELECT event_id FROM te ORDER BY weight DESC, event_id LIMIT 200), y AS (SELECT event_id FROM te ORDER BY k DESC, event_id LIMIT 200) SELECT (SELECT count(*) FROM x JOIN y USING (event_id)) / (SELECT count(*) FROM x) AS overlap")
events_query("targets", lambda e: L.targets(e.selectExpr("session_id graph_id", "node_id id").union(e.selectExpr("session_id", "concat('x', k)")).distinct(), E.heat(e).groupBy("node_id").agg(F.sum("heat").alias("heat"))).select("graph_id", "id", F.round("target", 6).alias("target")), ", u AS (SELECT session_id AS graph_id, node_id AS id FROM te UNION SELECT session_id, 'x' || k FROM te), h AS (SELECT node_id, sum(weight) AS heat FROM te GROUP BY 1), j AS (SELECT graph_id, id, coalesce(heat, 0) AS heat FROM u LEFT JOIN h ON id = node_id) SELECT graph_id, id, round(ln(1 + heat) / ln(1 + max(heat) OVER (PARTITION BY graph_id)), 6) AS target FROM j")
events_query("prediction_status", lambda e: L.prediction_status(e.groupBy(F.col("node_id").alias("id")).agg((F.max("k") / 99).alias("score")), e.groupBy(F.col("node_id").alias("id")).agg(F.sum("weight").alias("heat"))).select("id", "heat", "status"), ", s AS (SELECT node_id AS id, max(k) / 99 AS score FROM te GROUP BY 1), h AS (SELECT node_id AS id, CAST(sum(weight) AS BIGINT) AS heat FROM te GROUP BY 1), j AS (SELECT id, coalesce(heat, 0) AS heat, score FROM s LEFT JOIN h USING (id)), n AS (SELECT *, score / max(score) OVER () AS p, ln(1 + heat) / ln(1 + max(heat) OVER ()) AS a FROM j) SELECT id, heat, CASE WHEN abs(p - a) <= 0.25 THEN 'on-target' WHEN p > a THEN 'over' ELSE 'under' END AS status FROM n")
events_query("sessions_upsert", lambda e: R.save_sessions(e.groupBy(F.col("session_id").alias("id")).agg(F.min("ts_ns").alias("started_ns"), F.count("*").alias("event_count")), e.where("session_id in ('s1', 's2')").groupBy(F.col("session_id").alias("id")).agg(F.max("ts_ns").alias("started_ns"), F.lit(0).cast("long").alias("event_count"))), "SELECT session_id AS id, CASE WHEN session_id IN ('s1', 's2') THEN max(ts_ns) ELSE min(ts_ns) END AS started_ns, CASE WHEN session_id IN ('s1', 's2') THEN 0 ELSE count(*) END AS event_count FROM te GROUP BY 1")

frames_query("frames", lambda e, f: f.select("session_id", "thread_id", "call_idx", "close_idx", "parent_idx", "node_id", "depth", "start_ns", "end_ns", "total_ns", "self_ns", "synthetic"), "SELECT session_id, thread_id, call_idx, close_idx, parent_idx, node_id, depth, start_ns, end_ns, total_ns, self_ns, synthetic FROM fr")
frames_query("stack_at", lambda e, f: FR_.stack_at(f, 1200).select("session_id", "thread_id", "call_idx", "node_id"), "SELECT session_id, thread_id, call_idx, node_id FROM fr WHERE call_idx <= 1200 AND (close_idx IS NULL OR close_idx > 1200)")
frames_query("open_frames", lambda e, f: FR_.open_frames(e, e.where("event = 'exception'").select("session_id", "thread_id", "idx")), "SELECT x.session_id, x.thread_id, x.idx, f.call_idx, f.node_id, row_number() OVER (PARTITION BY x.session_id, x.idx ORDER BY f.call_idx) - 1 AS level FROM te x JOIN fr f ON f.session_id = x.session_id AND f.thread_id = x.thread_id AND f.call_idx <= x.idx AND (f.close_idx IS NULL OR f.close_idx > x.idx) WHERE x.event = 'exception'")
frames_query("active_threads", lambda e, f: FR_.active_threads(f, 1200), "SELECT session_id, count(DISTINCT thread_id) AS threads FROM fr WHERE call_idx <= 1200 AND (close_idx IS NULL OR close_idx > 1200) GROUP BY 1")
frames_query("causal_paths", lambda e, f: FR_.causal_paths(e).withColumn("path", F.array_join("path", ">")), "SELECT session_id, thread_id, call_idx, array_to_string(path, '>') AS path FROM pa", D.PATHS)
frames_query("mark_raised", lambda e, f: FR_.mark_raised(e), ", op AS (SELECT x.session_id, x.thread_id, x.idx, max(f.call_idx) FILTER (f.node_id = x.node_id) AS own, max(f.call_idx) AS top FROM te x JOIN fr f ON f.session_id = x.session_id AND f.thread_id = x.thread_id AND f.call_idx < x.idx AND (f.close_idx IS NULL OR f.close_idx > x.idx) WHERE x.event = 'exception' GROUP BY ALL) SELECT DISTINCT session_id, thread_id, coalesce(own, top) AS call_idx FROM op")
frames_query("tree_stats", lambda e, f: FR_.tree_stats(e, f).withColumn("threads", F.array_join("threads", ",")), ", fi AS (SELECT session_id, thread_id, min(idx) AS f FROM te GROUP BY 1, 2) SELECT s.session_id, (SELECT string_agg(thread_id, ',' ORDER BY f) FROM fi WHERE fi.session_id = s.session_id) AS threads, (SELECT CAST(max(len(path)) AS BIGINT) FROM pa WHERE pa.session_id = s.session_id) AS max_depth, max(ts_ns) - min(ts_ns) AS wall_ns, count(DISTINCT thread_id) AS n_threads, (SELECT count(*) FROM fr WHERE fr.session_id = s.session_id) AS n_frames, (SELECT bool_or(synthetic) FROM fr WHERE fr.session_id = s.session_id) AS had_synthetic, count(*) FILTER (event = 'return') - (SELECT count(*) FROM fr WHERE fr.session_id = s.session_id AND NOT synthetic) AS orphan_returns FROM te s GROUP BY 1", D.PATHS)


def flame_query(name: str, build, sql: str):
    """Over frames with the ids of their paths; every ninth node is an unresolved one, whose id holds a separator of printed paths."""

    def run(spark, sf):
        e = D.trace_events(spark, sf)
        return build(FR_.flame(FR_.build_frames(e.withColumn("node_id", F.when(F.col("k") % 9 == 0, "<unresolved>").otherwise(F.col("node_id"))), ids=True), names=False))

    named = "'mod' || (k % 10) || '.py:fn' || k"
    query(name, f"WITH RECURSIVE {D.PATHS.replace(f'{named} AS node_id', f"CASE WHEN k % 9 = 0 THEN '<unresolved>' ELSE {named} END AS node_id")} {sql}")(run)


FLAME = "SELECT session_id, thread_id, path, count(*) AS n, CAST(sum(total_ns) AS BIGINT) AS total_ns, CAST(sum(self_ns) AS BIGINT) AS self_ns, min(start_ns) AS start_ns, max(end_ns) AS end_ns, bool_or(synthetic) AS synthetic, min(call_idx) AS first_idx, path[:-2] AS parent_path FROM fr JOIN pa USING (session_id, thread_id, call_idx) GROUP BY session_id, thread_id, path"
RANKED = f", fl AS (SELECT *, row_number() OVER (PARTITION BY session_id, thread_id, parent_path ORDER BY total_ns DESC, n DESC, first_idx) AS sibling FROM ({FLAME}))"
printed = lambda df, *names: df.withColumns({c: F.array_join(c, " > ") for c in names})


def flame_named(flame):
    """The names are joined at the end, to a table of the flame."""
    flame = cut(flame)
    out = FR_.named(flame, FR_.trie(flame)).withColumn("parent_path", F.slice("path", F.lit(1), F.size("path") - 1))
    return printed(out, "path", "parent_path").drop("path_id", "parent_path_id", "node_id", "level")


def hot_named(flame):
    flame = cut(flame)
    return printed(FR_.named(FR_.hot_path(flame), FR_.trie(flame)).drop("path_id"), "path")


flame_query("flame", flame_named, f"{RANKED} SELECT * REPLACE (array_to_string(path, ' > ') AS path, array_to_string(parent_path, ' > ') AS parent_path) FROM fl")
flame_query("hot_path", hot_named, f"{RANKED}, hp AS (SELECT session_id, thread_id, path, 1 AS depth FROM fl WHERE len(path) = 1 AND sibling = 1 UNION ALL SELECT fl.session_id, fl.thread_id, fl.path, hp.depth + 1 FROM hp JOIN fl ON fl.session_id = hp.session_id AND fl.thread_id = hp.thread_id AND fl.parent_path = hp.path AND fl.sibling = 1) SELECT session_id, thread_id, array_to_string(path, ' > ') AS path, CAST(depth AS BIGINT) AS depth FROM hp")
frames_query("to_chrome_trace", lambda e, f: R.to_chrome_trace(f).select("session_id", "name", F.round("ts", 3).alias("ts"), F.round("dur", 3).alias("dur"), "tid"), "SELECT session_id, node_id AS name, round((start_ns - min(start_ns) OVER (PARTITION BY session_id)) / 1000, 3) AS ts, round(total_ns / 1000, 3) AS dur, thread_id AS tid FROM fr")

graph_query("count_by_kind", lambda n, e: G_.count_by_kind(n), "SELECT kind, count(*) AS n FROM gn GROUP BY 1")
graph_query("top_in_degree", G_.top_in_degree, "SELECT id, count(ge.target) AS in_degree FROM gn LEFT JOIN ge ON target = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
graph_query("hub_score", G_.hub_score, "SELECT id, CAST(coalesce(sum(d), 0) AS BIGINT) AS score FROM gn LEFT JOIN (SELECT target AS x, 1 AS d FROM ge UNION ALL SELECT source, -1 FROM ge) ON x = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
graph_query("edge_kind_counts", lambda n, e: G_.edge_kind_counts(e), "SELECT count(*) FILTER (kind = 'cross_language_call') AS http, count(*) FILTER (kind = 'cross_language_spawn') AS spawn FROM ge")
graph_query("orphans", G_.orphans, "SELECT id FROM gn WHERE id NOT IN (SELECT target FROM ge WHERE kind <> 'import')")
graph_query("file_fan", G_.file_fan, ", x AS (SELECT a.path AS sp, b.path AS tp FROM ge JOIN gn a ON a.id = source JOIN gn b ON b.id = target WHERE a.path <> b.path) SELECT path, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT sp AS path, 0 AS i, 1 AS o FROM x UNION ALL SELECT tp, 1, 0 FROM x) GROUP BY 1")
graph_query("degree_buckets", lambda n, e: G_.degree_buckets(n, e).select("id", "in_import", "in_call", "in_inherit", "in_cross_language", "in_other", "out_import", "out_call", "out_cross_language"), "SELECT id, " + ", ".join(f"(SELECT count(*) FROM ge WHERE {end} = id AND kind = '{kind}') AS {name}" for name, end, kind in [("in_import", "target", "import"), ("in_call", "target", "call"), ("in_inherit", "target", "inherit"), ("in_cross_language", "target", "cross_language_call"), ("in_other", "target", "?"), ("out_import", "source", "import"), ("out_call", "source", "call"), ("out_cross_language", "source", "cross_language_call")]) + " FROM gn")
graph_query("resolved_edges", lambda n, e: G_.resolved_edges(n.where("kind <> 'file'"), e).groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM ge WHERE source IN (SELECT id FROM gn WHERE kind <> 'file') AND target IN (SELECT id FROM gn WHERE kind <> 'file') GROUP BY 1")
graph_query("visible_nodes", lambda n, e: n.where(S.visible("ring", ("file",), ("cust/*IN*",))).select("id", "name"), "SELECT id, name FROM gn WHERE kind <> 'file' AND NOT regexp_full_match(path, 'cust/.*IN.*') AND (contains(lower(name), 'ring') OR contains(lower(path), 'ring'))")
DUNDER = "starts_with(name, '__') AND ends_with(name, '__') AND length(name) >= 5"
graph_query("name_flags", lambda n, e: n.withColumn("name", F.when(F.col("line") % 5 == 0, F.concat(F.lit("__"), "name", F.lit("__"))).when(F.col("line") % 5 == 1, F.concat(F.lit("_"), "name")).when(F.col("line") % 5 == 2, F.concat(F.lit("test_"), "name")).otherwise(F.col("name"))).withColumn("path", F.when(F.col("line") % 7 == 0, F.concat(F.lit("tests/"), "path")).otherwise(F.col("path"))).select("id", *S.name_flags(F.col("name"), F.col("path"))),
            f", x AS (SELECT id, CASE line % 5 WHEN 0 THEN '__' || name || '__' WHEN 1 THEN '_' || name WHEN 2 THEN 'test_' || name ELSE name END AS name, CASE WHEN line % 7 = 0 THEN 'tests/' || path ELSE path END AS path FROM gn) SELECT id, ({DUNDER}) AS is_dunder, (starts_with(name, '_') AND NOT ({DUNDER})) AS is_private, (starts_with(name, 'test_') OR list_contains(string_split(path, '/'), 'tests') OR starts_with(split_part(path, '/', -1), 'test_')) AS is_test, CAST(len(string_split(path, '/')) AS BIGINT) AS path_depth FROM x")
graph_query("edge_diff", lambda n, e: G_.edge_diff(e.where("edge_ord % 3 <> 0").select("source", "target", "kind", "line"), e.where("edge_ord % 5 <> 0").select("source", "target", "kind", "line")), "SELECT * FROM (SELECT source, target, kind, line, count(*) FILTER (edge_ord % 5 <> 0) - count(*) FILTER (edge_ord % 3 <> 0) AS change FROM ge GROUP BY 1, 2, 3, 4) WHERE change <> 0")
graph_query("node_diff", lambda n, e: G_.node_diff(n.where("line % 7 <> 0"), n.where("line % 5 <> 0").withColumn("line", F.when(F.col("line") == 12, 13).otherwise(F.col("line")))), "SELECT id, change FROM (SELECT id, CASE WHEN line % 7 = 0 AND line % 5 <> 0 THEN 'added' WHEN line % 5 = 0 AND line % 7 <> 0 THEN 'removed' WHEN line = 12 THEN 'changed' END AS change FROM gn) WHERE change IS NOT NULL")
graph_query("edge_evidence", G_.evidence_lines, "SELECT id, direction, other, kind, path, line, count(*) AS n FROM (SELECT ge.source AS id, 'out' AS direction, target AS other, ge.kind, path, ge.line FROM ge LEFT JOIN gn ON gn.id = source UNION ALL SELECT target, 'in', source, ge.kind, path, ge.line FROM ge LEFT JOIN gn ON gn.id = source) GROUP BY ALL")
graph_query("call_sites", lambda n, e: G_.call_sites(e), "SELECT source, target, arg_min(line, edge_ord) AS line FROM ge WHERE kind IN ('call', 'cross_language_call') GROUP BY 1, 2")
graph_query("standardize", lambda n, e: L.standardize(n, ["line"]).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")), "SELECT 'line' AS feature, round(avg(line), 6) AS mean, round(stddev_pop(line), 6) AS std FROM gn")
graph_query("clamp_middle", lambda n, e: n.select("id", S.clamp_middle(F.col("path"), 12).alias("short")), "SELECT id, CASE WHEN length(path) <= 12 THEN path ELSE left(path, 4) || '...' || right(path, 5) END AS short FROM gn")
graph_query("redact", lambda n, e: n.select("id", S.redact(F.concat(F.lit("Api-"), F.when(F.col("line") % 2 == 0, "Key").otherwise("x")), F.col("name")).alias("value")), "SELECT id, CASE WHEN line % 2 = 0 THEN '<redacted>' ELSE name END AS value FROM gn")
graph_query("posix_path", lambda n, e: n.select("id", S.posix_path(F.concat(F.lit("/r/x/../"), "path", F.lit("\\.\\b")), "/r").alias("p")), "SELECT id, path || '/b' AS p FROM gn")
graph_query("dedupe_nodes", lambda n, e: G_.dedupe_nodes(n.select(F.col("path").alias("id"), "kind", "line", F.xxhash64("id").alias("node_ord")).withColumn("node_ord", F.col("line"))).select("id", "line"), "SELECT path AS id, min(line) AS line FROM gn GROUP BY 1")


def _merged(spark, sf):
    """Three languages over all nodes and edges: customers call their nation's route, suppliers serve it, and both start their nation's file."""
    nodes, edges = D.graph_nodes(spark, sf), D.graph_edges(spark, sf)
    cust, supp = D.t(spark, sf, "customer"), D.t(spark, sf, "supplier")
    none = "cast(null as string)"
    web = cust.selectExpr("'http_client' kind", "concat('c', c_custkey) node_id", "concat('/N/', c_nationkey, '/list/') path", f"{none} command", "c_nationkey line", "c_custkey ord")
    serve = supp.selectExpr("'http_server' kind", "concat('s', s_suppkey) node_id", "concat('/n/', s_nationkey, '/list') path", f"{none} command", "1 line", "s_suppkey ord")
    start = supp.selectExpr("'subprocess' kind", "concat('s', s_suppkey) node_id", f"{none} path", "concat('./n', s_nationkey, ' -v') command", "2 line", "s_suppkey ord")
    of = lambda kinds, side: (nodes.where(F.col("kind").isin(kinds)), edges.where(F.substring("source", 1, 1).isin(side)))
    return G_.merge_graphs([("typescript", *of(["method"], ["c"]), web), ("go", *of(["class", "function"], ["s", "p"]), serve.union(start)), ("python", *of(["file"], ["n", "r"]), None)])


query("merge_graphs", f"WITH {D.G} SELECT 'go+python+typescript' AS graph, CASE WHEN kind = 'method' THEN 'typescript' WHEN kind = 'file' THEN 'python' ELSE 'go' END AS language, count(*) AS n FROM gn GROUP BY 2")(lambda spark, sf: _merged(spark, sf).counts)
query("merged_edges", f"""WITH {D.G}, last AS (SELECT s_nationkey AS k, max(s_suppkey) AS s FROM supplier GROUP BY 1),
 al AS (SELECT source, target, kind, line, CASE source[1] WHEN 'c' THEN 'typescript' WHEN 'n' THEN 'python' ELSE 'go' END AS language FROM ge
  UNION ALL SELECT 'c' || c_custkey, 's' || s, 'cross_language_call', c_nationkey, NULL FROM customer JOIN last ON k = c_nationkey
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'cross_language_spawn', 2, NULL FROM supplier) SELECT source, target, kind, line, language, count(*) AS n FROM al GROUP BY ALL""")(
    lambda spark, sf: _merged(spark, sf).edges.groupBy("source", "target", "kind", "line", "language").agg(F.count("*").alias("n"))
)
graph_query("snapshot_diff", lambda n, e: R.snapshot_diff(n.where("line % 3 > 0").select(F.col("id").alias("key"), F.sha2("name", 256).alias("hash")), n.where("line % 4 > 0").select(F.col("id").alias("key"), F.when(F.col("line") == 1, "x").otherwise(F.sha2("name", 256)).alias("hash"))), "SELECT key, change FROM (SELECT id AS key, CASE WHEN line % 3 = 0 AND line % 4 > 0 THEN 'added' WHEN line % 4 = 0 AND line % 3 > 0 THEN 'removed' WHEN line = 1 THEN 'changed' END AS change FROM gn) WHERE change IS NOT NULL")
query("asof_resolve", "WITH p AS (SELECT l_orderkey, l_linenumber, p_brand AS path, CAST(l_quantity AS INT) AS line FROM lineitem JOIN part ON p_partkey = l_partkey), d AS (SELECT p_brand AS path, p_size AS line, max(p_partkey) AS node FROM part GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, p.path, p.line, node FROM p ASOF LEFT JOIN d ON p.path = d.path AND p.line >= d.line")(
    lambda spark, sf: E.as_of(D.t(spark, sf, "lineitem").join(D.t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey", "l_linenumber", "p_brand path", "cast(l_quantity as int) line"), D.t(spark, sf, "part").selectExpr("p_brand path", "p_size line", "p_partkey node"), ["path"], "line", "node")
)
query("implements", """WITH m AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 200 AS m FROM lineitem), i AS (SELECT DISTINCT c_custkey AS i, unnest([c_custkey % 200, c_custkey * 7 % 200, c_nationkey]) AS m FROM customer),
 n AS (SELECT i, count(*) AS need FROM i GROUP BY 1) SELECT 's' || s AS struct, 'i' || i AS interface FROM m JOIN i USING (m) JOIN n USING (i) GROUP BY s, i HAVING count(*) = max(need)""")(
    lambda spark, sf: G_.implements_edges(D.t(spark, sf, "lineitem").selectExpr("concat('s', l_suppkey) id", "'struct' kind", "l_partkey % 200 method").union(D.t(spark, sf, "customer").selectExpr("concat('i', c_custkey)", "'interface'", "explode(array(c_custkey % 200, c_custkey * 7 % 200, c_nationkey))")))
)
query("route_edges", "WITH h AS (SELECT page_id, regexp_replace(rtrim(lower(trim(regexp_extract(url, '://[^/]+(/[^?#]*)', 1))), '/'), '\\{[^}]+\\}|:[a-zA-Z_][a-zA-Z0-9_]*|<[a-zA-Z_][a-zA-Z0-9_]*>', '{param}', 'g') AS route FROM pages), s AS (SELECT route, 'p' || arg_max(page_id, page_id) AS target FROM h WHERE page_id % 2 = 0 AND len(list_filter(string_split(route, '/'), lambda x: x <> '')) >= 2 GROUP BY 1) SELECT DISTINCT 'p' || page_id AS source, target, route FROM h JOIN s USING (route) WHERE page_id % 2 = 1 AND 'p' || page_id <> target")(
    lambda spark, sf: G_.route_edges(D.t(spark, sf, "pages").select(F.when(F.col("page_id") % 2 == 0, "http_server").otherwise("http_client").alias("kind"), F.concat(F.lit("p"), "page_id").alias("node_id"), F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1).alias("path"), F.col("page_id").alias("ord")))
)
query("spawn_edges", "WITH f AS (SELECT 'a/' || p_brand || '/f' || p_size AS id FROM part), s AS (SELECT 'c' || c_custkey AS source, 'f' || c_nationkey AS arg FROM customer) SELECT source, min(id) AS target FROM s JOIN f ON ends_with(id, '/' || arg) GROUP BY 1")(
    lambda spark, sf: G_.spawn_edges(D.t(spark, sf, "customer").selectExpr("'subprocess' kind", "concat('c', c_custkey) node_id", "concat('./f', c_nationkey, ' --x') command"), D.t(spark, sf, "part").selectExpr("concat('a/', p_brand, '/f', p_size) id"))
)
query("uniquify_ids", "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_size > 25, p_partkey) = 1 THEN p_name ELSE p_name || '.' || p_size END AS unique_id FROM part")(
    lambda spark, sf: G_.uniquify_ids(D.t(spark, sf, "part").selectExpr("p_partkey", "p_name id", "p_size line", "p_size > 25 is_overload", "p_partkey node_ord")).select("p_partkey", "unique_id")
)
query("surprise_hotspots", f"WITH {D.TE}, s AS (SELECT node_id AS id, CAST(max(k) AS DOUBLE) AS score, CAST(sum(weight) AS BIGINT) AS heat FROM te GROUP BY 1) SELECT * FROM (SELECT 'under' AS list, row_number() OVER (ORDER BY heat DESC, id) AS rank, id, CAST(heat AS DOUBLE) AS value FROM s WHERE score < 50 UNION ALL SELECT 'predicted', row_number() OVER (ORDER BY score DESC, id), id, score FROM s) WHERE rank <= 10")(
    lambda spark, sf: L.surprise_hotspots(D.trace_events(spark, sf).groupBy(F.col("node_id").alias("id")).agg(F.max("k").cast("double").alias("score"), F.sum("weight").alias("heat")).withColumn("status", F.when(F.col("score") < 50, "under").otherwise("over")))
)
query("line_coverage", "SELECT 'src/f' || (l_partkey % 9) || '.go' AS path, l_linenumber AS start_line, l_linenumber + 2 AS end_line, CAST(l_quantity AS BIGINT) AS n, l_orderkey AS ord FROM lineitem WHERE l_orderkey % 5 <> 0")(
    lambda spark, sf: R.parse_line_coverage(D.t(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 5 == 0, "mode: count").otherwise(F.concat(F.lit("src/f"), F.col("l_partkey") % 9, F.lit(".go:"), "l_linenumber", F.lit(".1,"), F.col("l_linenumber") + 2, F.lit(".9 3 "), F.col("l_quantity").cast("long"))).alias("value"), F.col("l_orderkey").alias("ord")))
)
query("offset_line", "SELECT doc_id, length(left(text, 500)) - length(replace(left(text, 500), chr(10), '')) + 1 AS line FROM documents")(
    lambda spark, sf: D.t(spark, sf, "documents").select("doc_id", S.offset_line(F.col("text"), 500).alias("line"))
)
query("bfs_depth", f"""WITH RECURSIVE {D.CG}, xe AS (SELECT DISTINCT source, target FROM ce WHERE source <> target), en AS (SELECT id FROM cn WHERE kind = 'file' OR id NOT IN (SELECT target FROM xe)),
 b AS (SELECT id, 0 AS d FROM en UNION SELECT target, d + 1 FROM b JOIN xe ON source = id WHERE d < 60) SELECT cn.id, CAST(coalesce(min(d), -1) AS BIGINT) AS depth, min(d) IS NOT NULL AS reachable FROM cn LEFT JOIN b USING (id) GROUP BY 1""")(lambda spark, sf: G_.bfs_depth(*D.call_graph(spark, sf)))
SCC = "s AS (SELECT cn.id, greatest(cn.id, coalesce((SELECT max(x.b) FROM rc x WHERE x.a = cn.id AND EXISTS (SELECT 1 FROM rc y WHERE y.a = x.b AND y.b = cn.id)), cn.id)) AS scc FROM cn)"
query("scc", f"WITH RECURSIVE {D.CG}, {SCC} SELECT id, scc, count(*) OVER (PARTITION BY scc) AS size FROM s")(lambda spark, sf: G_.scc(*D.call_graph(spark, sf)))
query("cycles", f"WITH RECURSIVE {D.CG}, {SCC}, m AS (SELECT scc, string_agg(id, '|' ORDER BY id) AS id, count(*) AS size FROM s GROUP BY 1), k AS (SELECT a.scc, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ce JOIN s a ON a.id = source JOIN s b ON b.id = target WHERE a.scc = b.scc GROUP BY 1) SELECT id, size, replace(id, '|', ' ') AS nodes, kinds FROM m JOIN k USING (scc) ORDER BY size DESC, id LIMIT 100")(lambda spark, sf: G_.cycles(*D.call_graph(spark, sf)).withColumn("nodes", F.array_join("nodes", " ")))




@query("graph_signature", f"WITH {D.G} SELECT (SELECT count(*) FROM gn) AS n_nodes, (SELECT count(*) FROM ge) AS n_edges, true AS same_when_reordered, true AS other_when_doubled, true AS other_without_one")
def _signature(spark, sf):
    """Counts, and that the sums are the same for any order and others for other multiplicities: the hashes themselves have no SQL."""
    n, e = D.graph_nodes(spark, sf), D.graph_edges(spark, sf)
    one = G_.graph_signature(n, e)
    moved = G_.graph_signature(n.orderBy(F.desc("id")), e.repartition(7, "line")).select(F.struct("node_sum", "edge_sum").alias("moved"))
    doubled = G_.graph_signature(n, e.union(e)).select(F.col("edge_sum").alias("doubled"))
    less = G_.graph_signature(n.where("id <> 'n3'"), e).select(F.col("node_sum").alias("less"))
    all_ = one.join(F.broadcast(moved)).join(F.broadcast(doubled)).join(F.broadcast(less))  # one row each
    return all_.select("n_nodes", "n_edges", (F.struct("node_sum", "edge_sum") == F.col("moved")).alias("same_when_reordered"), (F.col("edge_sum") != F.col("doubled")).alias("other_when_doubled"), (F.col("node_sum") != F.col("less")).alias("other_without_one"))


def _features_sql() -> str:
    """Every column of ``features`` over the given graph: its calls go from suppliers to parts, its imports to nations, so no two nodes reach each other."""
    deg = ", ".join(f"count(*) FILTER (side = '{s}' AND b = '{b}') AS {s}_{b}" for s in ("in", "out") for b in L.EDGE_BUCKETS)
    logs = ", ".join(f"ln(1 + {s}_{b}) AS log1p_{s}_{b}" for s in ("in", "out") for b in L.EDGE_BUCKETS)
    kinds = ", ".join(f"CASE WHEN kind = '{k}' THEN 1.0 ELSE 0.0 END AS kind_{k}" for k in L.KINDS)
    cols = ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in L.FEATURES)
    return f"""WITH {D.G}, b AS (SELECT source, target, CASE WHEN kind IN ('import', 'call', 'inherit', 'implements') THEN kind WHEN kind LIKE 'cross_language%' THEN 'cross_language' ELSE 'other' END AS b FROM ge),
 sd AS (SELECT target AS id, 'in' AS side, b FROM b UNION ALL SELECT source, 'out', b FROM b), dg AS (SELECT gn.id, {deg} FROM gn LEFT JOIN sd USING (id) GROUP BY 1),
 tt AS (SELECT *, {" + ".join(f"in_{b}" for b in L.EDGE_BUCKETS)} AS i, {" + ".join(f"out_{b}" for b in L.EDGE_BUCKETS)} AS o FROM dg),
 pc AS (SELECT *, (rank() OVER (ORDER BY i) - 1 + (count(*) OVER (PARTITION BY i) - 1) / 2) / (count(*) OVER () - 1) AS in_degree_percentile,
   (rank() OVER (ORDER BY o) - 1 + (count(*) OVER (PARTITION BY o) - 1) / 2) / (count(*) OVER () - 1) AS out_degree_percentile FROM tt),
 px AS (SELECT x.path AS sp, y.path AS tp FROM ge JOIN gn x ON x.id = source JOIN gn y ON y.id = target WHERE x.path <> y.path),
 fi AS (SELECT tp AS path, count(*) AS fan_in FROM px GROUP BY 1), fo AS (SELECT sp AS path, count(*) AS fan_out FROM px GROUP BY 1),
 ie AS (SELECT DISTINCT source, target FROM b WHERE b IN ('call', 'import') AND source <> target),
 en AS (SELECT id FROM gn WHERE kind = 'file' OR id NOT IN (SELECT target FROM ie)),
 bd AS (SELECT id, min(d) AS depth FROM (SELECT id, 0 AS d FROM en UNION ALL SELECT target, 1 FROM ie WHERE source IN (SELECT id FROM en)) GROUP BY 1),
 al AS (SELECT id, ln(1 + i) AS log1p_in_degree, ln(1 + o) AS log1p_out_degree, {logs}, {kinds}, CASE WHEN kind IN ({", ".join(f"'{k}'" for k in L.KINDS)}) THEN 0 ELSE 1 END AS kind_other, 0 AS in_cycle, ln(2) AS log1p_scc_size,
   in_degree_percentile, out_degree_percentile, ln(1 + coalesce(fan_in, 0)) AS log1p_file_fan_in, ln(1 + coalesce(fan_out, 0)) AS log1p_file_fan_out, ln(1 + coalesce(depth, 0)) AS log1p_bfs_depth,
   CASE WHEN depth IS NULL THEN 0 ELSE 1 END AS reachable, ln(1 + length(name)) AS log1p_name_len, 0 AS is_dunder, 0 AS is_private, 0 AS is_test, CASE WHEN line > 40 THEN 1 ELSE 0 END AS is_async,
   CASE WHEN line < 5 THEN 1 ELSE 0 END AS has_decorators, ln(1 + len(string_split(path, '/'))) AS log1p_path_depth, ln(1 + line) AS log1p_line
   FROM gn JOIN pc USING (id) LEFT JOIN fi USING (path) LEFT JOIN fo USING (path) LEFT JOIN bd USING (id)) SELECT id, {cols} FROM al"""


@query("features", _features_sql())
def _features(spark, sf):
    f = L.features(D.graph_nodes(spark, sf), D.graph_edges(spark, sf))
    return f.select("id", *[F.round(c, 9).alias(c) for c in L.FEATURES])
