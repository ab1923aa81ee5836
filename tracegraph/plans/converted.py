"""Queries over profiles, series, phases and text patterns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hints import find_all
from ..operators import series as SR
from ..sources import profiles as P
from . import derived as D
from .registry import events_query, frames_query, query

frames_query(
    "to_speedscope", lambda e, f: P.to_speedscope(f)[1],
    ", nm AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY name) - 1 AS frame FROM (SELECT DISTINCT session_id, node_id AS name FROM fr)), z AS (SELECT session_id, min(start_ns) AS z FROM fr GROUP BY 1), oc AS (SELECT *, 'O' AS type, call_idx AS a, 1 AS b, 0 AS c, start_ns AS ns FROM fr UNION ALL SELECT *, 'C', coalesce(close_idx, 9223372036854775807), 0, -call_idx, end_ns FROM fr) SELECT oc.session_id, thread_id, row_number() OVER (PARTITION BY oc.session_id, thread_id ORDER BY a, b, c) - 1 AS pos, type, frame, ns - z AS at FROM oc JOIN nm ON nm.session_id = oc.session_id AND name = node_id JOIN z ON z.session_id = oc.session_id",
)


def _samples(spark, sf):
    """Each session as a profile: an event samples its number's node in a binary tree of numbers, every seventh of them unnamed."""
    e = D.trace_events(spark, sf).withColumn("id", F.col("k").cast("long") + 1)
    tree = e.select(F.col("session_id").alias("doc"), "id").distinct().selectExpr("doc", "id", "id div 2 parent", "if(id % 7 = 0, null, concat('n', id)) node_id")
    samples = e.selectExpr("session_id doc", "idx pos", "id", "weight delta", "cast(0 as bigint) start_us", "cast(0 as bigint) end_us")
    return P.events_from_samples(samples, tree).select("session_id", "event", "node_id", "ts_ns", "frame_depth")


query("events_from_samples", f"""WITH RECURSIVE {D.TE}, tr AS (SELECT DISTINCT session_id AS s, CAST(k + 1 AS BIGINT) AS id, CAST((k + 1) // 2 AS BIGINT) AS up FROM te),
 an AS (SELECT s, id, id AS a FROM tr UNION SELECT an.s, an.id, tr.up FROM an JOIN tr ON tr.s = an.s AND tr.id = an.a JOIN tr t2 ON t2.s = tr.s AND t2.id = tr.up),
 nd AS (SELECT s, id, a, row_number() OVER (PARTITION BY s, id ORDER BY a) - 1 AS d FROM an WHERE a % 7 > 0),
 sm AS (SELECT session_id AS s, idx, CAST(k + 1 AS BIGINT) AS id, CAST(coalesce(sum(weight) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ts FROM te
   UNION ALL SELECT session_id, max(idx) + 1, NULL, CAST(sum(weight) AS BIGINT) FROM te GROUP BY 1),
 pr AS (SELECT *, lag(id) OVER (PARTITION BY s ORDER BY idx) AS was FROM sm)
 SELECT pr.s AS session_id, 'call' AS event, 'n' || a AS node_id, ts * 1000 AS ts_ns, CAST(d AS INT) AS frame_depth FROM pr JOIN nd ON nd.s = pr.s AND nd.id = pr.id WHERE NOT EXISTS (SELECT 1 FROM nd o WHERE o.s = pr.s AND o.id = pr.was AND o.a = nd.a)
 UNION ALL SELECT pr.s, 'return', 'n' || a, ts * 1000, CAST(d AS INT) FROM pr JOIN nd ON nd.s = pr.s AND nd.id = pr.was WHERE NOT EXISTS (SELECT 1 FROM nd o WHERE o.s = pr.s AND o.id = pr.id AND o.a = nd.a)""")(_samples)  # fmt: skip

_PHASES = {
    "step": "mod1.py:fn1", "evaluate": "mod2.py:fn2", "forward": "mod3.py:fn3", "backward": "mod4.py:fn4", "reset": "mod5.py:fn5",
    "layer_forward": "mod6.py:fn66", "layer_backward": "mod7.py:fn77", "loss": "mod8.py:fn8", "loss_grad": "mod9.py:fn9", "update": "mod0.py:fn10",
}
events_query(
    "phase_segments", lambda e: SR.phase_segments(e, 9, _PHASES),
    """, mk AS (SELECT session_id, k, idx, (SELECT min(x.idx) FROM te x WHERE x.session_id = m.session_id AND x.thread_id = m.thread_id AND x.idx > m.idx AND x.frame_depth <= m.frame_depth) AS shut FROM te m WHERE event = 'call' AND k IN (2, 3, 4)),
 ev AS (SELECT session_id, idx, shut FROM mk WHERE k = 2), fw AS (SELECT session_id, idx, shut FROM mk WHERE k = 3), bw AS (SELECT session_id, idx, shut FROM mk WHERE k = 4),
 r AS (SELECT t.session_id, t.idx, t.event, t.k, CASE WHEN ev.shut IS NULL OR ev.shut > t.idx THEN ev.idx END AS e, CASE WHEN fw.shut IS NULL OR fw.shut > t.idx THEN fw.idx END AS f, CASE WHEN bw.shut IS NULL OR bw.shut > t.idx THEN bw.idx END AS b
   FROM te t ASOF LEFT JOIN ev ON ev.session_id = t.session_id AND t.idx > ev.idx ASOF LEFT JOIN fw ON fw.session_id = t.session_id AND t.idx > fw.idx ASOF LEFT JOIN bw ON bw.session_id = t.session_id AND t.idx > bw.idx
   WHERE (t.event = 'return' AND t.k = 1) OR (t.event = 'call' AND t.k IN (5, 66, 77, 8, 9, 10)))
 SELECT session_id, idx, CASE k WHEN 1 THEN 'idle' WHEN 5 THEN 'reset' WHEN 66 THEN CASE WHEN e IS NULL THEN 'forward-train' ELSE 'forward-eval' END WHEN 77 THEN 'backward' WHEN 8 THEN 'loss' WHEN 9 THEN 'loss-grad' ELSE 'update' END AS phase,
  CAST(CASE k WHEN 66 THEN row_number() OVER (PARTITION BY session_id, k, f ORDER BY idx) - 1 WHEN 77 THEN 9 - row_number() OVER (PARTITION BY session_id, k, b ORDER BY idx) ELSE -1 END AS INT) AS token
 FROM r WHERE (k <> 66 OR f IS NOT NULL) AND (k <> 77 OR b IS NOT NULL)""",
)
events_query(
    "metric_series", lambda e: SR.metric_series(e.withColumns({"ret": F.expr("concat('(', event_id % 50, ', ', if(event_id % 9 = 0, 'inf', cast(weight as string)), ', ', k, if(event_id % 8 = 0, ', 1)', ')'))"), "ret_truncated": F.col("event_id") % 5 == 0}), "mod3.py:fn43"),
    ", p AS (SELECT * FROM te WHERE event = 'return' AND k = 43 AND event_id % 5 > 0 AND event_id % 8 > 0 AND node_id = 'mod3.py:fn43') SELECT session_id, idx, event_id % 50 AS epoch, CAST(weight AS DOUBLE) AS loss, CAST(k AS DOUBLE) AS accuracy, (SELECT count(*) FROM p q WHERE q.session_id = p.session_id AND event_id % 9 = 0) AS dropped FROM p WHERE event_id % 9 > 0",
)
query("find_all", """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line FROM pages)
 SELECT page_id, CAST(line AS INT) AS line, found, count(*) AS n FROM (SELECT page_id, line, unnest(regexp_extract_all(t, 'href="([^"\\n]*)"', 1)) AS found FROM l) GROUP BY ALL""")(
    lambda spark, sf: find_all(D.t(spark, sf, "pages").selectExpr("page_id path", "html text"), [("link", 'href="([^"\n]*)"')]).groupBy(F.col("path").alias("page_id"), "line", "found").agg(F.count("*").alias("n"))
)
