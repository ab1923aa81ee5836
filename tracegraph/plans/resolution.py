"""Queries that resolve names, locations and frames over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as RS
from . import derived as D
from .registry import query

MODULE_PATH = "concat('pk', {0} % 5, '/m', {0} % 20, '.py')"


def module_graph(spark, sf):
    """Parts as functions and methods of 20 files, customers as their imports, line items as calls by name."""
    path = MODULE_PATH.format("p_partkey")
    part = D.t(spark, sf, "part")
    defs = part.selectExpr(f"concat({path}, ':f', p_size, '.', p_partkey) id", "if(p_partkey % 3 > 0, 'function', 'method') kind", "concat('f', p_size) name", f"{path} path", "p_partkey node_ord")
    files = part.selectExpr(f"{path} id", "'file' kind", f"{path} name", f"{path} path", "cast(-1 as bigint) node_ord").distinct()
    imports = D.t(spark, sf, "customer").selectExpr(
        MODULE_PATH.format("c_custkey") + " source", "concat('..pk', (c_custkey + 1) % 5, '.m', (c_custkey + 1) % 20) target", "'import' kind", "cast(null as boolean) resolved", "c_custkey edge_ord",
        "if(c_custkey % 3 = 0, array(concat('f', c_nationkey)), array(concat('f', c_nationkey), concat('f', c_nationkey + 25))) names", "concat('g', c_nationkey) alias",
    )
    name = "case l_linenumber when 1 then concat('f', l_partkey % 60) when 2 then concat('g', l_suppkey % 25) when 3 then 'len' when 4 then 'self.x' when 5 then '<dynamic>' when 6 then 'zz.f1' else concat('f', l_suppkey % 50) end"
    calls = D.t(spark, sf, "lineitem").selectExpr(
        "concat(" + MODULE_PATH.format("l_partkey") + ", ':f')", name, "'call'", "false", "l_orderkey * 10 + l_linenumber", "cast(null as array<string>)", "cast(null as string)"
    )
    return defs.union(files), imports.union(calls)


_P = "'pk' || ({0} % 5) || '/m' || ({0} % 20) || '.py'"
MODULE_SQL = f"""WITH np AS (SELECT {_P.format("p_partkey")} AS path, 'f' || p_size AS name, p_partkey AS ord, p_partkey % 3 > 0 AS exported FROM part),
 n AS (SELECT *, path || ':' || name || '.' || ord AS id FROM np),
 own AS (SELECT path, name, arg_max(id, ord) AS id FROM n GROUP BY 1, 2), ex AS (SELECT path, name, arg_max(id, ord) AS id FROM n WHERE exported GROUP BY 1, 2),
 i0 AS (SELECT {_P.format("c_custkey")} AS file, {_P.format("(c_custkey + 1)")} AS module, c_custkey AS ord, 'f' || c_nationkey AS o1, 'f' || (c_nationkey + 25) AS o2, 'g' || c_nationkey AS a FROM customer),
 i AS (SELECT file, module, CASE WHEN ord % 3 = 0 THEN a ELSE o1 END AS key, o1 AS original, ord * 2 AS ord FROM i0 UNION ALL SELECT file, module, o2, o2, ord * 2 + 1 FROM i0 WHERE ord % 3 > 0),
 b AS (SELECT file, key, arg_max(module, ord) AS module, arg_max(original, ord) AS original FROM i GROUP BY 1, 2),
 c AS (SELECT {_P.format("l_partkey")} AS file, CASE l_linenumber WHEN 1 THEN 'f' || (l_partkey % 60) WHEN 2 THEN 'g' || (l_suppkey % 25) WHEN 3 THEN 'len' WHEN 4 THEN 'self.x' WHEN 5 THEN '<dynamic>' WHEN 6 THEN 'zz.f1' ELSE 'f' || (l_suppkey % 50) END AS name FROM lineitem),
 r AS (SELECT c.file, c.name, coalesce(own.id, ex.id) AS found FROM c LEFT JOIN own ON own.path = c.file AND own.name = c.name LEFT JOIN b ON b.file = c.file AND b.key = c.name LEFT JOIN ex ON ex.path = b.module AND ex.name = b.original)
 SELECT file || ':f' AS source, coalesce(found, name) AS target, CASE WHEN found IS NOT NULL THEN NULL WHEN name = 'len' THEN 'builtin' WHEN name = 'self.x' THEN NULL WHEN name = '<dynamic>' THEN 'dynamic' WHEN name = 'zz.f1' THEN 'not_imported' ELSE 'not_found' END AS reason,
 found IS NOT NULL AS followed, count(*) AS n FROM r GROUP BY ALL"""


@query("resolve_symbols", MODULE_SQL)
def _symbols(spark, sf):
    nodes, edges = module_graph(spark, sf)
    out = RS.resolve_symbols(nodes, edges).where("kind = 'call'")
    return out.groupBy("source", "target", "reason", F.col("resolved").isNull().alias("followed")).agg(F.count("*").alias("n"))


def _declared(spark, sf):
    part = D.t(spark, sf, "part")
    defs = part.selectExpr("concat('p', p_partkey) id", "'function' kind", "concat('f', p_partkey % 97) name", "concat('src/', p_brand, '.go') path", "p_partkey node_ord", "if(p_partkey % 2 = 0, p_size, null) line")
    files = part.where("p_brand not like '%5'").selectExpr("concat('src/', p_brand, '.go') id", "'file' kind", "p_brand name", "concat('src/', p_brand, '.go') path", "cast(-1 as bigint) node_ord", "cast(null as int) line").distinct()
    probes = D.t(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey", "l_linenumber", "concat(if(l_linenumber = 7, 'elsewhere', 'ex.com/m'), '/src/./', p_brand, '.go') path", "cast(l_quantity as int) line",
        "case l_linenumber when 1 then '' when 2 then '(gc)' else concat('C.f', l_partkey % 97) end function",
    )
    return defs.union(files), probes


_DECLARED = """p AS (SELECT l_orderkey, l_linenumber, 'src/' || p_brand || '.go' AS loc, CAST(l_quantity AS INT) AS line, l_partkey % 97 AS f FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 7),
 d AS (SELECT 'src/' || p_brand || '.go' AS loc, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS line, 'p' || p_partkey AS id, p_partkey % 97 AS f, p_brand NOT LIKE '%5' AS file FROM part),
 ex AS (SELECT loc, line, min(id) AS id FROM d WHERE line IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), fi AS (SELECT DISTINCT loc FROM d WHERE file)"""

query("resolve_locations", f"""WITH {_DECLARED}, dl AS (SELECT loc, line, max(id) AS id FROM d WHERE line IS NOT NULL GROUP BY 1, 2), a AS (SELECT p.*, dl.id AS enclosing FROM p ASOF LEFT JOIN dl ON p.loc = dl.loc AND p.line >= dl.line)
 SELECT l_orderkey, l_linenumber, coalesce(ex.id, enclosing, fi.loc, '<unresolved>') AS node_id FROM a LEFT JOIN ex ON ex.loc = a.loc AND ex.line = a.line LEFT JOIN fi ON fi.loc = a.loc""")(
    lambda spark, sf: (lambda n, p: RS.resolve_locations(p, n, "ex.com/m").select("l_orderkey", "l_linenumber", "node_id"))(*_declared(spark, sf))
)
query("resolve_frames", f"""WITH {_DECLARED}, nm AS (SELECT loc, f, min(id) AS id FROM d GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
 SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN coalesce(fi.loc, '<unresolved>') ELSE coalesce(ex.id, nm.id, fi.loc, '<unresolved>') END AS node_id FROM p
 LEFT JOIN ex ON ex.loc = p.loc AND ex.line = p.line LEFT JOIN nm ON nm.loc = p.loc AND nm.f = p.f LEFT JOIN fi ON fi.loc = p.loc WHERE l_linenumber <> 2""")(
    lambda spark, sf: (lambda n, p: RS.resolve_frames(p, n, "ex.com/m").select("l_orderkey", "l_linenumber", "node_id"))(*_declared(spark, sf))
)
