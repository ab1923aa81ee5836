"""Trace readers on malformed lines, and reading back what was written."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import events as E
from tracegraph.operators.resolve import resolve_symbols
from tracegraph.sources import traces as R

def said(node, ts, **more):
    return json.dumps({"event": "call", "node_id": node, "ts_ns": ts, "thread_id": 7, "frame_depth": 1, **more})


GOOD = [
    (said("core/run.py:main", 10), 1),
    (said("core/run.py:Loop.step", 20, metadata={"count": 40, "note": "hot"}), 40),
    (said("core/run.py:Loop.step", 30, metadata={"count": "12"}), 1),  # a string is no count
    (said("lib/io.go:Read", 40, metadata={"count": -5}), 1),
    (said("lib/io.go:Read", 50, metadata={"count": 1.5e3}), 1500),
    (said("lib/io.go:Read", 60, metadata={"count": [9]}, values={"ret": "'x'"}) + "\r", 1),
]
BROKEN = ['{"event": "call", "node_id": "cut off', said("a", 1)[:-2], "{}}"]


def write(lines):
    path = tempfile.mkdtemp() + "/t.jsonl"
    with open(path, "w", newline="") as f:
        f.write("\n".join(lines))
    return path


def test_read_trace(spark):
    lines = [GOOD[0][0], "  ", BROKEN[0], GOOD[1][0], GOOD[2][0], BROKEN[1], "", GOOD[3][0], GOOD[4][0], BROKEN[2], GOOD[5][0]]
    e = R.read_trace(spark, write(lines))
    got = [(r["idx"], r["node_id"], r["weight"]) for r in e.orderBy("idx").collect()]
    names = [json.loads(g)["node_id"] for g, _ in GOOD]
    assert got == [(i, names[k], GOOD[k][1]) for k, i in enumerate([0, 2, 3, 5, 6, 8])]
    heat = {"core/run.py:main": 1, "core/run.py:Loop.step": 41, "lib/io.go:Read": 1502}
    assert {r["node_id"]: r["heat"] for r in E.heat(e).collect()} == heat
    with pytest.raises(Exception, match="malformed line 1"):
        R.read_trace(spark, write(lines), "FAILFAST").collect()
    assert R.read_trace(spark, write([g for g, _ in GOOD]), "FAILFAST").count() == 6


def test_lines_that_are_no_events(spark):
    odd = ["[1, 2]", '"text"', "17", "null", said(None, 1), said(5, 2), said(["x"], 3), said("", 4), said("kept", 5)]
    got = R.read_trace(spark, write(odd), "DROPMALFORMED").collect()
    assert sorted((r["idx"], r["node_id"]) for r in got) == [(7, ""), (8, "kept")]
    assert [r["node_id"] for r in E.heat(R.read_trace(spark, write(odd[:4] + odd[7:]))).collect()] == ["kept"]


def test_count_that_is_no_number(spark):
    lines = [said("a", 1, metadata={"count": float("nan")}), said("a", 2, metadata={"count": 0}), said("b", 3, metadata={"count": float("inf")}), said("b", 4, metadata={"count": 3})]
    e = R.read_trace(spark, write(lines))
    assert [(r["idx"], r["node_id"], r["weight"]) for r in e.orderBy("idx").collect()] == [(0, "a", 1), (1, "a", 1), (2, "b", 1), (3, "b", 3)]


def test_round_trip(spark):
    e = R.read_trace(spark, write([g for g, _ in GOOD]))
    out = tempfile.mkdtemp() + "/out"
    R.write_trace(e, out)
    again = R.read_trace(spark, out)
    cols = ["event", "node_id", "ts_ns", "weight"]
    assert sorted(map(tuple, again.select(cols).collect())) == sorted(map(tuple, e.select(cols).collect()))


def test_read_graph(spark):
    graph = {"version": "1", "nodes": [{"id": "a.py", "kind": "file", "name": "a", "path": "a.py"}, {"id": "a.py:f", "kind": "function", "name": "f", "path": "a.py", "line": 3}],
             "edges": [{"source": "a.py:f", "target": "g", "kind": "call", "metadata": {"line": 4, "resolved": False}}] * 2}
    graph["edges"].append({"source": "a.py", "target": "b", "kind": "import", "metadata": {"names": ["g"], "alias": "h"}})
    nodes, edges = R.read_graph(spark, write([json.dumps(graph, indent=1)]))
    assert [tuple(r)[1:] for r in nodes.orderBy("node_ord").collect()] == [(0, "a.py", "file", "a", "a.py", None, None), (1, "a.py:f", "function", "f", "a.py", 3, None)]
    assert [tuple(r)[1:] for r in edges.orderBy("edge_ord").collect()] == [(0, "a.py:f", "g", "call", 4, False, None, None, None, None), (1, "a.py:f", "g", "call", 4, False, None, None, None, None), (2, "a.py", "b", "import", None, None, ["g"], "h", None, None)]
    assert resolve_symbols(nodes, edges).where("reason = 'not_found'").count() == 2


def test_write_graph(spark):
    graph = {"nodes": [{"id": "b", "kind": "file"}, {"id": "a", "kind": "method", "name": "f", "path": "x.py", "line": 2, "metadata": {"receiver": "T"}}],
             "edges": [{"source": "a", "target": "b", "kind": "import", "metadata": {"names": ["p", "q"], "aliases": {"p": "z"}, "resolved": True}}, {"source": "b", "target": "a", "kind": "call", "metadata": {"line": 9}}]}
    nodes, edges = R.read_graph(spark, write([json.dumps(graph)]))
    out = tempfile.mkdtemp() + "/g"
    R.write_graph(nodes, edges, out)
    again = R.read_graph(spark, out)
    for x, y in zip(again, (nodes, edges)):
        assert [r.asDict(True) | {"graph_id": 0} for r in x.orderBy(x.columns[1]).collect()] == [r.asDict(True) | {"graph_id": 0} for r in y.orderBy(y.columns[1]).collect()]


def test_graphs_as_lines_are_few_files(spark):
    """As many graphs as there are: a file a task, ids and contents as written, and what files of their own give."""
    n = 300
    nodes = spark.range(n * 3).selectExpr(f"concat('g ', id % {n}) graph_id", "id node_ord", "concat('n\\n\"', id) id", "'function' kind", "'f' name", "cast(null as string) path", "cast(id as int) line", "if(id % 2 = 0, 'T', null) receiver")
    edges = spark.range(n * 5 - 1, -1, -1).where(f"id % {n} > 0").selectExpr(f"concat('g ', id % {n}) graph_id", "id edge_ord", "'a' source", "concat('b\\r', id) target", "'call' kind", "cast(id as int) line", "id % 3 = 0 resolved", "if(id % 4 = 0, array('p', 'q'), null) names", "cast(null as string) alias", "cast(null as string) default_name", "if(id % 5 = 0, map('a', 'z'), null) aliases")
    out = tempfile.mkdtemp() + "/g"
    R.write_graph(nodes, edges, out, lines=True)
    assert len([f for f in os.listdir(out) if f.startswith("part-")]) <= 8
    for got, put in zip(R.read_graph(spark, out, lines=True), (nodes, edges)):
        rows = [r.asDict(True) for r in put.orderBy(put.columns[1]).collect()]
        seen = {}
        for r in rows:  # ordinals are counted from 0 in each document
            r[put.columns[1]] = seen[r["graph_id"]] = seen.get(r["graph_id"], -1) + 1
        key = lambda r: (r["graph_id"], r[put.columns[1]])  # noqa: B023, E731
        assert sorted((r.asDict(True) for r in got.collect()), key=key) == sorted(rows, key=key)
    few = tempfile.mkdtemp() + "/g"
    R.write_graph(nodes.where("graph_id < 'g 12'"), edges.where("graph_id < 'g 12'"), few)
    for got, lines in zip(R.read_graph(spark, few), R.read_graph(spark, out, lines=True)):
        content = lambda df: sorted(map(repr, df.drop("graph_id").collect()))
        assert content(got) == content(lines.where("graph_id < 'g 12'"))
    with pytest.raises(ValueError):
        R.read_graph(spark, out, 100, lines=True)


def test_graphs_as_lines_take_little_disk(spark, monkeypatch):
    """Lines are gzipped; of the query, which deals numbers by supplier, no JSON is shuffled."""
    from pyspark.sql import DataFrameWriter

    from tracegraph.plans import registry, sourced  # noqa: F401  (it registers the query)

    written, whole = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, *a, **b: (written.append((self._df, path)), whole(self, path, *a, **b))[1])
    out = registry.Q["graph_files"](spark, "/root/testdata/sf0.001")
    [(docs, path)] = written
    plan = spark._jvm.PythonSQLUtils.explainString(docs._jdf.queryExecution(), "simple")
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") == 2 and "Exchange hashpartitioning(l_suppkey" in plan
    folder = path.removeprefix("file://")
    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-")]
    size = docs.selectExpr("sum(octet_length(value)) n").first().n
    assert all(f.endswith(".gz") for f in files) and sum(map(os.path.getsize, files)) * 4 < size
    assert out.selectExpr("sum(n) n").first().n > spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_get_session(spark):
    from tracegraph.sources.files import get_session

    s = spark.createDataFrame([("a", 1), ("b", 2)], "id string, started_ns long")
    assert [r.started_ns for r in get_session(s, "b").collect()] == [2] and get_session(s, "c").count() == 0


def test_redacted_arguments(spark):
    from tracegraph.functions import scalars as S

    args = [("x", "1", None, None), ("API-Key", "abc", False, True), ("user_password", None, None, False), (None, "v", True, None)]
    row = spark.createDataFrame([(args,), (None,)], "args array<struct<name:string,repr:string,redacted:boolean,truncated:boolean>>").select(S.redact_args(F.col("args")).alias("a")).collect()
    assert [tuple(a) for a in row[0].a] == [("x", "1", False, None), ("API-Key", "<redacted>", True, True), ("user_password", "<redacted>", True, False), (None, "v", True, None)] and row[1].a is None
    cut = spark.createDataFrame([("abcdefghij",), ("abc",), (None,)], "t string").select(S.clamp_middle(F.col("t"), 8).alias("c"), S.is_clamped(F.col("t"), 8).alias("f")).collect()
    assert [tuple(r) for r in cut] == [("ab...hij", True), ("abc", False), (None, False)]
