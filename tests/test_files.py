"""Source files, messages, registries, sessions and recent history on small inputs."""

import fnmatch
import os
import re
import tempfile

import pytest

from tracegraph import extend
from tracegraph.functions import messages as M
from tracegraph.sources import files as S
from tracegraph.streaming import live


@pytest.mark.parametrize("glob", ["*.py", "a?b", "x[ab]c*", "[!a]b", "a.b", "[]x]", "node_modules/*", "[", "a[", "[a-c]z"])
def test_glob(glob):
    for name in ["a.py", "d/e.py", "axb", "xac", "xbcd", "xcc", "bb", "ab", "aXb", "a.b", "]", "x", "node_modules/q/r", "[", "a[", "bz", "dz"]:
        assert bool(re.match(S.glob_pattern(glob), name)) == fnmatch.fnmatchcase(name, glob), (glob, name)


def tree(files):
    root = tempfile.mkdtemp(prefix="spark-files-")
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}") or root, exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    return root


def test_sources(spark):
    a = S.read_sources(spark, tree({"m.py": "1", "p/q r.py": "x\ny", "p/skip_me.py": "2", "gen/z.py": "3", "n.txt": "4", "e.py": ""}), (".py",), ("skip_*", "gen/*"))
    assert sorted((r.path, r.text) for r in a.collect()) == [("m.py", "1"), ("p/q r.py", "x\ny")]  # no empty files
    b = S.read_sources(spark, tree({"m.py": "1", "p/q r.py": "changed", "new.py": "5"}), (".py",))
    assert sorted(tuple(r) for r in S.changed_files(a, b).collect()) == [("new.py", "added"), ("p/q r.py", "changed")]
    compute = lambda f: f.selectExpr("path", "hash", "length(text) n")
    seen = []
    again = S.reuse_partials(b, compute(a), lambda f: seen.extend(sorted(r.path for r in f.collect())) or compute(f))
    assert seen == ["new.py", "p/q r.py"] and sorted((r.path, r.n) for r in again.collect()) == [("m.py", 1), ("new.py", 1), ("p/q r.py", 7)]


def test_corpus_and_sessions(spark):
    files = spark.createDataFrame([("c/b.graph.json",), ("c/b.trace.jsonl",), ("c/a.trace.jsonl",), ("c/a.graph.json",), ("c/x.txt",)], "path string")
    assert [tuple(r) for r in S.pair_corpus(files).collect()] == [("a", "c/a.graph.json", "c/a.trace.jsonl"), ("b", "c/b.graph.json", "c/b.trace.jsonl")]
    with pytest.raises(Exception, match="no twin: a"):
        S.pair_corpus(files.where("path <> 'c/a.graph.json'")).collect()
    root = tree({"t.jsonl": '{"event":"call"}\n\nbad\n'})
    one, two = S.register_trace(spark, root + "/t.jsonl", "python"), S.register_trace(spark, root + "/t.jsonl")
    assert one.first().event_count == 2 and one.first().id == two.first().id
    s = spark.createDataFrame([("b", 5), ("a", 5), ("c", None), ("d", 9)], "id string, started_ns long")
    assert [r.id for r in S.list_sessions(s).collect()] == ["d", "a", "b", "c"]


def test_envelopes(spark):
    rows = ['{"id":"1","type":"ping","payload":{"a":1}}', '{"id":"1","type":"other","payload":{}}', '{"id":1,"type":"ping","payload":{}}', '{"id":"1","type":"ping"}', '{"id":"1","type":"ping","payload":{},"x":1}', "[1]", "{", None, '{"id":"1","type":"ping","payload":[]}']
    got = M.decode_envelopes(spark.createDataFrame([(v,) for v in rows], "value string"), ["ping"]).collect()
    assert [(r.id, r.payload, r.error) for r in got] == [("1", '{"a":1}', None), *[(None, None, "invalid envelope")] * 4, *[(None, None, "invalid JSON")] * 2, (None, None, "invalid envelope")]


def test_scores(spark):
    g = [("a", '{"predicted_heat":{"model_version":2,"scores":[{"node_id":"x","score":0.5},{"node_id":"","score":9},{"node_id":"y","score":"1"},{"node_id":"x","score":0.25},{"score":1},{"node_id":"z","score":0}]}}'),
         ("b", '{"predicted_heat":{"scores":[{"node_id":"x","score":0}]}}'), ("c", "{}"), ("d", None), ("e", '{"predicted_heat":{"model_version":"1","scores":[{"node_id":"x","score":1}]}}')]
    got = M.parse_scores(spark.createDataFrame(g, "graph_id string, metadata string"))
    assert sorted((r.graph_id, r.model_version, r.node_id, r.score, r.max_score) for r in got.collect()) == [("a", 2.0, "x", 0.25, 0.5), ("a", 2.0, "z", 0.0, 0.5), ("e", 0.0, "x", 1.0, 1.0)]


def test_registries(spark):
    extend.register_kind("node", " Trait ")
    extend.register_analysis("Edges", lambda n, e: e.groupBy().count())
    for bad in [lambda: extend.register_kind("node", "trait"), lambda: extend.register_analysis("edges ", None), lambda: extend.canonical("a\nb"), lambda: extend.canonical("  ")]:
        with pytest.raises(ValueError):
            bad()
    assert "trait" in [r.kind for r in extend.kinds(spark, "node").collect()]
    n, e = spark.createDataFrame([("a", "f"), ("b", "f")], "id string, kind string"), spark.createDataFrame([("a", "b", "call")], "source string, target string, kind string")
    cache, runs = tempfile.mkdtemp(), []
    extend.register_analysis("Counted", lambda n, e: runs.append(1) or e.groupBy().count())
    assert [extend.analyse("counted", x, y, cache).first()[0] for x, y in ((n, e), (n.orderBy("id"), e), (n, e.union(e)), (n, e))] == [1, 1, 2, 1]
    assert len(runs) == 2 and extend.analyse("edges", n, e).first()[0] == 1
    extend.register_source("table", lambda s, p: s.range(int(p)))
    assert extend.read(spark, "table", "3").count() == 3


def test_recent(spark):
    rows = spark.createDataFrame([("s", i, i * 1_000_000_000) for i in range(10)] + [("t", 0, 9_000_000_000)], "session_id string, idx long, received_ns long")
    assert sorted((r.session_id, r.idx) for r in live.recent(rows, 9_000_000_000, 5, 3).collect()) == [("s", 7), ("s", 8), ("s", 9), ("t", 0)]
    assert live.recent(rows, 9_000_000_000, 5).count() == 7


def drain(spark, parts, schema, build, write):
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/p{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    write(build(source)).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()


def test_stream_recent_and_sessions(spark):
    folder = tempfile.mkdtemp(prefix="spark-recent-") + "/r"
    drain(spark, [[("s", i)] for i in range(4)], "session_id string, idx long", lambda d: d, lambda d: live.stream_recent(d, folder, 3600, 3))
    assert sorted(r.idx for r in live.latest_recent(spark, folder).collect()) == [1, 2, 3]
    m = lambda seq, kind, sid=None, t=0: ("c", seq, kind, sid, t)
    first = [m(0, "trace_event", t=1), m(1, "trace_session_start", "a"), m(2, "trace_event", t=5), m(3, "trace_event", t=9)]
    second = [m(4, "trace_session_start", "b"), m(5, "trace_session_end"), m(6, "trace_event", t=11), m(7, "trace_session_start", "d"), m(8, "trace_event", t=12), m(9, "trace_session_end")]
    rows = []
    drain(spark, [first, second], "connection string, seq long, type string, session_id string, ts_ns long", live.stream_sessions,
          lambda d: d.writeStream.foreachBatch(lambda df, n: rows.extend(tuple(r) for r in df.collect())))
    assert rows == [("c", "a", 5, 9, 2), ("c", "d", 12, 12, 1)]
