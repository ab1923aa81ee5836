"""Streams give what the batch operators give on the same rows."""

import json
import tempfile
import time

from pyspark.sql import functions as F

from tracegraph.operators import events as E
from tracegraph.operators import frames as FR
from tracegraph.operators import series as SR
from tracegraph.plans import derived as D
from tracegraph.streaming import live

SF = "/root/testdata/sf0.001"


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_heat_and_frames(spark):
    e = D.trace_events(spark, SF).cache()
    path = tempfile.mkdtemp() + "/t"
    for lo, hi in ((0, 100), (100, 250), (250, 10_000)):
        e.where((F.col("idx") >= lo) & (F.col("idx") < hi)).coalesce(1).write.mode("append").parquet(path)
    run(live.stream_heat(live.stream_events(spark, path, e.schema)), "complete", "live_heat")
    key = lambda df: sorted(map(tuple, df.select("session_id", "node_id", "heat").collect()))
    assert key(spark.table("live_heat")) == key(E.heat(e))
    cols = ["session_id", "thread_id", "call_idx", "close_idx", "parent_idx", "node_id", "depth", "start_ns", "end_ns", "total_ns", "self_ns", "synthetic"]
    norm = lambda df: sorted(tuple(-1 if v is None else v for v in r) for r in df.select(cols).collect())
    ends = e.select("session_id").distinct().withColumns({"event": F.lit("end"), "idx": F.lit(1 << 40)})
    path = tempfile.mkdtemp() + "/t"
    for lo, hi in ((0, 100), (100, 250), (250, 10_000)):  # batches in order of their index
        e.where((F.col("idx") >= lo) & (F.col("idx") < hi)).coalesce(1).write.mode("append").parquet(path)
    e.limit(0).unionByName(ends, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    run(live.stream_frames(live.stream_events(spark, path, e.schema)), "append", "live_frames")
    assert norm(spark.table("live_frames")) == norm(FR.build_frames(e))  # open ones too


def test_frames_with_late_times_and_idle_sessions(spark):
    schema = "session_id string, idx long, event string, node_id string, ts_ns long, thread_id long, frame_depth int"
    path = tempfile.mkdtemp() + "/t"
    first = [("s", 0, "call", "a", 100, 1, 0), ("s", 1, "call", "b", 50, 1, 1), ("t", 0, "call", "x", 1, 5, 0)]
    second = [("s", 2, "call", "c", 400, 1, 2), ("s", 3, "exception", "c", 20, 1, 3), ("s", 4, "end", None, None, None, None)]
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    run(live.stream_frames(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), "append", "late_frames")
    got = {r.node_id: (r.start_ns, r.end_ns, r.close_idx, r.synthetic) for r in spark.table("late_frames").collect()}
    assert got == {"a": (100, 400, None, True), "b": (50, 400, None, True), "c": (400, 400, None, True)}  # x stays open
    q = live.stream_frames(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), idle_ms=1).writeStream.outputMode("append").format("memory").queryName("idle_frames")
    q = q.trigger(processingTime="300 milliseconds").start()
    for _ in range(100):
        if "x" in {r.node_id for r in spark.table("idle_frames").collect()}:
            break
        time.sleep(0.3)
    q.stop()
    assert {r.node_id: r.end_ns for r in spark.table("idle_frames").collect()}["x"] == 1


def test_messages(spark):
    folder = tempfile.mkdtemp()
    say = lambda kind, **p: json.dumps({"id": "1", "type": kind, "payload": p})
    event = lambda kind, node, ts, depth, **more: say("trace_event", event=kind, node_id=node, ts_ns=ts, thread_id=1, frame_depth=depth, **more)
    lines = [say("trace_session_start", session_id="one", started_ns=1, source="live"), event("call", "a", 1, 0), "no json", event("call", "b", 2, 1, metadata={"count": 4}), say("ping"), event("return", "b", 5, 1), say("trace_session_end", session_id="one", ended_ns=9, event_count=3)]
    with open(folder + "/c1.jsonl", "w") as f:
        f.write("\n".join(lines))
    run(live.stream_sessions(live.stream_messages(spark, folder)), "append", "live_sessions")
    assert [(r.session_id, r.started_ns, r.ended_ns, r.event_count) for r in spark.table("live_sessions").collect()] == [("one", 1, 5, 3)]
    run(live.stream_frames(live.events_of(live.stream_messages(spark, folder))), "append", "message_frames")
    assert sorted((r.node_id, r.start_ns, r.end_ns, r.synthetic) for r in spark.table("message_frames").collect()) == [("a", 1, 5, True), ("b", 2, 5, False)]
    run(live.stream_heat(live.events_of(live.stream_messages(spark, folder)).where("event <> 'end'")), "complete", "message_heat")
    assert {r.node_id: r.heat for r in spark.table("message_heat").collect()} == {"a": 1, "b": 5}


def test_metric_points_carry_their_run(spark):
    schema = "session_id string, idx long, event string, node_id string, ret string, ret_truncated boolean"
    epochs = [1, 2, 3, 1, 2, 2, 5, 4, 6, 1]
    rows = [("s", i, "return", "metrics.py:record_epoch", f"({e}, 0.5, {'nan' if i == 2 else 1})", False) for i, e in enumerate(epochs)] + [("t", 0, "return", "metrics.py:record_epoch", "(7, 1, 1)", None)]
    path = tempfile.mkdtemp() + "/t"
    for part in (rows[:4], rows[4:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    run(live.stream_metric_series(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), "append", "live_points")
    batch = E.segment_runs(SR.metric_series(spark.createDataFrame(rows, schema)))
    cols = ["session_id", "idx", "epoch", "loss", "accuracy", "run"]
    assert sorted(map(tuple, spark.table("live_points").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_graph_follows_its_files(spark):
    schema = "path string, hash string, text string, ord long"
    batches = [
        [("a", "1", "x y", 0), ("b", "1", "y", 0), ("c", "1", "z", 0)],
        [("a", "2", "x", 1), ("c", None, None, 1), ("d", "1", "q", 1), ("d", "2", "q r", 2)],
        [("a", "2", "x", 3), ("b", "1", "y", 3)],
    ]
    path = tempfile.mkdtemp() + "/t"
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    seen = {}

    def extract(files):
        return files.select("path", "hash", F.explode(F.split("text", " ")).alias("word"))

    def write(result, changes, n):
        seen[n] = ({r.word: r["count"] for r in result.collect()}, {r.key: r.change for r in changes.collect()})

    q = live.stream_graph(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), extract, lambda rows: rows.groupBy("word").count(), write).start()
    q.processAllAvailable()
    q.stop()
    assert seen[0] == ({"x": 1, "y": 2, "z": 1}, {"a": "added", "b": "added", "c": "added"})
    assert seen[1] == ({"x": 1, "y": 1, "q": 1, "r": 1}, {"a": "changed", "c": "removed", "d": "added"})
    assert seen[2] == (seen[1][0], {})


def test_poll_deltas(spark):
    path = tempfile.mkdtemp() + "/p"
    polls = spark.createDataFrame([("a", 0, 0, 3), ("a", 0, 1, 5), ("a", 0, 3, 6), ("b", 1, 1, 2), ("b", 1, 2, 2)], "script string, start long, poll long, n long")
    polls.coalesce(1).write.parquet(path)
    run(live.stream_coverage_deltas(spark.readStream.schema(polls.schema).parquet(path)), "append", "deltas")
    want = sorted(map(tuple, E.coverage_deltas(polls).select("script", "start", "poll", "delta").collect()))
    assert sorted(map(tuple, spark.table("deltas").collect())) == want == [("a", 0, 0, 3), ("a", 0, 1, 2), ("a", 0, 3, 6), ("b", 1, 1, 2)]


def test_live_diff(spark):
    import pytest

    e = D.trace_events(spark, SF)
    a, b = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    path = tempfile.mkdtemp() + "/t"
    for part in range(2):
        b.where(F.col("idx") % 2 == part).coalesce(1).write.mode("append").parquet(path)
    base = E.heat(a).groupBy("node_id").agg(F.sum("heat").alias("heat"))
    seen = {}
    key = lambda df: sorted(map(tuple, df.select("node_id", "status", "count_a", "count_b").collect()))
    q = live.stream_diff(live.stream_events(spark, path, b.schema), base, lambda df, n: seen.update({n: key(df)})).start()
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 2 and seen[1] == key(E.diff_traces(a, b))
    with pytest.raises(ValueError):
        live.stream_diff(e, base.limit(0), None)


EVENTS = "session_id string, idx long, event string, node_id string, ts_ns long, thread_id long, frame_depth int"
COLS = ["session_id", "thread_id", "call_idx", "close_idx", "parent_idx", "node_id", "depth", "start_ns", "end_ns", "total_ns", "self_ns", "synthetic"]


def add(spark, folder, part, k):
    spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{folder}/in/p{k}")


def test_frames_after_a_restart_equal_the_batch(spark):
    """Threads of their own, null ones and odd rows among them, over a query that is stopped and started again between any two batches."""
    import random

    rng = random.Random(5)
    rows = []
    for s in ("s", "t", None):
        at = {1: 0, 2: 0, None: 0}
        for i in range(240):
            t = rng.choice([1, 1, 2, None])
            event = rng.choice(["call", "call", "return", "exception", "line", None])
            at[t] = max(0, min(9, at[t] + (event == "call") - (event == "return") * rng.choice([0, 1, 1, 2])))
            rows.append((s, i, event, rng.choice(["a", "b", None]), 10 * i, t, None if rng.random() < 0.02 else at[t]))
    folder = tempfile.mkdtemp()
    seen = []
    for k in range(4):
        part = [r for r in rows if r[1] // 60 == k] + [("s", None, "call", "no index", 1, 1, 0)]
        if k == 3:
            part += [(s, 1000, "end", None, None, None, None) for s in ("s", "t", None)]
        add(spark, folder, part, k)
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        q = live.stream_frames(source).writeStream.option("checkpointLocation", f"{folder}/ck").foreachBatch(lambda df, n: seen.extend(df.select(COLS).collect()))
        q.trigger(availableNow=True).start().awaitTermination()
    norm = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    assert norm(seen) == norm(FR.build_frames(spark.createDataFrame(rows, EVENTS)).select(COLS).collect())
    assert len({r.thread_id for r in seen}) == 3 and any(r.close_idx is None for r in seen)
    add(spark, folder, [("s", 2000, "call", "again", 5, 1, 0), ("s", 2001, "return", "again", 9, 1, 0)], 9)  # an ended session may go on
    q = live.stream_frames(spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(f"{folder}/in")).writeStream.option("checkpointLocation", f"{folder}/ck")
    q.foreachBatch(lambda df, n: seen.extend(df.select(COLS).collect())).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r)[2:4] for r in seen if r.node_id == "again"] == [(2000, 2001)]


def test_sessions_with_odd_rows(spark):
    m = lambda seq, kind, sid=None, t=None: ("c", seq, kind, sid, t)
    parts = [[m(0, "trace_session_start", "a"), m(1, "trace_event"), m(None, "trace_event", t=3)], [m(2, "trace_event", t=9), m(3, "trace_event"), m(4, "trace_session_start", None), m(5, "trace_event", t=1)],
             [m(6, "trace_session_start", "b"), m(7, "trace_event"), m(8, "trace_session_end")]]
    path = tempfile.mkdtemp() + "/m"
    schema = "connection string, seq long, type string, session_id string, ts_ns long"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    run(live.stream_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), "append", "odd_sessions")
    assert sorted(tuple(r) for r in spark.table("odd_sessions").collect()) == [("c", "a", 9, 9, 3), ("c", "b", None, None, 1)]


def test_recent_history_writes_each_row_once(spark):
    folder, src = tempfile.mkdtemp() + "/r", tempfile.mkdtemp() + "/t"
    for k in range(4):
        spark.createDataFrame([("s", 10 * k + i) for i in range(5)] + [("t", k)], "session_id string, idx long").coalesce(1).write.mode("append").parquet(src)
    q = live.stream_recent(spark.readStream.schema("session_id string, idx long").option("maxFilesPerTrigger", 1).parquet(src), folder, 3600, 7).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(folder).count() == 24 and spark.read.parquet(folder).select("batch").distinct().count() == 4
    assert sorted((r.session_id, r.idx) for r in live.latest_recent(spark, folder).collect()) == [("s", k) for k in (23, 24, 30, 31, 32, 33, 34)] + [("t", k) for k in range(4)]
    later = time.time_ns() + 3 * 3600 * 10**9
    assert live.latest_recent(spark, folder, later).count() == 0
    assert live.latest_recent(spark, folder + "x") is None


def test_a_graph_goes_on_after_its_query_broke_off(spark):
    """A batch whose write fails ends the query; started again, it is run again from the tables before it, and the graph is that of all files."""
    import pytest

    schema = "path string, hash string, text string"
    folder = tempfile.mkdtemp()
    seen, fail = {}, {1}

    def write(result, changes, n):
        if n in fail:
            fail.discard(n)
            raise RuntimeError("lost")
        seen[n] = ({r.word: r["count"] for r in result.collect()}, {r.key: r.change for r in changes.collect()})

    def go():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        extract = lambda files: files.select("path", "hash", F.explode(F.split("text", " ")).alias("word"))
        q = live.stream_graph(source, extract, lambda rows: rows.groupBy("word").count(), write, f"{folder}/graph").option("checkpointLocation", f"{folder}/ck")
        q.trigger(availableNow=True).start().awaitTermination()

    parts = [[("a", "1", "x y"), ("b", "1", "y")], [("a", "2", "x"), ("c", "1", "z")], [("b", None, None)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/p{k}")
        if k == 1:
            with pytest.raises(Exception, match="lost"):
                go()
            continue
        go()
    assert seen == {0: ({"x": 1, "y": 2}, {"a": "added", "b": "added"}), 1: ({"x": 1, "y": 1, "z": 1}, {"a": "changed", "c": "added"}), 2: ({"x": 1, "z": 1}, {"b": "removed"})}


def test_heat_and_diff_are_kept_by_what_moves(spark):
    from tracegraph.storage import KeyedTable

    schema = "session_id string, idx long, node_id string, weight long"
    folder = tempfile.mkdtemp()
    parts = [[("s", 0, "a", 2), ("s", 1, "b", 1)], [("s", 2, "a", 1), ("t", 0, "c", 5)], [("s", 3, "b", 1)]]
    moved = {}
    base = spark.createDataFrame([("a", 3), ("b", 9), ("z", 1)], "node_id string, heat long")
    for k, part in enumerate(parts):  # a new query for each part
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/p{k}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        live.keep_heat(source, f"{folder}/heat").option("checkpointLocation", f"{folder}/ck1").trigger(availableNow=True).start().awaitTermination()
        q = live.stream_diff(source, base, lambda df, n: None, f"{folder}/diff", lambda df, n: moved.update({n: {r.node_id: r.status for r in df.collect()}}))
        q.option("checkpointLocation", f"{folder}/ck2").trigger(availableNow=True).start().awaitTermination()
    heat = KeyedTable(spark, f"{folder}/heat", ["session_id", "node_id"]).read()
    assert {(r.session_id, r.node_id): r.heat for r in heat.collect()} == {("s", "a"): 3, ("s", "b"): 2, ("t", "c"): 5}
    diff = KeyedTable(spark, f"{folder}/diff", ["node_id"]).read()
    assert {r.node_id: (r.status, r.count_a, r.count_b) for r in diff.collect()} == {"a": ("same", 3, 3), "b": ("colder", 9, 2), "c": ("new", 0, 5), "z": ("gone", 1, 0)}
    assert moved == {0: {"a": "colder", "b": "colder"}, 1: {"a": "same", "c": "new"}, 2: {"b": "colder"}}


def test_lines_of_spans_are_those_of_the_file():
    import io
    import random

    from tracegraph.sources import logs

    rng = random.Random(1)
    for _ in range(200):
        data = b"".join(bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(rng.randrange(8))) + rng.choice([b"", b"tail"])
        f = io.BytesIO(data)
        start = done = 0
        got = []
        while True:
            end = logs.whole_lines(f, done, min(len(data), done + rng.randrange(1, 30)), len(data))
            if end == done:
                break
            step = rng.randrange(1, 20)
            for a in range(done, end, step):
                got += logs.lines_of(f, logs.Span("", a, min(end, a + step), a == done))
            done = end
        want = []
        for line in data.split(b"\n")[:-1]:
            want.append((start, line))
            start += len(line) + 1
        assert got == want and done == start


def test_growing_logs_are_followed_over_a_restart(spark):
    folder = tempfile.mkdtemp()
    say = lambda k: json.dumps({"id": str(k), "type": "trace_event", "payload": {"event": "call", "node_id": f"n{k}", "ts_ns": k, "thread_id": 1, "frame_depth": 0}})
    seen, batches = [], []

    def take(df, n):
        rows = df.collect()
        batches.append(len(rows))
        seen.extend((r.connection.rsplit("/", 1)[1], r.seq, r.node_id) for r in rows)

    def start(most=1 << 20):
        q = live.follow_messages(spark, f"{folder}/logs", most).writeStream.option("checkpointLocation", f"{folder}/ck").foreachBatch(take).start()
        q.processAllAvailable()
        return q

    def append(name, text):
        import os

        os.makedirs(f"{folder}/logs", exist_ok=True)
        with open(f"{folder}/logs/{name}", "a") as f:
            f.write(text)

    append("a", "".join(say(k) + "\n" for k in range(20)) + say(20)[:30])
    q = start()
    assert sorted(x[2] for x in seen) == sorted(f"n{k}" for k in range(20))  # the last line is not whole yet
    append("a", say(20)[30:] + "\n")
    append("b", "no json\n" + say(50) + "\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(x[2] for x in seen[20:]) == ["n20", "n50"]
    append("a", "".join(say(k) + "\n" for k in range(21, 40)))
    batches.clear()
    q = start(500)  # a few lines a batch
    q.stop()
    assert sorted(x[2] for x in seen[22:]) == sorted(f"n{k}" for k in range(21, 40)) and len(batches) > 3
    a = sorted(x[1:] for x in seen if x[0] == "a")
    assert [n for _, n in a] == [f"n{k}" for k in range(40)] and len(set(seen)) == len(seen) == 41
