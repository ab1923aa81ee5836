"""Converters against small replays in plain Python, and round trips."""

import json
import random

from tracegraph.operators import frames as FR
from tracegraph.sources import profiles as P


def docs(spark, *values):
    return spark.createDataFrame([(f"d{i}", v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "doc string, value string")


def test_region_coverage(spark):
    f = lambda n, r, files=("a.rs", "b.rs"): {"count": n, "filenames": list(files), "regions": r}
    region = lambda line, file: [line, 1, line + 3, 2, 5, file, 0, 0]
    doc = {"data": [{"functions": [f(3, [region(9, 0), region(7, 0), region(2, 1)]), f(0, [region(4, 1)]), f(True, [region(1, 0)]), f(1.5, [region(1, 0)]), f(2, []), f(2, [region(1, 0)], ())]}, {"functions": None}]}
    got = P.parse_region_coverage(docs(spark, doc, "not json", {}))
    assert sorted(tuple(r) for r in got.collect()) == [("d0", "a.rs", 4, 0), ("d0", "a.rs", 7, 3)]


def test_coverage_polls(spark):
    r = lambda at, n: {"functionName": "f", "ranges": [{"startOffset": at, "count": n}, {"startOffset": 99, "count": 99}]}
    poll = [{"scriptId": "1", "url": "u", "functions": [r(0, 3), r(5, "x"), r(0, 4), {"functionName": "g", "ranges": []}]}]
    got = P.parse_coverage_polls(spark.createDataFrame([(0, json.dumps(poll)), (1, "?")], "poll int, value string"))
    assert sorted(tuple(x) for x in got.collect()) == [("1", 0, 0, 4), ("1", 5, 0, 0)]


def test_cpu_profile(spark):
    rng = random.Random(3)
    nodes = {1: (None, None)}
    for i in range(2, 40):
        nodes[i] = (rng.randrange(max(1, i - 6), i), None if rng.random() < 0.2 else f"n{i}")
    kids = lambda i: [c for c, (p, _) in nodes.items() if p == i]
    samples = [rng.choice([*nodes, 777]) for _ in range(120)]
    deltas = [rng.randrange(0, 50) for _ in range(110)]
    doc = {"nodes": [{"id": i, "callFrame": {"functionName": n or "", "url": "u", "lineNumber": i}, "children": kids(i)} for i, (_, n) in nodes.items()], "samples": samples, "timeDeltas": deltas, "startTime": 100, "endTime": 120}
    tree, s = P.read_cpu_profile(docs(spark, doc))
    got = [tuple(r) for r in P.events_from_samples(s, tree.selectExpr("doc", "id", "parent", "nullif(function, '') node_id")).orderBy("idx").collect()]

    def path(i):
        p, n = nodes[i]
        return (path(p) if p else []) + ([(i, n)] if n else [])

    want, was, now = [], [], 100

    def move(cur, t):
        k = sum(1 for _ in iter(lambda it=iter(zip(was, cur)): (lambda z: z if z and z[0] == z[1] else None)(next(it, None)), None))
        want.extend(("return", was[d][1], t * 1000, d) for d in reversed(range(k, len(was))))
        want.extend(("call", cur[d][1], t * 1000, d) for d in range(k, len(cur)))

    for i, sid in enumerate(samples):
        start, now = now, now + (deltas[i] if i < len(deltas) else 0)
        if sid in nodes:
            move(path(sid), start)
            was = path(sid)
    move([], max(120, now))
    assert [(e, n, t, d) for _, _, e, n, t, _, d in got] == want
    assert [g[1] for g in got] == list(range(len(want)))


def test_tree_with_a_ring(spark):
    tree = spark.createDataFrame([("d", 1, None, "a"), ("d", 2, 1, "b"), ("d", 3, 4, "c"), ("d", 4, 3, "e"), ("d", 5, 99, "f")], "doc string, id long, parent long, node_id string")
    assert {r.id: [x.node_id for x in r.path] for r in P.tree_paths(tree).collect()} == {1: ["a"], 2: ["a", "b"], 5: ["f"]}


def test_speedscope(spark):
    o, c = (lambda f, at: {"type": "O", "frame": f, "at": at}), (lambda f, at: {"type": "C", "frame": f, "at": at})
    doc = {"shared": {"frames": [{"name": "a"}, {"name": "b"}]}, "profiles": [{"type": "sampled", "name": "x 9"}, {"type": "evented", "name": "thread 7", "events": [c(0, 1), o(0, "2"), o(1, 3), None, c(1, 5), o(5, 6), c(5, 7), c(0, 8), c(0, 9)]}, {"type": "evented", "name": "main", "events": [o(1, 1)]}]}
    got = [tuple(r)[3:] for r in P.from_speedscope(docs(spark, doc)).orderBy("profile", "pos").collect()]
    u = "<unresolved>"
    assert got == [("return", "a", 1, 7, 0), ("call", "a", 2, 7, 0), ("call", "b", 3, 7, 1), ("return", "b", 5, 7, 1), ("call", u, 6, 7, 1), ("return", u, 7, 7, 1), ("return", "a", 8, 7, 0), ("return", "a", 9, 7, 0), ("call", "b", 1, 2, 0)]


def random_frames(spark, close_all):
    rng, rows, t = random.Random(5), [], 0
    for thread in (1, 2):
        stack = []
        for _ in range(150):
            t += rng.randrange(1, 5)
            if stack and rng.random() < 0.5:
                rows.append(("s", len(rows), "return", stack.pop(), t, thread, len(stack)))
            else:
                stack.append(f"m.py:f{rng.randrange(6)}")
                rows.append(("s", len(rows), "call", stack[-1], t, thread, len(stack) - 1))
        while close_all and stack:
            t += 1
            rows.append(("s", len(rows), "return", stack.pop(), t, thread, len(stack)))
    return spark.createDataFrame(rows, "session_id string, idx long, event string, node_id string, ts_ns long, thread_id long, frame_depth int")


def test_speedscope_round_trip(spark):
    e = random_frames(spark, True)
    back = P.from_speedscope(P.speedscope_documents(FR.build_frames(e)).selectExpr("concat(session_id, thread_id) doc", "value"))
    zero = e.selectExpr("min(ts_ns)").first()[0]
    for thread in (1, 2):
        want = [tuple(r) for r in e.where(f"thread_id = {thread}").orderBy("idx").selectExpr("event", "node_id", f"ts_ns - {zero}", "frame_depth").collect()]
        assert [tuple(r) for r in back.where(f"thread_id = {thread}").orderBy("pos").select("event", "node_id", "ts_ns", "frame_depth").collect()] == want


def test_chrome_trace(spark):
    ev = lambda ph, name, ts, tid=1, pid=1, **more: {"ph": ph, "name": name, "ts": ts, "tid": tid, "pid": pid, **more}
    one = {"traceEvents": [ev("E", "z", 0), ev("B", "a", 1), ev("B", "b", 2), ev("E", "b", 4), ev("X", "c", 4, dur="2"), ev("E", "a", 9), ev("E", "a", 10), ev("B", "open", 11), ev("M", "meta", 0), ev("X", "zero", 12, dur=0)]}
    two = {"traceEvents": [ev("X", "p", 0, 3, 1, dur=5), ev("X", "q", 0, 3, 2, dur=5)]}
    got = [tuple(r) for r in P.from_chrome_trace(docs(spark, one, two)).orderBy("session_id", "thread_id", "idx").collect()]
    assert [(e, n, t // 1000, d) for s, _, _, e, n, t, d in got if s == "d0"] == [
        ("call", "a", 1, 0), ("call", "b", 2, 1), ("return", "b", 4, 1), ("call", "c", 4, 1), ("return", "c", 6, 1), ("return", "a", 9, 0),
        ("call", "open", 11, 0), ("return", "open", 11, 0), ("call", "zero", 12, 0), ("return", "zero", 12, 0)]
    assert {(g[1], g[4]) for g in got if g[0] == "d1"} == {(1000003, "p"), (2000003, "q")}


def test_chrome_round_trip(spark):
    from tracegraph.sources.traces import to_chrome_trace

    frames = FR.build_frames(random_frames(spark, True))
    rows = [r.asDict() for r in to_chrome_trace(frames).collect()]
    doc = {"traceEvents": [{k: r[k] for k in ("name", "ph", "ts", "dur", "pid", "tid")} for r in rows]}
    zero = frames.selectExpr("min(start_ns)").first()[0]
    back = FR.build_frames(P.from_chrome_trace(docs(spark, doc)))
    shape = lambda f, z: sorted(tuple(r) for r in f.selectExpr("thread_id", "node_id", "depth", f"start_ns - {z}", f"end_ns - {z}").collect())
    assert shape(back, 0) == shape(frames, zero)


def plain_intervals(events):
    """A stack over the intervals of one thread in order, and nothing else: ``(event, name, time, depth)``."""
    open_, spans = [], []
    for e in events:
        if e["ph"] == "X":
            spans.append((e["ts"], e["ts"] + e["dur"], e["name"]))
        elif e["ph"] == "B":
            open_.append(e)
        elif open_:
            b = open_.pop()
            spans.append((b["ts"], e["ts"], b["name"]))
    spans += [(b["ts"], b["ts"], b["name"]) for b in open_]
    out, stack = [], []
    for start, end, name in sorted(spans, key=lambda s: (s[0], -s[1])):
        while stack and stack[-1][0] <= start:
            t, was = stack.pop()
            out.append(("return", was, t, len(stack)))
        out.append(("call", name, start, len(stack)))
        stack.append((end, name))
    while stack:
        t, was = stack.pop()
        out.append(("return", was, t, len(stack)))
    return out


def test_overlapping_intervals_stay_open_under_later_ones(spark):
    import json
    import random

    cases = [[{"name": "a", "ph": "X", "ts": 0, "dur": 10}, {"name": "b", "ph": "X", "ts": 5, "dur": 10}, {"name": "c", "ph": "X", "ts": 12, "dur": 1}, {"name": "d", "ph": "X", "ts": 20, "dur": 0}]]
    rng = random.Random(3)
    for _ in range(40):
        case = []
        for k in range(rng.randrange(1, 14)):
            ph = rng.choice("XXXBE")
            case.append({"name": f"n{k}", "ph": ph, "ts": rng.randrange(12), **({"dur": rng.choice([0, 1, 3, 8])} if ph == "X" else {})})
        cases.append(case)
    docs = [(str(k), json.dumps({"traceEvents": [e | {"pid": 1, "tid": 7} for e in case]})) for k, case in enumerate(cases)]
    got = {}
    for r in P.from_chrome_trace(spark.createDataFrame(docs, "doc string, value string")).orderBy("session_id", "idx").collect():
        assert r.thread_id == 7 and r.idx == len(got.setdefault(r.session_id, []))
        got[r.session_id].append((r.event, r.node_id, r.ts_ns // 1000, r.frame_depth))
    for k, case in enumerate(cases):
        assert got.get(str(k), []) == plain_intervals(case), case
    assert got["0"][:3] == [("call", "a", 0, 0), ("call", "b", 5, 1), ("call", "c", 12, 2)]  # a has ended and stays open under b
