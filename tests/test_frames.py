"""Frames, stacks and flames against a plain replay of the stack, at several chunk widths, on deep threads and odd ids."""

import random
from collections import defaultdict

import pytest

from tracegraph.operators import frames as FR

SCHEMA = "session_id string, thread_id long, idx long, event string, node_id string, frame_depth int, ts_ns long"
NODES = ["a", "b", "<unresolved>", "x > y", ">", "<module>", "pkg/f.py:C.m"]


def trace(seed, n, depth, threads=3):
    rng, rows, at = random.Random(seed), [], defaultdict(int)
    for i in range(n):
        thread = rng.choice([1] * 5 + list(range(threads)))
        d = at[thread]
        event = rng.choices(["call", "return", "exception"], [6, 5, 2])[0]
        if event == "call":
            d = min(depth, d + rng.choice([1, 1, 1, 1, 0, -2, 2]))
            at[thread] = d = max(0, d)
        elif event == "return":
            at[thread] = max(0, d - rng.choice([1, 1, 1, 3]))
            d = max(0, d + rng.choice([0, 0, 0, -1]))
        rows.append(("s", thread, i, event, rng.choice(NODES), None if rng.random() < 0.01 else d, 10 * i + rng.randrange(9)))
    return rows


def replay(rows):
    """(frames by call index, stacks before each event)"""
    last, frames, stacks, stack = {}, {}, {}, defaultdict(list)
    for _, t, i, event, node, d, ts in rows:
        last[t] = max(ts, last.get(t, ts))
        s = stack[t]
        if event != "call":
            stacks[i] = [f["call"] for f in s]
        if d is None or event not in ("call", "return"):
            if event == "call":
                stacks[i] = [f["call"] for f in s]
            continue
        while s and s[-1]["depth"] >= d:
            f = s.pop()
            f |= {"close": i, "end": max(f["start"], ts), "synthetic": not (event == "return" and f["depth"] == d)}
        if event == "call":
            stacks[i] = [f["call"] for f in s]
            f = {"call": i, "close": None, "parent": s[-1]["call"] if s else None, "node": node, "depth": d, "start": ts, "synthetic": True, "thread": t, "path": [x["node"] for x in s] + [node]}
            frames[i] = f
            s.append(f)
    for f in frames.values():
        f.setdefault("end", max(f["start"], last[f["thread"]]))
    inner = defaultdict(int)
    for f in frames.values():
        if f["parent"] is not None:
            inner[f["parent"]] += f["end"] - f["start"]
    for i, f in frames.items():
        f["self"] = max(0, f["end"] - f["start"] - inner[i])
    return frames, stacks


@pytest.mark.parametrize("depth,chunk", [(4, 7), (200, 50), (200, 1 << 16)])
def test_replay(spark, depth, chunk):
    rows = trace(depth + chunk, 3000, depth)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    frames, stacks = replay(rows)
    got = {r["call_idx"]: r for r in FR.build_frames(df, paths=True, chunk=chunk).collect()}
    assert got.keys() == frames.keys() and max(f["depth"] for f in frames.values()) == min(depth, max(f["depth"] for f in frames.values()))
    for i, f in frames.items():
        r = got[i]
        assert (r["close_idx"], r["parent_idx"], r["node_id"], r["depth"], r["synthetic"], r["path"]) == (f["close"], f["parent"], f["node"], f["depth"], f["synthetic"], f["path"]), i
        assert (r["start_ns"], r["end_ns"], r["total_ns"], r["self_ns"]) == (f["start"], f["end"], f["end"] - f["start"], f["self"]), i
    assert {r["idx"]: [s["call_idx"] for s in r["stack"]] for r in FR.stacks(df, chunk=chunk).collect()} == stacks
    plain = {r["call_idx"]: r["parent_idx"] for r in FR.build_frames(df, chunk=chunk).collect()}
    assert plain == {i: f["parent"] for i, f in frames.items()}


def test_deep_recursion(spark):
    n = 20000
    rows = [("s", 1, i, "call", "f", i, i) for i in range(n)] + [("s", 1, n + i, "return", "f", n - 1 - i, n + i) for i in range(n)]
    got = FR.build_frames(spark.createDataFrame(rows, SCHEMA), chunk=3000)
    r = got.selectExpr("count(*) n", "sum(int(synthetic)) bad", "sum(close_idx - call_idx) w", "count(parent_idx) p", "max(depth) d").first()
    assert (r.n, r.bad, r.w, r.p, r.d) == (n, 0, sum(2 * (n - i) - 1 for i in range(n)), n - 1, n - 1)


def test_open_frames(spark):
    rows = trace(5, 800, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    frames, _ = replay(rows)
    probes = [("s", t, i) for t in (0, 1, 2, 9) for i in (-1, 0, 33, 400, 401, 799, 10_000)]
    got = defaultdict(list)
    for r in FR.open_frames(df, spark.createDataFrame(probes * 2, "session_id string, thread_id long, idx long"), chunk=64).collect():
        got[r["thread_id"], r["idx"]].append((r["level"], r["call_idx"], r["node_id"]))
    for _, t, i in probes:
        want = sorted(f["call"] for f in frames.values() if f["thread"] == t and f["call"] <= i and (f["close"] is None or f["close"] > i))
        assert sorted(got[t, i]) == [(k, c, frames[c]["node"]) for k, c in enumerate(want)], (t, i)


def test_flame_with_separators_in_ids(spark):
    f = lambda call, close, depth, node, ts, end: [("s", 1, call, "call", node, depth, ts), ("s", 1, close, "return", node, depth, end)]
    rows = f(0, 9, 0, "a", 0, 100) + f(1, 2, 1, "b", 0, 10) + f(3, 4, 1, "<unresolved>", 10, 50) + f(5, 6, 1, "a > b", 60, 65) + f(10, 11, 0, "a > b", 200, 210)
    flame = FR.flame(FR.build_frames(spark.createDataFrame(sorted(rows, key=lambda r: r[2]), SCHEMA), paths=True))
    got = {tuple(r["path"]): (tuple(r["parent_path"]), r["n"], r["total_ns"], r["sibling"]) for r in flame.collect()}
    assert got == {
        ("a",): ((), 1, 100, 1), ("a > b",): ((), 1, 10, 2), ("a", "<unresolved>"): (("a",), 1, 40, 1), ("a", "b"): (("a",), 1, 10, 2), ("a", "a > b"): (("a",), 1, 5, 3),
    }
    assert sorted((r["depth"], tuple(r["path"])) for r in FR.hot_path(flame).collect()) == [(1, ("a",)), (2, ("a", "<unresolved>"))]


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert FR.build_frames(none, paths=True).count() == FR.flame(FR.build_frames(none, paths=True)).count() == FR.stacks(none).count() == 0
    rows = [(None, None, 0, "call", None, 0, None), (None, None, 1, "return", None, 0, 5), ("s", 1, 2, None, "x", 0, 7), ("s", 1, 3, "call", "x", None, 8)]
    got = FR.build_frames(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["session_id"], r["call_idx"], r["close_idx"], r["synthetic"]) for r in got] == [(None, 0, 1, False)]


def test_hops_carry_arguments_and_call_sites(spark):
    rows = [("s", 1, 0, "call", "a", 0, 0, "x=1"), ("s", 1, 1, "call", "b", 1, 1, None), ("s", 1, 2, "call", "c", 2, 2, "y=2")]
    edges = spark.createDataFrame([("a", "b", "call", 12, 0), ("a", "b", "call", 30, 1), ("b", "c", "import", 7, 2)], "source string, target string, kind string, line int, edge_ord long")
    got = FR.causal_hops(spark.createDataFrame(rows, SCHEMA + ", args string"), edges).where("call_idx = 2").orderBy("hop").collect()
    assert [(r["hop"], r["hop_idx"], r["node_id"], r["args"], r["line"]) for r in got] == [(0, 0, "a", "x=1", None), (1, 1, "b", None, 12), (2, 2, "c", "y=2", None)]


def test_a_deep_recursion_has_a_row_a_path_and_no_stack_in_it(spark):
    """5,000 levels over several chunks, called twice: a path's id is the same whichever way chunks cut it, and rows do not grow with depth."""
    n = 5000
    once = [("s", 1, i, "call", "f", i, i) for i in range(n)] + [("s", 1, n + i, "return", "f", n - 1 - i, n + i) for i in range(n)]
    rows = once + [(s, t, 2 * n + 7 + i, e, v, d, 2 * n + ts) for s, t, i, e, v, d, ts in once]
    frames = FR.build_frames(spark.createDataFrame(rows, SCHEMA), chunk=1700, ids=True)
    assert not any(f.dataType.typeName() == "array" for f in frames.schema)
    flame = FR.cut(FR.flame(frames, names=False))
    r = flame.selectExpr("count(*) k", "min(n) a", "max(n) z", "max(level) d", "count(parent_path_id) p").first()
    assert (r.k, r.a, r.z, r.d, r.p) == (n, 2, 2, n, n - 1)
    hot = FR.hot_path(flame).selectExpr("count(*) k", "max(depth) d", "sum(depth) s").first()
    assert (hot.k, hot.d, hot.s) == (n, n, n * (n + 1) // 2)
    names = FR.path_names(FR.trie(flame)).selectExpr("max(size(path)) d", "sum(size(path)) s", "count(distinct path) k").first()
    assert (names.d, names.s, names.k) == (n, n * (n + 1) // 2, n)


def test_paths_are_the_same_on_every_thread_and_chunk(spark):
    rows = trace(11, 2500, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    seen = {}
    for chunk in (9, 130, 1 << 16):
        for r in FR.build_frames(df, paths=True, chunk=chunk).collect():
            assert len(r["path"]) == r["level"] and r["path"][-1] == r["node_id"]
            assert seen.setdefault(tuple(r["path"]), r["path_id"]) == r["path_id"]
            assert (r["parent_path_id"] is None) == (len(r["path"]) == 1) and seen.get(tuple(r["path"][:-1]), r["parent_path_id"]) == r["parent_path_id"]
    assert len(set(seen.values())) == len(seen) > 300


def test_hot_path_against_a_walk(spark):
    rows = trace(23, 3000, 9)
    flame = FR.flame(FR.build_frames(spark.createDataFrame(rows, SCHEMA), chunk=200, paths=True)).collect()
    want = set()
    for t in {r["thread_id"] for r in flame}:
        at = ()
        while True:
            inside = [r for r in flame if r["thread_id"] == t and tuple(r["parent_path"]) == at and r["sibling"] == 1]
            if not inside:
                break
            at = tuple(inside[0]["path"])
            want.add((t, at, len(at)))
    for names in (True, False):
        f = FR.cut(FR.flame(FR.build_frames(spark.createDataFrame(rows, SCHEMA), chunk=200, ids=True), names=names))
        hot = FR.hot_path(f) if names else FR.named(FR.hot_path(f), FR.trie(f))
        assert {(r["thread_id"], tuple(r["path"]), r["depth"]) for r in hot.collect()} == want
