"""Components, cycles and implementations on random graphs, against plain searches."""

import random
from functools import reduce

from pyspark.sql import DataFrame

from tracegraph.operators import graph as G


def reach(adjacent, start):
    seen, todo = {start}, [start]
    while todo:
        for y in adjacent.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def test_scc_and_cycles(spark):
    rng, n, m = random.Random(1), 60, 75
    ids = [f"n{i}" for i in range(n)]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["call", "import"])) for _ in range(m)]
    chain = [f"c{i:03}" for i in range(24)]
    edges += [(a, b, "call") for a, b in zip(chain, chain[1:])] + [(chain[18], chain[4], "import"), ("n0", "n0", "call"), ("n1", "gone", "call")]
    nodes = ids + chain
    adjacent = {}
    for a, b, _ in edges:
        if b != "gone":
            adjacent.setdefault(a, set()).add(b)
    reached = {x: reach(adjacent, x) for x in nodes}
    want = {x: max(y for y in reached[x] if x in reached[y]) for x in nodes}
    nd = spark.createDataFrame([(x, "function") for x in nodes], "id string, kind string")
    ed = spark.createDataFrame(edges, "source string, target string, kind string")
    got = {r["id"]: r for r in G.scc(nd, ed).collect()}
    assert {x: r["scc"] for x, r in got.items()} == want
    members = {c: sorted(x for x in nodes if want[x] == c) for c in set(want.values())}
    assert all(r["size"] == len(members[r["scc"]]) for r in got.values()) and len(members[want[chain[10]]]) >= 15
    rings = [c for c, xs in members.items() if len(xs) > 1 or xs[0] in adjacent.get(xs[0], ())]
    rows = sorted(((len(members[c]), "|".join(members[c]), members[c]) for c in rings), key=lambda r: (-r[0], r[1]))
    assert [(r["size"], r["id"], r["nodes"]) for r in G.cycles(nd, ed, 3).collect()] == rows[:3] and len(rows) > 3


def test_what_lies_on_no_ring_is_not_searched(spark, monkeypatch):
    """Layers that no edge leads back from: each is a component of its own nodes, found without a round; rings beside them are searched alone, a long way between rings too."""
    layers = [(f"a{i}", f"b{(i * j) % 40}", "call") for i in range(40) for j in (1, 3, 7)] + [(f"b{i}", f"c{i % 5}", "call") for i in range(40)] + [("a1", "a1", "call")]
    nodes = [f"{x}{i}" for x, n in (("a", 40), ("b", 40), ("c", 5)) for i in range(n)]
    frame = lambda es: (spark.createDataFrame([(x, "function") for x in nodes + ring + ["z1", "z2"]], "id string, kind string"), spark.createDataFrame(es, "source string, target string, kind string"))
    sizes, whole = [], G.Rounds.cut
    monkeypatch.setattr(G.Rounds, "cut", lambda self, df: (out := whole(self, df), "f" in out.columns and sizes.append(out.count()))[0])
    ring = []
    assert sorted(map(tuple, G.scc(*frame(layers)).collect())) == sorted((x, x, 1) for x in nodes + ["z1", "z2"])
    assert sizes == []
    ring = ["r1", "r2", "r3"]
    got = {r.id: (r.scc, r.size) for r in G.scc(*frame(layers + [("r1", "r2", "call"), ("r2", "r3", "call"), ("r3", "r1", "call"), ("r3", "b2", "call"), ("a3", "r1", "call"), ("r2", "z1", "call"), ("z1", "z2", "call"), ("z2", "z1", "call")])).collect()}
    assert got == {x: (x, 1) for x in nodes} | {x: ("r3", 3) for x in ring} | {x: ("z2", 2) for x in ("z1", "z2")}
    assert sizes and max(sizes) == 5


def test_depths_stop_where_no_edge_leads_on(spark, monkeypatch):
    """One look at the edges brings all nodes of one step; parallel edges count as one."""
    nodes = [(f"n{i}", "function") for i in range(30)]
    edges = [(f"n{i}", f"n{20 + j}", "call") for i in range(20) for j in range(10)] * 2
    states, whole = [], G.Rounds.cut
    monkeypatch.setattr(G.Rounds, "cut", lambda self, df: ("depth" in df.columns and states.append(1), whole(self, df))[1])
    got = G.bfs_depth(spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame(edges, "source string, target string, kind string")).collect()
    assert {r.id: r.depth for r in got} == {f"n{i}": int(i >= 20) for i in range(30)} and len(states) == 2
    assert not [r for r in got if not r.reachable]


def test_ends_are_looked_up_once_for_all_features(spark, monkeypatch):
    from tracegraph.operators import learn as L

    calls, whole = [], G.resolved_edges
    monkeypatch.setattr(G, "resolved_edges", lambda n, e: calls.append(1) or whole(n, e))
    nodes = spark.createDataFrame([(f"n{i}", "function", f"f{i}", "a.py" if i % 2 else None, i, False, None) for i in range(9)], "id string, kind string, name string, path string, line int, is_async boolean, has_decorators boolean")
    edges = spark.createDataFrame([("n0", "n1", "call"), ("n1", "n0", "call"), ("n2", "n0", "x"), ("n2", "gone", "call"), ("n3", "n3", "call")], "source string, target string, kind string")
    got = {r.id: r for r in L.features(nodes, edges).collect()}
    assert len(calls) == 1 and sorted(got) == [f"n{i}" for i in range(9)]
    assert [i for i in range(9) if got[f"n{i}"].in_cycle] == [0, 1, 3] and [i for i in range(9) if not got[f"n{i}"].reachable] == [0, 1]


def test_evidence_is_counted_before_it_is_doubled(spark):
    """Parallel edges, loops, unknown and null ends and nodes given twice count as they do when all rows are counted at the end; one aggregation of edges, no sort of them."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    ends = ["a", "b", "c", "d", "gone", None]
    edges = spark.createDataFrame([(rng.choice(ends), rng.choice(ends), rng.choice(["call", "import", None]), i) for i in range(400)], "source string, target string, kind string, line int")
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("c", None), ("d", "y"), ("d", "z"), (None, "w")], "id string, path string")
    by = ["id", "direction", "other", "kind", "path"]
    want = G.edge_evidence(nodes, edges).groupBy(*by).agg(F.count("*").alias("n"))
    got = G.evidence_counts(nodes, edges)
    key = lambda df: sorted(map(repr, df.select(*by, "n").collect()))
    assert key(got) == key(want) and G.edge_evidence(nodes, edges).columns == ["id", "direction", "other", "kind", "path", "line"]
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" not in plan and "Union" not in plan and "ShuffledHashJoin" in plan


def test_evidence_keeps_every_line(spark):
    """Parallel edges on two lines are two rows at each end, those on one line are counted; the query gives the lines of all edges it is given."""
    from pyspark.sql import functions as F

    from tracegraph.plans import derived as D
    from tracegraph.plans import registry

    sf = "/root/testdata/sf0.001"
    out, edges = registry.Q["edge_evidence"](spark, sf), D.graph_edges(spark, sf)
    assert "line" in out.columns
    lines = lambda df, n: {r.line: r.n for r in df.groupBy("line").agg(n.alias("n")).collect()}
    assert lines(out.where("direction = 'out'"), F.sum("n")) == lines(out.where("direction = 'in'"), F.sum("n")) == lines(edges, F.count("*"))
    nodes = spark.createDataFrame([("a", "x"), ("b", None), (None, "w")], "id string, path string")
    few = spark.createDataFrame([("a", "b", "call", 1), ("a", "b", "call", 2), ("a", "b", "call", 2), ("a", "b", "call", None), ("b", "b", "x", 3), (None, "a", "x", 4)], "source string, target string, kind string, line int")
    seen = G.evidence_lines(nodes, few)
    assert spark._jvm.PythonSQLUtils.explainString(seen._jdf.queryExecution(), "simple").count("Exchange ") == 2  # rows are not shuffled again
    got = sorted(map(tuple, seen.collect()), key=repr)
    one = lambda a, b, *rest: [(a, "out", b, *rest), (b, "in", a, *rest)]
    want = one("a", "b", "call", "x", 1, 1) + one("a", "b", "call", "x", 2, 2) + one("a", "b", "call", "x", None, 1) + one("b", "b", "x", None, 3, 1) + one(None, "a", "x", None, 4, 1)
    assert got == sorted(want, key=repr)


def test_degrees_sort_no_edges(spark):
    """Ends are looked up in hashed ids, both sides come from one pass, and counts are made by node and kind before there are columns."""
    edges = spark.createDataFrame([("a", "b", "call"), ("a", "b", "call"), ("b", "a", "import"), ("a", "a", "cross_language_spawn"), ("a", "gone", "call"), ("b", "a", "odd"), (None, "a", "call")], "source string, target string, kind string")
    nodes = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f")], "id string, kind string")
    deg = G.degree_buckets(nodes, edges)
    got = {r.id: {k: v for k, v in r.asDict().items() if v and k != "id"} for r in deg.collect()}
    assert got == {"a": {"in_import": 1, "in_cross_language": 1, "in_other": 1, "out_call": 2, "out_cross_language": 1}, "b": {"in_call": 2, "out_import": 1, "out_other": 1}, "c": {}}
    plan = spark._jvm.PythonSQLUtils.explainString(G.resolved_edges(nodes, edges)._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2


def test_edges_of_many_tables_are_looked_up_once(spark):
    """Ids are hashed once an end, not once an end and table that edges come from; nodes are counted with the ends, so nothing is joined behind the two lookups."""
    schema = "source string, target string, kind string"
    tables = [[("a", "b", "call"), ("a", "gone", "call")], [("a", "b", "import"), (None, "b", "call")], [("b", "b", "inherit"), ("gone", "a", "call"), ("b", "a", None)]]
    edges = reduce(DataFrame.union, [spark.createDataFrame(t, schema) for t in tables])
    nodes = spark.createDataFrame([("a", "f"), ("b", "f"), ("b", "g"), ("c", "f"), (None, "f"), (None, "g")], "id string, kind string")
    deg = G.degree_buckets(nodes, edges)
    got = sorted((r.id or "", {k: v for k, v in r.asDict().items() if v != 0 and k != "id"}) for r in deg.collect())
    b = {"in_call": 1, "in_import": 1, "in_inherit": 1, "out_inherit": 1, "out_other": 1}
    assert [x for x, _ in got] == ["", "", "a", "b", "b", "c"]
    assert [x for _, x in got] == [{}, {}, {"in_other": 1, "out_call": 1, "out_import": 1}, b, b, {}]
    plan = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert plan(G.resolved_edges(nodes, edges)).count("Join ") == plan(G.degree_buckets(nodes, edges)).count("Join ") == 2


def test_no_edges(spark):
    nd, ed = spark.createDataFrame([("a", "file"), ("b", "file")], "id string, kind string"), spark.createDataFrame([], "source string, target string, kind string")
    assert sorted(tuple(r) for r in G.scc(nd, ed).collect()) == [("a", "a", 1), ("b", "b", 1)]


def test_implementations_with_a_method_that_all_have(spark):
    rng = random.Random(4)
    structs = {f"s{i}": {"String", *rng.sample("abcdefgh", 3)} for i in range(60)}
    interfaces = {f"i{i}": {"String", *rng.sample("abcdefgh", rng.randrange(3))} for i in range(30)} | {"none": {"String", "zz"}, "one": {"a"}}
    rows = [(k, "struct", m) for k, ms in structs.items() for m in ms] + [(k, "interface", m) for k, ms in interfaces.items() for m in ms]
    df = spark.createDataFrame(rows + rows[:40], "id string, kind string, method string")
    want = {(s, i) for s, have in structs.items() for i, need in interfaces.items() if need <= have}
    assert {tuple(r) for r in G.implements_edges(df).collect()} == want


def test_implementations_of_types_alike_are_joined_once_a_class(spark, monkeypatch):
    """Structs and interfaces with the same methods are joined as one; nulls are methods that no struct has."""
    rows = [(f"s{i}", "struct", m) for i in range(200) for m in ("a", "b", "ab"[i % 2] + "x", None)] + [(f"i{i}", "interface", m) for i in range(100) for m in (("a", "b") if i % 4 else ("bx",))]
    rows += [("no", "interface", "a"), ("no", "interface", None), (None, "interface", "a"), (None, "struct", "a")]
    df = spark.createDataFrame(rows, "id string, kind string, method string")
    sizes = []
    monkeypatch.setattr(G, "cut", lambda d, old=G.cut: (out := old(d), sizes.append((out.columns, out.count())))[0])
    got = [tuple(r) for r in G.implements_edges(df).collect()]
    assert sorted(got) == sorted((f"s{s}", f"i{i}") for s in range(200) for i in range(100) if i % 4 or s % 2)
    assert (["struct", "interface"], 3) in sizes  # pairs of classes


def test_implementations_send_no_table_through_the_driver(spark, monkeypatch):
    """Cut tables are small as files; none is broadcast all the same, ids of a class lie in blocks, and a pair of large classes is as many rows as it has blocks."""
    rng = random.Random(5)
    structs = {f"s{i}": frozenset(rng.sample("abcdef", 3)) for i in range(90)} | {"none": frozenset()}
    interfaces = {f"i{i}": frozenset(rng.sample("abcdef", 2)) for i in range(70)} | {"odd": frozenset("az"), "one": frozenset("b")}
    rows = [(k, "struct", m) for k, ms in structs.items() for m in ms or [None]] + [(k, "interface", m) for k, ms in interfaces.items() for m in ms]
    df = spark.createDataFrame(rows, "id string, kind string, method string")
    plans, plan = [], lambda d: spark._jvm.PythonSQLUtils.explainString(d._jdf.queryExecution(), "simple")
    monkeypatch.setattr(G, "cut", lambda d, old=G.cut: (plans.append(plan(d)), old(d))[1])
    monkeypatch.setattr(G, "BLOCK", 2, raising=False)
    got = G.implements_edges(df)
    assert not [p for p in [*plans, plan(got)] if "Broadcast" in p]
    assert sorted(map(tuple, got.collect())) == sorted((s, i) for s, have in structs.items() for i, need in interfaces.items() if need <= have)


def test_merged_graph_links_its_languages(spark):
    node, edge = "id string, kind string", "source string, target string, kind string, line int"
    py = spark.createDataFrame([("a.py", "file"), ("a.py:f", "function")], node), spark.createDataFrame([("a.py", "a.py:f", "call", 3)], edge)
    ts = spark.createDataFrame([("b.ts", "file"), ("x/run.ts", "file")], node), spark.createDataFrame([], edge)
    hint = "kind string, node_id string, path string, command string, line int, ord long"
    mine = spark.createDataFrame([("http_client", "a.py:f", "/Api/users/{id}/", None, 7, 0), ("http_client", "a.py:f", "/api/users/:id", None, 9, 1), ("subprocess", "a.py:f", None, "./run.ts -x", 11, 2), ("http_server", "a.py", "/api/users/<n>", None, 1, 99), ("http_client", "a.py", "/health", None, 1, 3)], hint)
    theirs = spark.createDataFrame([("http_server", "b.ts", "/api/users/{x}", None, 2, 0), ("http_client", "b.ts", "/api/users/{y}", None, 5, 1), ("subprocess", "x/run.ts", None, "run.ts", 1, 2)], hint)
    got = G.merge_graphs([("python", *py, mine), ("typescript", *ts, theirs), ("go", py[0].limit(0), py[1].limit(0), None)])
    assert sorted(map(tuple, got.counts.collect())) == [("go+python+typescript", "go", 0), ("go+python+typescript", "python", 2), ("go+python+typescript", "typescript", 2)]
    rows = sorted((r.source, r.target, r.kind, r.line) for r in got.edges.collect())
    assert rows == [("a.py", "a.py:f", "call", 3), ("a.py:f", "b.ts", "cross_language_call", 7), ("a.py:f", "b.ts", "cross_language_call", 9), ("a.py:f", "x/run.ts", "cross_language_spawn", 11)]
    assert got.nodes.where("language = 'python'").count() == 2 and got.hints.count() == 8


def plain_depths(nodes, edges):
    adjacent, into = {}, set()
    for a, b in edges:
        if a != b:
            adjacent.setdefault(a, set()).add(b)
            into.add(b)
    depth = {n: 0 for n, kind in nodes if kind == "file" or n not in into}
    front = list(depth)
    while front:
        front = [y for x in front for y in adjacent.get(x, ()) if y not in depth and depth.setdefault(y, depth[x] + 1)]
    return {n: depth.get(n, -1) for n, _ in nodes}


def test_depths_on_random_graphs(spark):
    rng = random.Random(9)
    for density in (0.7, 1.0, 1.6):
        nodes = [(f"n{k}", "file" if rng.random() < 0.04 else "function") for k in range(120)]
        edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(int(120 * density))]
        edges += [(f"n{k}", f"n{k + 1}") for k in range(80, 119)] + [("n40", "n41"), ("n41", "n42"), ("n42", "n40")]
        got = G.bfs_depth(spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame([(a, b, "call") for a, b in edges], "source string, target string, kind string"))
        assert {r.id: r.depth for r in got.collect()} == plain_depths(nodes, edges)
        assert all(r.reachable == (r.depth >= 0) for r in got.collect())


def test_depths_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    nodes = spark.range(n + 3).selectExpr("concat('n', id) id", "'function' kind")
    edges = spark.range(n - 1).selectExpr("concat('n', id) source", f"concat('n', id + 1) target", "'call' kind")
    ring = spark.range(3).selectExpr(f"concat('n', id + {n}) source", f"concat('n', (id + 1) % 3 + {n}) target", "'call' kind")  # nothing enters it
    whole = G.Rounds.cut
    monkeypatch.setattr(G.Rounds, "cut", lambda self, df: rounds.append(1) or whole(self, df))
    r = G.bfs_depth(nodes, edges.union(ring)).selectExpr("sum(depth) s", "max(depth) m", "count_if(not reachable) u").first()
    assert (r.s, r.m, r.u) == (n * (n - 1) // 2 - 3, n - 1, 3) and len(rounds) < 30
