"""Symbol resolution in its four styles on small graphs; answers by hand."""

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import resolve as RS

NODE = "id string, kind string, name string, path string, node_ord long, receiver string"
EDGE = "source string, target string, kind string, resolved boolean, edge_ord long, names array<string>, alias string, default_name string, aliases map<string,string>"


def graph(spark, nodes, imports, refs):
    n = spark.createDataFrame([(i, k, i.rsplit(":", 1)[-1].rsplit(".", 1)[-1] if k != "file" else i, i.split(":")[0], o, r) for o, (i, k, r) in enumerate(nodes)], NODE)
    rows = [(s, t, "import", None, o, names, alias, default, aliases) for o, (s, t, names, alias, default, aliases) in enumerate(imports)]
    rows += [(s, t, k, False, 100 + o, None, None, None, None) for o, (s, t, k) in enumerate(refs)]
    return n, spark.createDataFrame(rows, EDGE)


def answers(df):
    return {r.edge_ord - 100: (r.target, r.resolved, r.reason) for r in df.where("edge_ord >= 100").collect()}


def check(got, refs, want):
    for i, (ref, w) in enumerate(zip(refs, want)):
        found = w is not None and not w.startswith("!")
        assert got[i] == ((w, None, None) if found else (ref[1], False, w[1:] if w else None)), (ref, got[i], w)


def test_module(spark):
    nodes = [("app/main.py", "file", None), ("app/main.py:run", "function", None), ("app/util.py", "file", None), ("app/util.py:help_me", "function", None), ("app/util.py:A.go", "method", None),
             ("lib/__init__.py", "file", None), ("lib/__init__.py:boot", "function", None), ("lib/deep/x.py", "file", None), ("lib/deep/x.py:X", "class", None)]
    imports = [("app/main.py", ".util", ["help_me"], "hm", None, None), ("app/main.py", "lib", None, None, None, None), ("app/main.py", "lib.deep.x", None, None, None, None), ("app/util.py", "..lib.deep.x", ["X", "Y"], "ignored", None, None)]
    refs = [("app/main.py:run", t, "call") for t in ["hm", "help_me", "lib.boot", "x.X", "run", "print", "self.go", "<lambda>", "nowhere.f", "lib.none"]] + [("app/util.py:help_me", "X", "inherit"), ("app/util.py:help_me", "Y", "inherit"), ("app/util.py:help_me", "self.q", "inherit")]
    want = ["app/util.py:help_me", "!not_found", "lib/__init__.py:boot", "lib/deep/x.py:X", "app/main.py:run", "!builtin", None, "!dynamic", "!not_imported", "!not_found", "lib/deep/x.py:X", "!not_found", "!not_imported"]
    n, e = graph(spark, nodes, imports, refs)
    out = RS.resolve_symbols(n, e)
    assert out.count() == e.count()
    check(answers(out), refs, want)


def test_relative(spark):
    nodes = [("src/a.ts", "file", None), ("src/a.ts:main", "function", None), ("src/b/index.ts", "file", None), ("src/b/index.ts:Foo", "class", None), ("c.tsx", "file", None), ("c.tsx:Bar", "interface", None), ("c.tsx:dft", "function", None)]
    imports = [("src/a.ts", "./b", ["Foo"], None, None, {"Foo": "F2"}), ("src/a.ts", "../c.js", ["Bar"], None, "dft", None), ("src/a.ts", "react", ["use"], None, None, None)]
    refs = [("src/a.ts:main", t, k) for t, k in [("F2.make", "call"), ("Foo", "call"), ("Bar", "implements"), ("dft", "call"), ("use", "call"), ("main", "call")]]
    n, e = graph(spark, nodes, imports, refs)
    check(answers(RS.resolve_symbols(n, e, "relative")), refs, ["src/b/index.ts:Foo", None, "c.tsx:Bar", "c.tsx:dft", None, "src/a.ts:main"])


def test_package(spark):
    nodes = [("m/a.go:One", "function", None), ("m/b.go:One", "function", None), ("m/b.go:two", "function", None), ("n/x.go:T", "struct", None), ("n/y.go:T", "struct", None), ("main.go:main", "function", None)]
    imports = [("m/a.go", "ex.com/r/n", None, None, None, None), ("main.go", "ex.com/r/m", None, "mm", None, None), ("main.go", "fmt", None, None, None, None)]
    refs = [("m/a.go:One", "n.T", "inherit"), ("m/a.go:One", "One", "call"), ("m/a.go:One", "two", "call"), ("main.go:main", "mm.two", "call"), ("main.go:main", "m.two", "call"), ("main.go:main", "fmt.Print", "call"), ("main.go:main", "main", "call")]
    n, e = graph(spark, nodes, imports, refs)
    check(answers(RS.resolve_symbols(n, e, "package", root="ex.com/r")), refs, ["n/y.go:T", "m/a.go:One", "m/b.go:two", "m/b.go:two", None, None, "main.go:main"])


def test_crate(spark):
    nodes = [("crates/core/src/lib.rs:User", "struct", None), ("crates/core/src/lib.rs:User.new", "method", "User"), ("crates/app/src/main.rs:main", "function", None), ("crates/app/src/util.rs:helper", "function", None), ("crates/app/src/util.rs:Job.go", "method", "Job")]
    imports = [("crates/app/src/main.rs", "core::User", None, "U", None, None), ("crates/app/src/main.rs", "core::User", None, None, None, None), ("crates/app/src/main.rs", "crate::util::helper", None, None, None, None), ("crates/app/src/util.rs", "super::main", None, None, None, None)]
    at = "crates/app/src/main.rs:main"
    refs = [(at, "User::new", "call"), (at, "helper", "call"), (at, "Job.go", "call"), (at, "a::b::helper", "call"), (at, "nothing", "call"), (at, "U", "inherit"), (at, "Job::go", "call"), (at, "User.new", "call"), (at, "main", "call"), ("crates/app/src/util.rs:helper", "main", "call"), (at, "new", "implements")]
    n, e = graph(spark, nodes, imports, refs)
    out = RS.resolve_symbols(n, e, "crate", crates=[("app", "crates/app"), ("core", "crates/core")])
    user = "crates/core/src/lib.rs:User"
    check(answers(out), refs, [user + ".new", "crates/app/src/util.rs:helper", "crates/app/src/util.rs:Job.go", "crates/app/src/util.rs:helper", None, user, "crates/app/src/util.rs:Job.go", user + ".new", at, at, user + ".new"])


@pytest.mark.parametrize("style", ["module", "relative", "package", "crate"])
def test_empty_and_nulls(spark, style):
    n, e = graph(spark, [("a.py:f", "function", None)], [("a.py", "b", None, None, None, None)], [("a.py:f", None, "call"), (None, "f", "call")])
    assert RS.resolve_symbols(n.limit(0), e, style).count() == 3
    assert RS.resolve_symbols(n, e.limit(0), style).count() == 0
    out = RS.resolve_symbols(n, e.drop("aliases", "default_name"), style)
    assert out.where(F.col("edge_ord") >= 100).where("resolved = false").count() == 2
