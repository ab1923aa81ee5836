"""Keyed tables and batches in two places: whole or not at all, and again the same."""

import os
import tempfile

import pytest

from tracegraph.sources.traces import SessionStore
from tracegraph.storage import KeyedTable, Sides

SCHEMA = "k string, j long, v int"


def test_upserts_rewrite_only_what_they_touch(spark):
    folder = tempfile.mkdtemp() + "/t"
    t = KeyedTable(spark, folder, ["k", "j"], buckets=8)
    assert t.read() is None and t.get("a", 1) is None
    want = {}

    def put(rows, n=None):
        t.upsert(spark.createDataFrame(rows, SCHEMA), n)
        want.update({r[:2]: r[2] for r in rows})
        assert {(r.k, r.j): r.v for r in t.read().collect()} == want

    put([(f"x{i}", i, 0) for i in range(60)] + [(None, 1, 1), ("x", None, 2)])
    stamp = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{folder}/rows") for f in fs if f.startswith("part")}
    before = stamp()
    put([("x3", 3, 7), (None, 1, 9)])
    after = stamp()
    assert all(after[f] == before[f] for f in before) and 1 <= len(after) - len(before) <= 2  # new parts beside the old ones
    put([("x", None, 5), ("new", 4, 4)], 10)
    put([("x", None, 6), ("new", 4, 4)], 11)
    want_then = dict(want)
    t.upsert(spark.createDataFrame([("x", None, 6), ("new", 4, 4)], SCHEMA), 11)  # a batch that is run again
    assert {(r.k, r.j): r.v for r in t.read().collect()} == want_then
    put([], 12)
    assert [r.v for r in t.get("x", None).collect()] == [6] and t.get("nobody", 0).count() == 0


def test_a_broken_upsert_changes_nothing(spark, monkeypatch):
    t = KeyedTable(spark, tempfile.mkdtemp() + "/t", ["k"], buckets=2)
    t.upsert(spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], SCHEMA), 0)
    monkeypatch.setattr(Sides, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.upsert(spark.createDataFrame([("a", 1, 9)], SCHEMA), 1)
    monkeypatch.undo()
    assert sorted(tuple(r)[:3] for r in t.read().select("k", "j", "v").collect()) == [("a", 1, 1), ("b", 2, 2)]
    t.upsert(spark.createDataFrame([("a", 1, 9)], SCHEMA), 1)
    assert sorted(tuple(r)[:3] for r in t.read().select("k", "j", "v").collect()) == [("a", 1, 9), ("b", 2, 2)]


def test_sessions(spark):
    s = SessionStore(spark, tempfile.mkdtemp() + "/s")
    schema = "id string, label string, started_ns long, ended_ns long, source_path string, event_count long, language string"
    assert s.newest_first() is None
    s.save(spark.createDataFrame([("a", "one", 1, 2, "p", 3, "python"), ("b", "two", 5, 6, "p", 3, "go")], schema))
    s.save(spark.createDataFrame([("a", "one again", 9, 10, "p", 4, "python")], schema))
    assert [(r.id, r.label) for r in s.newest_first().collect()] == [("a", "one again"), ("b", "two")]
    assert s.get("b").first().language == "go" and s.get("c").count() == 0
