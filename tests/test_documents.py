"""Elements of large documents by parts of any size are those of the whole document."""

import json
import os
import random
import tempfile

import pytest

from tracegraph.sources import documents
from tracegraph.sources import profiles as P


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([0, -1.5, 10**12, True, None])
    if kind < 4:
        return "".join(rng.choice('ab"\\,:[]{}\né😀 ') for _ in range(rng.randrange(9)))
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "events", 'q"', "b]"]) + str(k): random_value(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 20])
def test_elements(spark, part):
    rng = random.Random(part)
    folder, want = tempfile.mkdtemp(), {}
    for k in range(3 if part == 1 else 8):
        doc = {"first": random_value(rng), "other": [random_value(rng) for _ in range(3)], "shared": {"events": [1, 2]}}
        doc["events"] = [random_value(rng) for _ in range(rng.choice([0, 1, 5, 12]))]
        doc["last"] = {"events": [3]}
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        name = f"{folder}/d{k}.json"
        with open(name, "w") as f:
            f.write(text)
        want[name] = doc["events"]
    open(f"{folder}/empty.json", "w").close()
    got = {}
    for r in documents.elements(spark, folder, "events", part).orderBy("doc", "ord").collect():
        assert r.ord == len(got.setdefault(r.doc, []))
        got[r.doc].append(json.loads(r.value))
    assert got == {k: v for k, v in want.items() if v}


def test_documents_that_are_arrays(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/a.json", "w") as f:
        json.dump([{"x": [1, {"y": "]"}]}, 2, "three, or so"], f)
    got = documents.elements(spark, f"{folder}/a.json", None, 5).orderBy("ord").collect()
    assert [json.loads(r.value) for r in got] == [{"x": [1, {"y": "]"}]}, 2, "three, or so"]


def test_interval_traces_by_parts_are_those_of_whole_documents(spark):
    rng = random.Random(6)
    folder, docs = tempfile.mkdtemp(), []
    for k in range(3):
        events = [{"name": f"n{i} {{[", "ph": rng.choice("XBE"), "ts": rng.randrange(50), "dur": rng.randrange(9), "pid": 1 + i % (k + 1), "tid": i % 3} for i in range(60)]
        text = json.dumps({"displayTimeUnit": "ns", "traceEvents": events})
        with open(f"{folder}/t{k}.json", "w") as f:
            f.write(text)
        docs.append((f"{folder}/t{k}.json", text))
    whole = P.from_chrome_trace(spark.createDataFrame(docs, "doc string, value string"))
    parts = P.from_chrome_events(documents.elements(spark, folder, "traceEvents", 500))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(parts) == key(whole) and len(key(whole)) > 100
    assert os.path.getsize(f"{folder}/t0.json") > 8 * 500


def test_graph_documents_by_parts(spark):
    from tracegraph.sources import traces as R

    rng = random.Random(8)
    folder = tempfile.mkdtemp()
    for k in range(2):
        nodes = [{"id": f"n{i}", "kind": "function", "name": f"f, {i}", "path": "a.py", "line": i, "metadata": {"receiver": "T"}} for i in range(30)]
        edges = [{"source": f"n{rng.randrange(30)}", "target": 'x "y"', "kind": "call", "metadata": {"line": i, "resolved": False, "names": ["a", "b"]}} for i in range(40)]
        with open(f"{folder}/g{k}.json", "w") as f:
            json.dump({"version": "1", "nodes": nodes, "edges": edges}, f)
    key = lambda df: sorted((r.asDict() | {"graph_id": r["graph_id"].rsplit("/", 1)[1]}).items().__repr__() for r in df.collect())
    for whole, parts in zip(R.read_graph(spark, folder), R.read_graph(spark, folder, 300)):
        assert key(parts) == key(whole) and len(key(whole)) >= 60
