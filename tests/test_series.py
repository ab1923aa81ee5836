"""Metric series, phases and hints against plain Python."""

import math
import random
import re

from tracegraph.functions import hints as H
from tracegraph.operators import series as SR
from tracegraph.operators.frames import build_frames


def test_metric_series(spark):
    ev = lambda i, ret, node="src/metrics.py:record_epoch", event="return", cut=False: ("s", i, event, node, ret, cut)
    rows = [ev(0, "(1, 0.5, 1)"), ev(1, "(2, -1e-3, .5)"), ev(2, "(3, inf, 0.1)"), ev(3, "(4, nan, -inf)"), ev(4, "(5, 1)"), ev(5, "(6, 1, 2)", cut=True), ev(6, "(7, 1, 2)", event="call"), ev(7, None),
            ev(8, "(8, 1., 2)", "xmetrics.py:record_epoch"), ev(9, "(9, 1, 2, 3)"), ev(10, "(10, 2., 3)", "metrics.py:record_epoch"), ev(11, "x(1, 1, 1)")]
    e = spark.createDataFrame(rows, "session_id string, idx long, event string, node_id string, ret string, ret_truncated boolean")
    got = sorted(tuple(r)[1:] for r in SR.metric_series(e).collect())
    assert got == [(0, 1, 0.5, 1.0, 2), (1, 2, -0.001, 0.5, 2), (10, 10, 2.0, 3.0, 2)]
    wide = spark.createDataFrame([("s", 0, "return", "metrics.py:record_layer_stats", "(3, 1, 2, 3.5, 4)", None), ("s", 1, "return", "metrics.py:record_layer_stats", "(4, 9, 2, 3, nan)", None)], e.schema)
    stats = SR.layer_stats(wide, 2)
    assert sorted(tuple(r)[1:] for r in stats.collect()) == [(0, 3, 0, 1.0, 2.0), (0, 3, 1, 3.5, 4.0)]
    assert sorted(tuple(r)[1:] for r in SR.series_maxima(stats).collect()) == [(0, 1.0, 2.0), (1, 3.5, 4.0)]
    assert SR.layer_stats(wide, 3).count() == 0 and math.isnan(SR.metric_tuples(wide, "metrics.py:record_layer_stats", 4).orderBy("idx").collect()[1].numbers[3])


def test_phases(spark):
    rng = random.Random(8)
    names = ["train.py:train_step", "train.py:evaluate", "model.py:Sequential.forward", "model.py:Sequential.backward", "model.py:Sequential.zero_grad", "a/layers.py:Dense.forward", "layers.py:Relu.backward", "layers.py:Dense.forward", "losses.py:MSE.forward", "losses.py:MSE.backward", "optim.py:SGD.step", "other.py:f"]
    rows = [("s", i, rng.choice(["call", "call", "call", "return", "exception"]), rng.choice(names), rng.randrange(2), rng.randrange(6)) for i in range(600)]
    slot, count, want = {}, {}, []
    for _, i, event, node, thread, depth in rows:
        slot = {k: v for k, v in slot.items() if not (v[0] == thread and depth <= v[1])}
        tail, method = node.split("/")[-1], node.rsplit(".", 1)[-1]
        if event == "return" and tail == names[0]:
            want.append((i, "idle", -1))
        if event != "call":
            continue
        marker = {names[1]: "e", names[2]: "f", names[3]: "b"}.get(tail)
        if marker:
            slot[marker], count[marker] = (thread, depth), 0
        elif tail.startswith("layers") and (side := method[0]) in slot:
            count[side] += 1
            want.append((i, "backward", 9 - count[side]) if side == "b" else (i, "forward-eval" if "e" in slot else "forward-train", count[side] - 1))
        elif tail.startswith("losses"):
            want.append((i, "loss" if method == "forward" else "loss-grad", -1))
        elif tail.startswith("optim"):
            want.append((i, "update", -1))
        elif tail == names[4]:
            want.append((i, "reset", -1))
    e = spark.createDataFrame(rows, "session_id string, idx long, event string, node_id string, thread_id long, frame_depth int")
    segments = SR.phase_segments(e, 9)
    assert sorted(tuple(r)[1:] for r in segments.collect()) == want
    at = SR.phase_at(segments.select("session_id", "idx", "phase"), e.select("session_id", "idx"))
    have, now, places = {r.idx: r.phase for r in at.collect()}, "idle", dict((w[0], w[1]) for w in want)
    for i in range(600):
        now = places.get(i, now)
        assert have[i] == now


def test_hints(spark):
    texts = {
        "python": "import requests\n\nrequests.get(\n  '/a/b')\nhttpx . post(\"/c\"); requests.get('/d')\n@app.route('/x')\n@api.get('/y/{id}')\nurlpatterns=[path('z/')]\nsubprocess.run(['ls', '-l'])\nsubprocess.call([cmd])\nos.system('make all')\nurllib.request.urlopen('http://u')",
        "typescript": "fetch('/q')\naxios.get(\"/r\")\nrouter.post('/s', f)\nspawn('node')\nawait execa('git')\nprefetch('/no')",
        "go": 'http.Get("/g")\nmux.HandleFunc("/h", f)\nhttp.Handle("/i", h)\nexec.Command("tool")',
        "rust": 'reqwest::get("/j")\nclient.post("/k")\nRouter::new().route("/l", get(f))\nCommand::new("bin")',
    }
    for language, text in texts.items():
        want = []
        for o, (kind, pattern) in enumerate([(k, p) for lang, k, p in H.PATTERNS if lang == language]):
            for m in re.finditer(pattern, text):
                value = m.group(1)
                if o == 5 and language == "python":
                    value = (re.findall(r"['\"]([^'\"]+)['\"]", value) or [None])[0]
                if value:
                    want.append((kind, value, text.count("\n", 0, m.start()) + 1))
        src = spark.createDataFrame([("f", text), ("none", None), ("empty", "")], "path string, text string")
        got = [(r.kind, r.path or r.command, r.line) for r in H.extract_hints(src, language).orderBy("ord", "pos").collect()]
        assert got == want and len(got) >= 4, language


def test_phases_send_no_growing_table_through_the_driver(spark):
    rows = [("s", i, "call", "train.py:evaluate", i % 50, i % 3) for i in range(400)]
    e = spark.createDataFrame(rows, "session_id string, idx long, event string, node_id string, thread_id long, frame_depth int")
    plan = SR.phase_segments(e, 9)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = build_frames(e.withColumn("ts_ns", e.idx), ids=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
