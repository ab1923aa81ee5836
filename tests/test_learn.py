"""Heat prediction: saved, loaded and better than the in-degree alone on held-out nodes."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import learn as L


def test_heat_model(spark):
    # made-up feature rows; the target follows two columns, one of them the in-degree
    rows = spark.range(600).withColumnRenamed("id", "n").select(F.concat(F.lit("n"), "n").alias("id"), *[(F.pmod(F.xxhash64("n", F.lit(c)), F.lit(1000)) / 1000).alias(c) for c in L.FEATURES])
    a, b = F.col("log1p_in_degree"), F.col("reachable")
    rows = rows.withColumn("target", 0.3 * a + 0.7 * b).withColumn("graph_id", F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, "g1").otherwise("g2")).cache()
    train, held = L.split_by_graph(rows, 1)
    assert train.select("graph_id").distinct().count() == held.select("graph_id").distinct().count() == 1
    with pytest.raises(ValueError):
        L.split_by_graph(rows, 2)
    path = tempfile.mkdtemp(prefix="spark-model-") + "/m"
    L.train_heat(train, path)
    scored = L.predict_heat(L.load_heat_model(spark, path), held).join(held, "id")
    assert scored.count() == held.count() and scored.where("score < 0 or score > 1").count() == 0
    got = {c: L.spearman(scored, c, "target", "graph_id").first().spearman for c in ("score", "log1p_in_degree")}
    assert got["score"] > max(0.5, got["log1p_in_degree"] + 0.05)
    spark.createDataFrame([('{"version": 0, "width": 1}',)], "meta string").write.mode("overwrite").text(path + "-meta")
    with pytest.raises(ValueError):
        L.load_heat_model(spark, path)


def test_report_and_hotspots(spark):
    rows = spark.createDataFrame([("g", f"n{i}", h, d) for i, (h, d) in enumerate([(0, 0.1), (5, 0.3), (9, 0.2), (30, 0.9)])] + [("h", "m0", 1, 0.5), ("h", "m1", 1, 0.7)], "graph_id string, id string, heat long, log1p_in_degree double")
    scores = spark.createDataFrame([("g", "n0", 0.0), ("g", "n1", 0.1), ("g", "n2", 0.2), ("g", "n3", 0.9), ("h", "m0", 0.3), ("h", "m1", 0.4)], "graph_id string, id string, score double")
    folder = tempfile.mkdtemp() + "/history"
    for loss in (0.25, float("nan"), None):
        L.learn_report(rows, scores, loss, folder)
    got = spark.read.parquet(folder).collect()
    assert [(r.examples, r.nodes, round(r.train_spearman, 9)) for r in got] == [(2, 6, 0.5)] * 3  # the constant graph counts 0
    assert sorted(str(r.final_loss) for r in got) == ["0.25", "None", "None"] and got[0].baseline_spearman == pytest.approx(0.4)
    status = spark.createDataFrame([("a", 9, 0.1, "under"), ("b", 3, 0.2, "under"), ("c", 9, 0.9, "over"), ("d", 9, 0.3, "under"), ("e", 0, 0.9, "on-target")], "id string, heat long, score double, status string")
    assert [tuple(r) for r in L.surprise_hotspots(status, 2).orderBy("list", "rank").collect()] == [("predicted", 1, "c", 0.9), ("predicted", 2, "e", 0.9), ("under", 1, "a", 9.0), ("under", 2, "d", 9.0)]


def planted_graphs(rng, n=8):
    """Graphs of 60 to 120 functions in a few files, calls by preference for what is called already, a ring each; heat follows calls, rings, privacy and the way from an entry."""
    import math

    nodes, edges, heat = [], [], []
    for g in range(n):
        files = [f"g{g}/m{k}.py" for k in range(rng.randrange(4, 9))]
        funcs = [f"{rng.choice(files)}:{'_' if rng.random() < 0.3 else ''}f{k}" for k in range(rng.randrange(60, 121))]
        nodes += [(f"g{g}", f, "file", f, f, None, False, False) for f in files]
        nodes += [(f"g{g}", f, "function", f.rsplit(":", 1)[1], f.split(":")[0], 10 * k, rng.random() < 0.1, rng.random() < 0.1) for k, f in enumerate(funcs)]
        called = []
        for k in range(1, len(funcs)):
            for _ in range(rng.choice([1, 1, 2, 3])):
                target = rng.choice(called) if called and rng.random() < 0.7 else funcs[rng.randrange(len(funcs))]
                called.append(target)
                edges.append((funcs[k], target, "call"))
        ring = rng.sample(funcs, rng.randrange(3, 6))
        edges += [(a, b, "call") for a, b in zip(ring, ring[1:] + ring[:1])]
        edges += [(f, rng.choice(files), "import") for f in files]
        into = {f: sum(t == f for _, t, _ in edges) for f in funcs}
        for f in funcs:
            x = 0.5 * math.log1p(into[f]) + 1.6 * (f in ring) - 1.4 * f.rsplit(":", 1)[1].startswith("_") + rng.gauss(0, 0.25)
            heat.append((f"g{g}", f, max(0, round(math.exp(2.5 + x)))))
    return nodes, edges, heat


def test_prediction_on_planted_graphs(spark):
    """From graphs to features, target and model: two graphs held out whole are ranked better than by in-degree, and a model of shuffled targets is not."""
    import random

    from tracegraph.storage import cut

    rng = random.Random(4)
    nodes, edges, heat = planted_graphs(rng)
    nodes = spark.createDataFrame(nodes, "graph_id string, id string, kind string, name string, path string, line int, is_async boolean, has_decorators boolean")
    edges = spark.createDataFrame(edges, "source string, target string, kind string")
    heat = spark.createDataFrame(heat, "graph_id string, node_id string, heat long")
    rows = L.features(nodes, edges).join(L.targets(nodes, heat.select("node_id", "heat")), "id").join(heat.select(F.col("node_id").alias("id"), "heat"), "id", "left").na.fill(0, ["heat"])
    rows = cut(rows)
    assert rows.count() == nodes.count() and rows.where("in_cycle = 1").count() >= 24
    train, held = L.split_by_graph(rows, 2, seed=1)
    mean = lambda df, by: df.transform(lambda d: L.spearman(d, by, "heat", "graph_id")).agg(F.avg("spearman")).first()[0]
    scored = held.join(L.predict_heat(L.train_heat(train), held), "id")
    own, base = mean(scored, "score"), mean(held, "log1p_in_degree")
    assert own > 0.5 and own >= base + 0.05, (own, base)
    shuffled = train.select("id").orderBy(F.xxhash64("id")).collect()
    values = [r.target for r in train.select("target").collect()]
    rng.shuffle(values)
    blind = train.drop("target").join(spark.createDataFrame([(r.id, t) for r, t in zip(shuffled, values)], "id string, target double"), "id")
    assert mean(held.join(L.predict_heat(L.train_heat(blind), held), "id"), "score") < 0.4
