"""Orchard's search against all distances; codebooks and codes against a plain reading; odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegraph.llm import codes


@pytest.mark.parametrize("high", [2, 6, 300, 1 << 26, 1 << 40])
def test_search_finds_the_nearest_of_lowest_index(high):
    rng = np.random.default_rng(high)
    for _ in range(30):
        k, width = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        entries, queries = rng.integers(-high, high, (k, width)), rng.integers(-high, high, (200, width))
        entries[k // 2 :: 3] = entries[0]  # equal entries
        code, dist, _ = codes.orchard(queries, codes.neighbour_lists(entries))
        full = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert (code == full.argmin(1)).all() and (dist == full.min(1)).all()


def test_search_stops_early():
    """Near clusters: far fewer distances than all."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-(10**6), 10**6, (64, 4))
    queries = centres[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 4))
    _, _, computed = codes.orchard(queries, codes.neighbour_lists(centres))
    assert computed < 2000 * 64 * 0.6


def plainly(rows, parts=16, k=64, rounds=2):
    """``{id: (code, error)}`` and the flat codebook by Python integers."""
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in sorted(rows, key=lambda r: r[0]) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(good[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in good[:k]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((gap(v, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in good:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for j, g in groups.items():
                books[p][j] = [sum(c) // len(g) for c in zip(*g)]
    found = {i: [near(cut(v, p), books[p]) for p in range(parts)] for i, v in good}
    return {i: ("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for i, f in found.items()}, books


SCHEMA = "vec_id long, embedding array<float>, label string, code int, error string, _key int"


def test_whole_operator(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(0, 0.3, 32).astype(np.float32)] for _ in range(300)]
    vectors[20:60] = [vectors[5]] * 40  # copies
    rows = [(i, v, None if i % 7 == 0 else f"l{i % 3}", 0, "", 1) for i, v in enumerate(vectors)]
    bad = [(900, None, "l1", 0, "", 1), (901, [None] + vectors[0][1:], "l1", 0, "", 1), (902, [float("nan")] + vectors[0][1:], "l1", 0, "", 1), (-3, vectors[0][1:] + [float("inf")], "l1", 0, "", 1), (-4, [], "l1", 0, "", 1), (-5, [1.0, 2.0], "l1", 0, "", 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    books = codes.fit(df)
    want, plain = plainly([(r[0], r[1]) for r in rows])
    assert [e.tolist() for e in books.entries] == plain
    out = codes.with_label_error(codes.encoded(df, books, ["vec_id", "label"])).withColumn("hex", F.lower(F.hex("code"))).collect()
    assert {r.vec_id: (r.hex, r.error) for r in out} == want
    label = {r[0]: r[2] for r in rows}
    sums = {x: sum(want[i][1] for i in want if label[i] == x) for x in set(label.values())}
    assert all(r.label_error == sums[r.label] for r in out)
    again = codes.decoded(codes.encoded(df, books, ["vec_id", "embedding"]), books, ["vec_id", "embedding", "error"]).collect()
    for r in again:  # the error is that of the integers; what is put together again is as near
        whole = np.floor(256 * np.array(r.embedding, np.float32).astype(float)) - 256 * np.array(r.vector)
        assert int(round((whole**2).sum())) == r.error


def test_few_null_and_great(spark):
    few = spark.createDataFrame([(None, [0.5] * 16, None, 0, "", 1), (3, [1e30] * 16, None, 0, "", 1), (3, [1e30] * 16, None, 0, "", 1)], SCHEMA)
    books = codes.fit(few)
    assert len(books.entries) == 16 and len(books.entries[0]) == 3
    out = codes.encoded(few, books, ["vec_id"]).orderBy("vec_id").collect()
    assert [(r.vec_id, r.error) for r in out] == [(None, 0), (3, 0), (3, 0)]
    assert codes.fit(few.limit(0)) is None
    with pytest.raises(ValueError):
        codes.fit(few, entries=300)
