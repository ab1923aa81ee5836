"""The difference-cover suffix array against sorted suffixes, and its repeats against brute force."""

import random

import pytest
from test_contract import brute_repeats

from tracegraph.llm import substrings, suffix_array


@pytest.mark.parametrize("text", ["mississippi", "aaaaaaaaaaaaaaaa", "x"])
def test_ranks(spark, text):
    s = [ord(c) for c in text] + [1000]
    df = spark.createDataFrame(list(enumerate(s)), "pos long, sym long")
    got = [r["pos"] for r in suffix_array.suffix_ranks(df, len(s)).orderBy("rank").collect()]
    assert got == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abc ") for _ in range(260))
    texts = [base[:140], base[30:180], None, "q" * 130, "", base[:120] + "Z" + base[:119]]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats([(i, (t or "").encode()) for i, t in rows])
    for module in (suffix_array, substrings):
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in module.remove_repeats(df).collect()} == want
    assert sum(v[1] for v in want.values()) > 200
    assert suffix_array.remove_repeats(df.limit(0)).count() == 0
