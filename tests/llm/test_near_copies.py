"""Near copies at a similarity, against all pairs."""

import random

import pytest

from tracegraph.llm import near_copies as N
from tracegraph.llm.near_copies import near_copies, one_of_each


def shingles(text, words=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def groups(rows, similarity=0.8):
    """Smallest id reachable over pairs at the similarity or more; texts without a word are copies."""
    rows = [r for r in rows if r[0] is not None]
    sets, label = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a == b or both and both >= similarity * (len(a) + len(b) - both) - 1e-9:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: find(i) for i, _ in rows}


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, common = [], new(90)
    for size in (8, 30, 120, 600):
        for _ in range(12):
            base = new(size)
            rows += [" ".join(changed(rng, base, rng.randint(0, max(1, size // 30)))) for _ in range(4)]
    hot = new(200)
    rows += [" ".join(changed(rng, hot, rng.choice([1, 2, 3, 8]))) for _ in range(120)]  # near each other or not
    rows += [" ".join(common + new(60)) for _ in range(60)]  # a shared passage
    rows += [" ".join(hot)] * 40 + [None, "", " \n", "one", "One", "a b c d e " * 3000]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None, " ".join(hot)), (3, rows[3]), (4, " ".join(hot))]


@pytest.mark.parametrize("most", [1 << 20, 2000])
def test_all_links(spark, texts, most):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = near_copies(df, most=most).collect()
    want = groups(texts)
    assert len(got) == len(texts)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, want.get(i)) for i, _ in texts}
    assert 60 < len(set(want.values())) < len(want) - 100


def test_one_stays(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = groups(texts)
    kept = [r.doc_id for r in one_of_each(df).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i, _ in texts if i is not None and want[i] == i)
    assert kept.count(None) == 1


def test_gray_index_gives_pairs(spark):
    """Fingerprints of near copies are linked by the Gray-ordered index, others are not."""
    base = [f"w{k}" for k in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(f"v{k}" for k in range(3000)))]
    a, b = (N.sketch(t.encode(), 5)[3][0] for _, t in rows[:2])
    assert 0 < N.GRAY_BITS and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= N.GRAY_BITS
    nodes = spark.createDataFrame([(i, (x[1], x[3])) for i, t in rows for x in [N.sketch(t.encode(), 5)]], "node long, s struct<n:int,wide:array<long>>")
    assert [tuple(sorted(r)) for r in N.gray_pairs(nodes).collect()] == [(1, 2)]
