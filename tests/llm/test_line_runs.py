"""Line dedup against a brute force over repeated runs of adjacent lines, with short and long passages in new surroundings."""

import random

from tracegraph.llm.line_dedup import without_repeats


def without_runs(texts):
    """Texts in order, without the lines of runs of two lines with words or more that stand earlier, whatever their length."""
    docs, out = [t.split("\n") for t in texts], []
    earlier = {}
    for d, lines in enumerate(docs):
        gone = set()
        for k in range(len(lines)):
            for e, j in earlier.get(lines[k], []):
                n = 0
                while k + n < len(lines) and j + n < len(docs[e]) and lines[k + n] == docs[e][j + n]:
                    n += 1
                while n and not lines[k + n - 1].strip():
                    n -= 1
                if lines[k].strip() and sum(1 for x in lines[k : k + n] if x.strip()) >= 2:
                    gone.update(range(k, k + n))
            if lines[k].strip():
                earlier.setdefault(lines[k], []).append((d, k))
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_runs_in_other_surroundings(spark):
    rng = random.Random(8)
    new = lambda n: [f"line {rng.randrange(10**9)} of its own" for _ in range(n)]
    passages = [new(n) for n in (2, 2, 2, 3, 3, 4, 7, 30)] + [["one", "", "two"], ["a", " ", "", "b", "c"]]
    texts = []
    for _ in range(40):
        lines = new(rng.randint(0, 4))
        for p in rng.sample(passages, 2):
            at = rng.randint(0, len(p) - 2)
            lines += p[at:] + new(rng.randint(0, 3)) + [""] * rng.randint(0, 1)
        texts.append("\n".join(lines))
    texts += ["x\nx\nx\nx", texts[3], "", "one", "two\n\none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in without_repeats(df).collect()}
    want = without_runs(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(a != b for a, b in zip(texts, want)) > 30
