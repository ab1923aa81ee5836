"""The whole corpus pipeline against a brute force written from what its stages promise."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_contract import SF, WORD, passages, rows
from test_near_copies import groups

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def quality(docs):
    """Base rules, then lines in over a tenth of a host's distinct texts (five at least), then what is left of a document."""
    norm = lambda line: " ".join(WORD.findall(line.translate(LOW)))
    texts, found = defaultdict(set), defaultdict(set)
    for d in docs:
        t = d["text"] or ""
        texts[d["source"]].add(t)
        for line in t.split("\n"):
            if WORD.search(line):
                found[d["source"], norm(line)].add(t)
    frequent = {k for k, ts in found.items() if len(ts) > 4 and len(ts) > min(1000, 0.1 * len(texts[k[0]]))}
    out = []
    for d in docs:
        w = WORD.findall(d["text"] or "")
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        if len(w) < 50 or 100 * len(hit) > 50 * len(w):
            continue
        bad = [line for line in d["text"].split("\n") if (d["source"], norm(line)) in frequent]
        if len(w) - sum(len(WORD.findall(x)) for x in bad) >= 0.3 * len(w):
            lines = [x for x in d["text"].split("\n") if not WORD.search(x) or (d["source"], norm(x)) not in frequent]
            out.append(d | {"text": "\n".join(lines) if bad else d["text"]})
    return out


def line_dedup(docs):
    seen, out = set(), []
    for d in docs:
        lines, gone = d["text"].encode().split(b"\n"), set()
        for a, z in passages(d["text"].encode()):
            body = b"\n".join(lines[a:z])
            if z - a >= 2 and sum(bool(x.strip()) for x in lines[a:z]) >= 2:
                gone |= set(range(a, z)) if body in seen else set()
                seen.add(body)
        text = b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
        if not gone or WORD.search(text):
            out.append(d | {"text": text})
    return out


def near_dedup(docs):
    label = groups([(d["doc_id"], d["text"]) for d in docs])
    return [d for d in docs if label[d["doc_id"]] == d["doc_id"]]


def decontaminate(docs):
    """Six windows of eight words of an item at one distance, or all if it has fewer; the given items hold no numbers or names to replace."""
    tokens = lambda t: re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", (t or "").lower())
    items = defaultdict(list)
    for b in rows("benchmark"):
        w = tokens(b["text"])
        assert len(w) >= 8
        for k in range(len(w) - 7):
            items[tuple(w[k : k + 8])].append((b["item_id"], k, min(6, len(w) - 7)))
    out = []
    for d in docs:
        w, at = tokens(d["text"]), defaultdict(set)
        for k in range(len(w) - 7):
            for item, j, need in items.get(tuple(w[k : k + 8]), ()):
                at[item, k - j, need].add(j)
        if not any(len(js) >= need for (_, _, need), js in at.items()):
            out.append(d)
    return out


def mixing(docs):
    size = {d["doc_id"]: len(WORD.findall(d["text"])) for d in docs}
    total = Counter()
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, target, left = set(order), {}, sum(total.values())
    while full := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * total[s]}:
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
        free -= full
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    at, out = Counter(), []
    for d in sorted(docs, key=lambda d: hashlib.md5(f"{d['doc_id']}:mix".encode()).hexdigest()):
        s, n = d["source"], size[d["doc_id"]]
        rounds, rest = divmod(int(target[s] + 1e-6), total[s])
        taken = rounds * n + max(0, min(n, rest - at[s]))
        at[s] += n
        if taken:
            out.append(d | {"size": n, "source_size": total[s], "target": target[s], "taken": taken})
    return out


def test_run(spark):
    docs = sorted(rows("documents"), key=lambda d: d["doc_id"])
    sizes = [len(docs)]
    for stage in (quality, line_dedup, near_dedup, decontaminate, mixing):
        docs = stage(docs)
        sizes.append(len(docs))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[-1] > 50  # stages take effect
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == {d["doc_id"] for d in docs}
    for d in docs:
        r = got[d["doc_id"]]
        assert all(r[c] == d[c] for c in ("text", "lang", "source", "size", "source_size", "taken")), d["doc_id"]
        assert r["n_chars"] == len(d["text"]) and r["target"] == pytest.approx(d["target"])
