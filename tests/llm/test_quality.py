"""Planted host boilerplate: small hosts, the share and the count limit, against a count by hand."""

from collections import Counter, defaultdict

from tracegraph.llm.quality import kept_documents, line_hash, quality_rules

BOILER = "\n".join("Notice" + "".join(f" {chr(97 + k)}{chr(97 + j)}" for j in range(15)) for k in range(9))


def own(host, k, n):
    spell = lambda x: "".join(chr(97 + int(c)) for c in str(x))  # noqa: E731  (digits count as alike)
    return " ".join(f"{host}word{spell(k)}x{spell(j)}" for j in range(n))


def planted():
    rows = []
    for host, n, with_it in (("small", 12, 9), ("none", 12, 4), ("large", 120, 11)):
        for k in range(n):
            words = 20 if k % 3 == 0 else 90
            rows.append((f"{host}{k}", host, own(host, k, words) + ("\n" + BOILER if k < with_it else "\n" + own(host, k + 1000, 60))))
    return [(i, text, host) for i, (_, host, text) in enumerate(rows)]


def by_hand(rows, max_share, min_docs, max_docs):
    docs, found = defaultdict(set), defaultdict(Counter)
    for _, text, host in rows:
        docs[host].add(text)
    for host, texts in docs.items():
        for t in texts:
            found[host].update(set(t.split("\n")))
    return {(host, line) for host in found for line, c in found[host].items() if c > min_docs and c > min(max_docs, max_share * len(docs[host]))}


def judged(spark, rows, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts, frequent = quality_rules(df, **limits)
    return {r.doc_id: r.kept for r in verdicts.collect()}, {(r.host, r.line) for r in frequent.collect()}, df


def check(spark, limits, hosts):
    rows = planted()
    want = by_hand(rows, **({"max_share": 0.1, "min_docs": 4, "max_docs": 1000} | limits))
    kept, frequent, df = judged(spark, rows, **limits)
    assert frequent == {("=" + host, line_hash(line.encode())) for host, line in want} and {host for host, _ in want} == hosts
    for i, text, host in rows:
        left = sum(len(x.split()) for x in text.split("\n") if (host, x) not in want)
        assert kept[i] == (left >= 0.3 * len(text.split()))
    assert hosts == {host for i, _, host in rows if not kept[i]}
    texts = {r.doc_id: r.text for r in kept_documents(df, **limits).collect()}
    assert set(texts) == {i for i in kept if kept[i]}
    assert all(("Notice" in t) == ("Notice" in rows[i][1] and rows[i][2] not in hosts) for i, t in texts.items())


def test_small_host(spark):
    check(spark, {}, {"small"})


def test_count_limit_comes_before_the_share(spark):
    check(spark, {"max_docs": 10}, {"small", "large"})
