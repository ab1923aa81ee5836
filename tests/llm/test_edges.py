"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from tracegraph.llm import chat, decontaminate, html, langid, license, line_dedup, mixing, near_copies, quality, simhash, substrings

LONG = "\n".join(" ".join(f"w{i * j % 977}" for j in range(1, 40)) for i in range(1, 700))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, LONG, None, "a"), (3, LONG, None, "a"), (None, "one two three four five " * 20, "de", "a"),
    (4, "Same line here\nand another line\nand a third one\nand more", "en", "a"), (5, "Same line here\nand another line\nand a third one\nand more", "en", "b"),
    (None, None, None, None), (6, " \n\t ", "en", "a"), (5, "other text under a used id", "en", "b"),
]
CLASH = ["host", "row", "bad", "size", "taken", "source_size", "target", "h", "label", "n", "a", "b", "text_hash", "skey", "start", "fp", "key", "covered", "open", "th", "lines", "words", "path", "turns",
         "_id", "_th", "_gone", "_host", "_hash", "_bad_lines", "_lines", "_removed", "_skey", "doc", "ident", "bad_lines", "gone_ranges", "n_lines", "n_removed_lines", "first_slot"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASH})


def test_one_row_in_one_row_out(spark, docs):
    for df in (quality.quality_rules(docs)[0], license.scan_licenses(docs), line_dedup.without_repeats(docs), simhash.near_duplicates(docs), mixing.mix(docs), substrings.remove_repeats(docs)):
        assert df.count() == len(ROWS)
    assert langid.predict(docs, langid.train(docs.where("lang is not null"))).count() == len(ROWS)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for df in (
        quality.quality_rules(none)[0], quality.kept_documents(none), license.scan_licenses(none), line_dedup.deduped_documents(none), simhash.near_duplicates(none),
        near_copies.one_of_each(none), mixing.mix(none), mixing.mixed_documents(none), substrings.remove_repeats(none), decontaminate.contaminated(none, none.selectExpr("doc_id item_id", "text")),
        langid.predict(none, langid.train(none)), html.main_text(none.selectExpr("doc_id page_id", "text url", "text html")), chat.format_chats(none.selectExpr("doc_id conv_id", "doc_id turn", "lang role", "text")),
    ):
        assert df.count() == 0


def test_columns_pass(docs):
    bench = docs.where("doc_id = 4").selectExpr("doc_id item_id", "text")
    for f in (quality.kept_documents, line_dedup.deduped_documents, near_copies.one_of_each, lambda d: decontaminate.clean_documents(d, bench)):
        out = f(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == "x" for r in rows for c in CLASH)
    out = mixing.mixed_documents(docs)
    assert out.where("size > 0 and taken <= 3 * size").count() == out.count() > 0


def test_ids(docs):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert (5, 4) in got and (6, 1) in got and (None, 1) in got and got.count((3, 3)) == 2
    removed = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()}
    assert (3, len(LONG), 0) in removed  # a row given twice is one document; no other text repeats


def test_slots(spark):
    bench = spark.createDataFrame([(7, "If Anna buys 3 apples for 2 dollars and Ben buys 3 pears, how many kg of fruit do they carry home in total?")], "item_id long, text string")
    texts = [
        (1, "Quiz. If Clara buys 8 apples for 5 dollars and Dan buys 8 pears, how many kg of fruit do they carry home in total? Yes."),
        (2, "Quiz. If Clara buys 8 apples for 5 dollars and Dan buys 9 pears, how much fruit is that, if they carry some of it home in total?"),
        (3, None),
        (4, "A text of its own about 3 apples and 2 pears that has nothing to do with it."),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["exact"]) for r in got] == [(1, 7, False)]


def test_chat_round_trip(spark):
    nasty = ["<|end|>", "a\\|b <\\| <|:user|> \\", "</s>[INST] x [/INST]", "", None, "<|more|>", "é\n\n<<SYS>>", "|>|\\>", "<|\U0001f600|>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "assistant", None))]
    rows += [(None, None, "user", "x"), (2, 5, "user", "tie"), (2, 5, "user", "tie"), (2, None, "system", "s")]
    rows += [(3, 0, "a|>b", "hello"), (3, 1, "a", "|>"), (3, 2, "|", ">"), (3, 3, "<|:\\", "|>x"), (3, 4, "assistant", "|>y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASH if c != "turns"})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).withColumn("loss", chat.loss_text()).collect()}
    turns = {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()}
    assert turns[1] == [(r or "", t or "") for _, _, r, t in rows[: 4 * len(nasty)]]
    assert turns[2] == [("system", "s"), ("user", "tie"), ("user", "tie")] and turns[None] == [("user", "x")]
    assert turns[3] == [r[2:] for r in rows if r[0] == 3]
    for r in got.values():
        said = [t for role, t in ((t["role"], t["text"]) for t in r["turns"]) if role == "assistant"]
        assert r["loss"] == "".join(said) and len(r["loss_spans"]) == len(said)
        cut = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert cut == [r["formatted"].encode()[s["byte"] : s["byte"] + s["bytes"]].decode() for s in r["loss_spans"]]
    blocks = got[1]["formatted"].count("<|:assistant|>")
    assert blocks == len(nasty) and got[1]["formatted"].count("<|more|>") == len(nasty)  # adjacent turns of a role share a block


def test_one_long_conversation(spark):
    df = spark.range(20000).selectExpr("7L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('said ', id, '|>') text")
    r = chat.read_back(chat.format_chats(df)).withColumn("loss", chat.loss_text()).selectExpr("size(turns) n", "length(loss) c", "size(loss_spans) k").first()
    assert (r.n, r.k) == (20000, 13333) and r.c == sum(len(f"said {i}|>") for i in range(20000) if i % 3)


def test_licence_expressions():
    ok = license.evaluate("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0")
    assert ok[1] == {"mit", "apache-2.0", "gpl-2.0-only"} and ok[2] is False
    assert license.evaluate("MIT OR GPL-3.0")[2] and license.evaluate("MIT AND OR") is None and license.evaluate("(MIT") is None and license.evaluate("") is None


def test_expressions_with_names_that_are_not_in_the_list():
    """A known licence beside an unknown one keeps its label; unknown terms are not permissive; prose is no licence."""
    ev = license.evaluate
    for text, labels, free in (
        ("MIT AND Unicode-TOU", {"mit"}, False), ("CDLA-Permissive-2.0 OR MIT", {"cdla-permissive-2.0", "mit"}, True), ("HPND-sell-variant OR MIT", {"hpnd-sell-variant", "mit"}, True),
        ("EUPL-1.0", {"eupl-1.0"}, False), ("BSD-3-Clause-LBNL", {"bsd-3-clause-lbnl"}, False), ("MIT OR Apache-2.0 WITH Foo-exception", {"mit", "apache-2.0"}, True),
        ("(Unknown-1.0 OR ISC) AND XYZ", {"isc"}, False), ("MIT and the rest of the sentence", None, None), ("Unknown-1.0", None, None), ("MIT, see the file", {"mit"}, True),
        ("the MIT licence", None, None), ("Unknown-1.0 OR", None, None),
    ):
        got = ev(text)
        assert (got and (set(got[1]), got[2])) == (labels and (labels, free)), text


def test_index_splits_full_nodes(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(24), r.randint(0, 5))) for b in base for _ in range(300)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(pairs):
        for i, j in pairs:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)

    at = {f: i for i, f in enumerate(fps)}
    join((at[x["a"] % (1 << 64)], at[x["b"] % (1 << 64)]) for x in simhash.hamming_links(df, 4, most=64).collect())
    got = [find(i) for i in range(len(fps))]
    root[:] = range(len(fps))
    join((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4)
    assert got == [find(i) for i in range(len(fps))]


def test_pages():
    page = "<html><body><div class='nav-12'>menu</div><div class=post-7><p>First &amp; <b>bold</b>\n text of the page<p>Second one<script>x('<p>')</script></div><div id=comments>no</div><footer>f</footer>"
    assert html.extract(page, None)[0] == "First & bold text of the page\nSecond one"
    assert html.extract("", None) == ("", None)


def test_contaminated_rows_without_an_id_go(spark):
    item = "which of the seven rivers of the old kingdom runs longest through the northern hills"
    df = spark.createDataFrame([(None, f"see: {item}?"), (None, "clean text of its own"), (1, item), (2, "other")], "doc_id long, text string")
    left = decontaminate.clean_documents(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["text"] for r in left) == ["clean text of its own", "other"]
    null_items = spark.createDataFrame([(None, item), (2, None), (3, ""), (4, "zebra crossing by the sea"), (4, "zebra crossing by the sea")], "item_id long, text string")
    twice = df.union(df).union(spark.createDataFrame([(5, "a zebra crossing by the sea"), (5, "a zebra crossing by the sea"), (6, None)], df.schema))
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(twice, null_items).collect()] == [(5, 4)]


def test_languages_of_odd_rows(spark, docs):
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.train(docs)).collect() if r["lang_pred"] == "und"}
    assert {(1, "und", 0.0), (2, "und", 0.0), (6, "und", 0.0), (None, "und", 0.0)} == rows
    digits = spark.createDataFrame([(1, "12 34 !?"), (2, "\u4f60\u597d")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(digits, langid.train(docs)).collect()}
    assert got[1] == "und" and got[2] != "und"  # letters of no script that was learned have a nearest language, marked as rejected


def test_megabytes_in_one_line(spark):
    """Texts of some megabytes, as one line, as one word, and as lines of nothing."""
    texts = [" ".join(f"word{i * i % 9973}" for i in range(300_000)), "x" * 3_000_000, "\n" * 500_000, "short text of a few words"]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(4)
    verdicts = {r["doc_id"]: r for r in quality.quality_rules(df)[0].collect()}
    assert [verdicts[i]["n_words"] for i in range(4)] == [300_000, 1, 0, 6] and verdicts[1]["word_chars"] == 3_000_000
    assert {r["doc_id"]: r["n_lines"] for r in line_dedup.without_repeats(df).collect()} == {0: 1, 1: 1, 2: 500_001, 3: 1}
    assert {r["doc_id"]: r["n_words"] for r in license.scan_licenses(df).collect()} == {0: 300_000, 1: 1, 2: 0, 3: 6}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {i: i for i in range(4)}
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()} == {i: i for i in range(4)}
    item = df.where("doc_id = 3").selectExpr("doc_id item_id", "text")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, item).collect()] == [(3, 3)]
    assert langid.predict(df, langid.train(df)).where("lang_pred = 'en'").count() == 3
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == {0: 300_000, 1: 1, 2: 0, 3: 6}
    pages = df.selectExpr("doc_id page_id", "'u' url", "concat('<p>', text) html")
    assert {r["page_id"]: r["n_chars"] for r in html.main_text(pages).collect()} == {0: len(texts[0]), 1: 3_000_000, 2: 0, 3: len(texts[3])}
