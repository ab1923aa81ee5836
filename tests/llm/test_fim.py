"""Piece tables: any cuts and arrangements restore; documents against a plain reading of the rule; odd rows."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracegraph.llm import fim

PART = st.sampled_from(["ab", "é", "<", "S>", "<S", "P>", "M", ">", " ", "\n", "x", "😀", "Q"])
TEXT = st.lists(PART, max_size=14).map("".join)


def plainly(text, key):
    """The rule on whole strings: ``(n, form, prefix, middle, output)``."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(-5, 10**12))
def test_one_text(text, key):
    n, form, table = fim.arrange(text, key)
    want = plainly(text, key)
    assert (n, form, table.text()) == (want[0], want[1], want[4])
    assert fim.restore(table.text(), form).text() == text
    assert table.sha256() == hashlib.sha256(want[4].encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(TEXT, st.data())
def test_cuts_arrangements_and_inverse(text, data):
    at = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=4)), reverse=True)
    table = fim.PieceTable((text, "<P>"))
    for k in at:
        table = table.cut(k)
    assert table.text() == text and len(table.pieces) == len(at) + 1
    order = tuple(data.draw(st.permutations(range(len(table.pieces)))))
    mixed = table.arranged(order, (1,) * len(order))
    assert sum(p.length for p in mixed.pieces) == len(text) + 3 * len(order)
    assert mixed.restored(order).text() == text and mixed.buffers[0] is text


SCHEMA = "form int, doc_id long, text string, OUTPUT string, pieces int"


def test_odd_rows(spark):
    long = "word " * 400_000
    rows = [(1, 5, "ab cd", "x", 1), (1, 5, "ab cd", "x", 1), (2, None, "ab cd ef", None, 2), (3, 7, None, "y", 3), (4, 8, "", "", 4), (5, 9, "a <M> b", "", 5), (6, 10, long, "", 6)]
    out = fim.transformed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r, (_, key, text, _, _) in zip(sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id)), sorted(rows, key=lambda r: (r[1] is not None, r[1]))):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(text, key)
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        buffers = (text or "", "<P>", "<S>", "<M>")
        assert "".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output
    assert fim.transformed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rates(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('some words of ', id) AS text")
    forms = {r.form: r["count"] for r in fim.transformed(docs, output=False).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 400) < 80 and abs(forms["spm"] - 720) < 100
    assert {r.form for r in fim.transformed(docs, rate=0).select("form").distinct().collect()} == {"plain"}
