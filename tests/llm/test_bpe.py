"""Byte-level BPE against the library that defines it: words, merges, whole documents, the bytes back again."""

import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracegraph.llm import bpe
from tracegraph.llm import queries as q

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)
PART = st.sampled_from([*"aeé '\n\t\r 1½,.!(x7", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'r", "  ", "''", "世", "😀", "́", " ", " ", "\x1c", "the", " and", "<|endoftext|>"])
TEXT = st.lists(PART, max_size=16).map("".join)


def halves(w):
    out, at = [], 0
    for end in w.ends:
        out.append(w.words[at:end].to_pylist())
        at = end
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=5))
def test_words_are_the_pattern_s_matches(texts):
    assert halves(bpe.words_of(pa.array(texts, pa.string()))) == [PATTERN.findall(t or "") for t in texts]


def test_words_of_every_code_point():
    every = [chr(k) for k in (*range(0xD800), *range(0xE000, 0x110000), ord("a"))]
    text = "".join(f"a{c} {c}1" for c in every[:: 7] + every[:3000])
    assert halves(bpe.words_of(pa.array([text]))) == [PATTERN.findall(text)]
    sliced = pa.array(["zz", "don't", None, "", " x"])[1:]
    assert halves(bpe.words_of(sliced)) == [["don", "'t"], [], [], [" x"]]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abehinortté世"), min_size=1, max_size=80))
def test_plain_merges(word):
    assert bpe.merged_long(word.encode(), RANKS) == bpe.merged_short(word.encode(), RANKS) == LIBRARY.encode_ordinary(word)


def test_heap_on_long_words():
    for word in ("a" * 20_000, "ab" * 5_000, "thequick" * 3_000, "é世" * 2_000):
        assert bpe.merged_long(word.encode(), RANKS) == LIBRARY.encode_ordinary(word)


def test_fold(spark):
    text = open(bpe.__file__).read() + " ".join("préfixe Überraschung niño 世界 naïve 12345 == >>> ́́ supercalifragilistic antidisestablishmentarianism" + "z" * k for k in range(50))
    words = sorted({w for w in PATTERN.findall(text) if len(w.encode()) <= bpe.LONG})
    got = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), RANKS).collect()
    assert len(got) == len(words) and max(map(len, words)) > 40
    for r in got:
        assert r.ids == LIBRARY.encode_ordinary(r.word), r.word


SCHEMA = "ids string, word int, text string, k1 int, kept int"


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([(1, [0, 5, 262]), (2, None), (3, []), (4, [-1, 10**6, 5])], "bytes int, ids array<int>")
    piece = {v: k for k, v in RANKS.items()}
    got = {r.bytes: r.text for r in bpe.decode(df, PATH, "ids", "text").collect()}
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == {1: piece[0] + piece[5] + piece[262], 2: None, 3: b"", 4: piece[5]}


@pytest.mark.parametrize("frequent", [0, 40, 1 << 19])
def test_odd_documents(spark, frequent):
    long = "lorem ipsum dolor " * 60_000 + "w" * 3_000
    texts = ["it's the end", "it's the end", None, "", " \n\n  x  ", "<|endoftext|> ordinary", "aaaa" * 40, long, "ünïcödé 世界 " * 50]
    rows = [("dup" if k < 2 else None, 1, t, 2, k // 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = bpe.encode(df, PATH, ["ids", "word", "kept"], frequent=frequent, sample=6)
    assert out.columns == ["ids", "word", "kept", "ids_"]
    key = lambda r: (r[0] or "", r[1], r[2])
    got = sorted(map(key, out.select("ids", "kept", F.array_join("ids_", " ")).collect()))
    want = sorted((r[0] or "", r[4], " ".join(map(str, LIBRARY.encode_ordinary(r[2] or "")))) for r in rows)
    assert got == want
    back = bpe.decode(out, PATH, "ids_", "bytes").collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for t in texts)
    assert bpe.encode(df.limit(0), PATH, ["ids"]).collect() == []


def test_query(spark):
    got = {r.doc_id: r for r in q.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs) > 0
    for d in docs:
        ids, r = LIBRARY.encode_ordinary(d.text or ""), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_table_counts_every_document(spark):
    """More documents than were once sampled: the counts are whole, so the most frequent word is known however its texts are spread."""
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 'supercali', concat('w', id)) text")
    words, ends, _ = bpe._frequent(rows, "text", RANKS, 1 << 18)
    every = {w for (t,) in rows.collect() for w in PATTERN.findall(t)}
    assert set(words.to_pylist()) == every and words[0].as_py() in ("supercali", "w")
    assert len(ends) == len(every)
