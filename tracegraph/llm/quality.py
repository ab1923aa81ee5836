"""Quality rules: per-document measures and cross-document line frequency per host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, fresh, host_key, whole

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
DIGITS = bytes.maketrans(b"123456789", b"000000000")
SIGNED = 1 << 63

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice, covered = counts[inverse] > 1, np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def normal_line(line: bytes) -> bytes:
    """A-Z lowered, white space collapsed, digits alike."""
    return b" ".join(line.lower().translate(DIGITS).split())


def line_hash(line: bytes) -> int:
    return (xxhash.xxh64_intdigest(normal_line(line)) ^ SIGNED) - SIGNED


def measure(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words of each line)."""
    words = text.split()
    own: dict[int, int] = {}
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if n := len(line.split()):
            dup += line in seen
            seen.add(line)
            h = line_hash(line)
            own[h] = own.get(h, 0) + n
    return (
        len(words),
        len(text.translate(None, SPACE).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        dup,
        repeated_words(words),
        list(own),
        list(own.values()),
    )


OUT = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64())]
    + [(c, pa.int64()) for c in MEASURES]
    + [("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))]
)


def _measure_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = [measure(t or b"") for t in part.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("host"), part.column("text_hash")]
                + [pa.array(c, t.type) for c, t in zip(cols, list(OUT)[3:])],
                schema=OUT,
            )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs``: measures and line hashes, no text. Written once and read back."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        host_key(host).alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(
        _measure_batches,
        "doc_id long, host string, text_hash long, "
        + ", ".join(f"{c} long" for c in MEASURES)
        + ", lines array<long>, line_words array<long>",
    )
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def frequent_lines(stats: DataFrame, max_share: float, min_docs: int, max_docs: int) -> DataFrame:
    """``(host, line)`` of lines found in more distinct documents of a host than its limit.

    The limit is the share ``max_share`` of the host's distinct documents or ``max_docs``, whichever is reached first, and
    ``min_docs`` at least. Exact copies count once: copies are the business of deduplication, not of this rule.
    """
    docs = stats.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("n_docs"))
    found = (
        stats.select("host", "text_hash", F.explode("lines").alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("found_in"))
        .where(F.col("found_in") > min_docs)
    )
    limit = F.least(F.col("n_docs") * max_share, F.lit(max_docs))
    return found.join(docs, "host").where(F.col("found_in") > limit).select("host", "line")


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    max_share: float = 0.1,
    min_docs: int = 4,
    max_docs: int = 1000,
    min_left: float = 0.3,
    min_words: int = 50,
    max_repeat: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """Judge every document; returns ``(verdicts, frequent)``.

    ``verdicts``: one row per input row with ``doc_id, host, text_hash``, the measures,
    ``n_line_words_removed``, ``base_failed`` and ``kept``. A document fails the base rule with
    under ``min_words`` words or more than ``max_repeat`` of them in repeated 3-word windows. Else it
    is rejected when lines above the host's limit hold so many of its words that under ``min_left``
    of them are left. ``frequent``: those ``(host, line)``, for :func:`without_lines`.

    Null text counts as empty (fails the base rule); null hosts form one host; repeated rows are
    judged alike; an empty table gives no rows; other columns of ``docs`` are not read.
    """
    stats = measured(docs, host)
    frequent = cut(frequent_lines(stats, max_share, min_docs, max_docs))
    gone = (
        stats.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
        .select("row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
        .join(frequent, ["host", "line"])
        .groupBy("row")
        .agg(F.sum("words").alias("gone"))
    )
    out = stats.drop("lines", "line_words").join(gone, "row", "left")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat)
    lost = F.coalesce("gone", F.lit(0))
    verdicts = out.select(
        "doc_id", "host", "text_hash", *MEASURES,
        lost.cast("long").alias("n_line_words_removed"),
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - lost >= F.col("n_words") * min_left)).alias("kept"),
    )
    return verdicts, frequent


def _drop_lines(lines: str):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, bad in enumerate(batch.column(lines).to_pylist()):
                if bad and texts[i]:
                    bad = set(bad)
                    own = texts[i].encode().split(b"\n")
                    texts[i] = b"\n".join(x for x in own if not x.split() or line_hash(x) not in bad).decode()
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string())).drop_columns([lines])

    return run


def kept_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that pass, without the lines above their host's limit; columns as given, whatever their names.

    ``n_chars``, where present, is counted again for changed texts. Null ``doc_id`` rows are judged by
    their text like any other.
    """
    verdicts, frequent = quality_rules(docs, host, **limits)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("ident")
    keep = verdicts.where("kept").select(ident, "host", "text_hash").distinct()
    keyed = docs.select(whole(docs), ident, host_key(host).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    lines = fresh(docs, "bad_lines")
    bad = frequent.groupBy("host").agg(F.collect_list("line").alias(lines))  # those of one host
    named = keyed.join(keep, ["ident", "host", "text_hash"], "left_semi").join(bad, "host", "left").select("doc.*", lines)
    out = named.mapInArrow(_drop_lines(lines), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
