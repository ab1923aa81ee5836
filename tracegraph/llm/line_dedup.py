"""Line dedup over content-defined chunks and pairs of adjacent lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, fresh, whole

SIGNED = 1 << 63
MIX = 0x9E3779B97F4A7C15
FILTER_BITS = 22


def chunks(text: bytes, spread: int = 4) -> list[tuple[int, int]]:
    """``(start, end)`` line numbers of the passages of a text that are compared: its chunks, and each pair of adjacent lines with words.

    The pairs (blank lines between belong to them) carry a match line by line to both ends of a repeated run, however short. A chunk ends
    behind a line where the rolling hash over it and the line before is 0 modulo ``spread``. That depends on these two lines alone, so lines put
    in or taken out elsewhere shift no boundary.
    """
    out, start, before = [], 0, 0
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line)
        if i and ((before * MIX + h) >> 17) % spread == 0:
            out.append((start, i + 1))
            start = i + 1
        before = h
    if start < len(lines):
        out.append((start, len(lines)))
    said = [i for i, line in enumerate(lines) if line.strip()]
    return sorted({*out, *((a, z + 1) for a, z in zip(said, said[1:]))})


def _passages(text: bytes, spread: int, least: int):
    """``(a, z, h, body)`` of the passages with ``least`` lines with words or more."""
    lines = text.split(b"\n")
    for a, z in chunks(text, spread):
        if z - a >= least and sum(1 for x in lines[a:z] if x.strip()) >= least:
            body = b"\n".join(lines[a:z])
            yield a, z, (xxhash.xxh3_64_intdigest(body) ^ SIGNED) - SIGNED, body


def _hash_batches(spread: int, least: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = [h for t in batch.column("text").slice(at, 1000).to_pylist() if t for _, _, h, _ in _passages(t, spread, least)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])

    return run


def _chunk_batches(spread: int, least: int, wanted: bytes):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    mask, shift = np.frombuffer(wanted, np.uint8), 64 - FILTER_BITS

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = tuple([] for _ in kinds)
                part = batch.slice(at, 1000)
                ids, hashes = part.column("doc_id").to_pylist(), part.column("th").to_pylist()
                for doc_id, th, text in zip(ids, hashes, part.column("text").to_pylist()):
                    for a, z, h, body in _passages(text or b"", spread, least):
                        p = (h & (1 << 64) - 1) >> shift
                        if mask[p >> 3] >> (p & 7) & 1:
                            for col, v in zip(out, (doc_id, th, a, z, h, body)):
                                col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "th", "a", "z", "h", "body"])

    return run


def _filter(hashes: DataFrame) -> bytes:
    """Bitmap of fixed size (2**22 bits) of the first bits of the hashes."""
    p = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(p).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits")).collect()
    size = 1 << 12  # bytes a bucket has
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in parts:
        out[(r.k - 1) * size : r.k * size] = r.bits
    return bytes(out)


def repeated_chunks(docs: DataFrame, spread: int = 4, least: int = 2) -> DataFrame:
    """``doc_id, th, a, z``: line ranges of the passages of :func:`chunks` with ``least`` lines with words or more that already stand elsewhere.

    A passage takes nothing at its first place, by doc_id (null last), text hash and line; where passages overlap, each line survives at its own first place.
    Hashes found once are left out before any text moves, by a bitmap that decides nothing. The rest is grouped by bytes, so equal hashes alone remove nothing; the group
    of a passage found millions of times is combined where it is read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    again = cut(texts.select("text").mapInArrow(_hash_batches(spread, least), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    rows = texts.mapInArrow(_chunk_batches(spread, least, _filter(again)), "doc_id long, th long, a int, z int, h long, body binary")
    rows = cut(rows.join(again, "h", "left_semi").select("doc_id", "th", "a", "z", "h", "body"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "a")
    bodies = rows.groupBy("h", "body").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    names = cut(bodies.groupBy("h").agg(F.count("*").alias("bodies"), F.max("n").alias("n"), F.min("first").alias("first")).where("n > 1"))
    found = rows.select("doc_id", "th", "a", "z", "h").join(names.where("bodies = 1").select("h", "first"), "h")
    clash = names.where("bodies > 1").select("h")
    if not clash.isEmpty():  # one hash, several bodies: told apart by their bytes
        both = rows.join(clash, "h")
        first = both.groupBy("h", "body").agg(F.min(place).alias("first"))
        found = found.unionByName(both.join(first, ["h", "body"]).select("doc_id", "th", "a", "z", "h", "first"))
    return found.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "a", "z")


def _remove(ranges: str, lines: str, removed: str):
    def run(batches):
        for batch in batches:
            texts, n_lines, n_gone = batch.column("text").to_pylist(), [], []
            for i, places in enumerate(batch.column(ranges).to_pylist()):
                n = texts[i].count("\n") + 1 if texts[i] else 0
                drop = set()
                for r in places or ():
                    drop.update(range(r["a"], r["z"]))
                if drop:
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
                n_lines.append(n), n_gone.append(len(drop))
            at = batch.schema.get_field_index("text")
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string())).drop_columns([ranges])
            out = out.append_column(lines, pa.array(n_lines, pa.int64()))
            yield out.append_column(removed, pa.array(n_gone, pa.int64()))

    return run


def _cleaned(docs: DataFrame, spread: int, least: int) -> tuple[DataFrame, str, str]:
    """``docs`` with repeated passages taken out of ``text``, and the names of two new columns: lines, and lines removed."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("ident")
    ranges, lines, removed = (fresh(docs, c) for c in ("gone_ranges", "n_lines", "n_removed_lines"))
    gone = repeated_chunks(docs, spread, least).distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "z")).alias(ranges))
    keyed = docs.select(whole(docs), ident, F.xxhash64("text").alias("th"))
    joined = keyed.join(gone.select(ident, "th", ranges), ["ident", "th"], "left").select("doc.*", ranges)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {lines} long, {removed} long"
    return joined.mapInArrow(_remove(ranges, lines, removed), schema), lines, removed


def without_repeats(docs: DataFrame, spread: int = 4, least: int = 2) -> DataFrame:
    """``docs`` with repeated passages of lines taken out of ``text``, and ``n_lines`` and ``n_removed_lines`` (in place of columns so named).

    Null text stays null, empty text empty; a row given twice (same id and text) counts as one document, and each keeps the same
    lines; rows with null ids come last in order, so they lose repeats first; other columns pass unchanged; an empty table gives no rows.
    """
    out, _, _ = _cleaned(docs.drop("n_lines", "n_removed_lines"), spread, least)
    return out


def deduped_documents(docs: DataFrame, spread: int = 4, least: int = 2) -> DataFrame:
    """The documents of :func:`without_repeats`, columns as given; one that had words and has none left is left out."""
    out, lines, removed = _cleaned(docs, spread, least)
    out = out.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(lines, removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
