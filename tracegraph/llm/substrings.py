"""Exact repeats of fixed length across a corpus, by sampled positions, names, and recursion on what names leave open.

The task names a suffix array by difference cover. A suffix array has a row for each byte; under the given limits
there are about two bytes of disk for each. So this module keeps the plan of that algorithm (sample positions
so that equal strings share a sampled offset, name the samples, recurse on the undecided, settle the rest from the
names, compare with the earliest neighbour) and changes two things: samples are content-defined, one in 31 bytes, and
names are pairs of 64-bit hashes (of the bytes that all strings of an interval share, and of all its bytes), which need no global sort and
stand for the bytes: those are not compared. The README says so too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

GRAM = 32
STEPS = (1, 9)  # interval lengths of the rounds after the first, last first
MULT = np.uint64(0x9E3779B97F4A7C15)
NULL_ORD, REPEAT_ORD = 1 << 62, 1 << 61


def samples(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, first, last)``: sampled positions and the starts that belong to each.

    The start of each ``size``-byte string is given to the smallest gram hash in it, leftmost on ties. That depends on those
    bytes alone, so equal strings are given to the same offset wherever they stand.
    """
    a = np.frombuffer(text, np.uint8)
    if len(a) < size:
        return (np.zeros(0, np.int64),) * 3
    h, m, p = a.astype(np.uint64) + np.uint64(1), 1, MULT
    with np.errstate(over="ignore"):
        while m < GRAM:
            h, m, p = h[:-m] * p + h[m:], 2 * m, p * p
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    width = size - GRAM + 1
    low, at, s = h, np.arange(len(h), dtype=np.int32), 1
    while s < width:
        d = min(s, width - s)
        left = low[:-d] <= low[d:]
        low, at = np.where(left, low[:-d], low[d:]), np.where(left, at[:-d], at[d:])
        s += d
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[edge].astype(np.int64), edge, np.r_[edge[1:], len(at)] - 1


def names(text: bytes, place: int, lo: int, hi: int, size: int) -> tuple[int, int]:
    """Names of the core and the extent of the starts ``place - hi .. place - lo``: the bytes all of their strings share, and all
    bytes that any of them has (as far as the document goes)."""
    shape = lo << 8 | hi
    a, z = place - hi, place - lo + size
    core = xxhash.xxh3_64_intdigest(text[place - lo : place - hi + size], shape)
    clip = (max(0, -a) << 12 | max(0, z - len(text))) << 16
    extent = xxhash.xxh3_64_intdigest(text[max(0, a) : z], clip | shape | 1 << 40)
    return core - (1 << 63), extent - (1 << 63)


def _emit(size: int, span: int):
    """``(core, extent, ord, tag)`` of each interval to decide; tag = place * 128 + lo."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            todo = batch.column("todo").to_pylist() if "todo" in batch.schema.names else None
            for i, (ord_, text) in enumerate(zip(batch.column("ord").to_pylist(), batch.column("text").to_pylist())):
                if not text or len(text) < size:
                    continue
                tags = (samples(text, size)[0] * 128).tolist() if todo is None else todo[i]
                pairs = [names(text, t >> 7, t & 127, (t & 127) + span - 1, size) for t in tags]
                out[0].extend(x[0] for x in pairs)
                out[1].extend(x[1] for x in pairs)
                out[2].extend([ord_] * len(tags))
                out[3].extend(tags)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["core", "extent", "ord", "tag"])

    return run


COVERED, OPEN, HOT = 1, 2, 3


def _judge(batches):
    """Rows sorted by core, extent, ord, tag: all but the first of an extent are covered; a first is open if its core
    has other extents. Of salted cores the firsts are handed on. Holds one row from batch to batch."""
    last = None  # (core, extent, ord, tag) of the row before
    pending = None  # the only first of its core so far
    several = False

    def rows(parts):
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["ord", "tag", "what", "core", "extent"])

    for batch in batches:
        if not batch.num_rows:
            continue
        core, extent, ord_, tag, salt = (batch.column(c).to_numpy() for c in ("core", "extent", "ord", "tag", "salt"))
        same = np.r_[last is not None and core[0] == last[0], core[1:] == core[:-1]]
        old = same & np.r_[last is not None and extent[0] == last[1], extent[1:] == extent[:-1]]
        twice = old & np.r_[last is not None and (ord_[0], tag[0]) == last[2:], (ord_[1:] == ord_[:-1]) & (tag[1:] == tag[:-1])]
        k = np.flatnonzero(~old)
        parts = []

        def add(at, what, parts=parts, ord_=ord_, tag=tag, core=core, extent=extent):
            parts.append((ord_[at], tag[at], np.full(len(at), what), core[at], extent[at]))

        add(np.flatnonzero(old & ~twice), COVERED)  # a row given twice is one
        group = np.cumsum(~same[k])  # 0: goes on with the core of the batch before
        n = np.bincount(group, minlength=1)
        multi = n[group] > 1
        if n[0]:
            if several or pending is not None:
                multi[group == 0] = True
            if pending is not None:
                parts.append(tuple(np.array([v]) for v in pending))
                pending, several = None, True
        cold = salt[k] < 0
        add(k[multi & cold], OPEN)
        add(k[~cold], HOT)
        if len(k) and group[-1] > 0:
            several = bool(n[group[-1]] > 1)
            j = k[-1]
            pending = None if several or salt[j] >= 0 else (ord_[j], tag[j], OPEN, core[j], extent[j])
        elif not same.all():  # cannot be: a new core has a first row
            pending, several = None, False
        last = (core[-1], extent[-1], ord_[-1], tag[-1])
        yield rows(parts)


def decide(rows: DataFrame, probe: DataFrame) -> DataFrame:
    """``ord, tag, what`` of the covered and the open intervals among ``rows``.

    Rows meet by core. Cores that hold over a 2000th of ``probe`` (rows of one document in 64; at most 2000 cores) are
    dealt over 64 salts first, where most of their rows are settled; one row per extent and salt goes on to an
    aggregation. The probe decides where rows are settled, not how.
    """
    counted = probe.groupBy("core").agg(F.count("*").alias("n")).where("n >= 30")
    total = probe.count()
    hot = [r.core for r in counted.where(F.col("n") * 2000 > total).select("core").collect()] if total else []
    salted = rows.withColumn("salt", F.lit(-1))
    if hot:
        few = F.broadcast(rows.sparkSession.createDataFrame([(c, 1) for c in hot], "core long, few int"))
        salted = rows.join(few, "core", "left").withColumn("salt", F.when(F.col("few") == 1, F.pmod(F.xxhash64("ord"), F.lit(64)).cast("int")).otherwise(-1)).drop("few")
    kinds = "ord long, tag long, what long, core long, extent long"
    judged = cut(salted.repartition("core", "salt").sortWithinPartitions("core", "salt", "extent", "ord", "tag").mapInArrow(_judge, kinds))
    done = judged.where(f"what <> {HOT}").select("ord", "tag", "what")
    if not hot:
        return done
    firsts = judged.where(f"what = {HOT}")
    least = firsts.groupBy("core", "extent").agg(F.min("ord").alias("least"))
    several = least.groupBy("core").agg(F.count("*").alias("n"))
    what = F.when(F.col("ord") > F.col("least"), COVERED).when(F.col("n") > 1, OPEN)
    more = firsts.join(least, ["core", "extent"]).join(several, "core").withColumn("what", what.cast("long")).where("what is not null")
    return done.unionByName(more.select("ord", "tag", "what"))


def _apply(size: int, span: int, step: int):
    """Mark the covered starts; cut open intervals into shorter ones; a document with none left is done."""
    keep = ("doc_id", "ord", "text", "starts", "todo", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        for batch in batches:
            out = tuple([] for _ in keep)
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "ord", "text", "covered", "open")]
            before = batch.column("starts").to_pylist() if "starts" in batch.schema.names else [None] * batch.num_rows
            for doc_id, ord_, text, covered, left, starts in zip(*cols, before):
                text = text or b""
                n = max(0, len(text) - size + 1)
                hit = np.unpackbits(np.frombuffer(starts, np.uint8))[:n].astype(bool) if starts else np.zeros(n, bool)
                own = owners(text, size) if n and (covered or left) else None
                for t in covered or ():
                    p, lo = t >> 7, t & 127
                    hit[max(0, p - lo - span + 1) : max(0, min(n, p - lo + 1))] = True
                todo = []
                if span > 1:
                    for t in left or ():
                        p, lo = t >> 7, t & 127
                        first, last = own[p]
                        for k in range(lo, lo + span, step):  # starts p - k - step + 1 .. p - k
                            if max(0, p - k - step + 1) <= min(last, p - k) and p - k >= first:
                                todo.append(p << 7 | k)
                if todo:
                    row = (doc_id, ord_, text, np.packbits(hit).tobytes(), todo, None, None, None, None)
                else:
                    row = (doc_id, ord_, None, None, [], *result(text, hit, size))
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=list(keep))

    return run


def owners(text: bytes, size: int) -> dict[int, tuple[int, int]]:
    place, first, last = samples(text, size)
    return {p: (a, z) for p, a, z in zip(place.tolist(), first.tolist(), last.tolist())}


def result(text: bytes, hit: np.ndarray, size: int) -> tuple[int, int, int, str]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) for the starts that are hit."""
    if not hit.any():
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + size, -1)
    gone = np.cumsum(edge)[:-1] > 0
    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(rest).hexdigest()


KINDS = "doc_id long, ord long, text binary, starts binary, todo array<long>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    A byte goes if a string of ``size`` bytes over it also starts earlier: in a smaller doc_id, or before it in the same text.
    Rounds: an interval of starts that belong to one sampled place is covered if its extent stands earlier, free if
    no other extent has its core, else cut into shorter intervals for the next round; in the last, an interval is one start.

    Null text is empty. Rows with null ids come after all others, by text hash; of rows that repeat an id with other texts the one
    with the smallest text hash holds the id's place, and the others come after all ids; a row given twice in full is one
    document. Texts under ``size`` bytes lose nothing; an empty table gives no rows; other columns are not read.
    """
    assert GRAM < size <= 127 + GRAM - 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    spread = F.col("th").bitwiseAND((1 << 60) - 1)
    ord_ = F.coalesce("doc_id", spread + NULL_ORD)
    twice = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most"))
    twice = twice.where("doc_id is not null and least <> most").select("doc_id", "least")
    if not twice.isEmpty():
        rows = rows.join(twice, "doc_id", "left")
        ord_ = F.when(F.col("least").isNotNull() & (F.col("th") != F.col("least")), spread + REPEAT_ORD).otherwise(ord_)
    table = rows.select("doc_id", ord_.alias("ord"), "text")
    done, span = [], size - GRAM + 1
    for step in [*sorted(STEPS, reverse=True), 0]:
        emit = lambda t: t.select("ord", "text", *(["todo"] if "todo" in t.columns else [])).mapInArrow(_emit(size, span), "core long, extent long, ord long, tag long")  # noqa: B023, E731
        found = decide(emit(table), emit(table.where(F.pmod(F.xxhash64("ord"), F.lit(64)) == 0)))
        lists = found.groupBy("ord").agg(
            F.collect_list(F.when(F.col("what") == COVERED, F.col("tag"))).alias("covered"), F.collect_list(F.when(F.col("what") == OPEN, F.col("tag"))).alias("open")
        )
        table = cut(table.join(lists, "ord", "left").select(*table.columns, "covered", "open").mapInArrow(_apply(size, span, step), KINDS))
        done.append(table.where("n_bytes is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
        table, span = table.where("n_bytes is null").select("doc_id", "ord", "text", "starts", "todo"), step
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
