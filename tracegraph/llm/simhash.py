"""SimHash near-dedup over a Gray-ordered index of masked bit patterns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, cut

ALL = (1 << 64) - 1
FINE = 16  # bits of one level inside a bucket


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; the whole sequence if it is shorter, none without a word."""
    w = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], np.uint64)


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of ``h``; none gives 0."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of word shingles by XXH64 (seed 42): a bit is 1 if set in over half the hashes; no word gives 0."""
    return majority(shingle_hashes(text, words))


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            fps = [signed(fingerprint(t or b"", words)) for t in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("fp", pa.array(fps, pa.int64()))

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row, null text like an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def submasks(mask: int, diff: int) -> list[int]:
    """Masks under ``mask``'s free bits: ``diff + 2`` blocks of them, two blocks fixed. Of two patterns that
    differ in at most ``diff`` free bits, one of these finds them equal."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    parts = [p for p in np.array_split(free, diff + 2) if len(p)]
    return [mask | sum(1 << int(b) for p in pair for b in p) for pair in combinations(parts, 2)]


def gray_rank(fp: Column) -> Column:
    """Place of the pattern in Gray order (neighbours differ in one bit), shifted to sort as signed."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(signed(1 << 63)))


def bucket_links(key: np.ndarray, fp: np.ndarray, diff: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that span the connected parts of each bucket, at ``diff`` differing bits or fewer.

    ``key``: bucket of each row, rows of a bucket together in Gray order, so that rows with the same leading bits
    are one run. The runs of 16, 32, 48 and 64 leading bits are the levels of a tree; two nodes
    are compared on their own 16 bits, and a pair whose differences so far exceed ``diff`` is dropped with all
    that lies below it.
    """
    n = len(fp)
    starts = [np.flatnonzero(np.r_[True, key[1:] != key[:-1]])]
    for bits in range(FINE, 65, FINE):
        top = fp >> np.uint64(64 - bits)
        starts.append(np.flatnonzero(np.r_[True, (top[1:] != top[:-1]) | (key[1:] != key[:-1])]))
    a = b = np.arange(len(starts[0]))
    acc = np.zeros(len(a), np.int64)
    for level in range(1, len(starts)):
        here = starts[level]
        first = np.searchsorted(here, starts[level - 1])
        count = np.diff(np.r_[first, len(here)])
        own = (fp[here] >> np.uint64(64 - level * FINE)) & np.uint64((1 << FINE) - 1)
        pa_, pb_, pacc = [], [], []
        size = count[a] * count[b]
        ends = np.cumsum(size)
        at = 0
        while at < len(a):  # pairs of nodes by the million, not all at once
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
            x, y, s = a[at:to], b[at:to], size[at:to]
            rep = np.repeat(np.arange(len(x)), s)
            inner = np.arange(len(rep)) - np.repeat(np.cumsum(s) - s, s)
            i = first[x][rep] + inner // count[y][rep]
            j = first[y][rep] + inner % count[y][rep]
            d = acc[at:to][rep] + np.bitwise_count(own[i] ^ own[j])
            ok = (d <= diff) & (i <= j)
            pa_.append(i[ok]), pb_.append(j[ok]), pacc.append(d[ok])
            at = to
        a, b, acc = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (pa_, pb_, pacc))
    last = starts[-1]
    a, b = last[a], last[b]
    a, b = a[a != b], b[a != b]
    label = np.arange(n)
    while True:  # smallest position reachable
        new = label.copy()
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    x = np.flatnonzero(label != np.arange(n))
    return label[x], x


def _link_batches(diff: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(t):
            b, v = (t.column(c).to_numpy() for c in ("bucket", "fp"))
            key = np.r_[0, np.cumsum((b[1:] != b[:-1]))]
            i, j = bucket_links(key, v.view(np.uint64), diff)
            return pa.RecordBatch.from_arrays([pa.array(v[i]), pa.array(v[j])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held).combine_chunks()
            b = t.column("bucket").to_numpy()
            other = np.flatnonzero(b != b[-1])
            cut_at = int(other[-1]) + 1 if len(other) else 0
            if cut_at:  # the last bucket may go on in the next batch
                yield solve(t.slice(0, cut_at))
            held = t.slice(cut_at).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def hamming_links(fps: DataFrame, diff: int = 4, most: int = 1024) -> DataFrame:
    """Links ``(a, b)`` of distinct patterns ``fps(fp)`` whose connected components are those at ``diff`` bits or fewer.

    Upper nodes of the index are masked bit patterns shared by many rows: each pattern is filed under the masks
    that fix two of ``diff + 2`` blocks of its bits, so that any close pair meets under one. A node of more than
    ``most`` rows is divided in the same way over its free bits, level by level; with fewer than log2(most) free bits it
    cannot hold more. So no task gets an unbounded node and no pair is lost. Inside a node see :func:`bucket_links`.
    """
    assert most >= 1 << (diff + 2)  # below that two blocks need not be equal
    spark = fps.sparkSession
    todo = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    masks, out = [0], None
    while True:
        table = [(signed(m), [signed(s) for s in submasks(m, diff)]) for m in masks]
        named = F.broadcast(spark.createDataFrame(table, "mask long, subs array<long>"))  # at most 15 ** level rows
        if len(masks) == 1:
            deeper = todo.select("fp", F.explode(F.array(*map(F.lit, table[0][1]))).alias("mask"))
        else:
            deeper = todo.join(named, "mask").select("fp", F.explode("subs").alias("mask"))
        deeper = deeper.distinct() if len(masks) > 1 else deeper
        # a node's name: mask and pattern under it, as one number (two nodes that share it only cost time)
        rows = deeper.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        masks = sorted({s for m in masks for s in submasks(m, diff)})
        full = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        rows = cut(rows.join(full, "bucket"))
        small = rows.where(F.col("n") <= most).select("bucket", "fp", gray_rank(F.col("fp")).alias("g"))
        links = small.repartition("bucket").sortWithinPartitions("bucket", "g").mapInArrow(_link_batches(diff), "a long, b long")
        links = cut(links.distinct())
        out = links if out is None else out.unionByName(links)
        todo = rows.where(F.col("n") > most).select("fp", "mask")
        if todo.isEmpty():
            return out.distinct()


def near_duplicates(docs: DataFrame, words: int = 4, diff: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Documents whose fingerprints are connected by steps of at most ``diff`` bits form a component; its id is the smallest
    doc_id in it. Equal fingerprints are one node, so groups of copies of any size cost one row each. Texts without a
    word (null and empty ones too) have fingerprint 0 and are linked like any other. Null doc_ids get their
    component's id, null if no member has one; repeated rows stay; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, words))
    # a node is the smallest doc_id; with null ids only, a number above all ids made of the pattern's low 62 bits
    # (two such patterns share it only if they differ in 2 bits at most, and are linked anyway)
    spare = F.col("fp").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    own = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("rep", F.coalesce("rep", spare)))
    links = hamming_links(own.select("fp"), diff)
    edges = links.join(own.toDF("a", "ra"), "a").join(own.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    label = components(edges)
    named = own.join(label, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("label", "rep").alias("c"))
    named = named.select("fp", F.when(F.col("c") < 1 << 62, F.col("c")).alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

