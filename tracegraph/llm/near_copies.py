"""Near copies at a shingle similarity: the Gray-ordered index of SimHash fingerprints and shared bands file texts together, an exact check decides.

At a similarity of 0.8 two 64-bit fingerprints differ in 10 bits or so, up to 19, too many for an index of bit patterns
to lose no pair. What the index links at ``GRAY_BITS`` is checked first; bands of MinHash values find the pairs beyond it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, cut
from .simhash import hamming_links, majority, shingle_hashes, signed

BANDS, ROWS = 20, 4  # a pair at 0.8 shares no band with probability 3e-5
GRAY_BITS = 4  # of 64, as in ``near_duplicates``
WIDE = 4  # SimHash words of 64 bits
NEAR_BITS = 62  # of 256; at 0.8 the mean is 39, the deviation 5.7
FEW = 32  # below so many shingles the pattern says too little and prunes nothing
_seeds = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
TIMES, PLUS = _seeds[0] | np.uint64(1), _seeds[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(text: bytes, words: int) -> tuple[bytes, int, list[int], list[int]]:
    """(name of the shingle set, its size, a key per band, the wide pattern)."""
    h = np.unique(shingle_hashes(text, words))
    name = xxhash.xxh3_128_digest(h.tobytes())
    if not len(h):
        return name, 0, [], [0] * WIDE
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 2048):  # memory stays bounded for long texts
        low = np.minimum(low, (h[at : at + 2048, None] * TIMES + PLUS).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    wide = [signed(majority(mixed(h + np.uint64(k)))) for k in range(WIDE)]
    return name, len(h), keys.view(np.int64).tolist(), wide


SKETCH = "doc_id long, name binary, n int, bands array<long>, wide array<long>"


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            done = [sketch(t or b"", words) for t in batch.column("text").to_pylist()]
            kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            cols = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "name", "n", "bands", "wide"])

    return run


def _similar(words: int, similarity: float):
    def run(batches):
        last, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            ok = []
            for x, y in zip(ta, tb):
                if x != last:
                    last, first = x, np.unique(shingle_hashes(x or b"", words))
                second = np.unique(shingle_hashes(y or b"", words))
                both = len(np.intersect1d(first, second, assume_unique=True))
                ok.append(both >= similarity * (len(first) + len(second) - both) - 1e-9)
            keep = [k for k, good in enumerate(ok) if good]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in keep], pa.int64()) for c in (a, b)], names=["a", "b"])

    return run


def similar(pairs: DataFrame, docs: DataFrame, words: int, similarity: float, fan: int = 1000) -> DataFrame:
    """Those of ``pairs(a, b)`` of ids whose whole texts have a shingle similarity of ``similarity`` or more.

    An ``a`` with more than ``fan`` partners is dealt over several tasks; each gets its text once.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("t"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).cast("int").alias("parts"))
    heads = parts.join(texts, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("t").alias("ta"))
    tails = pairs.join(parts, "a").join(texts, F.col("b") == F.col("id"))
    tails = tails.select("a", "b", F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"), F.col("t").alias("tb"))
    return cut(tails.join(heads, ["a", "part"]).mapInArrow(_similar(words, similarity), "a long, b long").distinct())


def could_be(x: str, y: str, similarity: float) -> Column:
    """Sizes and patterns (columns ``n``, ``wide`` of structs ``x`` and ``y``) allow the similarity."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    bits = sum(F.bit_count(F.col(f"{x}.wide")[k].bitwiseXOR(F.col(f"{y}.wide")[k])) for k in range(WIDE))
    return (small >= similarity * large) & ((small < FEW) | (bits <= NEAR_BITS))


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [np.unique(shingle_hashes(t or b"", words)).tobytes() for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def forest(node: np.ndarray, lab: np.ndarray, sets: list[np.ndarray], query: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that hold and join components: each row of ``query`` is compared with the rows outside its component.

    Rows are sets of numbers. A link that is found joins two components at once, so there are fewer links than components,
    however many pairs are similar.
    """
    n = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(n)]
    _, comp = np.unique(lab, return_inverse=True)
    here, out = np.zeros(code.max(initial=0) + 1, bool), []
    rest = np.flatnonzero(~query)
    for q in np.flatnonzero(query):
        to = rest[(comp[rest] != comp[q]) & (np.minimum(n[rest], n[q]) >= similarity * np.maximum(n[rest], n[q]))]
        if not len(to):
            continue
        own = code[start[q] : start[q + 1]]
        here[own] = True
        for at in range(0, len(to), 256):
            some = to[at : at + 256]
            ends = np.cumsum(n[some])
            hit = here[code[np.arange(ends[-1]) + np.repeat(start[some] - (ends - n[some]), n[some])]]
            both = np.add.reduceat(hit, ends - n[some], dtype=np.int64)
            for k in some[both >= similarity * (n[q] + n[some] - both) - 1e-9]:
                if comp[k] != comp[q]:
                    out.append((int(node[q]), int(node[k])))
                    comp[comp == comp[k]] = comp[q]
        here[own] = False
    return out


def _forests(similarity: float):
    """The links of :func:`forest` in each bucket and pair of blocks; rows of one are together."""

    def solve(t):
        node, lab, query = (t.column(c).to_numpy() for c in ("node", "lab", "query"))
        found = []
        if query.any() and not query.all():
            sets = [np.frombuffer(b, np.uint64) for b in t.column("shingles").to_pylist()]
            found = forest(node, lab, sets, query, similarity)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            for x, y in zip(starts[:-1], starts[1:]):
                yield solve(t.slice(x, y - x))
            held = t.slice(starts[-1]).to_batches()  # may go on in the next batch
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def gray_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes(node, s)`` that the Gray-ordered index links: one of each fingerprint with those of the same, and those of linked fingerprints. The
    fingerprint is the first word of the wide pattern."""
    filed = nodes.select("node", F.col("s.wide")[0].alias("fp"))
    one = cut(filed.groupBy("fp").agg(F.min("node").alias("rep")))
    same = filed.join(one, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = hamming_links(one.select("fp"), GRAY_BITS)
    ends = links.join(one.toDF("a", "ra"), "a").join(one.toDF("b", "rb"), "b").where("ra <> rb")
    return same.unionByName(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = 1 << 20) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``: components of texts linked at ``similarity`` or more.

    The similarity of two texts is that of their sets of word shingles (common over all); every link is checked on the
    whole sets. Equal sets are one node, so copies cost one row each. First what the Gray-ordered index links is checked, and every node of a bucket
    against the bucket's first node, where sizes and SimHash patterns allow it. Nodes that are not in its component after that are set
    aside and compared with all rows of the bucket outside their component, by the sets themselves and without a prune; a bucket
    gives fewer links than it has rows. A bucket with more than ``most`` shingles is dealt over several tasks, one for each block of
    rows set aside and block of all rows. Texts without a word are copies of one another. Rows with null ids link nothing
    and get a null component; rows that repeat an id are one document; an empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    known = plain.where("doc_id is not null")
    rows = cut(known.mapInArrow(_sketches(words), SKETCH))
    first = rows.groupBy("name").agg(F.min(F.struct("doc_id", "n", "wide", "bands")).alias("x"))
    nodes = first.select("name", F.col("x.doc_id").alias("node"), F.struct("x.n", "x.wide").alias("s"), F.col("x.bands").alias("bands"))
    nodes = cut(nodes.withColumn("o", F.xxhash64("node", "name")))  # an id may stand under several names, each a node
    rows = cut(rows.select("doc_id", "name").distinct().join(nodes.select("name", "node"), "name").select("doc_id", "node"))
    filed = nodes.select("o", F.explode("bands").alias("bucket"))
    groups = filed.groupBy("bucket").agg(F.min("o").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m")
    shared = cut(filed.join(groups, "bucket"))

    ends = nodes.select("o", "node", "s")
    pairs = shared.where("o <> head").select("o", "head").distinct().join(ends, "o")
    pairs = pairs.join(ends.toDF("head", "head_node", "head_s"), "head").where(could_be("s", "head_s", similarity) & (F.col("node") != F.col("head_node")))
    pairs = pairs.select(F.col("head_node").alias("a"), F.col("node").alias("b"))
    pairs = cut(pairs.unionByName(gray_pairs(nodes.where("s.n > 0"))).distinct())
    links = similar(pairs, known, words, similarity)
    # an id that stands under several names ties them together
    ties = rows.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    label = components(links.union(ties))

    where = ends.join(label, "node", "left").select("o", "node", F.coalesce("label", "node").alias("lab"), "s.n")
    put = shared.join(where, "o").join(where.select(F.col("o").alias("head"), F.col("lab").alias("head_lab")), "head")
    put = put.select("bucket", "node", "lab", "n", (F.col("lab") != F.col("head_lab")).alias("aside"))
    blocks = lambda c: F.ceil(F.sum(c) / most).cast("int")
    sizes = put.groupBy("bucket").agg(blocks("n").alias("all_"), blocks(F.when(F.col("aside"), F.col("n"))).alias("apart")).where("apart > 0")
    put = cut(put.join(sizes, "bucket"))
    texts = known.select(F.col("doc_id").alias("node"), F.col("text").alias("t")).join(put.select("node").distinct(), "node", "left_semi")
    sets = texts.mapInArrow(_sets(words), "node long, shingles binary")
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    flat = ["bucket", "i", "j", "node", "lab", "query"]
    asked = put.where("aside").withColumns({"i": dealt("apart"), "j": F.explode(every("all_")), "query": F.lit(True)}).select(flat)
    stand = put.withColumns({"i": F.explode(every("apart")), "j": dealt("all_"), "query": F.lit(False)}).select(flat)
    both = asked.union(stand).join(sets, "node").select(*flat, "shingles").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "query", "node")
    more = cut(both.mapInArrow(_forests(similarity), "a long, b long"))
    label = components(links.union(ties).union(more))

    named = rows.groupBy("doc_id").agg(F.min("node").alias("node")).join(label, "node", "left").select("doc_id", F.coalesce("label", "node").alias("component_id"))
    return plain.select("doc_id").join(named, "doc_id", "left")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest. Rows that repeat an id are one document; null ids stay."""
    found = near_copies(docs, **parameters)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
