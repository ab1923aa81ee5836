"""The difference-cover suffix array as Spark jobs: sorted triples of sampled positions, recursion on their names, a merge by counting.

Every step is a row per byte, so it suits corpora that are small beside the cluster. ``substrings`` finds the same repeats with far less data; the README
has measured figures of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut
from .substrings import result

UNIQUE = 257  # symbols from here on end a document and occur once


def counted(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``rows`` with ``set_before`` and ``clear_before``: how many rows with the flag set, and without it, come before in the order of ``keys`` (which are distinct, or ties
    are of no matter). Parts are ranges of the order; a part counts on its own, and the parts' totals are added up."""

    def run(batches):
        part, ones, zeros = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            f = batch.column(flag).to_numpy(zero_copy_only=False).astype(np.int64)
            before = ones + np.cumsum(f) - f
            other = zeros + np.cumsum(1 - f) - (1 - f)
            ones, zeros = ones + int(f.sum()), zeros + int((1 - f).sum())
            yield batch.append_column("part", pa.array(np.full(len(f), part, np.int32))).append_column("n_set", pa.array(before)).append_column("n_clear", pa.array(other))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    done = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{kinds}, part int, n_set long, n_clear long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    totals = done.groupBy("part").agg(F.count_if(flag).alias("ones"), F.count_if(~F.col(flag)).alias("zeros"))
    totals = totals.select("part", F.coalesce(F.sum("ones").over(before), F.lit(0)).alias("base_set"), F.coalesce(F.sum("zeros").over(before), F.lit(0)).alias("base_clear"))
    out = done.join(F.broadcast(totals), "part")
    return out.select(*rows.columns, (F.col("n_set") + F.col("base_set")).alias("set_before"), (F.col("n_clear") + F.col("base_clear")).alias("clear_before"))


def suffix_ranks(symbols: DataFrame, n: int) -> DataFrame:
    """``pos, rank`` (from 0) of the suffixes of ``symbols(pos, sym)``, positions 0 to ``n - 1``, symbols above 0, the last one found nowhere else.

    Positions that are 1 or 2 modulo 3 are the difference cover: their triples are sorted and named, and if names repeat, the string of names is ranked in the same
    way. A suffix at 0 modulo 3 is then its symbol and a ranked suffix; how many sampled suffixes come before it follows from two orders, one with each class.
    """
    near = symbols.select(F.explode(F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda k: F.struct((F.col("pos") - k).alias("pos"), k.alias("k"), F.col("sym").alias("sym")))).alias("x")).select("x.*")
    at = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("sym"))), F.lit(0)).alias(f"s{k}")
    near = cut(near.where("pos >= 0").groupBy("pos").agg(at(0), at(1), at(2)))
    sampled, triple = near.where("pos % 3 > 0"), ["s0", "s1", "s2"]
    names = counted(sampled.select(triple).distinct().withColumn("one", F.lit(True)), triple, "one").select(*triple, (F.col("set_before") + 1).alias("name"))
    named = cut(sampled.join(names, triple).select("pos", "name"))
    ones = (n + 1) // 3  # positions that are 1 modulo 3
    if named.agg(F.max("name")).first()[0] in (None, named.count()):
        ranks = named.select("pos", F.col("name").alias("r"))
    else:
        place = F.when(F.col("pos") % 3 == 1, F.expr("pos div 3")).otherwise(F.expr("pos div 3") + ones)
        inner = suffix_ranks(named.select(place.alias("pos"), F.col("name").alias("sym")), ones + n // 3)
        back = F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2)
        ranks = cut(inner.select(back.alias("pos"), (F.col("rank") + 1).alias("r")))
    shifted = lambda k: ranks.select((F.col("pos") - k).alias("pos"), F.col("r").alias(f"r{k}"))
    rows = near.select("pos", "s0", "s1").join(shifted(0), "pos", "left").join(shifted(1), "pos", "left").join(shifted(2), "pos", "left")
    rows = cut(rows.na.fill(0, ["r1", "r2"]).withColumn("free", F.col("pos") % 3 == 0))
    with_one = counted(rows.where("pos % 3 < 2").select("pos", "s0", "r1", "r0", "free"), ["s0", "r1"], "free")
    with_two = counted(rows.where("pos % 3 <> 1").select("pos", "s0", "s1", "r2", "r0", "free"), ["s0", "s1", "r2"], "free")
    free = with_one.where("free").join(with_two.where("free").select("pos", F.col("clear_before").alias("twos")), "pos")
    free = free.select("pos", (F.col("set_before") + F.col("clear_before") + F.col("twos")).alias("rank"))
    taken = with_one.where("not free").select("pos", "r0", "set_before").union(with_two.where("not free").select("pos", "r0", "set_before"))
    return cut(free.unionByName(taken.select("pos", (F.col("r0") - 1 + F.col("set_before")).alias("rank"))))


def _letters(size: int):
    """A row for every byte: its place, its symbol, and the ``size`` bytes from there on (null where the document ends before)."""

    def run(batches):
        for batch in batches:
            for start, k, text in zip(*(batch.column(c).to_pylist() for c in ("start", "k", "text"))):
                text = text or b""
                n = len(text)
                for a in range(0, n + 1, 4096):
                    z = min(n + 1, a + 4096)
                    sym = [x + 1 for x in text[a : min(z, n)]] + ([UNIQUE + k] if z == n + 1 else [])
                    body = [text[i : i + size] if i + size <= n else None for i in range(a, z)]
                    cols = [pa.array(range(start + a, start + z), pa.int64()), pa.array(sym, pa.int64()), pa.array([k] * (z - a), pa.int64()), pa.array(range(a, z), pa.int64()), pa.array(body, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["pos", "sym", "k", "at", "body"])

    return run


def _results(size: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, ats in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ats"))):
                text = text or b""
                hit = np.zeros(max(0, len(text) - size + 1), bool)
                hit[ats or []] = True
                out.append((doc_id, *result(text, hit, size)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """What ``substrings.remove_repeats`` gives, by the suffix array: neighbours in it are compared over ``size`` bytes, and of a run of equal ones all but the first place
    are covered. Documents are ordered by id, then by a hash of their text, null ids last; null texts are empty; rows given twice count as two."""
    order = Window.orderBy("none", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)  # a row a document: ids and lengths only
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumns({"none": F.col("doc_id").isNull(), "th": F.xxhash64("text")})
    known = cut(known.withColumn("row", F.monotonically_increasing_id()))
    places = known.select("row", "none", "doc_id", "th", (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long").alias("n"))
    places = places.select("row", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"), F.count("*").over(order).alias("k"), "n")
    table = cut(known.join(places, "row"))
    n = table.agg(F.sum("n")).first()[0]
    empty = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if not n:
        return known.select("doc_id", "text", F.array().cast("array<long>").alias("ats")).mapInArrow(_results(size), empty)
    letters = cut(table.select("start", "k", "text").mapInArrow(_letters(size), "pos long, sym long, k long, at long, body binary"))
    ranks = suffix_ranks(letters.select("pos", "sym"), n)
    ordered = letters.join(ranks, "pos").select("rank", "pos", "k", "at", "body")
    last = ordered.select((F.col("rank") + 1).alias("rank"), F.col("body").alias("before"))
    pairs = ordered.join(last, "rank", "left").select("rank", "pos", "k", "at", (F.col("body").isNull() | ~F.coalesce(F.col("body") == F.col("before"), F.lit(False))).alias("head"))
    runs = counted(pairs, ["rank"], "head").withColumn("run", F.col("set_before") + F.col("head").cast("long"))
    first = runs.groupBy("run").agg(F.min("pos").alias("first"), F.count("*").alias("m")).where("m > 1")
    covered = runs.join(first, "run").where("pos > first").groupBy("k").agg(F.collect_list("at").alias("ats"))
    return table.select("doc_id", "text", "k").join(covered, "k", "left").select("doc_id", "text", "ats").mapInArrow(_results(size), empty)
