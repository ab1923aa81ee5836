"""Mixing sources to target weights: a golden-ratio schedule joined with shuffled blocks of equal tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, host_key, whole

BITS = 40
UNIT = 1 << BITS
GOLDEN = int((5**0.5 - 1) / 2 * UNIT) | 1  # frac(golden ratio) in 40 bits; odd, so that points repeat only after 2**40
GRID = 1 << 12


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null gives 0."""
    plain = F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))
    spaces = F.length(plain) - F.length(F.translate(plain, " ", ""))
    return F.coalesce(F.when(plain == "", 0).otherwise(spaces + 1), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: words by weight, at most ``max_epochs`` x each source's size.

    Sources by code point, null last, take the weights in turn. What a full source cannot take is shared
    again by weight; the fixpoint is a water level ``least(cap, level x weight)``, found by a running sum over
    sources ordered by cap / weight. One row per source: the only ordered pass is over that table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    which = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), which + 1)
    every = Window.partitionBy()
    first = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("full", F.coalesce(F.sum("cap").over(first), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(first), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / (F.col("all_weight") - F.col("used")))
        # the level is the first that the next cap reaches; it falls no more behind that
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "weight", "target", "total")
    )


def placed(rows: DataFrame, bucket_bits: int = 12) -> DataFrame:
    """``rows(doc_id, skey, size, h)`` with ``start``: the row's first word in its source's shuffled stream.

    The order is by ``h``, a hash in hex. A source of any size is cut at the first ``bucket_bits`` bits of
    it; only bucket sums are added up per source, and rows only inside their bucket.
    """
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), 16 - bucket_bits))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["skey", "bucket"])
        .withColumn("start", F.col("base") + F.col("inner"))
        .drop("h", "bucket", "inner", "base")
    )


def point(slot: Column) -> Column:
    """frac(slot x golden ratio) x 2**40, in longs that do not overflow below slot 2**43."""
    high, low = F.shiftright(slot, 20), slot.bitwiseAND((1 << 20) - 1)
    return F.pmod(F.pmod(high * ((GOLDEN << 20) % UNIT), F.lit(UNIT)) + F.pmod(low * GOLDEN, F.lit(UNIT)), F.lit(UNIT))


def schedule(targets: DataFrame, block: int = 256, run: int = 1 << 16) -> DataFrame:
    """The order of the mix from ``targets(skey, target)``: ``(slot, skey, rank, words)``, one block of words a slot.

    A slot's golden-ratio point falls on the source whose stretch of the cumulative targets holds it,
    found by an equal join on a grid over [0, 1) that every stretch is laid out on. A source's slots are
    ranked; ranks beyond its target are left out, the last is trimmed, and the few (logarithmic in the number of slots)
    that the points leave missing follow at the end. Ranks come from counts of runs of ``run`` slots,
    so no source is counted in one task.
    """
    every, order = Window.partitionBy(), Window.orderBy("skey")
    share = (
        targets.where("target >= 1")
        .select("skey", F.floor("target").cast("long").alias("want"))
        .withColumn("blocks", F.ceil(F.col("want") / block).cast("long"))
        .withColumn("n", F.sum("blocks").over(every))
        .withColumn("high", F.floor(F.sum("want").over(order) / F.sum("want").over(every) * UNIT).cast("long"))
        .withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0)))
    )
    cell = UNIT // GRID
    cells = share.where("high > low").select(
        "skey", "low", "high", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))).alias("cell")
    )
    runs = share.agg(F.max("n").alias("n")).where("n > 0")
    runs = runs.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {run}"))).alias("run")).repartition("run")
    slots = runs.select("run", F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, F.col("n")) - 1)).alias("slot"))
    slots = slots.withColumn("point", point(F.col("slot"))).withColumn("cell", F.expr(f"point div {cell}"))
    # merge hints: the planner takes exploded sequences for tiny and would broadcast them; they grow with the data
    hit = slots.hint("merge").join(cells, "cell").where("point >= low and point < high").select("skey", "run", "slot")
    counts = hit.groupBy("skey", "run").agg(F.count("*").alias("c"))
    before = Window.partitionBy("skey").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("skey", "run", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("skey", "run").orderBy("slot")
    ranked = hit.withColumn("inner", F.row_number().over(inside) - 1).hint("merge").join(base, ["skey", "run"])
    ranked = ranked.select("skey", "slot", (F.col("base") + F.col("inner")).alias("rank"))
    have = share.join(counts.groupBy("skey").agg(F.sum("c").alias("c")), "skey", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    missing = have.where("c < blocks").select("skey", "n", F.explode(F.sequence(F.col("c"), F.col("blocks") - 1)).alias("rank"))
    ranked = ranked.unionByName(missing.select("skey", (F.col("n") + F.col("rank")).alias("slot"), "rank"))
    want = ranked.hint("merge").join(share.select("skey", "want"), "skey").where(F.col("rank") * block < F.col("want"))
    return want.select("slot", "skey", "rank", F.least(F.lit(block), F.col("want") - F.col("rank") * block).alias("words"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, block: int = 256, seed: str = "mix"
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, first_slot`` for every row of ``docs``: the words that the mix takes of it, and
    where in the mix the first of them stands.

    Each source's documents, shuffled by a seeded hash, form a stream that starts again at its end, at
    most ``max_epochs`` times; the schedule takes its blocks of ``block`` words in order. A source's taken
    words are its target's whole part. Read by ``first_slot`` (null where nothing is taken) the mix keeps near the target weights from the first
    slots on. Null source is a source of its own, last in order; null text has size 0 and
    is never taken; null ids and repeated rows are placed like others; an empty table gives no rows.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", host_key("source").alias("skey"), word_count().alias("size"),
        F.md5(F.concat(ident, F.lit(f":{seed}"))).alias("h"),
    )
    rows = cut(rows)
    sizes = rows.groupBy("source", "skey").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, max_epochs).withColumn("skey", host_key("source")))
    slots = schedule(targets, block)
    at = placed(rows.drop("source")).join(targets.select("skey", "source", "source_size", "target"), "skey")
    first = lambda e: F.col("start") + e * F.col("source_size")
    epochs = F.floor(F.floor("target") / F.col("source_size")).cast("long")
    parts = (
        at.where("size > 0 and target >= 1")
        .select("skey", "start", "size", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), epochs)).alias("epoch"))
        .select("skey", "start", first(F.col("epoch")).alias("a"), (first(F.col("epoch")) + F.col("size")).alias("z"))
        .withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(z - 1) div {block}"))))
        .join(slots.hint("merge"), ["skey", "rank"])
        .withColumn("took", F.least(F.col("z"), F.col("rank") * block + F.col("words")) - F.greatest(F.col("a"), F.col("rank") * block))
        .where("took > 0")
        .groupBy("skey", "start")
        .agg(F.sum("took").alias("taken"), F.min("slot").alias("first_slot"))
    )
    out = at.join(parts.hint("merge"), ["skey", "start"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    slot = F.when(F.col("size") > 0, F.col("first_slot"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), slot.alias("first_slot"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix: given columns, then ``size, source_size, target, taken, first_slot`` (in place of columns so named); documents with ``taken`` 0 are out.

    Rows that share id, source and size get the largest take and the first slot among them.
    """
    ident, key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("ident"), ["ident", "skey", "size"]
    new = ["size", "source_size", "target", "taken", "first_slot"]
    took = mix(docs, **parameters).where("taken > 0").select(ident, host_key("source").alias("skey"), *new)
    took = took.groupBy(*key).agg(*(F.max(c).alias(c) for c in new[1:4]), F.min("first_slot").alias("first_slot"))
    named = docs.select(whole(docs.drop(*new)), ident, host_key("source").alias("skey"), word_count().alias("size"))
    return named.join(took, key).select("doc.*", *new)
