"""Profiles of other tools as trace events, and frames as their documents.

A document is one row (``doc``, ``value``: its JSON text); its arrays are exploded at once, so a document's size bounds a task only while it is parsed.
Order inside a profile or thread is a window over that profile or thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import cut

UNRESOLVED = "<unresolved>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: ``doc`` (path) and ``value`` (text)."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc"), "value")


def _number(text: str | Column) -> Column:
    """A number that may stand as a string; 0 where it is none or not finite."""
    d = F.col(text) if isinstance(text, str) else text
    d = d.try_cast("double")
    return F.when(F.abs(d) < float("inf"), d).otherwise(F.lit(0.0))


def parse_region_coverage(docs: DataFrame) -> DataFrame:
    """``doc, path, start_line, n`` of each function: its first file, the smallest start line of its regions in that file (of all regions if
    none is), its count. Functions without a whole count, a file or a region are skipped, as are malformed documents."""
    schema = "data array<struct<functions array<struct<count variant, filenames array<string>, regions array<array<bigint>>>>>>"
    f = docs.select("doc", F.explode(F.from_json("value", schema)["data"]).alias("s")).select("doc", F.explode("s.functions").alias("f")).select("doc", "f.*")
    first_line = lambda keep: F.array_min(F.transform(F.filter("regions", keep), lambda r: F.get(r, F.lit(0))))
    line = F.coalesce(first_line(lambda r: F.coalesce(F.get(r, F.lit(5)) == 0, F.lit(False))), first_line(lambda r: F.size(r) > 0))
    n = F.when(F.schema_of_variant("count") == "BIGINT", F.try_variant_get("count", "$", "bigint"))
    out = f.select("doc", F.get("filenames", F.lit(0)).alias("path"), line.cast("int").alias("start_line"), n.alias("n"))
    return out.where("path <> '' and start_line is not null and n is not null")


def parse_coverage_polls(polls: DataFrame) -> DataFrame:
    """``script, start, poll, n`` of each function's first range; of the same key twice in a poll the last counts. ``polls(poll, value)``."""
    schema = "array<struct<scriptId string, url string, functions array<struct<functionName string, ranges array<struct<startOffset string, count string>>>>>>"
    s = polls.select("poll", F.posexplode(F.from_json("value", schema)).alias("i", "s")).select("poll", "i", "s.scriptId", F.posexplode("s.functions").alias("j", "f"))
    r = s.select("poll", "i", "j", F.coalesce("scriptId", F.lit("")).alias("script"), F.get("f.ranges", F.lit(0)).alias("r")).where("r is not null")
    whole = lambda c: _number(c).cast("long")
    r = r.select("poll", "i", "j", "script", whole("r.startOffset").alias("start"), whole("r.count").alias("n"))
    return r.groupBy("script", "start", "poll").agg(F.max_by("n", F.struct("i", "j")).alias("n"))


def read_cpu_profile(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tree nodes (``doc, id, parent, function, url, line``; lines from 1) and samples (``doc, pos, id, delta, start_us, end_us``)."""
    node = "struct<id bigint, callFrame struct<functionName string, url string, lineNumber int>, children array<bigint>>"
    d = docs.select("doc", F.from_json("value", f"nodes array<{node}>, samples array<bigint>, timeDeltas array<bigint>, startTime bigint, endTime bigint").alias("d")).select("doc", "d.*")
    nodes = d.select("doc", F.explode("nodes").alias("n")).select("doc", "n.*")
    parents = nodes.select("doc", F.col("id").alias("parent"), F.explode("children").alias("id")).groupBy("doc", "id").agg(F.max("parent").alias("parent"))
    tree = nodes.join(parents, ["doc", "id"], "left").select("doc", "id", "parent", "callFrame.functionName", "callFrame.url", (F.col("callFrame.lineNumber") + 1).alias("line"))
    tree = tree.withColumnRenamed("functionName", "function").dropDuplicates(["doc", "id"])
    samples = d.select("doc", F.posexplode("samples").alias("pos", "id"), "timeDeltas", "startTime", "endTime")
    samples = samples.select("doc", "pos", "id", F.coalesce(F.get("timeDeltas", F.col("pos")), F.lit(0)).alias("delta"), F.col("startTime").alias("start_us"), F.col("endTime").alias("end_us"))
    return tree, samples


def tree_paths(tree: DataFrame) -> DataFrame:
    """``doc, id, path``: the named nodes (``id, node_id``) from the root to each node of ``tree(doc, id, parent, node_id)``; a null
    ``node_id`` leaves a node out of paths. Chains double every round, so the rounds grow with the logarithm of the depth. Nodes whose parents run in a
    ring are dropped."""
    own = F.when(F.col("node_id").isNotNull(), F.array(F.struct("id", "node_id"))).otherwise(F.array().cast("array<struct<id:bigint,node_id:string>>"))
    known = tree.select("doc", F.col("id").alias("up")).withColumn("there", F.lit(True))
    rows = tree.select("doc", "id", F.col("parent").alias("up"), own.alias("path")).join(known, ["doc", "up"], "left")
    open_ = cut(rows.select("doc", "id", F.when(F.col("there"), F.col("up")).alias("up"), "path"))
    left = open_.where("up is not null").count()
    while left:
        above = open_.select("doc", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("over"))
        # a chain that is whole stays; the others take over the chain of the node above
        open_ = cut(open_.join(above, ["doc", "up"], "left").select("doc", "id", F.col("next").alias("up"), F.when(F.col("over").isNull(), F.col("path")).otherwise(F.concat("over", "path")).alias("path")))
        now = open_.where("up is not null").count()
        if now == left:  # only rings go on for ever
            break
        left = now
    return open_.where("up is null").select("doc", "id", "path")


def events_from_samples(samples: DataFrame, tree: DataFrame) -> DataFrame:
    """Calls and returns between the stacks of successive samples, stamped at each sample's start; at the end all frames close.

    ``tree(doc, id, parent, node_id)``; samples of unknown nodes give no event but their time counts. Out: trace events with ``idx``.
    """
    order = Window.partitionBy("session_id").orderBy("pos")
    s = samples.withColumnRenamed("doc", "session_id").withColumn("total", F.sum("delta").over(order))
    s = s.withColumn("ts", F.col("start_us") + F.col("total") - F.col("delta"))
    paths = tree_paths(tree).withColumnRenamed("doc", "session_id")
    known = s.join(paths, ["session_id", "id"]).select("session_id", "pos", "ts", "path")
    closing = s.groupBy("session_id").agg((F.max("pos") + 1).alias("pos"), F.greatest(F.max("end_us"), F.max_by(F.col("start_us") + F.col("total"), "pos")).alias("ts"))
    steps = known.unionByName(closing.withColumn("path", F.array().cast("array<struct<id:bigint,node_id:string>>")))
    none = F.array().cast("array<struct<id:bigint,node_id:string>>")
    steps = steps.withColumn("was", F.coalesce(F.lag("path").over(order), none))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    steps = steps.withColumn("same", F.size(F.array_intersect(ids("was"), ids("path"))))  # a tree node has one place, so shared ids are a prefix
    at = lambda p, kind: F.transform(p, lambda x, i: F.struct(F.lit(kind).alias("event"), x["node_id"].alias("node_id"), i.cast("int").alias("frame_depth")))
    changed = lambda p: F.slice(p, F.col("same") + 1, F.greatest(F.size(p) - F.col("same"), F.lit(0)))
    steps = steps.withColumn("out", F.concat(F.reverse(changed(at("was", "return"))), changed(at("path", "call"))))
    steps = steps.withColumn("base", F.sum(F.size("out")).over(order) - F.size("out"))
    rows = steps.select("session_id", "ts", "base", F.posexplode("out").alias("k", "e"))
    return rows.select("session_id", (F.col("base") + F.col("k")).alias("idx"), "e.event", "e.node_id", (F.col("ts") * 1000).alias("ts_ns"), F.lit(1).cast("long").alias("thread_id"), "e.frame_depth")


def from_speedscope(docs: DataFrame) -> DataFrame:
    """Trace events of evented profiles: ``session_id`` (document), ``profile``, ``pos``, event, node, time, thread, depth. The thread is the number a profile's
    name ends with, else its place; other profiles are skipped; an unknown frame is ``<unresolved>``."""
    schema = "shared struct<frames array<struct<name string>>>, profiles array<struct<type string, name string, events array<struct<type string, frame string, at string>>>>"
    d = docs.select(F.col("doc").alias("session_id"), F.from_json("value", schema).alias("d"))
    frames = d.select("session_id", F.posexplode("d.shared.frames").alias("frame", "f")).select("session_id", "frame", F.col("f.name").alias("name"))
    p = d.select("session_id", F.posexplode("d.profiles").alias("profile", "p")).where("p.type = 'evented'")
    number = F.regexp_extract(F.coalesce("p.name", F.lit("")), r"(\d+)\s*$", 1)
    p = p.withColumn("thread_id", F.coalesce(F.when(number != "", number.try_cast("long")), F.col("profile").cast("long")))
    e = p.select("session_id", "profile", "thread_id", F.posexplode("p.events").alias("pos", "e")).where("e is not null")
    opens = F.coalesce(F.col("e.type") == "O", F.lit(False))
    order = Window.partitionBy("session_id", "profile").orderBy("pos")
    e = e.withColumns({"opens": opens, "sum": F.sum(F.when(opens, 1).otherwise(-1)).over(order)})
    # a counter that never falls under 0 is its plain sum less the lowest sum so far
    depth = F.col("sum") - F.least(F.lit(0), F.min("sum").over(order))
    e = e.select("session_id", "profile", "pos", "opens", "thread_id", depth.alias("depth"), _number("e.frame").cast("int").alias("frame"), _number("e.at").cast("long").alias("ts_ns"))
    e = e.join(frames, ["session_id", "frame"], "left")
    return e.select(
        "session_id", "profile", "pos", F.when(F.col("opens"), "call").otherwise("return").alias("event"), F.coalesce("name", F.lit(UNRESOLVED)).alias("node_id"), "ts_ns", "thread_id",
        (F.col("depth") - F.col("opens").cast("int")).cast("int").alias("frame_depth"),
    )


def to_speedscope(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames as evented profiles: the name table (``session_id, frame, name``) and the events (``session_id, thread_id, pos, type, frame, at``), opened and
    closed in tree order, times from the session's first start."""
    names = frames.select("session_id", F.col("node_id").alias("name")).distinct()
    names = names.withColumn("frame", F.row_number().over(Window.partitionBy("session_id").orderBy("name")) - 1)
    zero = frames.groupBy("session_id").agg(F.min("start_ns").alias("zero"))
    never = F.lit((1 << 63) - 1)
    sides = F.array(
        F.struct(F.lit("O").alias("type"), F.col("call_idx").alias("a"), F.lit(1).alias("b"), F.lit(0).cast("long").alias("c"), F.col("start_ns").alias("ns")),
        F.struct(F.lit("C").alias("type"), F.coalesce("close_idx", never).alias("a"), F.lit(0).alias("b"), (-F.col("call_idx")).alias("c"), F.col("end_ns").alias("ns")),
    )
    e = frames.select("session_id", "thread_id", F.col("node_id").alias("name"), F.explode(sides).alias("e")).select("session_id", "thread_id", "name", "e.*")
    order = Window.partitionBy("session_id", "thread_id").orderBy("a", "b", "c")
    e = e.withColumn("pos", F.row_number().over(order) - 1).join(names, ["session_id", "name"]).join(zero, "session_id")
    return names.select("session_id", "frame", "name"), e.select("session_id", "thread_id", "pos", "type", "frame", (F.col("ns") - F.col("zero")).alias("at"))


def speedscope_documents(frames: DataFrame) -> DataFrame:
    """One JSON document per session and thread (``session_id, thread_id, value``), as large as that thread."""
    names, events = to_speedscope(frames)
    table = names.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "name"))), lambda x: F.struct(x["name"].alias("name"))).alias("frames"))
    by_thread = events.groupBy("session_id", "thread_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "frame", "at"))).alias("e"), F.max("at").alias("last"))
    profile = F.struct(
        F.lit("evented").alias("type"), F.concat(F.lit("thread "), "thread_id").alias("name"), F.lit("nanoseconds").alias("unit"), F.lit(0).alias("startValue"), F.col("last").alias("endValue"),
        F.transform("e", lambda x: F.struct(x["type"].alias("type"), x["frame"].alias("frame"), x["at"].alias("at"))).alias("events"),
    )
    value = F.to_json(F.struct(F.lit("https://www.speedscope.app/file-format-schema.json").alias("$schema"), F.struct("frames").alias("shared"), F.array(profile).alias("profiles")))
    return by_thread.join(table, "session_id").select("session_id", "thread_id", value.alias("value"))


def from_chrome_trace(docs: DataFrame) -> DataFrame:
    """Trace events (``session_id, thread_id, idx``...) of interval documents. ``B`` and ``E`` pair last in, first out; an ``E`` without ``B`` is skipped, a ``B`` without
    ``E`` has no length; the process counts in the thread only where a document has several.

    Intervals are taken by start, the longer first, then in the order they were complete. One that ends inside a later one, which it does not hold whole, stays open under it: its
    return comes behind the other's and has its own end as time. Each thread is scanned once, in that order, with the open intervals held and no others.
    """
    raw = docs.select("doc", F.posexplode(F.from_json("value", f"traceEvents array<{CHROME}>")["traceEvents"]).alias("ord", "e"))
    return _chrome(raw)


def from_chrome_events(elements: DataFrame) -> DataFrame:
    """The same of ``elements(doc, ord, value)``, a row each (see ``documents.elements``), so that a document may be of any size."""
    return _chrome(elements.select("doc", "ord", F.from_json("value", CHROME).alias("e")).where("e is not null"))


CHROME = "struct<name string, ph string, ts string, dur string, pid string, tid string>"


def _chrome(raw: DataFrame) -> DataFrame:
    raw = raw.select(F.col("doc").alias("session_id"), F.col("ord").cast("long").alias("ord"), "e.*")
    raw = raw.withColumns({"pid": _number("pid").cast("long"), "tid": _number("tid").cast("long"), "ts": _number("ts"), "name": F.coalesce("name", F.lit(UNRESOLVED))})
    several = raw.groupBy("session_id").agg((F.min("pid") < F.max("pid")).alias("several"))
    raw = raw.where("ph in ('X', 'B', 'E')").join(several, "session_id").withColumn("thread_id", F.when(F.col("several"), F.col("pid") * 1000000 + F.col("tid")).otherwise(F.col("tid")))
    thread = ["session_id", "thread_id"]
    keep = [*thread, "name", F.col("ts").alias("start")]
    whole = raw.where("ph = 'X'").select(*keep, (F.col("ts") + _number("dur")).alias("end"), "ord")
    order = Window.partitionBy(*thread).orderBy("ord")
    b = raw.where("ph <> 'X'").withColumn("sum", F.sum(F.when(F.col("ph") == "B", 1).otherwise(-1)).over(order))
    b = b.withColumn("low", F.least(F.lit(0), F.min("sum").over(order))).withColumn("depth", F.col("sum") - F.col("low"))
    # an E at the floor pushes the lowest sum down and closes nothing; any other closes the level above the one it reaches
    floor = F.col("low") < F.coalesce(F.lag("low").over(order), F.lit(0))
    b = b.withColumn("idle", (F.col("ph") == "E") & floor).where("not idle").withColumn("level", F.col("depth") + F.when(F.col("ph") == "E", 1).otherwise(0))
    level = Window.partitionBy(*thread, "level").orderBy("ord")
    unclosed = F.lit(1 << 40) + F.col("ord")  # these are complete when all others are
    paired = b.withColumns({"end": F.coalesce(F.lead("ts").over(level), F.col("ts")), "done": F.coalesce(F.lead("ord").over(level).cast("long"), unclosed)})
    spans = whole.unionByName(paired.where("ph = 'B'").select(*keep, "end", F.col("done").alias("ord"))).select(*thread, "name", F.col("start").cast("double"), F.col("end").cast("double"), F.col("ord").cast("long"), (-F.col("end")).cast("double").alias("sooner"))
    rows = spans.repartition(*thread).sortWithinPartitions(*thread, "start", "sooner", "ord")
    e = rows.mapInArrow(_nest, "session_id string, thread_id long, idx long, event string, node_id string, t double, frame_depth int")
    return e.select(*thread, "idx", "event", "node_id", F.round(F.col("t") * 1000).cast("long").alias("ts_ns"), "frame_depth")


def _nest(batches):
    """Calls and returns of intervals in order: what has ended by an interval's start closes before it, from the innermost one down to the first that is still open."""
    import pyarrow as pa

    names = ["session_id", "thread_id", "idx", "event", "node_id", "t", "frame_depth"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32()]
    key, stack, n, out = None, [], 0, []

    def table():
        cols = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def add(event, name, t):
        nonlocal n
        out.append((*key, n, event, name, t, len(stack)))
        n += 1

    def close(upto=None):
        while stack and (upto is None or stack[-1][1] <= upto):
            name, end = stack.pop()
            add("return", name, end)

    for batch in batches:
        for session, thread, name, start, end in zip(*(batch.column(c).to_pylist() for c in ("session_id", "thread_id", "name", "start", "end"))):
            if (session, thread) != key:
                close()
                key, n = (session, thread), 0
            close(start)
            add("call", name, start)
            stack.append((name, end))
        yield table()
        out = []
    close()
    yield table()
