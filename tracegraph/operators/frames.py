"""Call frames by the interval rule, and what follows from them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Rounds, cut
from . import scan as S

THREAD = ["session_id", "thread_id"]
NEVER = 2**31 - 1  # no call or return yet
STACK = "array<struct<call_idx:bigint,node_id:string>>"
SCAN = (
    f"session_id string, thread_id long, chunk long, kind string, idx long, close_idx long, parent_idx long, need int, node_id string, depth int,"
    f" start_ns long, end_ns long, normal boolean, stack {STACK}, above int, h1 long, h2 long, r1 long, r2 long, w1 long, w2 long"
)
NAMES = [c.split()[0] for c in SCAN.split(", ")]
_stack = pa.list_(pa.struct([("call_idx", pa.int64()), ("node_id", pa.string())]))
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), _stack]
KINDS += [pa.int32(), *[pa.int64()] * 6]
# A path's id is two polynomials over its nodes' hashes, modulo a prime: of what stands before and what stands behind, the id of both together is known.
PRIME = (1 << 61) - 1
BASES = (1_000_000_000_000_000_003, 1_234_567_890_123_456_789)
PATH_ID = "struct<a:bigint,b:bigint>"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS)], names=NAMES)


def _scan(emit: frozenset[str]):
    """One chunk of a thread after the other, rows in order; only the frames open in the chunk are held.

    Kinds of rows: ``frame`` closed inside the chunk; ``open`` at its end; ``low``: a call or return of a lower depth than all before it in the chunk,
    which is what closes frames that come in from the left; ``last``: the latest time; ``event``: events asked for, with the stack before them.
    ``need`` is the lowest depth so far: of the frames that come in, those of lower depth are still open. ``above``: a frame's ancestors in the chunk; ``h``: its node's
    hash; ``r``: the polynomial of those ancestors; ``w``: the base to the power of their number.
    """
    powers = [(1, 1)]

    def shot(stack):
        return [{"call_idx": s[0], "node_id": s[1]} for s in stack]

    def tail(stack, h):
        """Of a frame on top of ``stack``: how many stand above it, its hash, their polynomial, the powers."""
        k = len(stack)
        while len(powers) <= k:
            powers.append(tuple(w * b % PRIME for w, b in zip(powers[-1], BASES)))
        return (k, *h, *(stack[-1][7] if stack else (0, 0)), *powers[k])

    def run(batches):
        key, stack, low, latest = None, [], NEVER, None

        def close():
            if key is None:
                return
            for k, (idx, node, depth, start, parent, need, h, _) in enumerate(stack):
                yield (*key, "open", idx, None, parent, need, node, depth, start, None, None, None, *tail(stack[:k], h))
            yield (*key, "last", None, None, None, None, None, None, None, latest, None, None, *[None] * 7)

        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in (*THREAD, "chunk", "idx", "event", "node_id", "frame_depth", "ts_ns", "h1", "h2")]
            for session, thread, chunk, idx, event, node, depth, ts, *h in zip(*cols):
                if (session, thread, chunk) != key:
                    out.extend(close())
                    key, stack, low, latest = (session, thread, chunk), [], NEVER, None
                    out.append((*key, "low", idx, None, None, NEVER, None, NEVER, None, ts, None, None, *[None] * 7))
                if ts is not None and (latest is None or ts > latest):
                    latest = ts
                if (event != "call" or depth is None) and event in emit:
                    out.append((*key, "event", idx, None, None, low, node, depth, ts, None, None, shot(stack), *[None] * 7))
                if depth is None or event not in ("call", "return"):
                    continue
                while stack and stack[-1][2] >= depth:
                    i, n, d, start, parent, need, h_, _ = stack.pop()
                    out.append((*key, "frame", i, idx, parent, need, n, d, start, ts, event == "return" and d == depth, None, *tail(stack, h_)))
                if depth < low:
                    low = depth
                    out.append((*key, "low", idx, None, None, low, None, low, None, ts, event == "return", None, *[None] * 7))
                if event == "call":
                    if event in emit:
                        out.append((*key, "event", idx, None, None, low, node, depth, ts, None, None, shot(stack), *[None] * 7))
                    before = stack[-1][7] if stack else (0, 0)
                    stack.append((idx, node, depth, ts, stack[-1][0] if stack else None, low, h, tuple((r * b + x) % PRIME for r, b, x in zip(before, BASES, h))))
            yield _table(out)
        yield _table(list(close()))

    return run


LINK = f"session_id string, thread_id long, chunk long, need int, call_idx long, close_idx long, end_ns long, normal boolean, stack {STACK}, level int, p1 long, p2 long"


def _link(whole: bool):
    """The chunks' summaries of a thread in order: ``low`` rows close what comes in, ``open`` rows go on to the next chunk.

    Rows with ``need``: the innermost frame (``call_idx``) that comes in and is of lower depth, its level and its path's id, with ``whole`` the stack up to it. Rows
    without: a frame's close.
    """
    names = [c.split()[0] for c in LINK.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), _stack, pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        key, stack = None, []
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in (*THREAD, "chunk", "kind", "idx", "node_id", "depth", "end_ns", "normal", "h1", "h2")]
            for session, thread, chunk, kind, idx, node, depth, ts, normal, *h in zip(*cols):
                if (session, thread) != key:
                    key, stack = (session, thread), []
                if kind == "open":
                    stack.append((idx, node, depth, tuple((p * b + x) % PRIME for p, b, x in zip(stack[-1][3] if stack else (1, 1), BASES, h))))
                    continue
                while stack and stack[-1][2] >= depth:
                    i, _, d, _ = stack.pop()
                    out.append((*key, chunk, None, i, idx, ts, bool(normal) and d == depth, None, None, None, None))
                top = stack[-1] if stack else (None, None, None, (1, 1))
                out.append((*key, chunk, depth, top[0], None, None, None, [{"call_idx": s[0], "node_id": s[1]} for s in stack] if whole else None, len(stack), *top[3]))
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def scanned(events: DataFrame, chunk: int, emit: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """Threads of any length, cut into chunks of ``chunk`` indexes that are scanned on their own; then their summaries, which are as long as the
    stacks are deep, are linked in order. Returns the rows of :func:`_scan` and of :func:`_link`."""
    rows = events.select(
        F.col("session_id").cast("string").alias("session_id"), F.col("thread_id").cast("long").alias("thread_id"), F.floor(F.col("idx") / chunk).cast("long").alias("chunk"),
        F.col("idx").cast("long").alias("idx"), "event", "node_id", F.col("frame_depth").cast("int").alias("frame_depth"), "ts_ns",
        F.pmod(F.xxhash64("node_id"), F.lit(PRIME)).alias("h1"), F.pmod(F.xxhash64(F.lit(1), "node_id"), F.lit(PRIME)).alias("h2"),
    )
    order = [*THREAD, "chunk"]
    # a probe sees what its index's event has done
    rows = rows.repartition(*order).sortWithinPartitions(*order, "idx", F.col("event") == "probe", "event", "node_id", "frame_depth", "ts_ns")
    scan = cut(rows.mapInArrow(_scan(emit), SCAN))
    summary = scan.where("kind in ('low', 'open')").select(*THREAD, "chunk", "kind", "idx", "node_id", "depth", "end_ns", "normal", "h1", "h2")
    links = summary.repartition(*THREAD).sortWithinPartitions(*order, "kind", "idx", F.desc("depth")).mapInArrow(_link(bool(emit)), LINK)
    return scan, cut(links)


def _incoming(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``came`` (the innermost frame open from chunks before) and ``before`` (the stack up to it)."""
    came = links.where("need is not null").select(*(F.col(c).alias(f"l_{c}") for c in (*THREAD, "chunk", "need")), F.col("call_idx").alias("came"), F.col("stack").alias("before"), F.col("level").alias("came_level"), "p1", "p2")
    same = F.lit(True)
    for c in (*THREAD, "chunk", "need"):
        same = same & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    return rows.join(came.hint("merge"), same, "left").drop("l_session_id", "l_thread_id", "l_chunk", "l_need")


def stacks(events: DataFrame, kinds: tuple[str, ...] = ("call", "return", "exception"), chunk: int = 1 << 16) -> DataFrame:
    """``session_id, thread_id, idx, event_node, frame_depth, stack``: events of the given kinds with the frames open before them on their thread, root first
    (``call_idx, node_id``). For calls, frames of the same depth or more are closed by the call itself and left out."""
    scan, links = scanned(events, chunk, frozenset(kinds))
    rows = _incoming(scan.where("kind = 'event'"), links)
    return rows.select(*THREAD, "idx", F.col("node_id").alias("event_node"), F.col("depth").alias("frame_depth"), F.concat(F.coalesce("before", F.array().cast(STACK)), "stack").alias("stack"))


def _path_ids() -> tuple[Column, Column]:
    """The ids of a frame's parent's path and of its own, from those of the frames that came in and the polynomials of those above it in its chunk."""
    big = lambda c: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("decimal(19,0)")
    up = [((big(f"p{k}") * big(f"w{k}")) % PRIME).cast("long") + F.col(f"r{k}") for k in (1, 2)]
    up = [F.pmod(u, F.lit(PRIME)) for u in up]
    own = [F.pmod(((u.cast("decimal(19,0)") * big(b)) % PRIME).cast("long") + F.col(f"h{k}"), F.lit(PRIME)) for k, u, b in zip((1, 2), up, BASES)]
    return F.struct(up[0].alias("a"), up[1].alias("b")), F.struct(own[0].alias("a"), own[1].alias("b"))


def build_frames(events: DataFrame, paths: bool = False, chunk: int = 1 << 16, ids: bool = False) -> DataFrame:
    """One row per call: ``call_idx, close_idx, parent_idx, node_id, depth, level, start_ns, end_ns, total_ns, self_ns, synthetic``; ``level`` counts the open frames, itself
    included. With ``ids`` also ``path_id`` and ``parent_path_id``, which stand for the node ids from the root to it and to its parent (the same on every thread; null above a
    root); with ``paths`` also those node ids as ``path``, put together once for each distinct path.

    A call closes at the first later call or return of its depth or less on its thread; synthetic unless that is
    a return of its depth. Calls that never close end at the thread's last time. Events without a depth close and open nothing.

    All that is joined grows with the trace, and a cut table's file is a small part of what it holds, so Spark would send it through the driver: hints keep these joins shuffled.
    """
    scan, links = scanned(events, chunk)
    closes = links.where("need is null").select(*(F.col(c).alias(f"c_{c}") for c in THREAD), F.col("call_idx").alias("idx"), F.col("close_idx").alias("close"), F.col("end_ns").alias("end"), F.col("normal").alias("good"))
    same = F.col("session_id").eqNullSafe(F.col("c_session_id")) & F.col("thread_id").eqNullSafe(F.col("c_thread_id"))
    carried = scan.where("kind = 'open'").drop("close_idx", "end_ns", "normal").join(closes.withColumnRenamed("idx", "c_idx").hint("merge"), same & (F.col("idx") == F.col("c_idx")), "left")
    carried = carried.withColumnsRenamed({"close": "close_idx", "end": "end_ns", "good": "normal"}).select(NAMES)
    f = _incoming(scan.where("kind = 'frame'").unionByName(carried), links)
    ends = scan.where("kind = 'last'").groupBy(*(F.col(c).alias(f"e_{c}") for c in THREAD)).agg(F.max("end_ns").alias("last_ns"))
    f = f.join(ends.hint("merge"), F.col("session_id").eqNullSafe(F.col("e_session_id")) & F.col("thread_id").eqNullSafe(F.col("e_thread_id")))
    ids = ids or paths
    up, own = _path_ids()
    level = (F.col("came_level") + F.col("above") + 1).cast("long")
    f = f.select(
        *THREAD, F.col("idx").alias("call_idx"), "close_idx", F.coalesce("parent_idx", "came").alias("parent_idx"), "node_id", "depth", level.alias("level"), "start_ns",
        F.greatest("start_ns", F.coalesce("end_ns", "last_ns")).alias("end_ns"), (~F.coalesce("normal", F.lit(False))).alias("synthetic"),
        *([own.alias("path_id"), F.when(level > 1, up).alias("parent_path_id")] if ids else []),
    ).withColumn("total_ns", F.col("end_ns") - F.col("start_ns"))
    children = f.where("parent_idx is not null").groupBy(*(F.col(c).alias(f"p_{c}") for c in THREAD), F.col("parent_idx").alias("p_idx")).agg(F.sum("total_ns").alias("inner_ns"))
    inside = F.col("session_id").eqNullSafe(F.col("p_session_id")) & F.col("thread_id").eqNullSafe(F.col("p_thread_id")) & (F.col("call_idx") == F.col("p_idx"))
    out = f.join(children.hint("merge"), inside, "left").withColumn("self_ns", F.greatest(F.lit(0).cast("long"), F.col("total_ns") - F.coalesce("inner_ns", F.lit(0))))
    out = out.drop("inner_ns", "p_session_id", "p_thread_id", "p_idx")
    return named(out, trie(out)) if paths else out


def trie(frames: DataFrame) -> DataFrame:
    """``path_id, parent_path_id, node_id``: one row for each distinct path of frames (or a flame) with ids. Two paths with one id would stop the query."""
    row = F.struct("parent_path_id", "node_id")
    paths = frames.groupBy("path_id").agg(F.min(row).alias("row"), F.max(row).alias("other"))
    sure = F.when(F.col("row").eqNullSafe(F.col("other")), F.col("row")).otherwise(F.raise_error(F.lit("two paths have one id")).cast(f"struct<parent_path_id:{PATH_ID},node_id:string>"))
    return paths.select("path_id", sure.alias("row")).select("path_id", "row.parent_path_id", "row.node_id")


def path_names(paths: DataFrame) -> DataFrame:
    """``path_id, path``: the node ids from the root of each row of a trie, by pointer jumping: each round doubles how far a row has come, so a depth of n takes log2(n) rounds."""
    rounds = Rounds(paths.sparkSession)
    at = rounds.cut(paths.select("path_id", F.col("parent_path_id").alias("up"), F.array("node_id").alias("path")))
    while not at.where("up is not null").isEmpty():
        above = at.select(F.col("path_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("front"))
        far = at.where("up is not null").join(above, "up").select("path_id", F.col("next").alias("up"), F.concat("front", "path").alias("path"))
        at = rounds.cut(at.where("up is null").unionByName(far))
    return at.select("path_id", "path")


def named(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """``rows`` with ``path``, the node ids that their ``path_id`` stands for. The names are joined last, once a distinct path."""
    return rows.join(path_names(paths), "path_id", "left")


def stack_at(frames: DataFrame, idx: int) -> DataFrame:
    """Frames open at an index, all threads: a plain filter on the interval."""
    return frames.where((F.col("call_idx") <= idx) & (F.col("close_idx").isNull() | (F.col("close_idx") > idx)))


def open_frames(events: DataFrame, probes: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """``session_id, thread_id, idx, call_idx, node_id, level``: the frames open at each of ``probes(session_id, thread_id, idx)``, root at level 0.

    A frame is open from its call's index up to the one before its close. Probes are scanned along with the events, so no interval is joined.
    """
    asked = probes.select(*THREAD, "idx", F.lit("probe").alias("event")).distinct()
    rows = stacks(events.select(*THREAD, "idx", "event", "node_id", "frame_depth", "ts_ns").unionByName(asked, allowMissingColumns=True), ("probe",), chunk)
    return rows.select(*THREAD, "idx", F.posexplode("stack").alias("level", "s")).select(*THREAD, "idx", "s.call_idx", "s.node_id", F.col("level").cast("long").alias("level"))


def active_threads(frames: DataFrame, idx: int) -> DataFrame:
    return stack_at(frames, idx).groupBy("session_id").agg(F.countDistinct("thread_id").alias("threads"))


def boundaries(events: DataFrame, width: int = S.WIDTH) -> DataFrame:
    """Previous and next call or return of each call and return, over all threads of a session."""
    rows = events.where("event in ('call', 'return')").select("session_id", "idx")
    return S.scan(rows, ["session_id"], "idx", {"prev_idx": S.row_before(F.col("idx")), "next_idx": S.row_after(F.col("idx"))}, width)


def firings(events: DataFrame, cap: int = 200) -> DataFrame:
    """The first ``cap`` calls of each node in order (a report limit of the feature), and whether there are more."""
    calls = events.where("event = 'call'")
    w = Window.partitionBy("session_id", "node_id").orderBy("idx")
    n = calls.groupBy("session_id", "node_id").agg((F.count("*") > cap).alias("capped"))
    return calls.select("session_id", "node_id", "idx", F.row_number().over(w).cast("long").alias("nth")).where(F.col("nth") <= cap).join(n, ["session_id", "node_id"])


def nearest_firing(events: DataFrame, playhead: int) -> DataFrame:
    c = events.where("event = 'call'").groupBy("session_id", "node_id")
    return c.agg(F.coalesce(F.max(F.when(F.col("idx") <= playhead, F.col("idx"))), F.min("idx")).alias("idx"))


def causal_paths(events: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """For every call the node ids from the root to it. Each call has its path's id; the names are put together once for each distinct path."""
    return build_frames(events, paths=True, chunk=chunk).select(*THREAD, "call_idx", "path")


def causal_hops(events: DataFrame, edges: DataFrame | None = None, chunk: int = 1 << 16) -> DataFrame:
    """One row per call and frame on its way from the root: ``session_id, thread_id, call_idx, hop, hop_idx, node_id, args, line``.

    The output has a row for each frame that is open at a call, so the stacks are its size. ``args`` are those that the hop's own call captured (null where the events have none); ``line`` is where the hop before it calls its node, by the
    call sites of ``edges`` (see ``graph.call_sites``).
    """
    from .graph import call_sites

    paths = stacks(events, ("call",), chunk).where("frame_depth is not null")
    paths = paths.select(*THREAD, F.col("idx").alias("call_idx"), F.array_append("stack", F.struct(F.col("idx").alias("call_idx"), F.col("event_node").alias("node_id"))).alias("stack"))
    hops = paths.select(*THREAD, "call_idx", "stack", F.posexplode("stack").alias("hop", "s")).select(
        *THREAD, "call_idx", F.col("hop").cast("long").alias("hop"), F.col("s.call_idx").alias("hop_idx"), F.col("s.node_id").alias("node_id"), F.get("stack", F.col("hop") - 1)["node_id"].alias("caller"),
    )
    if "args" in events.columns:
        hops = hops.join(events.where("event = 'call'").select("session_id", F.col("idx").alias("hop_idx"), "args"), ["session_id", "hop_idx"], "left")
    else:
        hops = hops.withColumn("args", F.lit(None).cast("string"))
    if edges is not None:
        hops = hops.join(call_sites(edges).select(F.col("source").alias("caller"), F.col("target").alias("node_id"), "line"), ["caller", "node_id"], "left")
    else:
        hops = hops.withColumn("line", F.lit(None).cast("int"))
    return hops.select(*THREAD, "call_idx", "hop", "hop_idx", "node_id", "args", "line")


def mark_raised(events: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Frames that an exception event is laid to: the innermost open frame of its node, else the top of its stack."""
    s = stacks(events, ("exception",), chunk).where("size(stack) > 0")
    own = F.filter("stack", lambda x: x["node_id"] == F.col("event_node"))
    return s.select(*THREAD, F.coalesce(F.try_element_at(own, F.lit(-1)), F.element_at("stack", -1))["call_idx"].alias("call_idx")).distinct()


def tree_stats(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Per session: wall time, threads in order of their first event, frames, greatest depth (by nesting, roots 1), whether any frame is synthetic, returns that close none."""
    closers = frames.where("not synthetic").select(*THREAD, F.col("close_idx").alias("idx"))
    orphans = events.where("event = 'return'").join(closers, [*THREAD, "idx"], "left_anti").groupBy("session_id").agg(F.count("*").alias("orphan_returns"))
    firsts = events.groupBy("session_id", "thread_id").agg(F.min("idx").alias("first"), F.min("ts_ns").alias("a"), F.max("ts_ns").alias("z"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("first", "thread_id"))), lambda x: x["thread_id"])  # one entry a thread
    span = firsts.groupBy("session_id").agg((F.max("z") - F.min("a")).alias("wall_ns"), F.count("*").alias("n_threads"), in_order.alias("threads"))
    deep = F.max("level")
    f = frames.groupBy("session_id").agg(F.count("*").alias("n_frames"), F.bool_or("synthetic").alias("had_synthetic"), deep.alias("max_depth"))
    return span.join(f, "session_id", "left").join(orphans, "session_id", "left").na.fill(0, ["n_frames", "orphan_returns"])


def flame(frames: DataFrame, names: bool = True) -> DataFrame:
    """Frames (with ids) merged by thread and path; siblings ranked by total, count, first appearance. Ids may hold any characters.

    Rows are grouped by the path's id, so depth is in no row; with ``names`` the node ids are joined at the end as ``path`` and ``parent_path``.
    """
    out = frames.groupBy(*THREAD, "path_id").agg(
        F.count("*").alias("n"), F.sum("total_ns").alias("total_ns"), F.sum("self_ns").alias("self_ns"), F.min("start_ns").alias("start_ns"),
        F.max("end_ns").alias("end_ns"), F.bool_or("synthetic").alias("synthetic"), F.min("call_idx").alias("first_idx"),
        F.first("parent_path_id").alias("parent_path_id"), F.first("node_id").alias("node_id"), F.first("level").alias("level"),
    )
    w = Window.partitionBy(*THREAD, "parent_path_id").orderBy(F.desc("total_ns"), F.desc("n"), "first_idx")
    out = out.withColumn("sibling", F.row_number().over(w).cast("long"))
    if not names:
        return out
    out = cut(out)  # its trie is walked in rounds
    return named(out, trie(out)).withColumn("parent_path", F.slice("path", F.lit(1), F.size("path") - 1)).drop("path_id", "parent_path_id", "node_id", "level")


def hot_path(frames: DataFrame) -> DataFrame:
    """From each thread's first root down the first-ranked children, of a flame with or without names: ``depth`` and the path (its id where there are no names).

    Rows that rank first point to their parent; each round a row jumps to where its parent points, and rows whose chain breaks off fall out. A depth of n takes
    log2(n) rounds, and no row holds more than two ids.
    """
    if "path_id" in frames.columns:
        own, parent, root = F.col("path_id"), F.col("parent_path_id"), F.col("parent_path_id").isNull()
    else:
        own, parent, root = F.col("path"), F.col("parent_path"), F.size("parent_path") == 0
    first = cut(frames.where("sibling = 1"))
    # ids of names: each path once, by its hash and its thread
    key = F.xxhash64(own), F.xxhash64(F.lit(1), own)
    up = F.when(~root, F.struct(F.xxhash64(parent).alias("a"), F.xxhash64(F.lit(1), parent).alias("b")))
    rounds = Rounds(frames.sparkSession)
    at = rounds.cut(first.select(*THREAD, F.struct(key[0].alias("a"), key[1].alias("b")).alias("id"), up.alias("up"), F.lit(1).cast("long").alias("depth")))
    while not at.where("up is not null").isEmpty():
        above = at.select(*(F.col(c).alias(f"u_{c}") for c in THREAD), F.col("id").alias("u_id"), F.col("up").alias("next"), F.col("depth").alias("more"))
        same = F.col("session_id").eqNullSafe(F.col("u_session_id")) & F.col("thread_id").eqNullSafe(F.col("u_thread_id")) & (F.col("up") == F.col("u_id"))
        far = at.where("up is not null").join(above, same).select(*THREAD, "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        at = rounds.cut(at.where("up is null").unionByName(far))
    good = at.select(*(F.col(c).alias(f"g_{c}") for c in THREAD), "id", "depth")
    same = F.col("session_id").eqNullSafe(F.col("g_session_id")) & F.col("thread_id").eqNullSafe(F.col("g_thread_id")) & (F.col("own") == F.col("id"))
    shown = "path_id" if "path_id" in frames.columns else "path"
    return first.withColumn("own", F.struct(key[0].alias("a"), key[1].alias("b"))).join(good, same).select(*THREAD, shown, "depth")
