"""Live traces: running heat, frames rebuilt in state, sessions, poll deltas."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.messages import decode_envelopes
from ..functions.scalars import event_weight
from ..storage import KeyedTable, Sides, cut, new_folder
from .stateful import FRAME, Ends, Frames, first_of_each, rocks


def stream_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Trace events as they arrive as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


MESSAGES = ["trace_session_start", "trace_event", "trace_session_end"]
PAYLOAD = "session_id string, event string, node_id string, ts_ns long, thread_id long, frame_depth int, started_ns long, ended_ns long, metadata string"


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Messages of live traces as they arrive as files of JSON lines: ``connection`` (its file), ``seq`` (the line), ``type`` and the payload's fields.

    A file is one connection's messages in order and is read as one value, so a writer should roll its files (``follow_messages`` reads logs that grow); of a message queue give ``messages_of`` its key and offset.
    Lines that are no envelope and messages of other types are left out. What bounds a batch is the number of files it takes.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("wholetext", True).text(path)
    lines = files.select(F.col("_metadata.file_path").alias("connection"), F.posexplode(F.split("value", "\n")).alias("seq", "value"))
    return messages_of(lines.withColumn("seq", F.col("seq").cast("long")))


def follow_messages(spark: SparkSession, path: str, bytes_per_batch: int = 64 << 20) -> DataFrame:
    """Messages of live traces out of logs that grow, one a connection, in a folder: as ``stream_messages``, with the byte of a line as ``seq``.

    A batch takes what has been added up to so many bytes, whole lines only, split into tasks by bytes; a query that is started again goes on at its bytes.
    """
    from ..sources.logs import ConnectionLogs

    spark.dataSource.register(ConnectionLogs)
    return messages_of(spark.readStream.format("connection_logs").option("path", path).option("maxBytesPerBatch", str(bytes_per_batch)).load())


def messages_of(lines: DataFrame) -> DataFrame:
    """``lines(connection, seq, value)`` as ``connection, seq, type`` and the payload's fields."""
    known = decode_envelopes(lines, MESSAGES).where("error is null")
    return known.select("connection", "seq", "type", F.from_json("payload", PAYLOAD).alias("p")).select("connection", "seq", "type", "p.*")


def events_of(messages: DataFrame) -> DataFrame:
    """The trace events among messages, ready for ``stream_heat`` and ``stream_frames``: a connection is a session, ``seq`` its index. A session's end is
    an event ``end`` without a thread."""
    at = messages.where(F.col("type") != "trace_session_start")
    event = F.when(F.col("type") == "trace_session_end", "end").otherwise(F.col("event"))
    ts = F.when(F.col("type") == "trace_session_end", F.col("ended_ns")).otherwise(F.col("ts_ns"))
    return at.select(
        F.col("connection").alias("session_id"), F.col("seq").alias("idx"), event.alias("event"), F.coalesce("node_id", F.lit("")).alias("node_id"),
        ts.alias("ts_ns"), "thread_id", "frame_depth", event_weight(F.col("metadata")).alias("weight"),
    )


def stream_heat(events: DataFrame) -> DataFrame:
    """Running weighted count per session and node (update mode)."""
    return events.where("node_id <> ''").groupBy("session_id", "node_id").agg(F.sum("weight").cast("long").alias("heat"))


def stream_frames(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Frames, as soon as they close, of a stream of events (append mode).

    Rows count in index order inside a batch and in the order of their batches; an event ``end`` closes all that is open in its session, as does
    ``idle_ms`` without a row of the thread where that is given. Frames closed so have no ``close_idx`` and end at the latest time of their thread, so that rows with an
    earlier time that come late let no frame end before its children. Each thread of a session is a group: its state is an entry for each open frame, of which a batch
    reads and writes those it closes or opens. Rows without an index are left out; a thread, node or time may be null.
    """
    rocks(events.sparkSession)
    rows = events.selectExpr("session_id", "cast(thread_id as bigint) thread_id", "cast(idx as bigint) idx", "event", "node_id", "cast(frame_depth as int) frame_depth", "cast(ts_ns as bigint) ts_ns")
    # a session's end goes to each thread that it has shown
    ends = first_of_each(rows).groupBy("session_id").transformWithState(Ends(), "session_id string, thread_id long, idx long", "append", "none")
    both = rows.where("event is distinct from 'end'").unionByName(ends.withColumn("event", F.lit("end")), allowMissingColumns=True)
    return both.groupBy("session_id", "thread_id").transformWithState(Frames(idle_ms), FRAME, "append", "processingTime" if idle_ms else "none")


def _deltas(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    poll, n = state.get if state.exists else (-1, 0)
    out = []
    for r in pd.concat(list(chunks)).sort_values("poll").itertuples():
        delta = r.n - (n if poll == r.poll - 1 else 0)
        if delta > 0:
            out.append((*key, r.poll, delta))
        poll, n = r.poll, r.n
    state.update((int(poll), int(n)))
    yield pd.DataFrame(out, columns=["script", "start", "poll", "delta"])


def stream_coverage_deltas(polls: DataFrame) -> DataFrame:
    """Growth of each key against the poll just before (append mode)."""
    return polls.groupBy("script", "start").applyInPandasWithState(
        _deltas, "script string, start long, poll long, delta long", "poll long, n long", "append", GroupStateTimeout.NoTimeout
    )


def keep_heat(events: DataFrame, folder: str):
    """Running heat in a table under ``folder`` (``KeyedTable`` of session and node): a batch writes the parts that its nodes fall in."""
    table = KeyedTable(events.sparkSession, folder, ["session_id", "node_id"])
    return stream_heat(events).writeStream.outputMode("update").foreachBatch(lambda df, n: table.upsert(df, n))


def stream_diff(events: DataFrame, baseline: DataFrame, write, folder: str | None = None, changes=None):
    """A running comparison with a fixed baseline, kept in a table under ``folder`` (one of its own where none is given): ``write(diff, batch)`` gets the whole table after each
    batch, to be read as far as it is needed, and ``changes(diff, batch)``, where given, the rows of the batch's nodes.

    A batch reckons and writes the nodes that its events moved and no others; with a folder and a checkpoint, a query that is started again goes on.
    """
    from ..operators.events import rank_status

    if baseline.isEmpty():
        raise ValueError("the baseline is empty")
    spark = events.sparkSession
    base = baseline.select("node_id", F.col("heat").alias("count_a"))
    table = KeyedTable(spark, folder or new_folder(spark), ["node_id"])

    def status(df: DataFrame) -> DataFrame:
        a, b = F.col("count_a"), F.col("count_b")
        kind = F.when(a == 0, "new").when(b == 0, "gone").when(b > a, "hotter").when(b < a, "colder").otherwise("same")
        return df.withColumn("status", kind).withColumn("status_rank", rank_status())

    def batch(df: DataFrame, n: int) -> None:
        if table.sides.last() is None:
            table.upsert(status(base.withColumn("count_b", F.lit(0).cast("long"))), -1)  # nodes that the run has not touched
        moved = df.select("node_id", F.col("heat").alias("count_b")).join(base, "node_id", "left").na.fill(0, ["count_a"])
        moved = cut(status(moved.select("node_id", "count_a", "count_b")))
        table.upsert(moved, n)
        if changes is not None:
            changes(moved, n)
        write(table.read(), n)

    heat = events.where("node_id <> ''").groupBy("node_id").agg(F.sum("weight").cast("long").alias("heat"))
    return heat.writeStream.outputMode("update").foreachBatch(batch)


def recent(rows: DataFrame, now_ns: int, seconds: float = 60.0, max_events: int | None = None) -> DataFrame:
    """Rows (``session_id, idx, received_ns``) that are no older than ``seconds``, and of each session the last ``max_events`` of those."""
    kept = rows.where(F.col("received_ns") >= now_ns - int(seconds * 1_000_000_000))
    if max_events is None:
        return kept
    newest = Window.partitionBy("session_id").orderBy(F.desc("received_ns"), F.desc("idx"))
    return kept.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max_events).drop("_n")


SLOTS = 3


def stream_recent(events: DataFrame, folder: str, seconds: float = 60.0, max_events: int | None = None):
    """Keeps the recent history of a stream in ``folder`` for those who join late (``latest_recent``). A batch writes its own rows and no others.

    Time is cut into epochs of ``seconds``, which take three places in turn; the first batch of an epoch clears its place of rows that are two epochs old, so the folder holds
    three epochs at most. Age and count are exact when it is read. A batch that is run again replaces what it wrote.
    """

    def batch(df: DataFrame, n: int) -> None:
        now = time.time_ns()
        epoch = now // max(1, int(seconds * 1_000_000_000))
        place = f"{folder}/slot={epoch % SLOTS}"
        rows = df.withColumns({"received_ns": F.lit(now), "_seconds": F.lit(float(seconds)), "_most": F.lit(max_events).cast("long")})
        try:
            begun = not df.sparkSession.read.parquet(place).where(F.col("epoch") == epoch).isEmpty()
        except AnalysisException:  # nothing there yet
            begun = False
        if begun:
            rows.write.mode("overwrite").parquet(f"{place}/epoch={epoch}/batch={n}")
        else:
            rows.withColumns({"epoch": F.lit(epoch), "batch": F.lit(n)}).write.mode("overwrite").partitionBy("epoch", "batch").parquet(place)

    return events.writeStream.foreachBatch(batch)


def latest_recent(spark: SparkSession, folder: str, now_ns: int | None = None) -> DataFrame | None:
    """The rows that ``stream_recent`` keeps, as of ``now_ns`` (now): those young enough, and of each session no more than its cap. None where there are none."""
    try:
        held = spark.read.parquet(folder)
    except AnalysisException:  # not written yet
        return None
    last = held.orderBy(F.desc("received_ns")).select("_seconds", "_most", "received_ns").first()
    if last is None:
        return None
    now = time.time_ns() if now_ns is None else now_ns
    young = held.where(F.col("epoch") >= now // max(1, int(last._seconds * 1_000_000_000)) - 1)  # prunes folders
    return recent(young, now, last._seconds, last._most).drop("_seconds", "_most", "slot", "epoch", "batch")


SESSION = "connection string, session_id string, started_ns long, ended_ns long, event_count long"


def _sessions(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The open recording of one connection in state. Messages of a batch are taken in ``seq`` order."""
    sid, first, last, n = state.get if state.exists else (None, -1, -1, 0)
    done = []
    for r in pd.concat(list(chunks)).dropna(subset="seq").sort_values("seq").itertuples():
        if r.type == "trace_event" and sid:
            n += 1
            if not pd.isna(r.ts_ns):  # an event without a time counts and moves no bound
                first, last = (int(r.ts_ns) if first < 0 else first), max(last, int(r.ts_ns))
        elif r.type in ("trace_session_start", "trace_session_end"):
            if sid and n:  # empty recordings leave no session
                done.append((*key, sid, None if first < 0 else first, None if last < 0 else last, n))
            named = r.type == "trace_session_start" and isinstance(r.session_id, str)
            sid, first, last, n = (r.session_id or None) if named else None, -1, -1, 0
    state.update((sid, first, last, n))
    out = pd.DataFrame(done, columns=[c.split()[0] for c in SESSION.split(", ")])
    yield out.astype({"started_ns": "Int64", "ended_ns": "Int64"})


def stream_sessions(messages: DataFrame) -> DataFrame:
    """Sessions as they end (append mode) of ``messages(connection, seq, type, session_id, ts_ns)``. A new start ends the session before it; sessions without events
    are left out; events outside a session are ignored, as are rows without ``seq``; a session none of whose events has a time has no times. The rows go to ``save_sessions``."""
    return messages.groupBy("connection").applyInPandasWithState(_sessions, SESSION, "sid string, first long, last long, n long", "append", GroupStateTimeout.NoTimeout)


POINT = "session_id string, idx long, epoch long, loss double, accuracy double, run long"


def _points(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last epoch of a session and the number of its run in state."""
    last, run = state.get if state.exists else (-1, -1)
    out = []
    for r in pd.concat(list(chunks)).sort_values("idx").itertuples():
        run = max(run, 0) + (1 if run >= 0 and r.epoch <= last else 0)
        last = r.epoch
        out.append((*key, r.idx, r.epoch, r.loss, r.accuracy, run))
    state.update((int(last), int(run)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in POINT.split(", ")])


def stream_metric_series(events: DataFrame, suffix: str = "metrics.py:record_epoch") -> DataFrame:
    """Finite metric points as they arrive (append mode), with ``run``: a run starts where the epoch does not rise, also across batches."""
    from ..operators.series import metric_tuples

    points = metric_tuples(events, suffix, 2).where("finite").select("session_id", "idx", "epoch", F.col("numbers")[0].alias("loss"), F.col("numbers")[1].alias("accuracy"))
    return points.groupBy("session_id").applyInPandasWithState(_points, POINT, "last long, run long", "append", GroupStateTimeout.NoTimeout)


def stream_graph(files: DataFrame, extract, analyse, write, folder: str | None = None):
    """Refreshes a graph from changed files: ``files(path, hash, text)`` as they arrive, a null text for one that is gone.

    Each batch computes ``extract(files)`` (rows with ``path`` and ``hash``) for files whose hash is new and keeps the rest of the table before,
    then hands ``analyse(rows)`` of the whole table and the batch's changes of files to ``write(result, changes, batch)``. Of several rows of a file in one batch the last by
    ``ord`` counts where that column is there.

    The two tables, of files and of rows, stand in ``folder`` (one of its own where none is given) with the number of their batch, in two places that are written in turn: with
    the same folder and checkpoint a query that is started again goes on from the last whole batch, and runs a broken one again from the tables before it.
    """
    from ..sources.files import reuse_partials
    from ..sources.traces import snapshot_diff

    sides = Sides(files.sparkSession, folder or new_folder(files.sparkSession))

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        if "ord" in df.columns:
            df = df.groupBy("path").agg(F.max_by(F.struct("hash", "text"), "ord").alias("f")).select("path", "f.*")
        last, place = sides.last(n), sides.next(n)
        came = df.where("text is not null")
        fresh = extract(came)
        before = spark.read.parquet(f"{last[1]}/files") if last else df.select("path", "hash").limit(0)
        kept = spark.read.parquet(f"{last[1]}/rows") if last else fresh.limit(0)
        now = before.join(df.select("path").distinct(), "path", "left_anti").unionByName(came.select("path", "hash"))
        changes = snapshot_diff(before.select(F.col("path").alias("key"), "hash"), now.select(F.col("path").alias("key"), "hash"))
        files_now = cut(now, f"{place}/files")
        rows = cut(reuse_partials(files_now, kept, lambda missing: extract(came.join(missing.select("path", "hash"), ["path", "hash"], "left_semi"))), f"{place}/rows")
        sides.commit(n, place)
        write(analyse(rows), changes, n)

    return files.writeStream.foreachBatch(batch)
