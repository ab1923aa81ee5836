"""Processors that keep what a stream has to remember: open frames of a thread, threads of a session.

They need the RocksDB state store, which :func:`rocks` asks for where the session has the default one; a batch then reads and writes only the entries it touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocks(spark: SparkSession) -> None:
    if not (spark.conf.get(PROVIDER, None) or "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


FRAME = (
    "session_id string, thread_id long, call_idx long, close_idx long, parent_idx long, node_id string, depth int, start_ns long, end_ns long, total_ns long,"
    " self_ns long, synthetic boolean"
)
FRAME_NAMES = [c.split()[0] for c in FRAME.split(", ")]


class Stack:
    """The open frames of one thread in a map state by their level. Levels are read when they come to the top and written when the batch is over, if they changed."""

    def __init__(self, state, height: int):
        self.state, self.height, self.held, self.changed, self.stored = state, height, {}, set(), height

    def top(self) -> list | None:
        k = self.height - 1
        if k < 0:
            return None
        if k not in self.held:
            self.held[k] = list(self.state.getValue((k,)))
        return self.held[k]

    def touch(self) -> None:
        self.changed.add(self.height - 1)

    def push(self, frame: list) -> None:
        self.height += 1
        self.held[self.height - 1] = frame
        self.touch()

    def pop(self) -> list:
        frame = self.top()
        self.height -= 1
        del self.held[self.height]
        self.changed.discard(self.height)
        return frame

    def write(self) -> None:
        for k in range(self.height, self.stored):
            self.state.removeKey((k,))
        for k in self.changed:
            self.state.updateValue((k,), tuple(self.held[k]))


class Frames(StatefulProcessor):
    """Frames of a (session, thread) as they close. State: a frame per level, and how many there are with the thread's latest time."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "level int", "idx long, node string, depth int, start long, inner long")
        self.mark = handle.getValueState("mark", "height int, latest long")

    def _close(self, key, stack: Stack, idx, ts, normal: bool) -> Row:
        i, node, depth, start, inner = stack.pop()
        end = start if ts is None else ts if start is None else max(start, ts)
        total = None if start is None or end is None else end - start
        up = stack.top()
        if up and total:
            up[4] += total
            stack.touch()
        return Row(**dict(zip(FRAME_NAMES, (*key, i, idx, up[0] if up else None, node, depth, start, end, total, max(0, (total or 0) - inner), not normal))))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        height, latest = self.mark.get() if self.mark.exists() else (0, None)
        stack = Stack(self.open, height)
        for r in sorted((r for r in rows if r.idx is not None), key=lambda r: r.idx):
            if r.event == "end":
                while stack.height:
                    yield self._close(key, stack, None, latest, False)
                latest = None
                continue
            if r.ts_ns is not None:
                latest = r.ts_ns if latest is None else max(latest, r.ts_ns)
            if r.event not in ("call", "return") or r.frame_depth is None:
                continue
            while stack.height and stack.top()[2] >= r.frame_depth:
                yield self._close(key, stack, r.idx, latest if r.ts_ns is None else r.ts_ns, r.event == "return" and stack.top()[2] == r.frame_depth)
            if r.event == "call":
                stack.push([r.idx, r.node_id, r.frame_depth, r.ts_ns, 0])
        stack.write()
        if stack.height or latest is not None:
            self.mark.update((stack.height, latest))
        elif self.mark.exists():
            self.mark.clear()
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if stack.height:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.mark.exists():
            height, latest = self.mark.get()
            stack = Stack(self.open, height)
            while stack.height:
                yield self._close(key, stack, None, latest, False)
            stack.write()
            self.mark.clear()

    def close(self) -> None:
        pass


class Ends(StatefulProcessor):
    """An ``end`` of a session for each thread that it has shown up to then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.threads = handle.getMapState("threads", "thread_id long", "idx long")
        self.nameless = handle.getValueState("nameless", "idx long")  # a key of a map is no null

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted((r for r in rows if r.idx is not None), key=lambda r: (r.idx, r.event == "end")):
            if r.event == "end":
                for (thread,) in list(self.threads.keys()):
                    yield Row(session_id=key[0], thread_id=thread, idx=r.idx)
                if self.nameless.exists():
                    yield Row(session_id=key[0], thread_id=None, idx=r.idx)
                    self.nameless.clear()
                self.threads.clear()
            elif r.thread_id is None:
                self.nameless.update((r.idx,))
            elif not self.threads.containsKey((r.thread_id,)):
                self.threads.updateValue((r.thread_id,), (r.idx,))

    def close(self) -> None:
        pass


def first_of_each(rows: DataFrame) -> DataFrame:
    """``session_id, thread_id, event, idx`` of a batch, a thread once a piece of the batch: what :class:`Ends` needs of it, made small before it is sent."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shown = table.group_by(["session_id", "thread_id", "event"]).aggregate([("idx", "min")])
            yield from shown.select(["session_id", "thread_id", "event", "idx_min"]).rename_columns(["session_id", "thread_id", "event", "idx"]).combine_chunks().to_batches()

    kinds = rows.selectExpr("session_id", "cast(thread_id as bigint) thread_id", "if(event = 'end', 'end', '') event", "idx")
    ends, others = kinds.where("event = 'end'"), kinds.where("event is distinct from 'end'").selectExpr("session_id", "thread_id", "'' event", "idx")
    return others.mapInArrow(run, "session_id string, thread_id long, event string, idx long").unionByName(ends)
