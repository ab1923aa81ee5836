"""Growing logs as a stream: a log is followed by the byte, so a batch reads what has been added and no file is ever one value.

``spark.dataSource.register(ConnectionLogs)``, then ``spark.readStream.format("connection_logs").option("path", folder)``. The folder is read by the driver and the tasks
through pyarrow's file systems, so it is a path that both share or a store that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TAIL = 1 << 16


class Span(NamedTuple):
    """Bytes of a log: the lines that start in them."""

    path: str
    start: int
    end: int
    first: bool  # whether a line starts at ``start``


class SpanPartition(InputPartition):
    def __init__(self, span: Span):
        super().__init__(span)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_lines(f, start: int, limit: int, size: int) -> int:
    """Where the last whole line of the bytes from ``start`` to ``limit`` ends; of a line that is longer than that, its end; ``start`` where it has none yet."""
    at = limit
    while at > start:
        low = max(start, at - TAIL)
        f.seek(low)
        k = f.read(at - low).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        at = low
    at = limit
    while at < size:
        f.seek(at)
        piece = f.read(min(TAIL, size - at))
        k = piece.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(piece)
    return start


def lines_of(f, span: Span) -> Iterator[tuple[int, bytes]]:
    """Each line that starts in the span with its place."""
    at, rest = span.start, b""
    f.seek(at)
    skip = not span.first
    if skip:  # the line that is under way here belongs to the span before
        at -= 1
        f.seek(at)
    while True:
        while (k := rest.find(b"\n")) >= 0:
            if not skip:
                if at >= span.end:
                    return
                yield at, rest[:k]
            skip = False
            at, rest = at + k + 1, rest[k + 1 :]
        if not skip and at >= span.end:
            return
        piece = f.read(1 << 20)
        if not piece:
            return
        rest += piece


class LogReader(DataSourceStreamReader):
    """Offsets are bytes by log. A batch takes ``maxBytesPerBatch`` (64 MB), whole lines only; a task ``maxBytesPerPartition`` (16 MB)."""

    def __init__(self, options):
        self.path = options["path"]
        self.batch = int(options.get("maxBytesPerBatch", 64 << 20))
        self.part = int(options.get("maxBytesPerPartition", 16 << 20))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = _system(self.path)
        out, left = dict(self.at or {}), self.batch
        for info in sorted(system.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
            done = out.get(info.path, 0)
            if info.type != fs.FileType.File or info.size <= done or left <= 0:
                continue
            with system.open_input_file(info.path) as f:
                end = whole_lines(f, done, min(info.size, done + left), info.size)
            if end > done:
                out[info.path] = end
                left -= end - done
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:
            self.at = dict(end)  # a query that is started again plans its last batch first
        spans = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            spans += [Span(path, a, min(stop, a + self.part), a == first) for a in range(first, stop, self.part)]
        return [SpanPartition(s) for s in spans]

    def read(self, partition: SpanPartition) -> Iterator[tuple]:
        system, _ = _system(self.path)
        span = Span(*partition.value)
        with system.open_input_file(span.path) as f:
            for at, line in lines_of(f, span):
                yield span.path, at, line.decode("utf-8", "replace").removesuffix("\r")

    def commit(self, end: dict) -> None:
        pass


class ConnectionLogs(DataSource):
    """``connection`` (the log's path), ``seq`` (the byte at which a line starts, growing in a log) and ``value`` (the line)."""

    @classmethod
    def name(cls) -> str:
        return "connection_logs"

    def schema(self) -> str:
        return "connection string, seq long, value string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)
