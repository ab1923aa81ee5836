"""JSON documents of any size, an element of one of their arrays a row, read in parts by bytes.

A part does not know whether it begins inside a string or how deep. Each is looked at once on its own: whether its quotes leave a string open, and how much deeper it leads for
either beginning. Sums of these over the parts before give every part its beginning; then each gives the elements that start in it. No task holds more than its part and the
rest of its last element, and a document is as many tasks as it has parts.

Documents are listed by Spark; their bytes are read by the tasks through pyarrow's file systems, so a path is shared or in a store that pyarrow knows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.events import dense_index
from ..storage import cut
from .logs import _system

PART = 16 << 20
NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)
SPACE = b" \t\r\n"


class Part:
    """Bytes of a document with what stands outside strings: ``deep[i]`` is the depth before byte i, ``mark[i]`` its byte where it is structure, else 0."""

    def __init__(self, data: bytes, escaped: bool, inside: int, depth: int):
        b = np.frombuffer(data, np.uint8)
        at = np.arange(len(b))
        last = np.maximum.accumulate(np.where(b != 92, at, -1)) if len(b) else at
        run = np.append(0, (at - last)[:-1]) if len(b) else at  # backslashes just before each byte
        lead = np.append(-1, last[:-1]) < 0 if len(b) else at  # they reach to the beginning
        odd = (run + (lead & escaped)) % 2 == 1
        quote = (b == 34) & ~odd
        before = inside + np.cumsum(quote) - quote
        self.outside = (before % 2 == 0) & ~quote
        step = np.where(self.outside, ((b == 123) | (b == 91)).astype(np.int64) - ((b == 125) | (b == 93)), 0)
        self.delta, self.quotes = int(step.sum()), int(quote.sum())
        self.deep = depth + np.cumsum(step) - step
        self.mark = np.where(self.outside, b, 0)
        self.end = (inside + self.quotes) % 2, depth + self.delta  # whether a string is open behind it, and how deep

    def borders(self, level: int) -> np.ndarray:
        """Where a container that stands at ``level`` opens, its elements are divided, and it closes."""
        opens = ((self.mark == 123) | (self.mark == 91)) & (self.deep == level - 1)
        inner = ((self.mark == 44) | (self.mark == 125) | (self.mark == 93)) & (self.deep == level)
        return np.flatnonzero(opens | inner)


def _escaped(f, at: int) -> bool:
    """Whether an odd number of backslashes stands before a byte."""
    n = 0
    while at > 0:
        low = max(0, at - 256)
        f.seek(low)
        piece = f.read(at - low)
        own = len(piece) - len(piece.rstrip(b"\\"))
        n += own
        if own < len(piece):
            break
        at = low
    return n % 2 == 1


def _name(f, at: int) -> str | None:
    """The key of the value that begins at a byte."""
    f.seek(max(0, at - 4096))
    m = NAME.search(f.read(min(at, 4096)))
    return m[1].decode("utf-8", "replace") if m else None


def _each(batches, columns: tuple[str, ...]):
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "start", "stop", *columns))):
            system, path = _system(row[0])
            with system.open_input_file(path) as f:
                yield f, row


def _look(batches):
    """``quotes`` of a part, and the depths it leads to from outside a string (``d0``) and from inside one (``d1``)."""
    for f, (path, part, start, stop) in _each(batches, ()):
        escaped = _escaped(f, start)
        f.seek(start)
        data = f.read(stop - start)
        a, b = Part(data, escaped, 0, 0), Part(data, escaped, 1, 0)
        yield pa.RecordBatch.from_pylist([{"path": path, "part": part, "start": start, "stop": stop, "quotes": a.quotes, "d0": a.delta, "d1": b.delta}])


def _take(level: int):
    kinds = pa.schema([("path", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("opened", pa.int64()), ("name", pa.string()), ("array", pa.bool_()), ("value", pa.string())])

    def run(batches):
        """Elements that start in a part (``at``, ``value``) with where their container opened, null if in a part before; containers that open in it, with their name."""
        for f, (path, part, start, stop, inside, depth) in _each(batches, ("inside", "depth")):
            escaped = _escaped(f, start)
            f.seek(start)
            data = f.read(stop - start)
            p = Part(data, escaped, inside, depth)
            at = p.borders(level)
            out, opened = [], None
            for k, i in enumerate(at.tolist()):
                c = data[i]
                if c in b"[{":
                    opened = start + i
                    out.append((path, part, opened, opened, _name(f, opened), c == 91, None))
                if c in b"]}":
                    continue
                if k + 1 < len(at):
                    value = data[i + 1 : int(at[k + 1])]
                else:
                    value = data[i + 1 :] + _rest(f, stop, p, level)
                if value.strip(SPACE):
                    out.append((path, part, start + i + 1, opened, None, None, value.strip(SPACE).decode("utf-8", "replace")))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), kinds)], schema=kinds)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), kinds)], schema=kinds)

    return run


def _rest(f, stop: int, p: Part, level: int) -> bytes:
    """What follows a part up to the end of the element that is under way there."""
    out, at = b"", stop
    inside, depth = p.end
    while True:
        f.seek(at)
        piece = f.read(1 << 20)
        if not piece:
            return out
        more = Part(piece, _escaped(f, at), inside, depth)
        end = more.borders(level)
        if len(end):
            return out + piece[: int(end[0])]
        out += piece
        (inside, depth), at = more.end, at + len(piece)


def elements(spark: SparkSession, path: str, array: str | None, part: int = PART) -> DataFrame:
    """``doc, ord, value``: the elements of the array named ``array`` on the top level of each document, in order, as JSON text; without a name those of documents that are
    arrays themselves. Documents without that array, or with an empty one, give no rows; what no element can be (text behind the end) is left out."""
    level = 1 if array is None else 2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    begin = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part).cast("long"))
    parts = files.where("length > 0").select("path", "length", F.posexplode(begin).alias("part", "start"))
    parts = parts.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("part").cast("long").alias("part"), "start", F.least(F.col("start") + part, "length").alias("stop")).repartition("path", "part")
    look = parts.mapInArrow(_look, "path string, part long, start long, stop long, quotes long, d0 long, d1 long")
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    look = look.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    look = look.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))).over(before), F.lit(0)))
    found = look.select("path", "part", "start", "stop", "inside", "depth").repartition("path", "part").mapInArrow(_take(level), "path string, part long, at long, opened long, name string, array boolean, value string")
    found = cut(found)
    opens = found.where("value is null").select("path", "part", F.col("opened").alias("o"), "name", "array")
    last = opens.groupBy("path", "part").agg(F.max("o").alias("o"))
    every = found.select("path", "part").distinct().join(last, ["path", "part"], "left")
    came = every.select("path", "part", F.last("o", ignorenulls=True).over(before).alias("came"))
    rows = found.where("value is not null").join(came, ["path", "part"]).withColumn("o", F.coalesce("opened", "came"))
    wanted = opens.where(F.col("array") & (F.lit(True) if array is None else F.col("name") == array)).select("path", "o")
    rows = rows.join(wanted, ["path", "o"], "left_semi").select(F.col("path").alias("doc"), "at", "value")
    return dense_index(rows, "doc", "at", part).select("doc", F.col("idx").alias("ord"), "value")
