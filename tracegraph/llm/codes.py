"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, found by Orchard's search.

Components are integers (``floor(scale * x)``), distances are squared and exact. Each entry of a codebook has the list of all entries by distance from
it. A search goes down the list of its best entry so far; where it meets a better one it jumps to that one's list; entries are looked at once; it stops where
the list has come to twice the distance of the best, beyond which, by the triangle inequality, nothing is nearer.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import host_key

#: Components of at most this size keep all distances in 64 bits; others are reckoned with Python's integers.
SMALL = 1 << 27
SALTS = 16


class Lists(NamedTuple):
    """A codebook of one part with its neighbour lists: ``order[e]`` the entries by distance from e, ``gap[e]`` those squared distances."""

    entries: np.ndarray
    order: np.ndarray
    gap: np.ndarray


def _small(values: np.ndarray) -> bool:
    return values.size == 0 or max(abs(int(values.max())), abs(int(values.min()))) <= SMALL


def neighbour_lists(entries: np.ndarray) -> Lists:
    """``entries``: (k, width) integers. Ties in distance go to the lower index."""
    e = entries if _small(entries) else entries.astype(object)
    gap = ((e[:, None, :] - e[None, :, :]) ** 2).sum(2)
    order = np.argsort(gap, axis=1, kind="stable")
    return Lists(entries, order, np.take_along_axis(gap, order, 1))


def orchard(queries: np.ndarray, lists: Lists, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``queries`` the nearest entry (the lowest index of equals), its squared distance, and how many distances were computed in all.

    All queries take a step at a time; those that have stopped leave.
    """
    n, k = len(queries), len(lists.entries)
    exact = _small(queries) and _small(lists.entries)
    q, e, gap = (queries, lists.entries, lists.gap) if exact else (queries.astype(object), lists.entries.astype(object), lists.gap.astype(object))
    best = np.full(n, start)
    dist = ((q - e[start]) ** 2).sum(1)
    seen = np.zeros((n, k), bool)
    seen[:, start] = True
    at = np.zeros(n, np.int64)
    live, computed = np.arange(n), n
    while len(live):
        # squared distances: beyond twice the distance is beyond four times its square; at it an equal of lower index may stand
        now = (at[live] < k) & (gap[best[live], np.minimum(at[live], k - 1)] <= 4 * dist[live])
        live = live[now.astype(bool)]
        if not len(live):
            break
        entry = lists.order[best[live], at[live]]
        at[live] += 1
        new = ~seen[live, entry]
        rows, entry = live[new], entry[new]
        seen[rows, entry] = True
        d = ((q[rows] - e[entry]) ** 2).sum(1)
        computed += len(rows)
        better = ((d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))).astype(bool)
        rows = rows[better]
        best[rows], dist[rows], at[rows] = entry[better], d[better], 0
    return best, dist, computed


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size == 0 or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape)


def usable(vector) -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))), F.lit(False))


class Codebooks(NamedTuple):
    """``entries``: of each part an integer array (entries, width). ``scale``: components were multiplied by it and floored."""

    entries: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def _batches(batch: pa.RecordBatch, dim: int, rows: int = 4096):
    """Vectors of a batch as arrays of at most ``rows`` rows."""
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield part, np.array(part.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _assigner(books: Codebooks):
    lists = [neighbour_lists(e) for e in books.entries]
    width = books.entries[0].shape[1]

    def assign(vectors: np.ndarray):
        whole = integers(vectors, books.scale)
        for p, one in enumerate(lists):
            part = whole[:, p * width : (p + 1) * width]
            yield p, part, *orchard(part, one)[:2]

    return assign


def _saturated(x) -> int:
    return min(int(x), (1 << 63) - 1)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of usable vectors: first the parts of the rows with the smallest ids, then ``rounds`` times each entry becomes the floor of the mean of the
    parts that are nearest to it. All vectors count in each round: tasks send one sum for each entry. Unused entries stay.

    The codebooks (parts x entries x width numbers) are held by the driver and sent to the tasks. None where there is no usable vector.
    Ties in ids go by the vector, null ids come last. The dimension is that of the first row whose dimension can be cut into equal parts; see :func:`encoded`.
    """
    if not 0 < entries <= 256:
        raise ValueError("a part's index is one byte: 1 to 256 entries")
    good = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    ordered = good.orderBy(F.asc_nulls_last("id"), "v")
    first = ordered.limit(entries).collect()
    if not first:
        return None
    dim = len(first[0].v)
    if any(len(r.v) != dim for r in first):
        first = ordered.where(F.size("v") == dim).limit(entries).collect()
    width = dim // parts
    start = integers(np.array([r.v for r in first]), scale)
    books = Codebooks([start[:, p * width : (p + 1) * width] for p in range(parts)], scale)
    own = good.where(F.size("v") == dim).select("v")
    for _ in range(rounds):
        assign = _assigner(books)

        def sums(batches, assign=assign, books=books):
            total = [np.zeros(e.shape, object) for e in books.entries]
            count = [np.zeros(len(e), np.int64) for e in books.entries]
            for batch in batches:
                for _, x in _batches(batch, dim):
                    for p, part, code, _ in assign(x):
                        count[p] += np.bincount(code, minlength=len(count[p]))
                        order = np.argsort(code, kind="stable")
                        used = np.unique(code)
                        total[p][used] += np.add.reduceat(part[order], np.searchsorted(code[order], used), axis=0).astype(object)
            rows = [(p, e, int(count[p][e]), [str(s) for s in total[p][e]]) for p in range(len(total)) for e in range(len(total[p])) if count[p][e]]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["part", "entry", "n", "sums"])

        rows = own.mapInArrow(sums, "part int, entry int, n long, sums array<string>")
        added = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(width)]
        for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # parts x entries rows at most
            mean = np.array([int(r[f"s{k}"]) // r.n for k in range(width)], object)
            book = books.entries[r.part]
            book = book.astype(object) if max(map(abs, mean)) >= 1 << 62 else book.copy()
            book[r.entry] = mean
            books.entries[r.part] = book
    return books


def encoded(vectors: DataFrame, books: Codebooks, keep: list[str], vector_col: str = "embedding") -> DataFrame:
    """``keep`` columns of each usable vector with ``code`` (bytes, one index a part) and ``error`` (its squared distances added up). One pass, no shuffle.

    Vectors that are null, hold null or non-finite components, or have another dimension than the codebooks are left out. Repeated rows give equal rows; an
    error that 64 bits cannot hold is given as the greatest number that they can.
    """
    width, assign = books.entries[0].shape[1], _assigner(books)
    dim = width * len(books.entries)
    good = vectors.select(*keep, F.col(vector_col).cast("array<double>").alias("_v")).where(usable(F.col("_v")) & (F.size("_v") == dim))

    def run(batches):
        for batch in batches:
            for part, x in _batches(batch, dim):
                found = list(assign(x))
                codes = np.stack([f[2] for f in found], 1).astype(np.uint8)
                error = sum(f[3].astype(object) for f in found) if any(f[3].dtype == object for f in found) else sum(f[3] for f in found)
                out = [*part.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([_saturated(e) for e in error], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "code", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema[:-1])
    return good.mapInArrow(run, f"{kinds}, code binary, error long")


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows with the same label (nulls are one) added up.

    Sums meet in one row a label; rows are dealt to ``SALTS`` copies of it, so that a label that holds a third of the rows is no single task.
    """
    salted = codes.withColumn("_key", host_key(label)).withColumn("_salt", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)))
    sums = codes.groupBy(host_key(label).alias("_key")).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(sums, ["_key", "_salt"], "left").drop("_key", "_salt")


def decoded(codes: DataFrame, books: Codebooks, keep: list[str], code: str = "code") -> DataFrame:
    """``keep`` columns and ``vector``: the codebook entries of a code put together, scaled back. Built-in expressions over a literal table."""
    table = F.lit([[[float(x) / books.scale for x in e] for e in book] for book in books.entries])
    at = F.sequence(F.lit(1), F.lit(len(books.entries)))
    one = lambda k: F.get(F.get(table, k - 1), F.conv(F.hex(F.substring(code, k, F.lit(1))), 16, 10).cast("int"))
    return codes.select(*keep, F.flatten(F.transform(at, one)).alias("vector"))
