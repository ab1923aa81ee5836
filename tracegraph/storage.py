"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets one of its own; any other is told to set it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-cut-"))
    return _own[0]


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table and read it back: lost executors redo nothing before it. With ``folder`` what was written there before is replaced."""
    spark = df.sparkSession
    path = folder or new_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Cuts of a loop in two folders in turn, so that the loop holds two rounds on disk and no more. A round may read the one before it only."""

    def __init__(self, spark: SparkSession):
        self.folders = [new_folder(spark), new_folder(spark)]

    def cut(self, df: DataFrame) -> DataFrame:
        self.folders.reverse()
        return cut(df, self.folders[0])


class Sides:
    """Two places under ``folder`` that batches write in turn, so that a batch that is broken off leaves the one before it whole.

    A place counts once the mark beside it has its batch's number. A batch that is run again, by a query that was started again too, finds what was there before it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _marks(self) -> dict[int, str]:
        marks = {}
        for side in (f"{self.folder}/side=0", f"{self.folder}/side=1"):
            try:
                for row in self.spark.read.schema("id long").parquet(f"{side}/mark").collect():  # one row
                    marks[row.id] = side
            except AnalysisException:  # not written yet
                continue
        return marks

    def last(self, before: int | None = None) -> tuple[int, str] | None:
        """The number and the place of the last whole batch (under ``before``)."""
        marks = self._marks()
        done = [n for n in marks if before is None or n < before]
        return (max(done), marks[max(done)]) if done else None

    def next(self, n: int) -> str:
        """Where batch ``n`` is to write."""
        last = self.last(n)
        return f"{self.folder}/side={1 if last and last[1].endswith('0') else 0}"

    def commit(self, n: int, place: str) -> None:
        self.spark.range(n, n + 1).coalesce(1).write.mode("overwrite").parquet(f"{place}/mark")


class KeyedTable:
    """A table of one row a key, in ``buckets`` parts by a hash of the key. An upsert reads and rewrites the parts that its keys fall in and no others.

    Each part has two places that are written in turn; a small table of which part stands where is written last (see :class:`Sides`), so an upsert counts whole
    or not at all, and one that is run again under the same number gives the same table.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets
        self.sides = Sides(spark, f"{folder}/where")

    def _where(self, before: int | None = None) -> dict[int, int]:
        last = self.sides.last(before)
        return {r.bucket: r.place for r in self.spark.read.parquet(f"{last[1]}/parts").collect()} if last else {}  # a row a bucket

    def _rows(self, where: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/rows/place={p}/bucket={b}" for b, p in sorted(where.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def upsert(self, rows: DataFrame, number: int | None = None) -> None:
        """``rows`` (one a key; keys may hold nulls) replace those of the same keys. ``number``: a batch's number, growing; the next one where it is not given."""
        if number is None:
            last = self.sides.last()
            number = last[0] + 1 if last else 0
        rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        where = self._where(number)
        old = self._rows({b: where[b] for b in touched if b in where})
        place = {b: 1 - where.get(b, 1) for b in touched}
        if touched:
            key = F.struct(*self.keys)
            new = rows
            if old is not None:
                old = old.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
                kept = old.withColumn("_key", key).join(rows.select(key.alias("_key")), "_key", "left_anti").drop("_key")
                new = kept.unionByName(rows, allowMissingColumns=True)
            at = F.when(F.col("bucket").isin([b for b in touched if place[b]]), 1).otherwise(0)
            new = new.withColumn("place", at).repartition("bucket")
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("place", "bucket").parquet(f"{self.folder}/rows")
        side = self.sides.next(number)
        self.spark.createDataFrame(sorted((where | place).items()), "bucket int, place int").coalesce(1).write.mode("overwrite").parquet(f"{side}/parts")
        self.sides.commit(number, side)

    def read(self) -> DataFrame | None:
        """The whole table; None before the first upsert."""
        return self._rows(self._where())

    def get(self, *key) -> DataFrame | None:
        """The rows of one key: only its part is read. None before the first upsert."""
        one = self.spark.range(1).select(F.pmod(F.xxhash64(*(F.lit(k) for k in key)), F.lit(self.buckets)).alias("b")).first().b
        where = self._where()
        if not where:
            return None
        part = self._rows({one: where[one]}) if one in where else self._rows(where).limit(0)
        for c, k in zip(self.keys, key):
            part = part.where(F.col(c).eqNullSafe(F.lit(k)))
        return part
