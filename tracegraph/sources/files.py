"""Source files, snapshots of them, reuse of results per file, corpora and the session registry."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .traces import read_lines, snapshot_diff


def glob_pattern(glob: str) -> str:
    """A file-name glob (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored pattern; ``*`` crosses slashes."""
    out, rest = "", glob
    while rest:
        seq = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if rest[0] == "[" and seq:
            out += "[" + ("^" if seq[1] else "") + seq[2].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&") + "]"
            rest = rest[seq.end() :]
            continue
        out += {"*": ".*", "?": "."}.get(rest[0]) or re.escape(rest[0])
        rest = rest[1:]
    return f"(?s)^{out}$"


def read_sources(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """``path`` (relative), ``text`` and ``hash`` of the files under ``root``. A glob of ``exclude`` hits the whole relative path or the file's own name.
    Spark's file sources list no empty files, so those give no row."""
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.url_decode(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B")))
    files = raw.select(F.substring(full, F.length(F.lit(base)) + 1, F.length(full)).alias("path"), "content")
    if suffixes:
        files = files.where(F.col("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    for g in exclude:
        files = files.where(~(F.col("path").rlike(glob_pattern(g)) | F.substring_index("path", "/", -1).rlike(glob_pattern(g))))
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("hash"))


def snapshot(sources: DataFrame) -> DataFrame:
    """``key, hash`` of each file, for ``snapshot_diff``."""
    return sources.select(F.col("path").alias("key"), "hash")


def reuse_partials(files: DataFrame, cached: DataFrame, compute) -> DataFrame:
    """Rows per file (with ``path`` and ``hash``): those of ``cached`` where path and hash still hold, and ``compute(files)`` for the files without.

    A file of which ``cached`` has no row is computed again; rows of files that are gone or changed are left out.
    """
    key = ["path", "hash"]
    again = compute(files.join(cached.select(key).distinct(), key, "left_anti"))
    return cached.join(files.select(key).distinct(), key, "left_semi").unionByName(again)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return snapshot_diff(snapshot(old), snapshot(new))


def register_trace(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """A session row for a trace file: its id follows from its absolute path, so a file is one session however it is named; its count is that of non-blank lines, its times
    are the file's own. A path with a scheme is taken as it is."""
    whole = re.sub(r"^file:/*", "/", path) if path.startswith("file:") else path
    if "://" not in whole:
        whole = os.path.realpath(whole)
    times = spark.read.format("binaryFile").load(path).agg((F.unix_micros(F.max("modificationTime")) * 1000).alias("at"))
    n = read_lines(spark, path).agg(F.count("*").alias("event_count"))
    return n.join(F.broadcast(times)).select(  # one row each
        F.lit(str(uuid.uuid5(uuid.NAMESPACE_URL, whole))).alias("id"), F.lit(whole.rsplit("/", 1)[-1]).alias("label"), F.col("at").alias("started_ns"),
        F.col("at").alias("ended_ns"), F.lit(whole).alias("source_path"), "event_count", F.lit(language).cast("string").alias("language"),
    )


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Newest first, then by id; sessions without a start last."""
    return sessions.orderBy(F.desc_nulls_last("started_ns"), "id")


def get_session(sessions: DataFrame, session: str) -> DataFrame:
    """The row with that id, if any."""
    return sessions.where(F.col("id") == session)


def pair_corpus(files: DataFrame) -> DataFrame:
    """``stem, graph, trace`` from paths ``*.graph.json`` and ``*.trace.jsonl`` (``files(path)``); a stem without its twin is an error when read."""
    name = F.substring_index("path", "/", -1)
    part = lambda ending, to: files.where(F.endswith("path", F.lit(ending))).groupBy(F.regexp_replace(name, re.escape(ending) + "$", "").alias("stem")).agg(F.min("path").alias(to))
    both = part(".graph.json", "graph").join(part(".trace.jsonl", "trace"), "stem", "full_outer")
    alone = F.assert_true(F.col("graph").isNotNull() & F.col("trace").isNotNull(), F.concat(F.lit("no twin: "), "stem"))
    return both.select("stem", F.when(alone.isNull(), F.col("graph")).alias("graph"), "trace").orderBy("stem")
