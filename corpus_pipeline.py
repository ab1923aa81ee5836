"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracegraph.llm import decontaminate, line_dedup, mixing, near_copies, quality
from tracegraph.llm._common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted by their host's frequent lines go; those lines go from the others."""
    return quality.kept_documents(docs).select(COLUMNS)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand earlier in the corpus go; documents of which no word is left go."""
    return line_dedup.deduped_documents(docs).select(COLUMNS)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_copies.one_of_each(docs, words=5, similarity=0.8).select(COLUMNS)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document taken, with how many of its words are (repeats counted) and its first slot in the schedule, by which the mix is read."""
    return mixing.mixed_documents(docs).select(*COLUMNS, "size", "source_size", "target", "taken", "first_slot")


STAGES = [
    ("quality rules", stage_quality),
    ("line dedup", stage_line_dedup),
    ("near-dedup", stage_near_dedup),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
]

#: Shingle fingerprints and content-defined chunks have no SQL form; run() as a whole is tested against a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
