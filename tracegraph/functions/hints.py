"""Hints of links between programs, found in source text by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARG = r"\s*\(\s*['\"]([^'\"]+)['\"]"

# Fixed values: (language, kind, pattern); group 1 is the path or command.
PATTERNS = [
    ("python", "http_client", r"(?:requests|httpx)\s*\.\s*(?:get|post|put|delete|patch|request)" + _ARG),
    ("python", "http_client", r"urllib\.request\.urlopen" + _ARG),
    ("python", "http_server", r"@\w+\.route" + _ARG),
    ("python", "http_server", r"@\w+\.(?:get|post|put|delete|patch)" + _ARG),
    ("python", "http_server", r"\bpath" + _ARG),
    ("python", "subprocess", r"subprocess\.(?:run|Popen|call)\s*\(\s*\[([^\]]+)\]"),
    ("python", "subprocess", r"os\.system" + _ARG),
    ("typescript", "http_client", r"\bfetch" + _ARG),
    ("typescript", "http_client", r"\baxios\s*\.\s*(?:get|post|put|delete|patch|request)" + _ARG),
    ("typescript", "http_server", r"(?:app|router)\s*\.\s*(?:get|post|put|delete|patch)" + _ARG),
    ("typescript", "subprocess", r"(?:exec|spawn|fork)" + _ARG),
    ("typescript", "subprocess", r"\bexeca" + _ARG),
    ("go", "http_client", r"\bhttp\s*\.\s*(?:Get|Post|Put|Delete|Patch|NewRequest)" + _ARG),
    ("go", "http_server", r"(?:\w+)\s*\.\s*HandleFunc" + _ARG),
    ("go", "http_server", r"\bhttp\s*\.\s*Handle" + _ARG),
    ("go", "subprocess", r"\bexec\s*\.\s*Command" + _ARG),
    ("rust", "http_client", r"\breqwest\s*::\s*get" + _ARG),
    ("rust", "http_client", r"\.(?:get|post|put|delete|patch)" + _ARG),
    ("rust", "http_server", r"\.route" + _ARG),
    ("rust", "subprocess", r"Command\s*::\s*new" + _ARG),
]


def _tagged(kind: str, ord_: int):
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(ord_).alias("ord"), i.alias("pos"), x["found"].alias("found"), x["line"].alias("line"))


def find_all(sources: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Every match in ``text`` of each ``(kind, pattern)``: ``path, kind, ord, pos, found`` (group 1) and ``line`` (of its start, from 1).
    Lines come from the line breaks of the pieces between matches, so a match may span lines."""
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    hits = []
    for ord_, (kind, pattern) in enumerate(patterns):
        p = F.lit(pattern)
        pieces, whole = F.transform(F.split("text", pattern, -1), breaks), F.transform(F.regexp_extract_all("text", p, 0), breaks)
        # breaks before each match: those of the pieces up to it and of the matches before it
        start = F.struct(F.array().cast("array<int>").alias("lines"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(F.array_append(acc["lines"], acc["n"] + x["a"]).alias("lines"), (acc["n"] + x["a"] + x["b"]).alias("n"))
        both = F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), whole, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        lines = F.aggregate(both, start, step, lambda acc: acc["lines"])
        found = F.zip_with(F.regexp_extract_all("text", p, 1), lines, lambda f, n: F.struct(f.alias("found"), (n + 1).alias("line")))
        hits.append(F.transform(found, _tagged(kind, ord_)))
    return sources.where("text is not null").select("path", F.explode(F.concat(*hits)).alias("h")).select("path", "h.*")


def extract_hints(sources: DataFrame, language: str) -> DataFrame:
    """``kind, node_id, language, path, command, line, ord, pos`` of ``sources(path, text)``. A list of arguments gives its first quoted one; lists without one give none."""
    found = find_all(sources, [(kind, pattern) for lang, kind, pattern in PATTERNS if lang == language])
    listed = (F.col("kind") == "subprocess") & F.col("ord").isin([i for i, (_, _, p) in enumerate([x for x in PATTERNS if x[0] == language]) if r"\[" in p and _ARG not in p])
    value = F.when(listed, F.regexp_extract("found", r"['\"]([^'\"]+)['\"]", 1)).otherwise(F.col("found"))
    out = found.withColumn("value", value).where("value <> ''")
    spawn = F.col("kind") == "subprocess"
    return out.select("kind", F.col("path").alias("node_id"), F.lit(language).alias("language"), F.when(~spawn, F.col("value")).alias("path"), F.when(spawn, F.col("value")).alias("command"), "line", "ord", "pos")
