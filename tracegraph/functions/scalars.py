"""Column functions: weights, labels, matching, paths, redaction. All native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments of argument names that hold credentials.
SENSITIVE = (
    "password", "passwd", "secret", "token", "credential", "api_key", "apikey", "private_key", "secret_key", "access_key",
    "signing_key", "authorization", "auth_token", "bearer",
)


# Fixed value: the styles of a path parameter, {id}, :id and <id>.
PARAM = r"\{[^}]+\}|:[a-zA-Z_][a-zA-Z0-9_]*|<[a-zA-Z_][a-zA-Z0-9_]*>"


def event_weight(metadata: Column) -> Column:
    """``metadata.count`` of a JSON object, cut to a whole number of 1 at least; 1 where it is absent or no number."""
    v = F.try_variant_get(F.try_parse_json(metadata), "$.count", "variant")
    numeric = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    d = F.try_variant_get(v, "$", "double")
    ok = numeric & (F.abs(d) < 9.2e18) & (d >= 1)
    return F.when(ok, F.floor(d).cast("long")).otherwise(F.lit(1).cast("long"))


def matches_node(node_id: Column, suffix: str) -> Column:
    return (node_id == suffix) | F.endswith(node_id, F.lit("/" + suffix))


def matches_method(node_id: Column, file: str, method: str) -> Column:
    """Path before the last colon is or ends with ``file``; the name behind it has a dot and ends in ``method``."""
    name = F.substring_index(node_id, ":", -1)
    path = F.regexp_replace(node_id, r":[^:]*$", "")
    return F.contains(node_id, F.lit(":")) & matches_node(path, file) & F.contains(name, F.lit(".")) & (F.substring_index(name, ".", -1) == method)


def frame_label(node_id: Column) -> Column:
    return F.substring_index(F.substring_index(node_id, ":", -1), "/", -1)


def redact(name: Column, value: Column) -> Column:
    """The value, or ``<redacted>`` where the name, lower-cased and with ``-`` as ``_``, holds a sensitive part."""
    return F.when(F.translate(F.lower(name), "-", "_").rlike("|".join(SENSITIVE)), F.lit("<redacted>")).otherwise(value)


def redact_args(args: Column) -> Column:
    """An array of captured arguments (``name, repr, redacted, truncated``) in which sensitive ones are marked and lose their value."""
    hide = lambda a: F.coalesce(F.translate(F.lower(a["name"]), "-", "_").rlike("|".join(SENSITIVE)), F.lit(False))
    one = lambda a: F.struct(
        a["name"].alias("name"), F.when(hide(a), F.lit("<redacted>")).otherwise(a["repr"]).alias("repr"),
        (hide(a) | F.coalesce(a["redacted"], F.lit(False))).alias("redacted"), a["truncated"].alias("truncated"),
    )
    return F.transform(args, one)


def is_clamped(text: Column, n: int) -> Column:
    """Whether :func:`clamp_middle` shortens the text."""
    return F.coalesce(F.length(text) > n, F.lit(False))


def visible(search: str = "", hidden_kinds: tuple[str, ...] = (), exclude: tuple[str, ...] = (), names: tuple[str, ...] = ("name", "path")) -> Column:
    """Whether a node (columns ``kind, path`` and ``names``) is shown: its kind is not hidden, no glob holds its path, and the search, in any case, is part of a name."""
    out = ~F.coalesce(F.col("kind").isin(list(hidden_kinds)), F.lit(False)) if hidden_kinds else F.lit(True)
    for g in exclude:
        out = out & ~F.coalesce(glob_match(F.col("path"), g), F.lit(False))
    if search:
        found = F.lit(False)
        for c in names:
            found = found | F.coalesce(F.contains(F.lower(c), F.lit(search.lower())), F.lit(False))
        out = out & found
    return out


def is_private(name: Column) -> Column:
    return F.startswith(name, F.lit("_")) & ~is_dunder(name)


def is_test(name: Column, path: Column) -> Column:
    """A test by its own name, its file's, or a folder ``tests`` on the way."""
    return F.startswith(name, F.lit("test_")) | F.array_contains(F.split(path, "/"), "tests") | F.startswith(F.substring_index(path, "/", -1), F.lit("test_"))


def path_depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).cast("long")


def name_flags(name: Column, path: Column) -> list[Column]:
    return [is_dunder(name).alias("is_dunder"), is_private(name).alias("is_private"), is_test(name, path).alias("is_test"), path_depth(path).alias("path_depth")]


def offset_line(text: Column, offset: Column | int) -> Column:
    """Line, from 1, of the character at ``offset``."""
    head = F.left(text, offset if isinstance(offset, Column) else F.lit(offset))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def clamp_middle(text: Column, n: int) -> Column:
    i = (n - 3) // 2
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(i)), F.lit("..."), F.right(text, F.lit(n - 3 - i))))


def posix_path(path: Column, root: str = "") -> Column:
    """Forward slashes, relative to ``root``, ``.`` and ``..`` folded."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if root:
        p = F.regexp_replace(p, "^" + re.escape(root.rstrip("/")) + "/", "")
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")


def glob_match(path: Column, glob: str) -> Column:
    """Anchored; ``*`` crosses slashes, ``?`` is one character."""
    return path.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$")


def normalize_http_path(path: Column) -> Column:
    p = F.regexp_replace(F.lower(F.trim(path)), "/+$", "")
    return F.regexp_replace(p, PARAM, "{param}")


def path_segments(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def is_dunder(name: Column) -> Column:
    return F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")) & (F.length(name) >= 5)
