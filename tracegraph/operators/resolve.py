"""Names to nodes: symbols of edges across files, source locations, stack frames.

A scope is a table with one row per (place, name); an aggregate picks the winner. Every distinct reference is asked once, by left joins with such
tables, and the answers are joined back to the edges, so a name used a million times costs one lookup.

Nodes: ``id, kind, name, path, node_ord`` (``receiver`` for crates). Edges: ``source, target, kind, resolved, edge_ord``, and on import edges
``names array<string>``, ``alias``, ``default_name``, ``aliases map<string,string>``; columns that are missing count as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import posix_path
from .events import as_of

UNRESOLVED = "<unresolved>"

# Names of the language that no file defines.
BUILTINS = (
    "abs all any bool bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec filter float format frozenset "
    "getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview min next object oct open ord "
    "pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip Exception ValueError "
    "TypeError KeyError IndexError AttributeError RuntimeError StopIteration OSError NotImplementedError OverflowError ZeroDivisionError"
).split()

# Frames of a profile that stand for no code.
PSEUDO_FRAMES = ["(root)", "(program)", "(idle)", "(garbage collector)", "(gc)"]

# What a relative specifier may leave out, in order of preference.
SUFFIXES = [".ts", ".tsx", ".mts", ".cts", "/index.ts", "/index.tsx"]
SCRIPT_SUFFIXES = [".ts", ".tsx"]

KINDS = {"module": ["inherit", "call"], "relative": ["inherit", "implements", "call"], "package": ["inherit", "call"], "crate": ["inherit", "implements", "call"]}


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def filled(text: Column) -> Column:
    return F.when(text != "", text)


def absolute_module(file: Column, module: Column) -> Column:
    """Dotted module that an import in ``file`` means: one leading dot is the file's package, each further one the package above."""
    tail = F.regexp_replace(module, r"^\.+", "")
    dots = F.length(module) - F.length(tail)
    parts = F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), ".")
    return F.when(dots == 0, module).otherwise(F.coalesce(filled(F.concat_ws(".", filled(base), filled(tail))), module))


def first_of(nodes: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    return nodes.groupBy(*keys).agg(F.min_by("id", "node_ord").alias(name))


def last_of(nodes: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    return nodes.groupBy(*keys).agg(F.max_by("id", "node_ord").alias(name))


def split_names(names: DataFrame) -> DataFrame:
    head = F.substring_index("name", ".", 1)
    return names.withColumns({"head": head, "rest": F.when(F.contains("name", F.lit(".")), F.substring("name", F.length(head) + 2, F.length("name")))})


def _by_module(nodes: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    defs = nodes.where("kind in ('class', 'function', 'method')")
    local = last_of(defs.select(F.col("path").alias("file"), F.col("name").alias("head"), "id", "node_ord"), "file", "head", name="own")

    listed = imports.where("names is not null").select("file", "target", "alias", "edge_ord", F.size("names").alias("n"), F.posexplode("names").alias("pos", "original"))
    listed = listed.withColumn("head", F.when(F.col("n") == 1, F.coalesce(filled(F.col("alias")), "original")).otherwise(F.col("original")))
    whole = imports.where("names is null").withColumns({"pos": F.lit(0), "original": F.lit(None).cast("string")})
    last_part = F.substring_index(F.regexp_replace("target", r"^\.+", ""), ".", -1)
    whole = whole.withColumn("head", F.coalesce(filled(F.col("alias")), filled(last_part), "target"))
    columns = ["file", "head", "target", "original", "edge_ord", "pos"]
    bound = listed.select(columns).union(whole.select(columns)).groupBy("file", "head").agg(F.max_by(F.struct("target", "original"), F.struct("edge_ord", "pos")).alias("b"))
    bound = bound.select("file", "head", F.lit(True).alias("imported"), absolute_module(F.col("file"), F.col("b.target")).alias("module"), "b.original")

    python = nodes.where("path like '%.py'").withColumn("stem", F.regexp_replace("path", r"\.py$", ""))
    python = python.withColumns({"init": F.endswith("stem", F.lit("/__init__")), "stem": F.regexp_replace("stem", "/__init__$", "")}).withColumn("module", F.replace("stem", F.lit("/"), F.lit(".")))
    chosen = last_of(python.where("kind = 'file'"), "module", name="chosen")
    # the file that a module names, else the plain file, else the package's file
    rank = F.when(F.col("path") == F.col("chosen"), 0).when(~F.contains("stem", F.lit(".")), F.when(F.col("init"), 2).otherwise(1))
    exports = last_of(python.where("kind in ('class', 'function')"), "path", "name", "module", "stem", "init").join(chosen, "module", "left").withColumn("rank", rank)
    exports = exports.where("rank is not null").groupBy("module", F.col("name").alias("symbol")).agg(F.min_by("id", "rank").alias("export"))

    asked = split_names(names).join(local, ["file", "head"], "left").join(bound, ["file", "head"], "left")
    asked = asked.withColumn("symbol", F.coalesce("rest", "original", "head")).join(exports, ["module", "symbol"], "left")
    dynamic = (F.col("name") == "") | F.startswith("name", F.lit("<"))
    method = F.col("is_call") & F.col("head").isin("self", "cls") & F.col("rest").isNotNull()
    plain = F.col("rest").isNull()
    builtin = plain & F.col("head").isin(BUILTINS)
    found = F.when(dynamic | method | builtin, None).when(plain & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("export"))
    missing = F.when(F.col("imported").isNull() & ~plain, "not_imported").otherwise("not_found")
    reason = F.when(dynamic, "dynamic").when(builtin, "builtin").when(~method & found.isNull(), missing)
    return asked.select("file", "name", "is_call", found.alias("found"), reason.alias("reason"))


def _by_relative_file(nodes: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    local = last_of(nodes.select(F.col("path").alias("file"), F.col("name").alias("head"), "id", "node_ord"), "file", "head", name="own")
    at = posix_path(F.concat_ws("/", filled(directory(F.col("file"))), F.col("target")))
    specs = imports.where("target like '.%'").select("file", "target").distinct().withColumn("at", at)
    script = F.regexp_replace("at", r"\.js$", "")
    tries = [F.concat("at", F.lit(s)) for s in SUFFIXES] + [F.when(F.endswith("at", F.lit(".js")), F.concat(script, F.lit(s))) for s in SCRIPT_SUFFIXES]
    files = nodes.where("kind = 'file'").select(F.col("id").alias("candidate")).distinct()
    specs = specs.select("file", "target", F.posexplode(F.array(*tries)).alias("pos", "candidate")).join(files, "candidate").groupBy("file", "target").agg(F.min_by("candidate", "pos").alias("module"))

    listed = imports.select("file", "target", "edge_ord", "aliases", F.posexplode("names").alias("pos", "original")).withColumn("head", F.coalesce(F.try_element_at("aliases", F.col("original")), "original"))
    default = imports.where("default_name is not null").select("file", "target", "edge_ord", F.lit(1 << 30).alias("pos"), F.lit(None).cast("string").alias("original"), F.col("default_name").alias("head"))
    columns = ["file", "head", "target", "original", "edge_ord", "pos"]
    bound = listed.select(columns).union(default.select(columns)).groupBy("file", "head").agg(F.max_by(F.struct("target", "original"), F.struct("edge_ord", "pos")).alias("b"))
    bound = bound.select("file", "head", "b.target", "b.original").join(specs, ["file", "target"]).drop("target")
    exported = nodes.where("kind in ('class', 'interface', 'function', 'type_alias', 'enum', 'method')")
    exports = last_of(exported.select(F.col("path").alias("module"), F.col("name").alias("symbol"), "id", "node_ord"), "module", "symbol", name="export")

    asked = split_names(names).join(local, ["file", "head"], "left").join(bound, ["file", "head"], "left")
    asked = asked.withColumn("symbol", F.coalesce("original", "head")).join(exports, ["module", "symbol"], "left")
    return asked.select("file", "name", "is_call", F.coalesce("own", "export").alias("found"), F.lit(None).cast("string").alias("reason"))


def _by_package(nodes: DataFrame, imports: DataFrame, names: DataFrame, root: str) -> DataFrame:
    defs = nodes.where("kind in ('struct', 'interface', 'function', 'type_alias') and path <> ''").select(directory(F.col("path")).alias("package"), F.col("name").alias("symbol"), "id", "node_ord")
    local, exports = first_of(defs, "package", "symbol", name="own"), last_of(defs, "package", "symbol", name="export")
    inner = imports.where(F.startswith("target", F.lit(root + "/")) if root else F.lit(False))
    bound = inner.groupBy("file", F.coalesce(filled(F.col("alias")), F.substring_index("target", "/", -1)).alias("head")).agg(F.max_by("target", "edge_ord").alias("target"))
    bound = bound.select("file", "head", F.substring("target", F.lit(len(root) + 2), F.length("target")).alias("there"))
    asked = split_names(names).join(bound, ["file", "head"], "left")
    asked = asked.withColumns({"package": F.when(F.col("rest").isNull(), directory(F.col("file"))).otherwise(F.col("there")), "symbol": F.coalesce("rest", "head")})
    asked = asked.join(local, ["package", "symbol"], "left").join(exports, ["package", "symbol"], "left")
    found = F.when(F.col("rest").isNull(), F.col("own")).otherwise(F.col("export"))
    return asked.select("file", "name", "is_call", found.alias("found"), F.lit(None).cast("string").alias("reason"))


def _by_crate(nodes: DataFrame, imports: DataFrame, names: DataFrame, crates: Sequence[tuple[str, str]]) -> DataFrame:
    def under(path: Column, root: str) -> Column:
        return F.startswith(path, F.lit(root + "/")) if root else F.lit(True)

    def crate_of(path: Column) -> Column:
        return F.coalesce(*[F.when(under(path, root), F.lit(name)) for name, root in crates], F.lit(crates[0][0] if crates else None).cast("string"))

    def root_of(crate: Column) -> Column:
        return F.coalesce(*[F.when(crate == name, F.lit(root)) for name, root in crates], F.lit(None).cast("string"))

    top = nodes.where("kind in ('struct', 'interface', 'function', 'type_alias', 'enum') and path <> ''").withColumns({"crate": crate_of(F.col("path")), "symbol": F.col("name")})
    exports = first_of(top, "crate", "symbol", name="export")
    roots = F.array_compact(F.array(*[F.when(under(F.coalesce("path", F.lit("")), root), F.lit(root)) for root in sorted({r for _, r in crates})]).cast("array<string>"))
    inside = first_of(nodes.select("id", "node_ord", F.col("name").alias("symbol"), F.explode(roots).alias("root")), "root", "symbol", name="inner")
    beside = first_of(nodes.select("id", "node_ord", F.col("name").alias("symbol"), directory(F.col("path")).alias("dir")), "dir", "symbol", name="sibling")

    uses = imports.select("file", "target", "alias", "edge_ord", F.substring_index("target", "::", 1).alias("start"), F.substring_index("target", "::", -1).alias("symbol"))
    known = F.col("start").isin([name for name, _ in crates])
    uses = uses.withColumns({
        "crate": F.when(known, F.col("start")), "dir": F.when(~known & F.col("start").isin("self", "super"), directory(F.col("file"))),
        "root": root_of(F.when(known, F.col("start")).when(F.col("start") == "crate", crate_of(F.col("file")))),
    })
    uses = uses.join(exports, ["crate", "symbol"], "left").join(inside, ["root", "symbol"], "left").join(beside, ["dir", "symbol"], "left")
    uses = uses.select("file", F.coalesce(filled(F.col("alias")), "symbol").alias("key"), F.coalesce("export", "inner", "sibling").alias("id"), "edge_ord").where("id is not null")
    bound = uses.groupBy("file", "key").agg(F.max_by("id", "edge_ord").alias("bound"))

    scoped, dotted = F.contains("name", F.lit("::")), F.contains("name", F.lit("."))
    tail = F.substring_index("name", "::", -1)
    owner = F.substring_index(F.substring_index("name", "::", -2), "::", 1)
    parts = split_names(names).withColumn("shape", F.when(~F.col("is_call"), "type").when(scoped, "scoped").when(dotted, "method").otherwise("plain"))
    parts = parts.withColumns({
        "key": F.when(F.col("shape") == "scoped", owner).when(F.col("shape") == "method", F.col("head")).otherwise(F.col("name")),
        "member": F.when(F.col("shape") == "scoped", tail).when(F.col("shape") == "method", F.col("rest")),
    })
    asked = parts.join(bound, ["file", "key"], "left").join(bound.select("file", F.col("key").alias("member"), F.col("bound").alias("bound_member")), ["file", "member"], "left")
    exact = F.when(F.col("shape") == "scoped", F.concat(F.substring_index("bound", ":", 1), F.lit(":"), "key", F.lit("."), "member")).when(F.col("shape") == "method", F.concat("bound", F.lit("."), "member"))
    asked = asked.withColumns({"exact": exact, "qualname": F.concat_ws(".", "key", "member")})
    ids = nodes.select(F.col("id").alias("exact"), F.col("id").alias("exact_id")).distinct()
    tails = first_of(nodes.where("id like '%:%'").withColumn("qualname", F.substring_index("id", ":", -1)), "qualname", name="tail_id")
    methods = first_of(nodes.where("kind = 'method'").select("id", "node_ord", F.col("name").alias("member"), F.col("receiver").alias("key")), "key", "member", name="method_id")
    here = first_of(nodes.select("id", "node_ord", F.col("path").alias("file"), "name"), "file", "name", name="here_id")
    anywhere = first_of(nodes, "name", name="any_id")
    asked = asked.join(ids, "exact", "left").join(tails, "qualname", "left").join(methods, ["key", "member"], "left").join(here, ["file", "name"], "left").join(anywhere, "name", "left")
    found = (
        F.when(F.col("shape") == "type", F.coalesce("bound", "here_id", "any_id"))
        .when(F.col("shape") == "scoped", F.coalesce("exact_id", "tail_id", "bound_member"))
        .when(F.col("shape") == "method", F.coalesce("exact_id", F.when(F.col("bound").isNotNull(), F.col("tail_id")), "method_id"))
        .otherwise(F.coalesce("bound", "here_id"))
    )
    return asked.select("file", "name", "is_call", found.alias("found"), F.lit(None).cast("string").alias("reason"))


def resolve_symbols(nodes: DataFrame, edges: DataFrame, style: str = "module", root: str = "", crates: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The edges with the targets of unresolved ones replaced by node ids where the name can be followed; adds ``reason``.

    ``style``: ``module`` (dotted modules, leading dots), ``relative`` (file specifiers), ``package`` (directories under ``root``) or
    ``crate`` (``::`` paths; ``crates`` lists name and root folder of each). An edge that is resolved loses its mark
    (``resolved`` null) and keeps its other columns; one that is not keeps target and mark. Null targets count as empty names.
    """
    missing = {"names": "array<string>", "alias": "string", "default_name": "string", "aliases": "map<string,string>"}
    imports = edges.where("kind = 'import'").withColumns({"file": F.col("source"), **{c: F.lit(None).cast(t) for c, t in missing.items() if c not in edges.columns}})
    if "receiver" not in nodes.columns:
        nodes = nodes.withColumn("receiver", F.lit(None).cast("string"))
    unresolved = F.coalesce(F.col("kind").isin(KINDS[style]) & ~F.col("resolved"), F.lit(False))
    key = {"file": F.substring_index("source", ":", 1), "name": F.coalesce("target", F.lit("")), "is_call": F.col("kind") == "call"}
    asked = edges.where(unresolved).withColumns(key)
    names = asked.select(*key).distinct()
    if style == "package":
        answers = _by_package(nodes, imports, names, root)
    elif style == "crate":
        answers = _by_crate(nodes, imports, names, crates)
    else:
        answers = {"module": _by_module, "relative": _by_relative_file}[style](nodes, imports, names)
    done = asked.join(answers, list(key), "left").withColumns({"target": F.coalesce("found", "target"), "resolved": F.when(F.col("found").isNull(), F.lit(False))})
    return edges.where(~unresolved).withColumn("reason", F.lit(None).cast("string")).unionByName(done.select(*edges.columns, "reason"))


def _only(nodes: DataFrame, *keys: str, name: str) -> DataFrame:
    """The node of each key that has just one."""
    return nodes.groupBy(*keys).agg(F.min("id").alias(name), F.max("id").alias("_max")).where(F.col(name) == F.col("_max")).drop("_max")


def _inside(places: DataFrame, prefix: str) -> DataFrame:
    """Places under ``prefix``, their paths relative to it, sentinels such as ``<stdin>`` left out."""
    out = places.where("path <> '' and path not like '<%'")
    if prefix:
        out = out.where(F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
    return out.withColumn("at", posix_path(F.col("path"), prefix))


def resolve_locations(probes: DataFrame, nodes: DataFrame, prefix: str = "") -> DataFrame:
    """Probes (``path, line``) with ``node_id``: the only function or method declared at the line, else the last one declared before it,
    else the file, else ``<unresolved>``. Probes outside ``prefix`` go."""
    defs = nodes.where("kind in ('function', 'method') and line is not null").select(F.col("path").alias("at"), F.col("line").cast("long").alias("at_line"), "id")
    places = _inside(probes.select("path", F.col("line").cast("long").alias("at_line")).distinct(), prefix)
    declared = defs.groupBy("at", "at_line").agg(F.max("id").alias("enclosing"))
    files = last_of(nodes.where("kind = 'file'").withColumn("at", F.col("path")), "at", name="file_id")
    found = as_of(places, declared, ["at"], "at_line", "enclosing").join(_only(defs, "at", "at_line", name="exact"), ["at", "at_line"], "left").join(files, "at", "left")
    found = found.select(F.col("path").alias("_path"), "at_line", F.coalesce("exact", "enclosing", "file_id", F.lit(UNRESOLVED)).alias("node_id"))
    return probes.join(found, (F.col("path") == F.col("_path")) & F.col("line").cast("long").eqNullSafe(F.col("at_line"))).drop("_path", "at_line")


def resolve_frames(frames: DataFrame, nodes: DataFrame, prefix: str = "", by_name: bool = True) -> DataFrame:
    """Stack frames (``path, line, function``) with ``node_id``: the only node at the line, else (``by_name``) the only one of the name or of its part
    behind the last dot, else the file, else ``<unresolved>``. Module frames (no name or ``<module>``) are the file's; pseudo
    frames and frames outside ``prefix`` go."""
    defs = nodes.where("kind in ('function', 'method')").select(F.col("path").alias("at"), F.col("line").cast("long").alias("at_line"), "name", "id")
    asked = frames.select("path", F.col("line").cast("long").alias("at_line"), F.coalesce("function", F.lit("")).alias("called")).distinct()
    module = F.col("called").isin("", "<module>")
    places = _inside(asked.where(~F.col("called").isin(PSEUDO_FRAMES)), prefix).withColumn("tail", F.substring_index("called", ".", -1))
    places = places.join(_only(defs.where("at_line is not null"), "at", "at_line", name="exact"), ["at", "at_line"], "left")
    if by_name:
        named = _only(defs.where("name <> ''"), "at", "name", name="named")
        places = places.join(named.withColumnsRenamed({"name": "called"}), ["at", "called"], "left").join(named.withColumnsRenamed({"name": "tail", "named": "tail_named"}), ["at", "tail"], "left")
    else:
        places = places.withColumns({"named": F.lit(None).cast("string"), "tail_named": F.lit(None).cast("string")})
    files = last_of(nodes.where("kind = 'file'").withColumn("at", F.col("path")), "at", name="file_id")
    best = F.when(~module, F.coalesce("exact", "named", "tail_named"))
    found = places.join(files, "at", "left").select(F.col("path").alias("_path"), "at_line", "called", F.coalesce(best, "file_id", F.lit(UNRESOLVED)).alias("node_id"))
    match = (F.col("path") == F.col("_path")) & F.col("line").cast("long").eqNullSafe(F.col("at_line")) & (F.coalesce("function", F.lit("")) == F.col("called"))
    return frames.join(found, match).drop("_path", "at_line", "called")
