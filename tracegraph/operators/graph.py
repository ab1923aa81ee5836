"""Operators over code graphs: degrees, hubs, components, reachability, differences, links between languages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EDGE_BUCKETS
from ..storage import Rounds, cut


def resolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known nodes. The ids of a partition are hashed, so no edges are sorted or held, and a node that many edges lead to takes no room.

    Inner joins with distinct ids: Spark moves semi-joins below a union, and edges that come from many tables would have hashed ids for each of them in one task.
    """
    ids = nodes.select("id").distinct()
    of = lambda side: ids.withColumnRenamed("id", side).hint("shuffle_hash")
    return edges.join(of("source"), "source").join(of("target"), "target")


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """The first row of each id by ``node_ord``."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*rest), "node_ord").alias("r")).select("id", "r.*")


def count_by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def top_in_degree(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    deg = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    out = nodes.select("id").join(deg, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    return out.orderBy(F.desc("in_degree"), "id").limit(n)


def hub_score(nodes: DataFrame, edges: DataFrame, top: int = 50, universe: str = "targets") -> DataFrame:
    """In minus out degree; over nodes and edge targets, or nodes only."""
    both = edges.select(F.col("target").alias("id"), F.lit(1).alias("d")).union(edges.select("source", F.lit(-1)))
    score = both.groupBy("id").agg(F.sum("d").alias("score"))
    ids = nodes.select("id")
    ids = (ids.union(edges.select("target")) if universe == "targets" else ids).distinct()
    return ids.join(score, "id", "left").select("id", F.coalesce("score", F.lit(0)).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def edge_kind_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(F.col("kind") == "cross_language_call").alias("http"), F.count_if(F.col("kind") == "cross_language_spawn").alias("spawn"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.where("kind <> 'import'").select(F.col("target").alias("id")), "id", "left_anti").select("id")


def file_fan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges into and out of each path from and to other paths."""
    p = nodes.select("id", "path")
    e = edges.select("source", "target").join(p.toDF("source", "sp").hint("shuffle_hash"), "source").join(p.toDF("target", "tp").hint("shuffle_hash"), "target").where("sp <> tp")
    both = e.select(F.inline(F.array(F.struct(F.col("sp").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tp").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return both.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def bucket_of(kind="kind") -> F.Column:
    k = F.col(kind)
    return F.when(k.isin(EDGE_BUCKETS[:4]), k).when(F.startswith(k, F.lit("cross_language")), "cross_language").otherwise("other")


def degree_buckets(nodes: DataFrame, edges: DataFrame, resolved: bool = False) -> DataFrame:
    """Edges into and out of each node by kind. ``resolved``: all ends are known. Nodes are counted along with the ends, so counts are neither joined to them nor sorted; a row for each row of ``nodes``."""
    names = [f"{s}_{b}" for s in ("in", "out") for b in EDGE_BUCKETS]
    slot = F.array_position(F.array(*[F.lit(b) for b in EDGE_BUCKETS]), bucket_of()).cast("int") - 1
    e = edges.select("source", "target", slot.alias("slot"))
    e = e if resolved else resolved_edges(nodes, e)
    sides = e.select(F.inline(F.array(F.struct(F.col("target").alias("id"), "slot"), F.struct(F.col("source").alias("id"), (F.col("slot") + len(EDGE_BUCKETS)).alias("slot")))))
    rows = sides.union(nodes.select("id", F.lit(-1)))
    of = lambda k: F.count(F.when(F.col("slot") == k, 1))
    deg = rows.groupBy("id").agg(of(-1).cast("int").alias("_rows"), *[of(k).alias(n) for k, n in enumerate(names)])
    return deg.select("id", *names, F.explode(F.array_repeat(F.lit(0), F.col("_rows")))).select("id", *names)


def bfs_depth(nodes: DataFrame, edges: DataFrame, resolved: bool = False) -> DataFrame:
    """``id, depth, reachable``: steps over call and import edges from files and nodes nothing calls or imports; -1 where not reached.

    A node with one predecessor that is no entry is one step behind it, whatever that one's depth: such nodes find the first other node before them, and how far it is, by pointer
    jumping, so a chain of n takes log2(n) rounds (a ring of them that nothing enters never finds one and is not reached). Between the others an edge is as long as the chain
    it ends; each round moves from the nodes that the last one brought nearer and from which edges lead on. A loop holds two of its rounds. ``resolved``: ``edges`` is a table
    whose ends are all known.
    """
    spark = nodes.sparkSession
    walked = lambda df: df.where("kind in ('call', 'import') and source <> target").select("source", "target")
    e = walked(edges) if resolved else cut(walked(resolved_edges(nodes, edges)))
    into = cut(e.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("up"), F.max("source").alias("last")))
    entry = cut(nodes.select("id", "kind").join(into, "id", "left").where("kind = 'file' or up is null").select("id").distinct())
    single = cut(into.where("up = last").join(entry, "id", "left_anti").select("id", "up"))
    chains = Rounds(spark)
    ids = single.select(F.col("id").alias("up"), F.lit(True).alias("inside"))
    at = chains.cut(single.join(ids, "up", "left").select("id", "up", F.lit(1).cast("long").alias("far"), F.col("inside").isNull().alias("done")))
    for _ in range(max(1, single.count()).bit_length()):  # a longer way than all of them is a ring
        if at.where("not done").isEmpty():
            break
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("done").alias("found"))
        moved = at.where("not done").join(above, "up").select("id", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.col("found").alias("done"))
        at = chains.cut(at.where("done").unionByName(moved))
    behind = at.where("done").select("id", "up", "far")
    settled = single.select(F.col("id").alias("target")).union(entry.select(F.col("id").alias("target")))
    ends = e.join(settled.hint("shuffle_hash"), "target", "left_anti")
    ends = ends.join(at.withColumnRenamed("id", "source").hint("shuffle_hash"), "source", "left").where("done is null or done")  # not from a ring that nothing enters
    links = cut(ends.groupBy(F.coalesce("up", "source").alias("source"), "target").agg(F.min(F.coalesce("far", F.lit(0)) + 1).alias("w")))
    leads = cut(links.select(F.col("source").alias("id"), F.lit(True).alias("leads")).distinct())
    rounds = Rounds(spark)
    state = rounds.cut(entry.join(leads, "id", "left").select("id", F.lit(0).cast("long").alias("depth"), F.coalesce("leads", F.lit(False)).alias("moved")))
    while not state.where("moved").isEmpty():
        near = links.join(state.where("moved").select(F.col("id").alias("source"), "depth").hint("shuffle_hash"), "source").groupBy(F.col("target").alias("id")).agg(F.min(F.col("depth") + F.col("w")).alias("new"))
        both = state.select("id", "depth").join(near, "id", "full_outer").join(leads, "id", "left")
        nearer = F.col("leads").isNotNull() & F.col("new").isNotNull() & (F.col("depth").isNull() | (F.col("new") < F.col("depth")))
        state = rounds.cut(both.select("id", F.least("depth", "new").alias("depth"), nearer.alias("moved")))
    known = state.select("id", "depth")
    known = known.unionByName(behind.join(known.withColumnRenamed("id", "up"), "up").select("id", (F.col("depth") + F.col("far")).alias("depth")))
    out = nodes.select("id").distinct().join(known, "id", "left")
    return out.select("id", F.coalesce("depth", F.lit(-1)).cast("long").alias("depth"), F.col("depth").isNotNull().alias("reachable"))


def scc(nodes: DataFrame, edges: DataFrame, resolved: bool = False) -> DataFrame:
    """``id, scc, size``: strongly connected components, named by their greatest id.

    In each round every node learns the greatest id that reaches it and the greatest that it reaches. Where both are the same the nodes with it are a
    component; else only edges between nodes that agree in both can lie inside one, so the others go and the next round begins.
    Greatest ids spread over edges and by pointer jumping (what reaches the id that reaches me reaches me too), so steps are few on long chains; a step is one table,
    and the loop holds two of them.

    A node that no edge enters, or none leaves, is a component of its own. Such nodes go first, with their edges, as long as that at least halves the edges; what then has edges left is
    searched. ``resolved``: ``edges`` is a table whose ends are all known.
    """
    spark = nodes.sparkSession
    states, links, found = Rounds(spark), Rounds(spark), []
    e = edges if resolved else links.cut(resolved_edges(nodes, edges).select("source", "target"))
    n = e.count()
    while n:
        e = e.where("source <> target").select("source", "target")
        entered, left_ = e.select(F.col("target").alias("source")).distinct(), e.select(F.col("source").alias("target")).distinct()
        e = links.cut(e.join(entered.hint("shuffle_hash"), "source", "left_semi").join(left_.hint("shuffle_hash"), "target", "left_semi").distinct())
        before, n = n, e.count()
        if n * 2 > before:
            break
    left = cut(e.select(F.explode(F.array("source", "target")).alias("id")).distinct())
    alone = nodes.select("id").distinct().join(left, "id", "left_anti").select("id", F.col("id").alias("scc"), F.lit(1).cast("long").alias("size"))
    while n:
        state = states.cut(left.select("id", F.col("id").alias("f"), F.col("id").alias("b"), F.lit(True).alias("moved")))
        while not state.where("moved").isEmpty():
            up = e.join(state.select(F.col("id").alias("source"), "f"), "source").groupBy(F.col("target").alias("id")).agg(F.max("f").alias("fu"))
            down = e.join(state.select(F.col("id").alias("target"), "b"), "target").groupBy(F.col("source").alias("id")).agg(F.max("b").alias("bd"))
            jump = lambda c, to: state.select(F.col("id").alias(c), F.col(c).alias(to)).where(F.col(c) != F.col(to)).join(state.select(c).distinct(), c, "left_semi")  # noqa: B023, E731
            new = state.join(up, "id", "left").join(down, "id", "left").join(jump("f", "ff"), "f", "left").join(jump("b", "bb"), "b", "left")
            f, b = F.greatest("f", "fu", "ff"), F.greatest("b", "bd", "bb")
            state = states.cut(new.select("id", f.alias("f"), b.alias("b"), ((f > F.col("f")) | (b > F.col("b"))).alias("moved")))
        found.append(cut(state.where("f = b").select("id", F.col("f").alias("scc"))))
        rest = state.where("f <> b").select("id", "f", "b")
        if rest.isEmpty():
            break
        ends = e.join(rest.toDF("source", "f", "b"), "source").join(rest.toDF("target", "tf", "tb"), "target")
        e = links.cut(ends.where("f = tf and b = tb").select("source", "target"))
        left = rest.select("id")
    if not found:
        return alone
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    size = out.groupBy("scc").agg(F.count("*").alias("size"))
    return out.join(size, "scc").select("id", "scc", "size").unionByName(alone)


def cycles(nodes: DataFrame, edges: DataFrame, top: int = 100) -> DataFrame:
    """Components of more than one node and self loops: ``id`` (sorted ids joined), ``size``, ``nodes`` (sorted ids), ``kinds``; the largest ``top``, ties by ``id``.

    The largest are chosen by size and smallest member before any ids are gathered, so only what is returned is put into rows.
    """
    e = resolved_edges(nodes, edges)
    loops = e.where("source = target").select(F.col("source").alias("id")).distinct().withColumn("loop", F.lit(True))
    member = cut(scc(nodes, edges).join(loops, "id", "left").where("size > 1 or loop").select("id", "scc", "size"))
    # ids of components that share no node differ within the smallest member and the mark behind it
    by = F.when(F.col("size") > 1, F.concat("least", F.lit("|"))).otherwise(F.col("least"))
    chosen = member.groupBy("scc").agg(F.min("id").alias("least"), F.count("*").alias("size")).orderBy(F.desc("size"), by).limit(top).select("scc", "size")
    member = member.select("id", "scc").join(F.broadcast(chosen.select("scc")), "scc")  # ``top`` rows
    kinds = e.join(member.select(F.col("id").alias("source"), F.col("scc").alias("a")), "source").join(member.select(F.col("id").alias("target"), F.col("scc").alias("b")), "target")
    kinds = kinds.where("a = b").groupBy(F.col("a").alias("scc")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    names = member.groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    return names.join(chosen, "scc").join(kinds, "scc").select(F.array_join("nodes", "|").alias("id"), "size", "nodes", "kinds").orderBy(F.desc("size"), "id")


def graph_signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and sums of row hashes: alike for any order, different for another multiplicity."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).cast("string").alias("node_sum"))
    e = edges.agg(F.count("*").alias("n_edges"), F.sum(F.xxhash64("source", "target", "kind").cast("decimal(38,0)")).cast("string").alias("edge_sum"))
    return n.join(F.broadcast(e))  # one row each


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parallel edges as a multiset by (source, target, kind, line): how many were added (positive) or removed."""
    key = ["source", "target", "kind", "line"]
    both = new.select(*key, F.lit(1).alias("d")).union(old.select(*key, F.lit(-1)))
    return both.groupBy(*key).agg(F.sum("d").alias("change")).where("change <> 0")


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    attrs = ["kind", "name", "path", "line"]
    a, b = (dedupe_nodes(x).select("id", F.struct(*attrs).alias(n)) for x, n in ((old, "a"), (new, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def uniquify_ids(nodes: DataFrame) -> DataFrame:
    """The first definition of an id that is no overload keeps it; the others become ``id.line``."""
    w = Window.partitionBy("id").orderBy("is_overload", "node_ord")
    return nodes.withColumn("r", F.row_number().over(w)).withColumn("unique_id", F.when(F.col("r") == 1, F.col("id")).otherwise(F.concat_ws(".", "id", "line"))).drop("r")


BLOCK = 4096  # ids of a class in a row


def implements_edges(members: DataFrame) -> DataFrame:
    """Structs that have all methods of an interface. ``members(id, kind, method)``; a null method is one that no struct has, null ids are left out.

    Types of a kind with the same methods are a class, named by its smallest id, and classes are joined, not types. A class of interfaces is first joined on its method that the
    fewest classes of structs have, and all its methods are looked up in those candidates alone. So neither a method that every type has nor a set of methods that many types
    share multiplies anything but the result, which is put together from pairs of classes and their members at the end: ids of a class lie in blocks, and what is shuffled is blocks.

    Cut tables are small as files and large as rows, so Spark would broadcast them, and few bytes become many rows behind a join: both sides are dealt over all partitions by number.
    """
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    join = lambda a, b, *by: a.repartition(tasks, *by).join(b.repartition(tasks, *by).hint("shuffle_hash"), list(by))
    rows = members.where("kind in ('struct', 'interface') and id is not null").select("kind", "id", "method").distinct()
    sets = rows.groupBy("kind", "id").agg(F.array_sort(F.collect_list("method")).alias("methods"), F.bool_or(F.col("method").isNull()).alias("lacks"))
    sets = cut(sets.where("kind = 'struct' or not lacks").drop("lacks"))
    classes = cut(sets.groupBy("kind", "methods").agg(F.min("id").alias("class"), F.ceil(F.count("*") / BLOCK).alias("blocks")))
    member = join(sets, classes, "kind", "methods").select("kind", "class", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id")
    blocks = cut(member.groupBy("kind", "class", "block").agg(F.collect_list("id").alias("ids")))
    of = lambda df, kind: df.where(F.col("kind") == kind).drop("kind").withColumnRenamed("class", kind)
    structs, interfaces = of(classes, "struct"), of(classes, "interface").withColumnRenamed("methods", "need")
    have = structs.select("struct", F.explode("methods").alias("method"))
    common = join(interfaces.select("interface", F.explode("need").alias("method")), have.groupBy("method").agg(F.count("*").alias("structs")), "method")
    # a method that no struct has is not in ``common``
    first = common.groupBy("interface").agg(F.min(F.struct("structs", "method")).alias("m"), F.count("*").alias("known"))
    first = join(interfaces, first, "interface").where("known = size(need)").select("interface", "need", F.col("m.method").alias("method"))
    candidates = join(join(have, first, "method"), structs.select("struct", "methods"), "struct")
    pairs = cut(candidates.where(F.size(F.array_except("need", "methods")) == 0).select("struct", "interface"))
    ids = of(blocks, "interface")
    out = join(join(pairs, ids.select("interface", "block"), "interface"), of(blocks, "struct").select("struct", F.col("ids").alias("structs")), "struct")
    out = join(out, ids, "interface", "block")
    return out.select(F.explode("structs").alias("struct"), "ids").select("struct", F.explode("ids").alias("interface"))


def _routes(hints: DataFrame) -> DataFrame:
    """Each client's hint with ``route`` and ``target``."""
    from ..functions.scalars import normalize_http_path, path_segments

    h = hints.withColumn("route", normalize_http_path(F.col("path")))
    server = h.where("kind = 'http_server'").where(path_segments(F.col("route")) >= 2).groupBy("route").agg(F.max_by("node_id", "ord").alias("target"))
    return h.where("kind = 'http_client'").join(server, "route").where("node_id <> target")


def route_edges(hints: DataFrame) -> DataFrame:
    """Clients to the last server of the same normalised path of two segments or more; no self edges. ``hints(kind, node_id, path, ord)``."""
    return _routes(hints).select(F.col("node_id").alias("source"), "target", "route").distinct()


def _spawns(hints: DataFrame, files: DataFrame) -> DataFrame:
    suffix = files.withColumn("parts", F.split("id", "/")).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))).alias("arg"))
    best = suffix.groupBy("arg").agg(F.min("id").alias("target"))
    return hints.where("kind = 'subprocess'").withColumn("arg", F.regexp_replace(F.substring_index("command", " ", 1), "^[./]+", "")).join(best, "arg")


def spawn_edges(hints: DataFrame, files: DataFrame) -> DataFrame:
    """Commands to the smallest file id that is, or ends after a slash in, the command's first word. Every path suffix of a file is a row, so this
    is an equal join."""
    return _spawns(hints, files).select(F.col("node_id").alias("source"), "target")


def edge_evidence(nodes: DataFrame, edges: DataFrame, keep: tuple[str, ...] = ("line",)) -> DataFrame:
    """Every edge seen from both its ends, with the source's path and the columns in ``keep``, of edges or else of the source's node. The nodes of a partition are hashed: no edges are sorted."""
    more = [c for c in keep if c not in edges.columns]
    e = edges.join(nodes.select(F.col("id").alias("source"), "path", *more).hint("shuffle_hash"), "source", "left")
    end = lambda side, own, other: F.struct(F.col(own).alias("id"), F.lit(side).alias("direction"), F.col(other).alias("other"))
    return e.select(F.inline(F.array(end("out", "source", "target"), end("in", "target", "source"))), "kind", "path", *keep)


def evidence_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edge_evidence`` with how many edges (``n``) are alike but for their line. Edges are counted before they are seen from their ends, so what is counted is one row an edge,
    not two, and without the path; an end, direction, other end, kind and path then stand in one row."""
    alike = edges.groupBy("source", "target", "kind").agg(F.count("*").alias("n"))
    named = nodes.groupBy("id", "path").agg(F.count("*").alias("times"))
    return edge_evidence(named, alike, ("n", "times")).withColumn("n", F.col("n") * F.coalesce("times", F.lit(1))).drop("times")


def evidence_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edge_evidence`` of every edge, with its line; ``n`` is how many rows are the same in all of that. The source follows from an end, its direction and the other, so rows are
    counted where their source's edges were dealt to, and are not shuffled again."""
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["id", "direction", "other", "kind", "path", "line"]
    seen = edge_evidence(nodes.repartition(tasks, "id"), edges.repartition(tasks, "source"), ("line", "source"))
    return seen.groupBy("source", *key).agg(F.count("*").alias("n")).drop("source")


def call_sites(edges: DataFrame) -> DataFrame:
    c = edges.where("kind in ('call', 'cross_language_call') and line is not null")
    return c.groupBy("source", "target").agg(F.min_by("line", "edge_ord").alias("line"))


class Merged(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    hints: DataFrame
    counts: DataFrame


HINT = "kind string, node_id string, path string, command string, line int, ord long, language string"


def merge_graphs(parts: list[tuple[str, DataFrame, DataFrame, DataFrame | None]]) -> Merged:
    """One graph of those of several languages: ``(language, nodes, edges, hints)`` each, hints (``kind, node_id, path, command, line, ord``) where there are any.

    ``nodes``, ``edges`` and ``hints`` of all languages with ``language``; behind the edges those that lead from one language to another, or from one part of one to another: a
    client's call to a route's last server and a command's file, one edge a hint with its line, none from a node to itself. ``counts``: nodes of each language, and on each row
    ``graph``, the languages sorted and joined. A language without nodes counts 0. Of one language's hints the order is ``ord``, of several that of the parts.
    """
    spark = parts[0][1].sparkSession
    nodes = edges = None
    hints = spark.createDataFrame([], HINT)
    for k, (language, n, e, h) in enumerate(parts):
        n, e = n.withColumn("language", F.lit(language)), e.withColumn("language", F.lit(language))
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
        if h is not None:
            # later parts stand behind earlier ones, whatever their own order
            hints = hints.unionByName(h.withColumns({"language": F.lit(language), "ord": F.col("ord") + (k << 48)}), allowMissingColumns=True)
    line = lambda df, kind: df.select(F.col("node_id").alias("source"), "target", F.lit(kind).alias("kind"), "line", F.lit(True).alias("resolved"))
    files = nodes.where("kind = 'file'").select("id").distinct()
    crossing = line(_routes(hints), "cross_language_call").unionByName(line(_spawns(hints, files).where("node_id <> target"), "cross_language_spawn"))
    languages = [p[0] for p in parts]
    every = spark.createDataFrame([(x,) for x in sorted(set(languages))], "language string")
    counts = every.join(nodes.groupBy("language").agg(F.count("*").alias("n")), "language", "left")
    counts = counts.select(F.lit("+".join(sorted(set(languages)))).alias("graph"), "language", F.coalesce("n", F.lit(0)).alias("n"))
    return Merged(nodes, edges.unionByName(crossing, allowMissingColumns=True), hints, counts)
