"""The symbol graph: current rows, degrees, neighbourhoods, impact and bounded dependency graphs.

All walks take many pivots at once and move along ids; texts and names are joined last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.tables import BROADCAST_ROWS, checkpoint, hinted, newest, slash

NODE_COLUMNS = ["repo_id", "file_path", "language", "symbol_name", "symbol_type", "source_start_byte", "source_end_byte", "start_line", "start_column", "end_line", "end_column"]


def current_nodes(nodes: DataFrame, shared: DataFrame, removed: DataFrame, extra: tuple[str, ...] = (), columns: tuple[str, ...] = tuple(NODE_COLUMNS)) -> DataFrame:
    """The newest row of each id that wasn't removed after it, and the shared rows; paths with ``/``.

    A null ingested_at is oldest and loses to any removal. Rows without an id are left out. ``extra`` names further
    columns of both inputs, such as what was computed from the texts, so that texts needn't go through the exchange;
    ``columns`` are the others that are wanted: what isn't, is neither read nor moved.
    """
    cols = [*columns, *extra]
    n = newest(nodes.withColumn("file_path", slash("file_path")), "id", "ingested_at", cols)
    gone = removed.filter("node_id IS NOT NULL AND removed_at IS NOT NULL").groupBy(F.col("node_id").alias("id")).agg(F.max("removed_at").alias("_gone"))
    n = n.join(gone, "id", "left").filter(F.col("_gone").isNull() | F.coalesce(F.col("_gone") <= F.col("ingested_at"), F.lit(False)))
    s = shared.filter("id IS NOT NULL").withColumn("file_path", slash("file_path"))
    return n.select("id", *cols).union(s.select("id", *cols))


def edge_set(edges: DataFrame) -> DataFrame:
    """Distinct ``source_id, target_id, kind`` with both ends given, the type in capitals."""
    return edges.filter("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id", F.upper("relationship_type").alias("kind")).distinct()


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = nodes.select("id")
    a = edges.join(ids, edges.source_id == ids.id, "left_semi")
    return a.join(ids, a.target_id == ids.id, "left_semi")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("id")).union(edges.select("target_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree``: ends of valid edges at each node, a loop counting 2; 0 for nodes without."""
    d = _ends(valid_edges(edges, nodes)).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def top_by_degree(nodes: DataFrame, degree: DataFrame, k: int = 500) -> DataFrame:
    """The k nodes of the highest degree; ties by file, name, id."""
    return nodes.join(degree, "id").orderBy(F.desc("degree"), F.asc_nulls_last("file_path"), F.asc_nulls_last("symbol_name"), "id").limit(k)


def induced_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges between chosen nodes, of which there are at most as many as a top-k keeps."""
    ids = chosen.select("id")
    a = edges.join(F.broadcast(ids), edges.source_id == ids.id, "left_semi")
    return a.join(F.broadcast(ids), a.target_id == ids.id, "left_semi")


def neighbours(pivots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``pivot_id, id, degree``: each pivot and its neighbours in either direction, with their degree over all edges."""
    p = pivots.select(F.col("id").alias("pivot_id"))
    near = (
        p.join(edges, F.col("pivot_id") == F.col("source_id")).select("pivot_id", F.col("target_id").alias("id"))
        .union(p.join(edges, F.col("pivot_id") == F.col("target_id")).select("pivot_id", F.col("source_id")))
        .union(p.select("pivot_id", "pivot_id"))
        .distinct()
    )
    d = _ends(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return near.join(nodes.select("id"), "id", "left_semi").join(d, "id", "left").select("pivot_id", "id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def adjacent(nodes: DataFrame, edges: DataFrame, out_limit: int = 50, in_limit: int = 64, pivots: DataFrame | None = None) -> DataFrame:
    """``pivot_id, direction, rank, id, symbol_name, file_path, kind``: for every node, or those of ``pivots`` (``pivot_id``), its callees and
    callers, the first by name, file, id of each direction; loops and unknown ends are left out.

    The limit is a feature of the capsule and is taken before the exchange by pivot as well, so a node that a third of all
    edges point at sends no more than the limit per task.
    """
    facts = nodes.select("id", "symbol_name", "file_path")
    if pivots is not None:
        pivots = hinted(checkpoint(pivots.select("pivot_id").distinct()))

    def side(frm: str, to: str, way: str, limit: int) -> DataFrame:
        e = edges.filter("source_id <> target_id").select(F.col(frm).alias("pivot_id"), F.col(to).alias("id"), "kind")
        if pivots is not None:
            e = e.join(pivots, "pivot_id", "left_semi")
        j = e.groupBy("pivot_id", "id").agg(F.min("kind").alias("kind")).join(facts, "id")
        w = Window.partitionBy("pivot_id").orderBy(F.asc_nulls_last("symbol_name"), F.asc_nulls_last("file_path"), "id")
        return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).withColumn("direction", F.lit(way))

    both = side("source_id", "target_id", "out", out_limit).unionByName(side("target_id", "source_id", "in", in_limit))
    both = both.join(nodes.select(F.col("id").alias("pivot_id")), "pivot_id", "left_semi")
    return both.select("pivot_id", "direction", F.col("rank").cast("long").alias("rank"), "id", "symbol_name", "file_path", "kind")


def reach(pivots: DataFrame, edges: DataFrame, depth: int, reverse: bool, known: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """``pivot_id, id, depth, kind``: nodes within ``depth`` edges of each pivot, at their least depth, without the pivot; kind
    is the least relationship of that depth. Cycles end where nothing new is found.

    With ``known`` (``id``) only these are returned, though the walk goes through others; with ``cap`` a pivot that has so many is not followed
    to the next depth, so whoever takes the nearest ``cap`` misses none.
    """
    frm, to = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    e = edges.select(F.col(frm).alias("_from"), F.col(to).alias("_to"), F.col("kind").alias("_kind"))
    if known is not None:
        k = known.select(F.col("id").alias("_to"), F.lit(True).alias("_known"))
        e = checkpoint(e.join(k, "_to", "left").select("_from", "_to", "_kind", F.coalesce("_known", F.lit(False)).alias("_known")))
    else:
        e = e.withColumn("_known", F.lit(True))
    seen = checkpoint(pivots.select(F.col("id").alias("pivot_id"), "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("known")))
    few = seen.count() <= BROADCAST_ROWS
    for d in range(1, depth + 1):
        start = seen.filter(F.col("depth") == d - 1).select("pivot_id", "id")
        if cap is not None:
            full = seen.groupBy("pivot_id").agg(F.count_if("known").alias("_n")).filter(F.col("_n") >= cap).select("pivot_id")
            start = start.join(F.broadcast(full) if few else full, "pivot_id", "left_anti")
        n = start.count()
        if not n:
            break
        met = (F.broadcast(start) if n <= BROADCAST_ROWS else start).join(e, F.col("id") == F.col("_from"))
        met = met.select("pivot_id", F.col("_to").alias("id"), F.lit(d).alias("depth"), F.col("_kind").alias("kind"), F.col("_known").alias("known"))
        # what was seen before keeps its depth: one exchange finds what is new
        least = F.min(F.struct("depth", "kind", "known")).alias("m")
        seen = checkpoint(seen.union(met).groupBy("pivot_id", "id").agg(least).select("pivot_id", "id", "m.depth", "m.kind", "m.known"))
    return seen.filter("depth > 0 AND known").drop("known")


def impact(pivots: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 10, cap: int = 5000) -> DataFrame:
    """``pivot_id, id, depth, kind, truncated``: what depends on each pivot, through any repository. At most ``cap`` rows per
    pivot, the nearest first, then by id; truncated where a pivot has as many as that."""
    r = reach(pivots, edges, depth, True, nodes, cap)
    w = Window.partitionBy("pivot_id").orderBy("depth", "id")
    total = Window.partitionBy("pivot_id")
    r = r.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    return r.withColumn("truncated", F.count("*").over(total) >= cap).select("pivot_id", "id", F.col("depth").cast("long").alias("depth"), "kind", "truncated")


def dependency_walk(pivots: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, direction: str = "both", cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """The breadth-first neighbourhood of each pivot: its entries, and per pivot ``pivot_id, nodes, edges, truncated``.

    Entries are ``pivot_id, direction, depth, position, id, kind, parent_id, already_seen``, in the order in which a queue meets
    them: by the parent's place, then relationship, name, file, id. Both directions, callers first, share the nodes visited
    and the cap on them, the pivot included. A link to a node that was visited before is an entry in addition to the cap and isn't
    followed; one to a new node beyond the cap makes the walk truncated. edges counts every link met. edges are distinct.
    """
    facts = nodes.select("id", "symbol_name", "file_path")
    start = checkpoint(pivots.select(F.col("id").alias("pivot_id"), "id", F.lit(0).cast("long").alias("_seq")).distinct())
    visited = start.select("pivot_id", "id")
    entries, counts, over = [], [], []
    for way in {"callers": [0], "callees": [1], "both": [0, 1]}[direction]:
        frm, to = ("source_id", "target_id") if way else ("target_id", "source_id")
        e = edges.select(F.col(frm).alias("_from"), F.col(to).alias("_to"), "kind")
        front = start
        for d in range(1, depth + 1):
            met = front.select("pivot_id", F.col("id").alias("parent_id"), F.col("_seq").alias("_parent")).join(e, F.col("parent_id") == F.col("_from"))
            met = checkpoint(met.select("pivot_id", "parent_id", "_parent", "kind", F.col("_to").alias("id")).join(facts.select("id"), "id", "left_semi"))
            counts.append(met.groupBy("pivot_id").agg(F.count("*").alias("n")))
            new = met.join(visited, ["pivot_id", "id"], "left_anti").groupBy("pivot_id", "id").agg(F.min(F.struct("_parent", "kind")).alias("_first"))
            w = Window.partitionBy("pivot_id").orderBy("_first", F.asc_nulls_last("symbol_name"), F.asc_nulls_last("file_path"), "id")
            # of the new nodes one more than have room is enough to see that the walk is truncated
            new = new.join(facts, "id").withColumn("_seq", F.row_number().over(w).cast("long")).filter(F.col("_seq") <= cap)
            new = checkpoint(new.join(visited.groupBy("pivot_id").agg(F.count("*").alias("_have")), "pivot_id").select("pivot_id", "id", "_first", "_seq", (F.col("_seq") + F.col("_have") <= cap).alias("_in")))
            over.append(new.filter("NOT _in").select("pivot_id"))
            front = new.filter("_in")
            visited = visited.union(front.select("pivot_id", "id"))
            seen = visited.join(front.select("pivot_id", "id", "_first"), ["pivot_id", "id"], "left")
            first = F.coalesce(F.struct("_parent", "kind").eqNullSafe(F.col("_first")), F.lit(False))
            entries.append(met.join(seen, ["pivot_id", "id"]).select("pivot_id", F.lit(way).alias("_way"), F.lit(d).cast("long").alias("depth"), "_parent", "parent_id", "kind", "id", (~first).alias("already_seen")))
            if front.limit(1).count() == 0:
                break
    union = lambda parts: reduce(DataFrame.union, parts)
    w = Window.partitionBy("pivot_id").orderBy("_way", "depth", "_parent", "kind", F.asc_nulls_last("symbol_name"), F.asc_nulls_last("file_path"), "id")
    rows = union(entries).join(facts, "id").withColumn("position", F.row_number().over(w).cast("long"))
    links = union(counts).groupBy("pivot_id").agg(F.sum("n").alias("edges"))
    cut = union(over).distinct().withColumn("truncated", F.lit(True))
    totals = visited.groupBy("pivot_id").agg(F.count("*").alias("nodes")).join(links, "pivot_id", "left").join(cut, "pivot_id", "left")
    return (
        rows.select("pivot_id", F.when(F.col("_way") == 0, "callers").otherwise("callees").alias("direction"), "depth", "position", "id", "kind", "parent_id", "already_seen"),
        totals.select("pivot_id", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), F.coalesce("truncated", F.lit(False)).alias("truncated")),
    )


def dependency_graph(pivots: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, direction: str = "both", cap: int = 200) -> DataFrame:
    """The entries of dependency_walk, each with its pivot's ``nodes, edges, truncated``."""
    entries, totals = dependency_walk(pivots, nodes, edges, depth, direction, cap)
    return entries.join(totals, "pivot_id")


def nearest_by_direction(pivots: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, direction: str = "both", cap: int = 200) -> DataFrame:
    """``pivot_id, direction, depth, position, id, kind``: nodes that each direction reaches on its own, callers first, then by
    depth, relationship, name, file, id, up to ``cap`` rows with the pivot. Not the walk of dependency_walk: a node reached both
    ways takes two places, and links to nodes already seen aren't given."""
    facts = nodes.select("id", "symbol_name", "file_path")
    ways = {"callers": [(True, 0)], "callees": [(False, 1)], "both": [(True, 0), (False, 1)]}[direction]
    parts = [reach(pivots, edges, depth, reverse).withColumn("_way", F.lit(way)) for reverse, way in ways]
    every = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    w = Window.partitionBy("pivot_id").orderBy("_way", "depth", "kind", F.asc_nulls_last("symbol_name"), F.asc_nulls_last("file_path"), "id")
    every = every.join(facts, "id").withColumn("position", F.row_number().over(w)).filter(F.col("position") < cap)
    return every.select(
        "pivot_id", F.when(F.col("_way") == 0, "callers").otherwise("callees").alias("direction"), F.col("depth").cast("long").alias("depth"),
        F.col("position").cast("long").alias("position"), "id", "kind",
    )


def repo_scope(nodes: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo_id, symbols, files, out_edges``: counted apart and joined, for repositories that have symbols or files."""
    n = nodes.groupBy("repo_id").agg(F.count("*").alias("symbols"))
    f = files.select("repo_id", slash("file_path").alias("file_path")).distinct().groupBy("repo_id").agg(F.count("*").alias("files"))
    home = nodes.select(F.col("id").alias("source_id"), "repo_id")
    e = edges.join(home, "source_id").groupBy("repo_id").agg(F.count("*").alias("out_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return n.join(f, "repo_id", "full").join(e, "repo_id", "left").filter("repo_id IS NOT NULL").select("repo_id", zero("symbols"), zero("files"), zero("out_edges"))


def absolute_paths(nodes: DataFrame, repositories: DataFrame) -> DataFrame:
    """``id, path``: where a node's file lies, with ``/``: below the root of its repository (of several the least). Nodes without a path or of
    unknown repositories have none."""
    roots = repositories.filter("id IS NOT NULL AND root_path IS NOT NULL").groupBy(F.col("id").alias("repo_id")).agg(F.min(F.rtrim(slash("root_path"), F.lit("/"))).alias("root"))
    return nodes.filter("file_path IS NOT NULL").join(roots, "repo_id").select("id", F.concat_ws("/", "root", slash("file_path")).alias("path"))


# Parts of a path and the category of a path that has one; the first decides.
CATEGORIES = [("controllers", "controllers"), ("jobs", "jobs"), ("services", "services"), ("models", "models"), ("tests", "tests"), ("tests", "spec")]


def path_category(path: Column) -> Column:
    """The category of a path by its parts, ``other`` without any."""
    parts = F.split(F.lower(path), "/")
    out = None
    for name, part in CATEGORIES:
        hit = F.array_contains(parts, part)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def degree_cache_fresh(nodes: DataFrame, cache: DataFrame, meta: DataFrame) -> DataFrame:
    """``repo_id, fresh``: whether a repository's stored degrees can be used: not dirty, and as many rows as nodes."""
    n = nodes.groupBy("repo_id").agg(F.count("*").alias("have"))
    c = cache.groupBy("repo_id").agg(F.count("*").alias("rows"))
    j = n.join(c, "repo_id", "left").join(meta.select("repo_id", "node_count", "dirty"), "repo_id", "left")
    ok = ~F.coalesce("dirty", F.lit(True)) & (F.col("node_count") == F.col("have")) & (F.coalesce("rows", F.lit(0)) == F.col("have"))
    return j.select("repo_id", F.coalesce(ok, F.lit(False)).alias("fresh"))
