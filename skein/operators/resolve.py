"""Calls and imports resolved to symbols, and change sets between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.extract.languages import C_FAMILY
from skein.sources.tables import slash

# Kinds that are never the target of a call, and those that aren't in the C family.
NOT_CALLABLE = ("interface", "type", "union", "macro")
NOT_CALLABLE_IN_C = ("struct", "enum")


def callable_nodes(nodes: DataFrame) -> DataFrame:
    kind = F.col("symbol_type")
    return nodes.filter(~kind.isin(*NOT_CALLABLE) & ~(kind.isin(*NOT_CALLABLE_IN_C) & F.col("language").isin(*C_FAMILY)))


def resolve_calls(callees: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``source_id, target_id, kind`` of ``source_id, repo_id, file_path, callee``.

    All callable symbols of that name in the same file but the source itself; where the file has none (the source
    counts), the one symbol of that name in the repository, if there is exactly one and it isn't the source.
    Candidates of a repository are reduced to their number and least id before the join, so a name that
    a third of all symbols bear is one row.
    """
    t = callable_nodes(nodes).filter("symbol_name IS NOT NULL").select("repo_id", "file_path", F.col("symbol_name").alias("callee"), F.col("id").alias("target_id"))
    c = callees.select("source_id", "repo_id", "file_path", "callee").distinct()
    near = c.join(t, ["repo_id", "file_path", "callee"])
    have = t.select("repo_id", "file_path", "callee").distinct()
    one = t.groupBy("repo_id", "callee").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id")).filter("n = 1")
    far = c.join(have, ["repo_id", "file_path", "callee"], "left_anti").join(one, ["repo_id", "callee"])
    out = near.select("source_id", "target_id").union(far.select("source_id", "target_id"))
    return out.filter("source_id <> target_id").distinct().withColumn("kind", F.lit("CALLS"))


def resolve_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``source_id, target_id, kind`` of ``repo_id, file_path, import_name``: to the symbol of that name in another
    repository where there is exactly one; the source is the file's symbol of the least id.

    Counted by subtraction: all symbols of the name less those of the own repository, so no pairs are formed.
    """
    named = nodes.filter("symbol_name IS NOT NULL AND repo_id IS NOT NULL").groupBy("symbol_name", "repo_id").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    every = named.groupBy("symbol_name").agg(F.sum("n").alias("all")).withColumnRenamed("symbol_name", "import_name")
    own = named.select(F.col("symbol_name").alias("import_name"), "repo_id", F.col("n").alias("own"))
    c = imports.select("repo_id", "file_path", "import_name").distinct()
    hit = c.join(every, "import_name").join(own, ["import_name", "repo_id"], "left").filter(F.col("all") - F.coalesce("own", F.lit(0)) == 1)
    # of such a name the other repositories hold one symbol: at most two repositories per name are left
    few = named.join(hit.select(F.col("import_name").alias("symbol_name")).distinct(), "symbol_name", "left_semi").select(F.col("symbol_name").alias("import_name"), F.col("repo_id").alias("other"), F.col("id").alias("target_id"))
    first = nodes.filter("repo_id IS NOT NULL").groupBy("repo_id", "file_path").agg(F.min("id").alias("source_id"))
    out = hit.join(few, "import_name").filter("other <> repo_id").join(first, ["repo_id", "file_path"])
    return out.select("source_id", "target_id").distinct().withColumn("kind", F.lit("IMPORTS"))


def change_set(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``repo_id, file_path, status`` (added, changed, unchanged, removed) from the stored files to those seen, by
    content hash; a null hash differs from any. Both have ``repo_id, file_path, content_hash``; repeated rows count once, of
    several hashes the greatest."""
    one = lambda df, h: df.groupBy("repo_id", slash("file_path").alias("file_path")).agg(F.max("content_hash").alias(h), F.lit(True).alias(f"has_{h}"))
    j = one(known, "old").join(one(seen, "new"), ["repo_id", "file_path"], "full")
    status = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(F.coalesce(F.col("old") == F.col("new"), F.lit(False)), "unchanged").otherwise("changed")
    return j.select("repo_id", "file_path", status.alias("status"))


def vanished(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of old that new doesn't have."""
    return old.select("id").distinct().join(new.select("id"), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of old with the same id."""
    return old.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def apply_changes(nodes: DataFrame, edges: DataFrame, files: DataFrame, parsed: DataFrame, parsed_files: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New nodes, CALLS edges and files after some files were parsed anew and some removed (``repo_id, file_path``); nodes have ``callees``.

    Symbols of those files are replaced, and so are the edges of every symbol that lies in them or calls a name that they
    defined before or define now, as its target may be gone, new, or no longer the only one. All other
    edges stay, so the result is that of resolving everything anew.
    """
    from skein.extract.table import callee_rows

    touched = parsed_files.select("repo_id", "file_path").union(removed.select("repo_id", "file_path")).distinct()
    cols = nodes.columns
    stale = nodes.join(touched, ["repo_id", "file_path"], "left_semi")
    new_nodes = nodes.join(touched, ["repo_id", "file_path"], "left_anti").select(cols).unionByName(parsed.select(cols))
    names = stale.select("repo_id", F.col("symbol_name").alias("callee")).union(parsed.select("repo_id", "symbol_name")).distinct()
    every = callee_rows(new_nodes)
    again = every.join(names, ["repo_id", "callee"], "left_semi").select("source_id").union(parsed.select("id")).distinct()
    calls = resolve_calls(every.join(again, "source_id", "left_semi"), new_nodes)
    old = again.union(stale.select("id")).distinct()
    kept = edges.join(old, "source_id", "left_anti").select("source_id", "target_id", "kind")
    new_files = files.join(touched, ["repo_id", "file_path"], "left_anti").unionByName(parsed_files.select(files.columns))
    return new_nodes, kept.union(calls).distinct(), new_files
