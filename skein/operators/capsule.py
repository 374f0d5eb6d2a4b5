"""Context capsules: a symbol with the signatures around it; traces; class maps; proofs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.extract.condense import signature, with_condensed
from skein.functions.text import saved_share, tokens_down
from skein.operators.graph import adjacent, dependency_graph, path_category
from skein.sources.tables import checkpoint

PIVOT_BYTES, SHOWN_CALLERS, PROOF_FILES, PROOF_BYTES = 12_000, 10, 8, 16 * 1024


def capsules(pivots: DataFrame, nodes: DataFrame, edges: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pivot_id, direction, rank, id, signature``: per pivot the pivot itself (direction ``self``, its text, condensed when it has
    more than PIVOT_BYTES), callees as signature lines, and the first callers, of which ``omitted`` says how many loaded ones
    aren't shown. ``texts`` gives ``id, language, symbol_name, raw_text`` of the ids that it is given: those that are shown."""
    ids = pivots.select(F.col("id").alias("pivot_id"))
    near = adjacent(nodes, edges, pivots=ids)
    loaded = near.filter("direction = 'in'").groupBy("pivot_id").agg(F.count("*").alias("n"))
    near = near.filter((F.col("direction") == "out") | (F.col("rank") <= SHOWN_CALLERS))
    want = near.select("pivot_id", "direction", "rank", "id").union(ids.select("pivot_id", F.lit("self"), F.lit(0).cast("long"), "pivot_id"))
    want = checkpoint(want)
    full = want.join(texts(want.select("id").distinct()).select("id", "language", "raw_text", F.col("symbol_name").alias("name")), "id")
    cut = with_condensed(full.withColumn("full", F.when(F.col("direction") == "self", F.col("raw_text"))))
    shown = F.when(F.col("direction") != "self", signature(F.col("condensed"), F.col("name"))).when(F.octet_length("full") <= PIVOT_BYTES, F.col("full")).otherwise(F.col("condensed"))
    out = cut.join(loaded, "pivot_id", "left")
    omitted = F.when(F.col("direction") == "self", F.greatest(F.coalesce("n", F.lit(0)) - SHOWN_CALLERS, F.lit(0)))
    return out.select("pivot_id", "direction", "rank", "id", shown.alias("shown"), omitted.cast("long").alias("omitted"))


def capsule_tokens(capsule: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``pivot_id, used, baseline, saved_pct``: estimated tokens of a capsule against those of the texts it stands for."""
    used = capsule.groupBy("pivot_id").agg(F.sum(tokens_down(F.col("shown"))).alias("used"))
    whole = capsule.select("pivot_id", "id").distinct().join(nodes.select("id", "raw_text"), "id").groupBy("pivot_id").agg(F.sum(tokens_down(F.col("raw_text"))).alias("baseline"))
    return used.join(whole, "pivot_id").select("pivot_id", "used", "baseline", saved_share(F.col("baseline"), F.col("used")).alias("saved_pct"))


def traces(pivots: DataFrame, nodes: DataFrame, edges: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pivot_id, rank, id, text``: the pivot's whole text (rank 0) and the condensed texts of its callees."""
    ids = pivots.select(F.col("id").alias("pivot_id"))
    out = adjacent(nodes, edges, pivots=ids).filter("direction = 'out'").select("pivot_id", "rank", "id")
    want = checkpoint(out.union(ids.select("pivot_id", F.lit(0).cast("long"), "pivot_id")))
    want = want.join(texts(want.select("id").distinct()).select("id", "language", "raw_text"), "id")
    cut = with_condensed(want.withColumn("full", F.when(F.col("rank") == 0, F.col("raw_text"))))
    return cut.select("pivot_id", "rank", "id", F.coalesce("full", "condensed").alias("text"))


def neighbour_categories(pivots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``pivot_id, category, files``: distinct files of a pivot's neighbours, by category."""
    ids = pivots.select(F.col("id").alias("pivot_id"))
    near = (
        ids.join(edges, F.col("pivot_id") == F.col("source_id")).select("pivot_id", F.col("target_id").alias("id"))
        .union(ids.join(edges, F.col("pivot_id") == F.col("target_id")).select("pivot_id", "source_id"))
        .distinct()
    )
    f = near.join(nodes.select("id", "file_path"), "id").select("pivot_id", "file_path").distinct()
    return f.groupBy("pivot_id", path_category(F.col("file_path")).alias("category")).agg(F.count("*").alias("files"))


def class_map(pivots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``pivot_id, part, key, value``: members of the pivot's file, its dependency graph to depth 2, and categories."""
    ids = pivots.select(F.col("id").alias("pivot_id"))
    home = ids.join(nodes.select(F.col("id").alias("pivot_id"), "repo_id", "file_path"), "pivot_id")
    mates = home.join(nodes.select("id", "repo_id", "file_path"), ["repo_id", "file_path"]).select("pivot_id", F.lit("file").alias("part"), F.col("id").alias("key"), F.lit(0).cast("long").alias("value"))
    deps = dependency_graph(pivots, nodes, edges).filter("NOT already_seen").select("pivot_id", "direction", "id", "depth")
    cats = neighbour_categories(pivots, nodes, edges).select("pivot_id", F.lit("category"), "category", "files")
    return mates.union(deps).union(cats)


def sample_paths(paths: DataFrame, k: int = PROOF_FILES) -> DataFrame:
    """``repo_id, position, file_path``: at most k paths of each repository, evenly spaced in order: of n the ones at i * (n - 1) / (k - 1)."""
    w = Window.partitionBy("repo_id").orderBy("file_path")
    one = paths.select("repo_id", "file_path").distinct().withColumn("i", F.row_number().over(w) - 1)
    n = one.groupBy("repo_id").agg(F.count("*").alias("n"))
    want = n.select("repo_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.least("n", F.lit(k)) - 1), lambda j: F.when(F.col("n") <= k, j).otherwise(F.floor(j * (F.col("n") - 1) / max(1, k - 1))))).alias("position", "i"))
    return one.join(want, ["repo_id", "i"]).select("repo_id", F.col("position").cast("long").alias("position"), "file_path")


def byte_budget(rows: DataFrame, group: str, order: list, text: str, limit: int) -> DataFrame:
    """Rows of each group in order until the first that would exceed ``limit`` bytes in all."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("bytes_so_far", F.sum(F.octet_length(text)).over(w)).filter(F.col("bytes_so_far") <= limit)
