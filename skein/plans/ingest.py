"""From source trees to a graph, whole or by what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.extract.imports import file_imports
from skein.extract.table import callee_rows, extract_symbols
from skein.functions.text import with_fnv
from skein.operators.resolve import apply_changes, change_set, resolve_calls, resolve_imports
from skein.sources.tables import checkpoint
from skein.sources.tree import scan_tree


@dataclass
class Graph:
    """nodes (with raw_text and callees), edges ``source_id, target_id, kind``, files with content hashes, imports."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    imports: DataFrame


def scan_all(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Files of several trees by repository."""
    out = None
    for repo, root in roots.items():
        df = scan_tree(spark, root, repo)
        out = df if out is None else out.union(df)
    return out


def file_rows(scanned: DataFrame) -> DataFrame:
    return with_fnv(scanned.select("repo_id", "file_path", "mtime_ns", "content"), "content", "content_hash")


def ingest(scanned: DataFrame) -> Graph:
    """Everything anew: each file is parsed once; calls and imports are joins."""
    scanned = checkpoint(scanned)
    nodes = checkpoint(extract_symbols(scanned))
    imports = file_imports(scanned)
    edges = resolve_calls(callee_rows(nodes), nodes).union(resolve_imports(imports, nodes)).distinct()
    return Graph(nodes, edges, file_rows(scanned), imports)


def ingest_changes(graph: Graph, scanned: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after a new scan, and the change set. Only files whose hash differs are parsed and have their calls
    resolved anew; imports are resolved for all, as they depend on every repository."""
    scanned = checkpoint(scanned)
    seen = file_rows(scanned)
    changes = checkpoint(change_set(graph.files, seen))
    touched = changes.filter("status IN ('added', 'changed')").select("repo_id", "file_path")
    parsed = checkpoint(extract_symbols(scanned.join(touched, ["repo_id", "file_path"], "left_semi")))
    removed = changes.filter("status = 'removed'").select("repo_id", "file_path")
    calls = graph.edges.filter("kind = 'CALLS'")
    nodes, edges, files = apply_changes(graph.nodes, calls, graph.files, parsed, seen.join(touched, ["repo_id", "file_path"], "left_semi"), removed)
    imports = file_imports(scanned)
    return Graph(nodes, edges.union(resolve_imports(imports, nodes)).distinct(), files, imports), changes


def self_check(nodes: DataFrame) -> DataFrame:
    """``repo_id, file_path, symbol_name, found_slash, found_backslash``: the first symbol of each file is looked up by its path in
    both styles; both must be found."""
    first = nodes.filter("symbol_name IS NOT NULL").groupBy("repo_id", "file_path").agg(F.min("symbol_name").alias("symbol_name"))
    back = F.replace("file_path", F.lit("/"), F.lit("\\"))
    keys = nodes.select("repo_id", F.replace("file_path", F.lit("\\"), F.lit("/")).alias("p"), "symbol_name").distinct()
    for name, asked in (("found_slash", F.col("file_path")), ("found_backslash", back)):
        want = F.replace(asked, F.lit("\\"), F.lit("/"))
        hit = keys.select(F.col("repo_id").alias("_r"), F.col("p").alias("_p"), F.col("symbol_name").alias("_s"), F.lit(True).alias(name))
        first = first.join(hit, (F.col("repo_id") == F.col("_r")) & (want == F.col("_p")) & (F.col("symbol_name") == F.col("_s")), "left").drop("_r", "_p", "_s")
    return first.select("repo_id", "file_path", "symbol_name", F.coalesce("found_slash", F.lit(False)).alias("found_slash"), F.coalesce("found_backslash", F.lit(False)).alias("found_backslash"))
