"""Queries of the general data problems (p2, p5, p6) over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import forest, heavy_keys, orphans
from skein.sources.tables import table


def p2_orphans(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return orphans.orphan_references(
        t("edges"), t("observations"), t("nodes"), t("shared_nodes"), t("removed_nodes"), t("files")
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_orphans(spark, sf).drop("period")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(p2_orphans(spark, sf))


def p5_target_counts(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys.target_counts(table(spark, sf, "edges"), table(spark, sf, "nodes"))


def p5_name_counts(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys.name_counts(table(spark, sf, "nodes"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    a = heavy_keys.heavy_keys(p5_target_counts(spark, sf), "target_id")
    b = heavy_keys.heavy_keys(p5_name_counts(spark, sf), "symbol_name")
    return a.union(b).select("field_name", "key_value")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return forest.links_of(table(spark, sf, "edges"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return forest.resolve(_links(spark, sf)).select(F.col("node").alias("node_id"), F.coalesce("root", "cycle").alias("top_id"))


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    return forest.hierarchy(_links(spark, sf)).select(
        F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", " > ").alias("path")
    )


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    d = forest.descendants(forest.hierarchy(_links(spark, sf)))
    return d.select(F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def p6_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return forest.cycles(forest.resolve(_links(spark, sf))).select(F.col("cycle").alias("cycle_id"), "nodes")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_report, p5_found, p5_target_counts, p5_name_counts, p6_found, p6_paths, p6_descendants, p6_cycles,
    )
}

_NEWEST = """newest AS (
  SELECT id, ingested_at, repo_id, replace(file_path, '\\', '/') AS path, symbol_name FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, repo_id DESC NULLS LAST,
      file_path DESC NULLS LAST, symbol_name DESC NULLS LAST) AS k FROM nodes WHERE id IS NOT NULL) WHERE k = 1)"""

_ORPHANS = f"""WITH {_NEWEST}, gone AS (SELECT node_id, max(removed_at) AS removed_at FROM removed_nodes GROUP BY 1),
live AS (
  SELECT id, repo_id, path, symbol_name FROM newest LEFT JOIN gone ON id = node_id WHERE removed_at IS NULL OR removed_at <= ingested_at
  UNION ALL SELECT id, repo_id, replace(file_path, '\\', '/'), symbol_name FROM shared_nodes),
obs AS (SELECT CAST(id AS VARCHAR) AS record_key, repo_id, symbol_name, replace(filepath, '\\', '/') AS path, "timestamp" AS seen FROM observations),
known AS (SELECT repo_id, replace(file_path, '\\', '/') AS path FROM files),
cases AS (
  SELECT 'edges' AS table_name, 'target_id' AS field_name, source_id AS record_key, target_id AS missing_key, seen_at AS seen
  FROM edges WHERE target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM live WHERE live.id = target_id)
  UNION ALL SELECT 'observations', 'filepath', record_key, path, seen FROM obs
  WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known WHERE known.repo_id = obs.repo_id AND known.path = obs.path)
  UNION ALL SELECT 'observations', 'symbol_name', record_key, symbol_name, seen FROM obs
  WHERE symbol_name IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM live WHERE live.repo_id = obs.repo_id AND live.path = obs.path AND live.symbol_name = obs.symbol_name)),
orphans AS (
  SELECT table_name, field_name, record_key, missing_key, strftime(min(seen), '%Y-%m') AS period FROM cases GROUP BY 1, 2, 3, 4)
"""

_TARGETS = """WITH triples AS (
  SELECT DISTINCT source_id, target_id, upper(relationship_type) AS kind FROM edges WHERE target_id IS NOT NULL),
repos AS (SELECT id, max(repo_id) AS repo FROM nodes WHERE id IS NOT NULL GROUP BY 1),
target_counts AS (
  SELECT target_id AS key_value, CAST(count(*) AS BIGINT) AS records,
    CAST(count(DISTINCT coalesce(repo, split_part(source_id, ':', 1))) AS BIGINT) AS repositories
  FROM triples LEFT JOIN repos ON source_id = id GROUP BY 1)"""

_NAMES = f"""{_NEWEST}, name_counts AS (
  SELECT symbol_name AS key_value, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT repo_id) AS BIGINT) AS repositories
  FROM newest GROUP BY 1)"""

_FOREST = """WITH RECURSIVE links AS (
  SELECT target_id AS child, min(source_id) AS parent FROM edges
  WHERE upper(relationship_type) = 'IMPORTS' AND target_id IS NOT NULL GROUP BY 1),
ids AS (SELECT child AS node FROM links UNION SELECT parent FROM links WHERE parent IS NOT NULL),
walk(node, cur, path) AS (
  SELECT node, node, [node] FROM ids
  UNION ALL SELECT node, parent, list_append(path, parent) FROM walk JOIN links ON cur = child
  WHERE parent IS NOT NULL AND NOT list_contains(path, parent)),
ends AS (SELECT w.node, w.cur, w.path, l.parent FROM walk w LEFT JOIN links l ON l.child = w.cur
  WHERE l.parent IS NULL OR list_contains(w.path, l.parent)),
resolved AS (
  SELECT node, path, CASE WHEN parent IS NULL THEN cur END AS root,
    CASE WHEN parent IS NOT NULL THEN list_min(path[list_position(path, parent):]) END AS cycle FROM ends)
"""

SQL = {
    "p2_found": _ORPHANS + "SELECT table_name, field_name, record_key, missing_key FROM orphans",
    "p2_report": _ORPHANS + "SELECT table_name, field_name, period, CAST(count(*) AS BIGINT) AS orphans FROM orphans GROUP BY 1, 2, 3",
    "p5_target_counts": _TARGETS + " SELECT * FROM target_counts",
    "p5_name_counts": f"WITH {_NAMES} SELECT * FROM name_counts",
    "p5_found": f"""{_TARGETS}, {_NAMES}
SELECT 'target_id' AS field_name, key_value FROM target_counts WHERE records >= 0.01 * (SELECT sum(records) FROM target_counts)
UNION ALL SELECT 'symbol_name', key_value FROM name_counts
WHERE key_value IS NOT NULL AND records >= 0.01 * (SELECT sum(records) FROM name_counts)""",
    "p6_found": _FOREST + "SELECT node AS node_id, coalesce(root, cycle) AS top_id FROM resolved",
    "p6_paths": _FOREST
    + """SELECT node AS node_id, root AS root_id, CAST(len(path) - 1 AS BIGINT) AS depth,
array_to_string(list_reverse(path), ' > ') AS path FROM resolved WHERE root IS NOT NULL""",
    "p6_descendants": _FOREST
    + """SELECT p AS node_id, node AS descendant_id, CAST(d AS BIGINT) AS distance FROM (
  SELECT node, unnest(path[2:]) AS p, unnest(range(1, len(path))) AS d FROM resolved WHERE root IS NOT NULL)""",
    "p6_cycles": _FOREST + "SELECT cycle AS cycle_id, CAST(count(*) AS BIGINT) AS nodes FROM resolved WHERE cycle IS NOT NULL GROUP BY 1",
}
