"""Per-key counts where a few keys hold most rows (problem 5).

Eager aggregation through the join: both inputs are pre-aggregated by the join
key, the compact states are joined, counts are combined, and only then rolled
up to the skewed key. No exchange is keyed by the skewed key before its rows
were combined on the map side, so a key that holds a third of all rows costs
one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import newest


def target_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per target_id: distinct edges and distinct repositories of their sources.

    An edge is a (source, target, type) triple, the type without regard to case; null
    targets are left out; null sources and types are values like any other. The
    repository of a source is that of its row in nodes, or, where there is none, the
    part of the id before the first colon. Empty tables give no rows.
    """
    # types are few: their set makes triples distinct in the same exchange that counts them
    kind = F.coalesce(F.upper("relationship_type"), F.lit("\u0000"))
    state = edges.filter(F.col("target_id").isNotNull()).groupBy("source_id", "target_id").agg(F.size(F.collect_set(kind)).cast("long").alias("n"))
    repos = nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("repo_id").alias("repo"))
    joined = state.join(repos, state.source_id == repos.id, "left").select(
        "target_id", "n", F.coalesce("repo", F.split_part("source_id", F.lit(":"), F.lit(1))).alias("repo")
    )
    return _roll_up(joined, "target_id")


def name_counts(nodes: DataFrame) -> DataFrame:
    """Per symbol_name (of an id's newest row): distinct ids and distinct repositories; null names keep a row of their own."""
    state = (
        newest(nodes, "id", "ingested_at", ["symbol_name", "repo_id"])
        .groupBy("symbol_name", F.col("repo_id").alias("repo"))
        .agg(F.count("*").alias("n"))
    )
    return _roll_up(state, "symbol_name")


def _roll_up(states: DataFrame, key: str) -> DataFrame:
    return (
        states.groupBy(key, "repo")
        .agg(F.sum("n").alias("n"))
        .groupBy(F.col(key).alias("key_value"))
        .agg(F.sum("n").alias("records"), F.count("repo").alias("repositories"))
    )


def heavy_keys(counts: DataFrame, field: str, share: float = 0.01) -> DataFrame:
    """The keys with at least ``share`` of all records; records without a key count in the total only."""
    total = counts.agg(F.sum("records").alias("total"))
    return (
        counts.filter(F.col("key_value").isNotNull())
        .join(F.broadcast(total), F.col("records") >= F.col("total") * F.lit(share))
        .select(F.lit(field).alias("field_name"), "key_value", "records", "repositories")
    )
