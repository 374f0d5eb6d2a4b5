"""Workspaces: registration, status, inventory, routing."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import fnv1a64

COLUMNS = ["workspace_id", "workspace_root", "graph_path", "display_name", "status", "registered_at", "last_seen_at"]


def workspace_id(root: str) -> str:
    """The folder's name, made plain, with the first 8 digits of the root's hash."""
    name = re.sub(r"[^A-Za-z0-9_-]+", "-", os.path.basename(root.replace("\\", "/").rstrip("/"))).strip("-") or "workspace"
    return f"{name}-{fnv1a64(root.encode())[:8]}"


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by workspace_id: the first registered_at and, where the new row has none, the old display name stay."""
    every = known.select(*COLUMNS, F.lit(0).alias("_o")).unionByName(new.select(*COLUMNS, F.lit(1).alias("_o")))
    late = lambda c: F.max_by(c, F.struct("_o", "last_seen_at")).alias(c)
    name = F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.struct("_o", "last_seen_at"))).alias("display_name")
    return every.groupBy("workspace_id").agg(late("workspace_root"), late("graph_path"), name, late("status"), F.min("registered_at").alias("registered_at"), F.max("last_seen_at").alias("last_seen_at")).select(*COLUMNS)


def classify_error(message: F.Column) -> F.Column:
    m = F.lower(message)
    return F.when(m.contains("locked") | m.contains("busy"), "locked").when(m.contains("malformed") | m.contains("not a database"), "corrupt").otherwise("inaccessible_db")


def inventory(workspaces: DataFrame, scope: DataFrame, errors: DataFrame) -> DataFrame:
    """``workspace_id, label, status, repos, symbols, files``, by label without regard to case. scope has ``workspace_id, repo_id, symbols,
    files`` of the graphs that could be read, errors ``workspace_id, message`` of the others; one with neither has no graph."""
    s = scope.groupBy("workspace_id").agg(F.count("repo_id").alias("repos"), F.sum("symbols").alias("symbols"), F.sum("files").alias("files"))
    e = errors.groupBy("workspace_id").agg(F.max("message").alias("message"))
    j = workspaces.join(s, "workspace_id", "left").join(e, "workspace_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    status = (
        F.when(F.col("message").isNotNull(), classify_error(F.col("message"))).when(F.col("repos").isNull(), "missing_db")
        .when((zero("symbols") == 0) & (zero("files") == 0), "empty").otherwise("available")
    )
    label = F.coalesce("display_name", "workspace_root")
    return j.select("workspace_id", label.alias("label"), status.alias("status"), zero("repos").alias("repos"), zero("symbols").alias("symbols"), zero("files").alias("files")).orderBy(F.lower("label"), "workspace_id")


def totals(inv: DataFrame) -> DataFrame:
    return inv.agg(F.count("*").alias("workspaces"), F.sum("repos").alias("repos"), F.sum("symbols").alias("symbols"), F.sum("files").alias("files"))


def owner(scope: DataFrame, workspaces: DataFrame, repos: DataFrame) -> DataFrame:
    """``repo_id, workspace_id``: of the workspaces that hold a repository the one registered first."""
    j = repos.join(scope.select("workspace_id", "repo_id").distinct(), "repo_id").join(workspaces.select("workspace_id", "registered_at"), "workspace_id")
    return j.groupBy("repo_id").agg(F.min_by("workspace_id", F.struct("registered_at", "workspace_id")).alias("workspace_id"))


def dead_workspaces(workspaces: DataFrame, existing: DataFrame, temp_prefixes: list[str]) -> DataFrame:
    """Temporary workspaces whose root is gone."""
    temp = F.lit(False)
    for p in temp_prefixes:
        temp = temp | F.col("workspace_root").startswith(p)
    return workspaces.filter(temp).join(existing.select("workspace_root"), "workspace_root", "left_anti")


def clear(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a graph emptied; notes, counters and repositories stay."""
    keep = {"observations", "stats", "repositories"}
    return {k: df if k in keep else df.limit(0) for k, df in tables.items()}
