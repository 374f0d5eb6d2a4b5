"""References to records that do not exist (problem 2).

Keys are range-partitioned on their 64-bit hash, which is uniform, so equal-width
ranges are balanced without sampling. Each range holds its parents as one sorted
array; the distinct reference keys of the range are probed by a vectorised
binary search, and all hits are verified on the keys in one comparison. Only the keys that
miss are joined back to the references, so a key that holds a third of all
references is probed once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import newest, slash

#: Keys of parents and references that one range holds on average.
KEYS_PER_RANGE = 100_000


def _probe(parents: pa.Table, refs: pa.Table) -> pa.Table:
    want = refs.column("h").to_numpy()
    have = parents.column("h").to_numpy()
    order = np.argsort(have, kind="stable")
    have = have[order]
    at = np.searchsorted(have, want, "left")
    end = np.searchsorted(have, want, "right")
    miss = at == end
    found = np.flatnonzero(~miss)
    rk, pk = refs.column("key"), parents.column("key")
    same = pc.equal(rk.take(pa.array(found)), pk.take(pa.array(order[at[found]]))).to_numpy(zero_copy_only=False)
    for i in found[~same.astype(bool)]:  # different keys of one hash: the other parents of that hash
        miss[i] = rk[i] not in [pk[j] for j in order[at[i] + 1 : end[i]]]
    return refs.select(["key"]).filter(pa.array(miss))


def missing_keys(parents: DataFrame, refs: DataFrame, ranges: int) -> DataFrame:
    """Distinct non-null values of ``refs.key`` that are not in ``parents.key``. No parents: all of them."""

    def keyed(df: DataFrame) -> DataFrame:
        h = F.xxhash64("key")
        return (
            df.select("key").filter(F.col("key").isNotNull()).distinct()
            .withColumn("h", h)
            .withColumn("r", F.floor((h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64 / ranges)).cast("int"))
        )

    return keyed(parents).groupBy("r").cogroup(keyed(refs).groupBy("r")).applyInArrow(_probe, "key string")


def ranges_for(*dfs: DataFrame) -> int:
    """Ranges such that each holds about KEYS_PER_RANGE keys; the counts come from the files' footers."""
    return max(8, -(-sum(df.count() for df in dfs) // KEYS_PER_RANGE))


def live_nodes(nodes: DataFrame, removed: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows ``id, repo_id, file_path, symbol_name`` of live nodes: shared ones, and newest rows not removed after them.

    A removal at the same instant does not count as after; rows without an id or removal time are passed over.
    """
    n = newest(nodes, "id", "ingested_at", ["repo_id", "file_path", "symbol_name"])
    gone = (
        removed.filter(F.col("node_id").isNotNull() & F.col("removed_at").isNotNull())
        .groupBy("node_id").agg(F.max("removed_at").alias("removed_at"))
    )
    alive = n.join(gone, n.id == gone.node_id, "left").filter(
        F.col("removed_at").isNull() | F.coalesce(F.col("removed_at") <= F.col("ingested_at"), F.lit(False))
    )
    cols = ["id", "repo_id", "file_path", "symbol_name"]
    return alive.select(cols).union(shared.filter(F.col("id").isNotNull()).select(cols))


def _compound(*cols) -> F.Column:
    return F.concat_ws("\u0000", *cols)


def orphan_references(
    edges: DataFrame, observations: DataFrame, nodes: DataFrame, shared: DataFrame, removed: DataFrame, files: DataFrame
) -> DataFrame:
    """``table_name, field_name, record_key, missing_key, period`` of each reference without a live counterpart.

    The period is the first month in which the reference was seen, null where no time is
    known. A null reference is no reference; a null repo_id, path or id of a record
    matches nothing and is a case where the other part is given. Repeated
    rows count once. Empty parents make every reference a case; empty references give none.
    """
    live = live_nodes(nodes, removed, shared)
    e = edges.filter(F.col("target_id").isNotNull()).select(
        F.lit("edges").alias("table_name"), F.lit("target_id").alias("field_name"),
        F.col("source_id").alias("record_key"), F.col("target_id").alias("missing_key"),
        F.col("seen_at").alias("at"), _compound(F.lit("n"), "target_id").alias("key"),
    )
    o = observations.select(
        F.col("id").cast("string").alias("record_key"), "repo_id", "symbol_name",
        slash("filepath").alias("path"), F.col("timestamp").alias("at"),
    )
    blank = F.lit("\u0001")
    of = o.filter(F.col("path").isNotNull()).select(
        F.lit("observations"), F.lit("filepath"), "record_key", "path", "at",
        _compound(F.lit("f"), F.coalesce("repo_id", blank), "path"),
    )
    os_ = o.filter(F.col("symbol_name").isNotNull()).select(
        F.lit("observations"), F.lit("symbol_name"), "record_key", "symbol_name", "at",
        _compound(F.lit("s"), F.coalesce("repo_id", blank), F.coalesce("path", blank), "symbol_name"),
    )
    refs = e.union(of).union(os_)
    full = lambda *c: F.lit(True) if not c else F.col(c[0]).isNotNull() & full(*c[1:])
    parents = (
        live.select(_compound(F.lit("n"), "id").alias("key"))
        .union(files.filter(full("repo_id", "file_path")).select(_compound(F.lit("f"), "repo_id", slash("file_path"))))
        .union(
            live.filter(full("repo_id", "file_path", "symbol_name"))
            .select(_compound(F.lit("s"), "repo_id", slash("file_path"), "symbol_name"))
        )
    )
    missing = missing_keys(parents, refs, ranges_for(edges, nodes, observations, files))
    # the references were not deduplicated yet: each orphan once, at its first time
    return (
        refs.join(missing, "key", "left_semi")
        .groupBy("table_name", "field_name", "record_key", "missing_key")
        .agg(F.date_format(F.min("at"), "yyyy-MM").alias("period"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and month."""
    return orphans.groupBy("table_name", "field_name", "period").agg(F.count("*").alias("orphans"))
