"""Usage telemetry: counters, sessions, failures, activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import failure_category

#: Failures that the ring keeps.
RING = 50


def counters(deltas: DataFrame) -> DataFrame:
    """``key, value``: the sums of an append-only log ``key, delta``; null deltas count as 0."""
    return deltas.groupBy("key").agg(F.sum(F.coalesce("delta", F.lit(0))).cast("long").alias("value"))


def read_counters(values: DataFrame, keys: list[str]) -> DataFrame:
    """The counters asked for, 0 where there is none."""
    spark = values.sparkSession
    want = spark.createDataFrame([(k,) for k in keys], "key string")
    return want.join(values, "key", "left").select("key", F.coalesce("value", F.lit(0)).alias("value"))


def lifetime(values: DataFrame) -> DataFrame:
    """One row over the counters ``workspace_id, key, value`` of many workspaces: the totals, the percentage saved and the percentage of
    requests that came through the pipeline, 0 where there were none."""
    total = lambda k: F.coalesce(F.sum(F.when(F.col("key") == k, F.col("value"))), F.lit(0)).cast("long").alias(k)
    keys = ["total_requests", "total_tokens_saved", "total_file_tokens", "pipeline_requests", "direct_low_level_autorouted", "direct_low_level_rejected"]
    t = values.agg(*[total(k) for k in keys])
    n = F.col("pipeline_requests") + F.col("direct_low_level_autorouted") + F.col("direct_low_level_rejected")
    return t.select(
        "*", F.when(F.col("total_file_tokens") > 0, F.col("total_tokens_saved") * 100.0 / F.col("total_file_tokens")).otherwise(0.0).alias("reduction_pct"),
        F.when(n > 0, F.col("pipeline_requests") * 100.0 / n).otherwise(0.0).alias("compliance_pct"),
    )


def sessions(calls: DataFrame) -> DataFrame:
    """``session, calls, file_tokens, used_tokens, saved, signed``: per session what calls ``session, file_tokens, used_tokens`` saved, never
    below 0 a call; signed is the plain difference that the lifetime counters add."""
    f, u = F.coalesce("file_tokens", F.lit(0)), F.coalesce("used_tokens", F.lit(0))
    return calls.groupBy("session").agg(
        F.count("*").alias("calls"), F.sum(f).cast("long").alias("file_tokens"), F.sum(u).cast("long").alias("used_tokens"),
        F.sum(F.greatest(f - u, F.lit(0))).cast("long").alias("saved"), F.sum(f - u).cast("long").alias("signed"),
    )


def failure_ring(failures: DataFrame, keep: int = RING) -> DataFrame:
    """The newest failures by id; the ring's size is a feature."""
    return failures.orderBy(F.desc("id")).limit(keep)


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy(failure_category(F.col("message")).alias("category")).agg(F.count("*").alias("failures"))


def activities(log: DataFrame) -> DataFrame:
    """The latest state ``id, kind, state, at`` of each activity of an append-only log; ties go to the greater state."""
    m = F.max_by(F.struct("kind", "state", "at"), F.struct("at", "state"))
    return log.groupBy("id").agg(m.alias("m")).select("id", "m.*")


def capsule_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``key, side, line``: lines that one of two capsules ``key, text`` has more often than the other."""
    tall = lambda df, s: df.select("key", F.explode(F.split("text", "\n")).alias("line")).groupBy("key", "line").agg(F.count("*").alias(s))
    j = tall(before, "b").join(tall(after, "a"), ["key", "line"], "full")
    b, a = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    return j.filter(a != b).select("key", F.when(a > b, "added").otherwise("removed").alias("side"), "line")


def ranked_per_key(df: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= keep)
