"""Streams: file events applied to the graph, telemetry counters, activity states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.sources.tables import slash
from skein.sources.tree import safe_to_parse, supported

EVENTS = "path string, kind string, at timestamp, content string"


def relevant(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events ``repo_id, file_path, kind, at, content`` of files that may be parsed, for the first root (by position) that holds them.

    roots has ``position, repo_id, root``: the watched folders of one process, a short list.
    """
    e = events.withColumn("path", slash("path")).filter(safe_to_parse(F.col("path")) & supported(F.col("path")))
    r = roots.select("position", "repo_id", F.concat(F.rtrim("root", F.lit("/")), F.lit("/")).alias("root"))
    j = e.join(F.broadcast(r), F.col("path").startswith(F.col("root")))
    first = j.groupBy("path", "kind", "at", "content").agg(F.min_by(F.struct("repo_id", "root"), "position").alias("r"))
    return first.select("r.repo_id", F.expr("substring(path, length(r.root) + 1)").alias("file_path"), "kind", "at", "content")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each file of a batch: what debouncing leaves."""
    w = Window.partitionBy("repo_id", "file_path").orderBy(F.desc("at"), F.desc("kind"))
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_events(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """A stream of JSON event files; at most so many files a trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(path)


def watch(events: DataFrame, roots: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``apply(changed, removed, batch)`` for each micro-batch with the last event of each file: changed with
    content, removed those deleted. A batch may be applied again after a failure; applying is by replacement, so it may."""

    def batch(df: DataFrame, n: int) -> None:
        last = latest(relevant(df, roots))
        gone = F.col("kind") == "deleted"
        apply(last.filter(~gone), last.filter(gone), n)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counters(events: DataFrame) -> DataFrame:
    """``key, value`` of a stream ``key, delta``, for the update mode."""
    return events.groupBy("key").agg(F.sum("delta").alias("value"))


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: counts per window of event time, with a watermark for late events."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("events"))
