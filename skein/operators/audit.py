"""Sessions of transcripts: usage per message, tools, models, cost, and comparison of two sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = (
    "type string, timestamp string, message struct<id:string, model:string, stop_reason:string, "
    "usage:struct<input_tokens:bigint, output_tokens:bigint, cache_creation_input_tokens:bigint, cache_read_input_tokens:bigint>, "
    "content:array<struct<type:string, name:string, id:string, tool_use_id:string, text:string>>>"
)
USAGE = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


def read_lines(lines: DataFrame) -> DataFrame:
    """``session, line_no`` and the parsed line of ``session, line_no, value``; blank and broken lines are left out."""
    j = F.from_json("value", LINE, {"mode": "PERMISSIVE"})
    return lines.filter(F.trim("value") != "").select("session", "line_no", j.alias("j")).filter("j.type IS NOT NULL OR j.message IS NOT NULL").select("session", "line_no", "j.*")


def requests(parsed: DataFrame) -> DataFrame:
    """One row per session and message: model and usage of its first line, the last stop reason given, the content of all its lines in order."""
    a = parsed.filter("type = 'assistant' AND message.id IS NOT NULL")
    g = a.groupBy("session", F.col("message.id").alias("message_id")).agg(
        F.min_by("message.model", "line_no").alias("model"),
        F.min_by("message.usage", "line_no").alias("u"),
        F.max_by("message.stop_reason", F.when(F.col("message.stop_reason").isNotNull(), F.col("line_no"))).alias("stop_reason"),
        F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("message.content", F.array().cast("array<struct<type:string,name:string,id:string,tool_use_id:string,text:string>>")).alias("c")))).alias("cs"),
        F.min("timestamp").alias("first_at"),
    )
    return g.select("session", "message_id", "model", *[F.coalesce(f"u.{c}", F.lit(0)).alias(c) for c in USAGE], "stop_reason", F.flatten(F.transform("cs", lambda x: x["c"])).alias("content"), "first_at")


def tool_calls(reqs: DataFrame, parsed: DataFrame) -> DataFrame:
    """``session, message_id, tool, call_id, answered``: tool uses with whether a result came back."""
    uses = reqs.select("session", "message_id", F.explode("content").alias("c")).filter("c.type = 'tool_use'").select("session", "message_id", F.col("c.name").alias("tool"), F.col("c.id").alias("call_id"))
    results = parsed.select("session", F.explode("message.content").alias("c")).filter("c.type = 'tool_result'").select("session", F.col("c.tool_use_id").alias("call_id"), F.lit(True).alias("_a")).distinct()
    return uses.join(results, ["session", "call_id"], "left").select("session", "message_id", "tool", "call_id", F.coalesce("_a", F.lit(False)).alias("answered"))


def by_model(reqs: DataFrame) -> DataFrame:
    return reqs.groupBy("session", "model").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in USAGE])


def by_session(reqs: DataFrame) -> DataFrame:
    """Totals of each session over all models."""
    return reqs.groupBy("session").agg(F.min("first_at").alias("first_at"), F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in USAGE])


def by_tool(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session", "tool").agg(F.count("*").alias("calls"))


def priced(reqs: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests with ``cost`` and ``tier``. prices has ``tier, pattern, input, output, cache_write, cache_read`` (per token): the first
    of the tiers override (the model itself), exact (the model, with or without a provider before a slash), family (a part of
    the model's name) and bundled (likewise) decides; of several of a tier the longest pattern, then the least.

    A price book is a short list, and models are few: they are matched distinct.
    """
    models = reqs.select("model").filter("model IS NOT NULL").distinct()
    tiers = {"override": 0, "exact": 1, "family": 2, "bundled": 3}
    number = None
    for k, n in tiers.items():
        number = F.when(F.col("tier") == k, n) if number is None else number.when(F.col("tier") == k, n)
    bare = F.element_at(F.split("model", "/"), -1)
    equal = models.join(F.broadcast(prices.filter("tier IN ('override', 'exact')")), (F.col("model") == F.col("pattern")) | (bare == F.element_at(F.split("pattern", "/"), -1)))
    part = models.join(F.broadcast(prices.filter("tier IN ('family', 'bundled')")), F.col("model").contains(F.col("pattern")))
    rates = ["input", "output", "cache_write", "cache_read"]
    one = equal.unionByName(part).groupBy("model").agg(F.min_by(F.struct("tier", *rates), F.struct(number, -F.length("pattern"), "pattern")).alias("p")).select("model", "p.*")
    cost = sum((F.col(c) * F.coalesce(r, F.lit(0.0)) for c, r in zip(["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"], rates)), F.lit(0.0))
    return reqs.join(one, "model", "left").withColumn("cost", cost).drop(*rates)


def compare(reqs: DataFrame, calls: DataFrame, a: str, b: str) -> DataFrame:
    """``metric, a, b, delta, delta_pct`` of two sessions: usage, requests, and each tool's calls."""
    use = reqs.filter(F.col("session").isin(a, b)).groupBy("session").agg(F.count("*").cast("long").alias("requests"), *[F.sum(c).alias(c) for c in USAGE])
    tall = use.select("session", F.expr("stack(5, " + ", ".join(f"'{c}', {c}" for c in ["requests", *USAGE]) + ") AS (metric, value)"))
    tools = calls.filter(F.col("session").isin(a, b)).groupBy("session", F.concat(F.lit("tool:"), "tool").alias("metric")).agg(F.count("*").alias("value"))
    both = tall.unionByName(tools)
    side = lambda s: F.coalesce(F.sum(F.when(F.col("session") == s, F.col("value"))), F.lit(0)).cast("long")
    t = both.groupBy("metric").agg(side(a).alias("a"), side(b).alias("b"))
    return t.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"), F.when(F.col("a") != 0, (F.col("b") - F.col("a")) * 100.0 / F.col("a")).alias("delta_pct"))
