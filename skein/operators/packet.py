"""Context packets: task terms, lexical scores, neighbours, and a greedy token budget, for many tasks at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.extract.condense import with_condensed
from skein.functions.text import capped_count, match_lower, task_terms, tokens_up
from skein.sources.tables import checkpoint

# Words that make a task broad or targeted; weights of a term; entry costs; reserve.
BROAD = ("whole", "entire", "all", "every", "codebase", "repository", "overview")
TARGETED = ("trace", "flow", "caller", "callee", "impact", "refactor", "symbol", "function")
NAME, PATH, KIND, MOST = 12, 6, 2, 5
EXACT_COST, CONDENSED_COST, RESERVE, LEAST = 32, 24, 180, 40


@dataclass(frozen=True)
class Profile:
    window: int
    percent: int
    exact: int
    neighbours: int
    chars: int


PROFILES = {"local-8k": Profile(8000, 70, 2, 1, 240), "local-32k": Profile(32000, 100, 4, 3, 900), "cloud": Profile(128000, 60, 3, 2, 420)}


def entry_budget(request: int, profile: Profile) -> int:
    left = min(request, profile.window) * profile.percent // 100 - RESERVE
    return left if left >= LEAST else 0


def scored(nodes: DataFrame, task: str) -> DataFrame:
    """nodes (with raw_text) and ``score``: for each term of the task 12 for the name, 6 for the path, 2 for the kind, and its occurrences in the
    text, at most 5. Only ASCII case is folded. Null columns score nothing; without terms all score 0."""
    score = F.lit(0)
    for t in task_terms(task):
        for col, points in (("symbol_name", NAME), ("file_path", PATH), ("symbol_type", KIND)):
            score = score + F.when(match_lower(F.col(col)).contains(t), points).otherwise(0)
        score = score + capped_count(match_lower(F.col("raw_text")), t, MOST)
    return nodes.withColumn("score", score.cast("long"))


def route(task: str, best: int, indexed: bool = True) -> str:
    """How to serve a task, by parts of its words and the best score."""
    low = task.lower()
    if not indexed:
        return "needs_index"
    broad, targeted = any(w in low for w in BROAD), any(w in low for w in TARGETED)
    if broad:
        return "use_native" if best <= 3 else "hybrid"
    if best > 0:
        return "use_graph" if targeted else "hybrid"
    return "use_native"


def candidates(scores: DataFrame, degree: DataFrame, k: int) -> DataFrame:
    """The k best nodes (``id, file_path, symbol_name, score``): score, then degree, file, name, id. Texts aren't sorted."""
    s = scores.filter("score > 0").select("id", "file_path", "symbol_name", "score")
    return s.join(degree, "id", "left").select("id", "file_path", "symbol_name", "score", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(
        F.desc("score"), F.desc("degree"), F.asc_nulls_last("file_path"), F.asc_nulls_last("symbol_name"), "id"
    ).limit(k)


def greedy(entries: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Entries of each group in order, taken while they fit: one that doesn't is passed over and the next is tried.

    A group holds the few entries of one packet.
    """
    arr = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).alias("c"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(a, x):
        fits = a["used"] + x["c"] <= budget
        return F.struct(
            F.when(fits, a["used"] + x["c"]).otherwise(a["used"]).cast("long").alias("used"),
            F.when(fits, F.array_append(a["kept"], x["o"].cast("long"))).otherwise(a["kept"]).alias("kept"),
        )

    kept = entries.groupBy(group).agg(F.aggregate(arr, zero, step)["kept"].alias("_kept"))
    return entries.join(kept, group).filter(F.array_contains("_kept", F.col(order).cast("long"))).drop("_kept")


def greedy_in_order(entries: DataFrame, group: str, order: list[Column], id_: str, cost: str, budget: int) -> DataFrame:
    """``group, id, position, cost``: as greedy, for groups of any size. Rows are folded as they pass in order; the state is one sum.

    No group and no cost is null.
    """

    def fold(batches):
        at, used, place = None, 0, 0
        for b in batches:
            kept, places = [], []
            for i, (g, c) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if g != at:
                    at, used, place = g, 0, 0
                place += 1
                if used + c <= budget:
                    used += c
                    kept.append(i)
                    places.append(place)
            few = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(places, pa.int64()), few.column(2)], names=[group, id_, "position", cost])

    kinds = dict(entries.dtypes)
    rows = entries.repartition(group).sortWithinPartitions(group, *order).select(group, id_, cost)
    return rows.mapInArrow(fold, f"{group} {kinds[group]}, {id_} {kinds[id_]}, position long, {cost} {kinds[cost]}")


def packet(
    scores: DataFrame, edges: DataFrame, degree: DataFrame, texts: Callable[[DataFrame], DataFrame], request: int = 12_000, profile: str = "cloud"
) -> DataFrame:
    """``rank, context_type, id, score, cost, text``: the entries of a packet for one task within its budget.

    The best nodes with their whole text; for each, its first neighbours (callees before callers) condensed, score 1. A node that is
    an exact entry isn't repeated. Order: exact first, score, file, name, id. scores are current nodes with their score;
    ``texts`` gives ``id, language, raw_text`` of the few ids that it is given.
    """
    p = PROFILES[profile]
    best = checkpoint(candidates(scores, degree, p.exact))
    names = scores.select("id", "symbol_name", "file_path")
    exact = best.select("id", "score", F.lit(0).alias("_k"))
    ids = best.select(F.col("id").alias("pivot_id"))
    e = edges.filter("source_id <> target_id")
    near = (
        ids.join(e, F.col("pivot_id") == F.col("source_id")).select("pivot_id", F.col("target_id").alias("id"), F.lit(0).alias("_way"))
        .union(ids.join(e, F.col("pivot_id") == F.col("target_id")).select("pivot_id", "source_id", F.lit(1)))
        .groupBy("pivot_id", "id").agg(F.min("_way").alias("_way"))
        .join(names, "id")
    )
    w = Window.partitionBy("pivot_id").orderBy("_way", F.asc_nulls_last("symbol_name"), F.asc_nulls_last("file_path"), "id")
    near = near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= p.neighbours).select("id").distinct()
    near = near.join(exact.select("id"), "id", "left_anti").select("id", F.lit(1).cast("long").alias("score"), F.lit(1).alias("_k"))
    chosen = checkpoint(exact.union(near).join(names, "id"))
    every = chosen.join(texts(chosen.select("id")).select("id", "language", "raw_text"), "id")
    full = with_condensed(every.withColumn("full", F.col("raw_text")))
    text = F.when(F.col("_k") == 0, F.col("full")).otherwise(F.substring("condensed", 1, p.chars))
    cost = F.coalesce(tokens_up(text), F.lit(0)) + F.when(F.col("_k") == 0, EXACT_COST).otherwise(CONDENSED_COST)
    order = Window.orderBy("_k", F.desc("score"), F.asc_nulls_last("file_path"), F.asc_nulls_last("symbol_name"), "id")
    rows = full.select("id", "_k", "score", "file_path", "symbol_name", text.alias("text"), cost.cast("long").alias("cost")).withColumn("_o", F.row_number().over(order)).withColumn("_g", F.lit(0))
    kept = greedy(rows, "_g", "_o", "cost", entry_budget(request, p))
    return kept.select(
        F.row_number().over(Window.orderBy("_o")).cast("long").alias("rank"), F.when(F.col("_k") == 0, "exact_source").otherwise("condensed_source").alias("context_type"), "id", "score", "cost", "text"
    )


def freshness(files: DataFrame, seen: DataFrame, nodes: DataFrame) -> DataFrame:
    """``repo_id, status, stale, unavailable, fresh``: stored hashes against those seen; a file that isn't seen is unavailable. The
    status of a repository is stale before unavailable before fresh, missing without nodes."""
    f = files.groupBy("repo_id", "file_path").agg(F.max("content_hash").alias("old"))
    s = seen.groupBy("repo_id", "file_path").agg(F.max("content_hash").alias("new"), F.lit(True).alias("there"))
    j = f.join(s, ["repo_id", "file_path"], "left")
    kind = F.when(F.col("there").isNull() | F.col("new").isNull(), "unavailable").when(F.col("old").eqNullSafe(F.col("new")), "fresh").otherwise("stale")
    per = j.groupBy("repo_id").agg(*[F.count_if(kind == k).alias(k) for k in ("stale", "unavailable", "fresh")])
    have = nodes.select("repo_id").distinct().withColumn("has", F.lit(True))
    status = F.when(F.col("has").isNull(), "missing").when(F.col("stale") > 0, "stale").when(F.col("unavailable") > 0, "unavailable").otherwise("fresh")
    return per.join(have, "repo_id", "left").select("repo_id", status.alias("status"), "stale", "unavailable", "fresh")
