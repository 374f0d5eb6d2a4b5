"""Symbol resolution, symbol search with ranking, repository listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import ascii_lower, contains_folded, search_tokens
from skein.sources.tables import slash

# Parts of kinds that a listing shows; parameters of the ranking.
LISTED = ("function", "class", "struct", "trait", "interface", "method", "enum", "impl", "module", "type", "union", "macro")
K1, B = 1.2, 0.75
#: Parts of a repository that are cut to the limit on their own.
PARTS = 32


def resolve_symbols(asked: DataFrame, nodes: DataFrame, show: int = 20) -> DataFrame:
    """Candidates of each request ``ask_id, repo_id, symbol_name, file_path``: rows ``ask_id, position, matches, id, file_path``, at
    most ``show`` of them, by file, id; matches is their full number. A null file_path asks for any file; requests
    without candidates have no rows."""
    a = asked.select("ask_id", F.col("repo_id").alias("_r"), F.col("symbol_name").alias("_s"), slash("file_path").alias("_f"))
    n = nodes.select("id", "repo_id", "symbol_name", slash("file_path").alias("file_path"))
    j = a.join(n, (F.col("_r") == F.col("repo_id")) & (F.col("_s") == F.col("symbol_name")) & (F.col("_f").isNull() | (F.col("_f") == F.col("file_path"))))
    count = j.groupBy("ask_id").agg(F.count("*").alias("matches"))
    w = Window.partitionBy("ask_id").orderBy(F.asc_nulls_last("file_path"), "id")
    top = j.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= show)
    return top.join(count, "ask_id").select("ask_id", F.col("position").cast("long").alias("position"), "matches", "id", "file_path")


def find_symbols(nodes: DataFrame, query: str, kind: str | None = None, repo: str | None = None, limit: int = 50) -> DataFrame:
    """``rank, id, symbol_name, file_path, score`` of the symbols whose name has, for each alphanumeric part of the query, a
    token that starts with it; the best first (Okapi BM25 over the names of all repositories), then by name, file, id.

    A query without alphanumeric parts is looked for as it is anywhere in the names, the shortest first. ``limit`` rows
    and one more are returned, so that a caller sees whether there are more.
    """
    terms = [t for t in "".join(c.lower() if c.isalnum() else " " for c in query).split() if t]
    base = nodes.filter(F.col("symbol_name").isNotNull())
    keep = F.lit(True)
    if kind:
        keep = keep & contains_folded(F.col("symbol_type"), kind)
    if repo:
        keep = keep & (F.col("repo_id") == repo)
    last = [F.asc("symbol_name"), F.asc_nulls_last("file_path"), F.asc("id")]
    if not terms:
        hits = base.filter(contains_folded(F.col("symbol_name"), query) & keep).withColumn("score", F.lit(0.0))
        order = [F.length("symbol_name"), *last]
    else:
        toks = base.withColumn("_t", search_tokens(F.col("symbol_name")))
        begins = lambda t: F.size(F.filter("_t", lambda x: x.startswith(t)))
        tf = [begins(t) for t in terms]
        stats = toks.agg(F.count("*").alias("_n"), F.avg(F.size("_t")).alias("_avg"), *[F.count_if(c > 0).alias(f"_d{i}") for i, c in enumerate(tf)])
        m = toks.filter(keep)
        for c in tf:
            m = m.filter(c > 0)
        m = m.crossJoin(F.broadcast(stats))  # one row
        score = F.lit(0.0)
        for i, c in enumerate(tf):
            idf = F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5) + 1)
            score = score + idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.size("_t") / F.col("_avg")))
        hits = m.withColumn("score", score)
        order = [F.desc(F.round("score", 9)), *last]
    top = hits.orderBy(*order).limit(limit + 1)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", "id", "symbol_name", "file_path", F.round("score", 6).alias("score"))


def listing(nodes: DataFrame, limit: int = 2000) -> DataFrame:
    """``repo_id, position, file_path, symbol_name, symbol_type, start_line``: the first ``limit`` symbols of shown kinds of each
    repository by file and place. The limit is taken of parts of a repository first, so that no task sorts a whole one."""
    order = [F.asc_nulls_last("file_path"), F.asc_nulls_last("source_start_byte"), F.asc("id")]
    w = Window.partitionBy("repo_id").orderBy(*order)
    shown = nodes.filter(F.regexp_like(F.col("symbol_type"), F.lit("(?i)" + "|".join(LISTED)))).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    shown = shown.withColumn("_n", F.row_number().over(Window.partitionBy("repo_id", "_part").orderBy(*order))).filter(F.col("_n") <= limit)
    return shown.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit).select(
        "repo_id", F.col("position").cast("long").alias("position"), "file_path", "symbol_name", "symbol_type", "start_line"
    )


def within_directory(nodes: DataFrame, directory: str) -> DataFrame:
    """Rows of a file or below a directory; wildcards are taken as they are, siblings with a common beginning are left out.
    Empty, ``.`` and ``./`` mean everything."""
    d = directory.replace("\\", "/").removeprefix("./").rstrip("/")
    if d in ("", "."):
        return nodes
    p = slash("file_path")
    return nodes.filter((p == d) | p.startswith(d + "/"))


def pick_symbols(nodes: DataFrame, part: str, repo: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols of which the name or the path holds ``part``, by name without regard to case, file, id; one more than the limit."""
    hit = contains_folded(F.col("symbol_name"), part) | contains_folded(slash("file_path"), part)
    df = nodes.filter(hit & (F.col("repo_id") == repo if repo else F.lit(True)))
    return df.orderBy(ascii_lower(F.col("symbol_name")), "file_path", "id").select("id", "symbol_name", "file_path").limit(limit + 1)
