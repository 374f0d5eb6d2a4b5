"""Notes about symbols: saving them, reading them back, and marking those of changed symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import with_fnv
from skein.sources.tables import slash


def hashed(nodes: DataFrame) -> DataFrame:
    """nodes with ``content_hash``, the FNV-1a hash of each text (null of null), in place of the text."""
    return with_fnv(nodes, "raw_text", "content_hash")


def save_observations(new: DataFrame, hashes: DataFrame) -> DataFrame:
    """Notes ``id, repo_id, symbol_name, filepath, observation_text, timestamp`` about existing symbols, with the hash of the symbol
    (of several of that name in the file, of the one with the least id) and not stale. Others are refused: left out."""
    h = hashes.filter("symbol_name IS NOT NULL").groupBy("repo_id", "file_path", "symbol_name").agg(F.min_by("content_hash", "id").alias("last_known_hash"))
    n = new.withColumn("file_path", slash("filepath"))
    return n.join(h, ["repo_id", "file_path", "symbol_name"]).select(
        "id", "repo_id", "symbol_name", F.col("file_path").alias("filepath"), "observation_text", "timestamp", "last_known_hash", F.lit(False).alias("is_stale")
    )


def mark_stale(observations: DataFrame, hashes: DataFrame, files: DataFrame) -> DataFrame:
    """Observations (repeated rows once) with ``is_stale`` brought up to date: stale stays stale; a note becomes stale where a symbol of its name
    in its file has another hash, or where its file is gone. A symbol gone from a file that is still there changes nothing."""
    o = observations.select("id", "repo_id", "symbol_name", slash("filepath").alias("file_path"), "last_known_hash", F.coalesce("is_stale", F.lit(False)).alias("is_stale")).distinct()
    h = hashes.filter("symbol_name IS NOT NULL AND content_hash IS NOT NULL").groupBy("repo_id", "file_path", "symbol_name").agg(F.min("content_hash").alias("_lo"), F.max("content_hash").alias("_hi"))
    f = files.select("repo_id", slash("file_path").alias("file_path"), F.lit(True).alias("_there")).distinct()
    j = o.join(h, ["repo_id", "file_path", "symbol_name"], "left").join(f, ["repo_id", "file_path"], "left")
    changed = F.coalesce((F.col("_lo") != F.col("last_known_hash")) | (F.col("_hi") != F.col("last_known_hash")), F.lit(False))
    return j.select("id", "repo_id", "symbol_name", "file_path", (F.col("is_stale") | changed | F.col("_there").isNull()).alias("is_stale"))


def session_context(observations: DataFrame, repo: str | None = None, symbol: str | None = None, path: str | None = None) -> DataFrame:
    """Notes by any combination of repository, symbol and file, at least one of them, newest first; stale ones say so."""
    if repo is None and symbol is None and path is None:
        raise ValueError("give a repository, a symbol or a file")
    df = observations.withColumn("filepath", slash("filepath")).distinct()
    for col, want in (("repo_id", repo), ("symbol_name", symbol), ("filepath", path.replace("\\", "/") if path else None)):
        if want is not None:
            df = df.filter(F.col(col) == want)
    text = F.concat(F.when(F.coalesce("is_stale", F.lit(False)), F.lit("[stale] ")).otherwise(F.lit("")), "observation_text")
    return df.select("id", "repo_id", "symbol_name", "filepath", text.alias("note"), "timestamp").orderBy(F.desc_nulls_last("timestamp"), F.desc("id"))
