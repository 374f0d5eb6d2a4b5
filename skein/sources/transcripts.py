"""Session transcripts: folders of JSON-lines files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """``session, line_no, value`` of every line of the .jsonl files below a folder. The session is the file's name without its
    ending; lines of a file in a folder ``subagents`` belong to the session that the folder lies in. line_no orders the lines of a
    file: it isn't consecutive."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    own = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    session = F.when(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")) == "subagents", F.try_element_at(parts, F.lit(-3))).otherwise(own)
    # a file's blocks in order, and in a block the order of reading
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return lines.select(session.alias("session"), place.alias("line_no"), "value")
