"""Queries of the problems on training text over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import docs, packing, quality, sources, spans, splitting, tokens
from skein.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.node_pairs(*spans.shared_spans(table(spark, sf, "nodes")))


def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return spans.coverage(*spans.shared_spans(table(spark, sf, "nodes")))


def p3_files(spark: SparkSession, sf: str) -> DataFrame:
    return sources.classify(table(spark, sf, "nodes")).withColumnRenamed("path", "file_path")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_files(spark, sf).filter("NOT by_hand").select("repo_id", "file_path")


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docs.pairs(table(spark, sf, "nodes"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pairs(spark, sf).filter("id = source_id").select("id")


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_nodes(table(spark, sf, "nodes"))


def p7_whole(spark: SparkSession, sf: str) -> DataFrame:
    r = splitting.reassembled(p7_pieces(spark, sf))
    return r.select("id", "digest", F.greatest(F.col("largest") - splitting.LIMIT, F.lit(0)).alias("bytes_over"), (F.col("pieces") >= 2).alias("cut"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pieces(spark, sf).filter("piece = 1").select("id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    docs_ = table(spark, sf, "documents")
    return packing.pack(tokens.token_counts(docs_), docs_.count())


def p9_placed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.placement(p9_containers(spark, sf))


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, sf))


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.statistics(table(spark, sf, "documents")).drop("_text")


def p10_rules(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([quality.learn(table(spark, sf, "documents"))])


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).filter("junk").select("doc_id")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_coverage, p3_found, p3_files, p4_found, p4_pairs, p7_found, p7_pieces, p7_whole, p8_ids, p8_round_trip, p9_containers, p9_placed, p9_fill, p10_found, p10_statistics, p10_rules,
)}

#: White space as in Unicode's White_Space, for patterns and for trimming.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LONG = """FROM (SELECT id, raw_text, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST,
    CASE WHEN strlen(raw_text) > 6000 THEN raw_text END DESC NULLS LAST) AS k FROM nodes WHERE id IS NOT NULL)
WHERE k = 1 AND strlen(raw_text) > 6000"""

#: Every run of 300 characters of the newest texts by its hash, those that texts of several repositories hold.
_SPANS = """WITH n AS (SELECT id, repo_id, raw_text, length(raw_text) AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, repo_id DESC NULLS LAST,
    CASE WHEN length(raw_text) >= 300 THEN md5(raw_text) END DESC NULLS LAST) AS k FROM nodes WHERE id IS NOT NULL)
  WHERE k = 1 AND repo_id IS NOT NULL AND length(raw_text) >= 300),
w AS (SELECT id, repo_id, i, md5_number(substring(raw_text, i, 300)) AS h FROM (SELECT *, unnest(range(1, chars - 298)) AS i FROM n)),
s AS (SELECT * FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING min(repo_id) < max(repo_id)) m USING (h)),
pairs AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM (SELECT DISTINCT id, repo_id, h FROM s) a JOIN (SELECT DISTINCT id, repo_id, h FROM s) b USING (h)
  WHERE a.repo_id <> b.repo_id AND a.id < b.id)
"""

SQL = {
    "p1_found": _SPANS + "SELECT * FROM pairs",
    "p1_coverage": _SPANS
    + """, c AS (SELECT id, CAST(sum(least(300, i - before)) AS BIGINT) AS shared_chars FROM (
  SELECT id, i, coalesce(lag(i) OVER (PARTITION BY id ORDER BY i), i - 300) AS before FROM s) GROUP BY 1),
p AS (SELECT id, CAST(count(*) AS BIGINT) AS partners FROM (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs) GROUP BY 1)
SELECT id, coalesce(partners, 0) AS partners, shared_chars, CAST(chars AS INTEGER) AS chars FROM c JOIN n USING (id) LEFT JOIN p USING (id)""",
    "p9_placed": """SELECT doc_id, CAST(0 AS BIGINT) AS missing_parts, CAST(0 AS BIGINT) AS tokens_over, TRUE AS whole_if_it_fits FROM documents WHERE text <> ''""",
    "p7_found": f"SELECT id {_LONG}",
    "p7_whole": f"SELECT id, md5(raw_text) AS digest, CAST(0 AS BIGINT) AS bytes_over, TRUE AS cut {_LONG}",
    "p10_statistics": f"""WITH t AS (SELECT doc_id, text, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, list_filter(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda x: trim(x, {_quoted(quality.BLANK)}) <> '') AS l,
  length(regexp_replace(t, '[{_SPACE}]+', '', 'g')) AS n, len(list_filter(regexp_split_to_array(t, '[{_SPACE}]+'), lambda x: x <> '')) AS w FROM t)
SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(w AS INTEGER) AS words, CAST(len(l) AS INTEGER) AS lines, CASE WHEN w > 0 THEN n / w END AS mean_word_length,
  CASE WHEN n > 0 THEN length(regexp_replace(t, '[\\p{{L}}\\p{{N}}{_SPACE}]+', '', 'g')) / n END AS symbol_share,
  CASE WHEN n > 0 THEN length(regexp_replace(t, '[^0-9]+', '', 'g')) / n END AS digit_share,
  CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: contains({_quoted(quality.ENDS)}, right(rtrim(x, {_quoted(quality.BLANK + quality.AFTER_END)}), 1)) AND rtrim(x, {_quoted(quality.BLANK + quality.AFTER_END)}) <> '')) / len(l) END AS punct_line_share,
  CASE WHEN w > 0 THEN len(list_filter(regexp_split_to_array(lower(t), '[''’{_SPACE}]+'), lambda x: trim(x, {_quoted(quality.AROUND)}) IN ({", ".join(map(_quoted, sorted(quality._COMMON)))}))) / w END AS common_share,
  CASE WHEN len(l) > 0 THEN w / len(l) END AS mean_line_words FROM l""",
    "p8_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
