"""Command line: ``python -m skein list``, ``run QUERY DIR``, ``ask DIR INTENT``, ``audit DIR``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from skein import render
from skein.api import Pipeline, Query
from skein.operators import audit
from skein.plans import graph_queries, problem_queries
from skein.sources.transcripts import read_transcripts

QUERIES = problem_queries.QUERIES | graph_queries.QUERIES
FORMATS = {"text": render.to_text, "json": render.to_json, "markdown": render.to_markdown}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    what = p.add_subparsers(dest="what", required=True)
    what.add_parser("list", help="names of the queries")
    run = what.add_parser("run", help="a query over a folder of tables, to the screen or as Parquet")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("dir")
    run.add_argument("--out", help="folder to write instead of printing; for results of any size")
    ask = what.add_parser("ask", help="a structural question over a folder of tables")
    ask.add_argument("dir")
    ask.add_argument("intent")
    for name in ("repo-id", "target", "filepath", "kind"):
        ask.add_argument(f"--{name}")
    ask.add_argument("--direction", default="both")
    for name, value in (("depth", None), ("limit", 50), ("max-nodes", 200)):
        ask.add_argument(f"--{name}", type=int, default=value)
    look = what.add_parser("audit", help="usage in a folder of transcripts, or the comparison of two sessions")
    look.add_argument("dir")
    look.add_argument("--by", choices=("session", "model", "tool"), default="session")
    look.add_argument("--compare", nargs=2, metavar="SESSION")
    for sub in (run, ask, look):
        sub.add_argument("--format", choices=sorted(FORMATS), default="text")
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.what == "run":
        return QUERIES[a.query](spark, a.dir)
    if a.what == "ask":
        nodes, edges = graph_queries.graph_tables(spark, a.dir)
        query = Query(a.intent, a.repo_id, a.target, a.filepath, a.depth, a.direction, a.kind, a.limit, a.max_nodes)
        return Pipeline(nodes, edges, graph_queries.texts_of(spark, a.dir)).run(query)
    lines = audit.read_lines(read_transcripts(spark, a.dir))
    reqs = audit.requests(lines)
    if a.compare:
        return audit.compare(reqs, audit.tool_calls(reqs, lines), *a.compare).orderBy("metric")
    if a.by == "tool":
        return audit.by_tool(audit.tool_calls(reqs, lines)).orderBy("session", "tool")
    return audit.by_model(reqs).orderBy("session", "model") if a.by == "model" else audit.by_session(reqs).orderBy("session")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.what == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    try:
        df = result(spark, a)
    except (LookupError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if getattr(a, "out", None):
        df.write.parquet(a.out)
    else:
        print(FORMATS[a.format](df))
    return 0


if __name__ == "__main__":
    sys.exit(main())
