"""The table function from files to symbols."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.extract import braces, python_source, ruby
from skein.extract.languages import EXTENSIONS, FILE_LIMIT, Symbol, capped

SYMBOLS = (
    "id string, repo_id string, file_path string, language string, symbol_name string, symbol_type string, raw_text string, "
    "source_start_byte long, source_end_byte long, start_line long, start_column long, end_line long, end_column long, callees array<string>"
)


def parse(text: str, ext: str) -> list[Symbol]:
    if ext == "py":
        return python_source.symbols(text)
    if ext == "rb":
        return ruby.symbols(text)
    return braces.symbols(text, ext) if ext in EXTENSIONS else []


def node_id(repo: str, path: str, kind: str, name: str, start: int) -> str:
    return f"{repo}:{path}:{kind}:{name}:{start}"


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files ``repo_id, file_path, content`` (string): one row per symbol with its span, text and callees.

    Files larger than FILE_LIMIT, without content, or of other languages have none. A symbol's text is cut
    at the body limit. Columns and lines count from 1.
    """

    def run(batches):
        for b in batches:
            rows = []
            for repo, path, text in zip(*(b.column(c).to_pylist() for c in ("repo_id", "file_path", "content"))):
                if text is None or path is None:
                    continue
                data = text.encode()
                ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
                if len(data) > FILE_LIMIT or ext not in EXTENSIONS:
                    continue
                for s in parse(text, ext):
                    head, body = data[: s.start], data[s.start : s.end]
                    line = head.count(b"\n") + 1
                    column = s.start - (head.rfind(b"\n") + 1) + 1
                    last = line + body.count(b"\n")
                    end_column = s.end - (data.rfind(b"\n", 0, s.end) + 1) + 1
                    rows.append(
                        (node_id(repo, path, s.kind, s.name, s.start), repo, path, ext, s.name, s.kind, capped(body.decode("utf-8", "replace")), s.start, s.end, line, column, last, end_column, s.callees)
                    )
            names = [x.split()[0] for x in SYMBOLS.split(", ")]
            cols = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.list_(pa.string()) if n == "callees" else pa.int64() if n.startswith(("source_", "start_", "end_")) else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return files.select("repo_id", "file_path", "content").mapInArrow(run, SYMBOLS)


def callee_rows(symbols: DataFrame) -> DataFrame:
    """``source_id, repo_id, file_path, callee``: one row per symbol and distinct callee."""
    return symbols.select(F.col("id").alias("source_id"), "repo_id", "file_path", F.explode(F.array_distinct("callees")).alias("callee"))


def with_called_names(nodes: DataFrame) -> DataFrame:
    """nodes with ``callees`` from stored texts, by expression: distinct names before an opening bracket."""
    return nodes.withColumn("callees", F.array_distinct(F.regexp_extract_all("raw_text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)))
