"""Text, Markdown and JSON out of bounded results; the only place that collects rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from skein.functions.text import prefix_bytes

RESPONSE_BYTES = 32_000


def _rows(df: DataFrame) -> Iterator[dict]:
    """Every row, a partition at a time; df is a result that its query bounds (top-k, cap per pivot)."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def to_json(df: DataFrame) -> str:
    return json.dumps(list(_rows(df)), ensure_ascii=False, indent=2, default=str)


def to_markdown(df: DataFrame) -> str:
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in _rows(df)])


def to_text(df: DataFrame, limit: int = RESPONSE_BYTES) -> str:
    """One line a row, cut at a byte budget with a remark; rows are read until the budget is used."""
    lines, size = [], 0
    for r in _rows(df):
        lines.append("\t".join("" if v is None else str(v) for v in r.values()))
        size += len(lines[-1].encode()) + 1
        if size > limit + 1:
            return prefix_bytes("\n".join(lines), limit) + "\n[truncated]"
    return "\n".join(lines)


def tree(df: DataFrame) -> str:
    """A dependency graph as indented lines; links to nodes seen before are marked."""
    rows = sorted(_rows(df), key=lambda r: r["position"])
    seen = lambda r: " (seen before)" if r.get("already_seen") else ""
    return "\n".join(f"{'  ' * r['depth']}{r['direction']}: {r['id']} ({r['kind']}){seen(r)}" for r in rows)
