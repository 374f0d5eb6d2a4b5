"""Bodies condensed to a mark, and signature lines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.extract import braces, python_source
from skein.extract.languages import C_FAMILY


def condense(text: str | None, language: str | None) -> str | None:
    """The text with its outermost body replaced: ``{ /* ... */ }`` in braces, ``pass`` in Python, ``# ...`` in Ruby.
    Unchanged for other languages, and where there is no body."""
    if text is None:
        return None
    if language == "py":
        span = python_source.body_of(text)
        if not span:
            return text
        data = text.encode()
        return (data[: span[0]] + b"pass" + data[span[1] :]).decode("utf-8", "replace")
    if language == "rb":
        m = re.search(r"^[ \t]*(?:private\s+|protected\s+|public\s+)?(?:def|class|module)\b[^\n]*\n", text, re.M)
        last = re.search(r"^[ \t]*end\s*\Z", text, re.M)
        if not m or not last or last.start() <= m.end():
            return text
        pad = re.match(r"[ \t]*", text[m.end() :])[0]
        return f"{text[: m.end()]}{pad}# ...\n{text[last.start() :]}"
    if language in C_FAMILY or language in ("ts", "tsx", "rs"):
        code = braces.blank(text, language == "rs")
        at = code.find("{")
        if at < 0:
            return text
        return text[:at] + "{ /* ... */ }" + text[braces._match(code, at) :]
    return text


def with_condensed(nodes: DataFrame, text: str = "raw_text", language: str = "language", to: str = "condensed") -> DataFrame:
    """nodes with the condensed text in place of the text."""
    keep = [c for c in nodes.columns if c != text]

    def run(batches):
        for b in batches:
            out = [condense(t, g) for t, g in zip(b.column(text).to_pylist(), b.column(language).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, to])

    fields = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in keep)
    return nodes.select(*keep, text).mapInArrow(run, f"{fields}, `{to}` string")


def signature(condensed: Column, name: Column) -> Column:
    """The first line that isn't blank, else the name."""
    lines = F.filter(F.split(condensed, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(F.trim(F.get(lines, F.lit(0))), name)
