"""Names that a file imports, line by line, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.extract.languages import C_FAMILY


def file_imports(files: DataFrame) -> DataFrame:
    """``repo_id, file_path, import_name`` (distinct) of files ``repo_id, file_path, language, content``.

    Python: the names after ``from ... import``, and the last part of ``import a.b``; TypeScript: the names in braces of
    an import on one line; C family: the stem of a quoted include. Rust and Ruby have none.
    """
    line = files.select("repo_id", "file_path", "language", F.explode(F.split("content", r"\r?\n")).alias("line"))
    drop_as = lambda x: F.trim(F.regexp_replace(x, r"(^\s*type\s+)|(\s+as\s+.*$)", ""))
    names = lambda part: F.transform(F.split(part, ","), drop_as)
    py = F.col("language") == "py"
    ts = F.col("language").isin("ts", "tsx")
    c = F.col("language").isin(*C_FAMILY)
    froms = F.regexp_extract("line", r"^\s*from\s+[\w.]+\s+import\s+\(?([^#()]*)", 1)
    plain = F.regexp_extract("line", r"^\s*import\s+([\w., ]+?)\s*(?:#.*)?$", 1)
    braces = F.regexp_extract("line", r"^\s*import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}\s*from\b", 1)
    include = F.regexp_extract("line", r"^\s*#\s*include\s+\"(?:[^\"]*/)?([^\"/]+?)(?:\.[A-Za-z+]+)?\"", 1)
    found = (
        F.when(py & (froms != ""), names(froms))
        .when(py & (plain != ""), F.transform(names(plain), lambda x: F.element_at(F.split(x, r"\."), -1)))
        .when(ts & (braces != ""), names(braces))
        .when(c & (include != ""), F.array(include))
    )
    out = line.select("repo_id", "file_path", F.explode(found).alias("import_name"))
    return out.filter("import_name <> '' AND import_name <> '*'").distinct()
