"""Source trees as tables: discovery, exclusions, languages, size cap."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.extract.languages import EXTENSIONS, FILE_LIMIT

CONFIG = ".skein.json"

# Directories that are passed over by default; names, endings and extensions that are never parsed.
DEFAULT_IGNORE = ["node_modules", "target", "dist", ".git", "worktrees", ".worktrees"]
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock"]
SECRETS = [".env", "id_rsa", "secrets.yml"]
ENDINGS = [".min.js", ".tar.gz"]
BLOCKED = ["pem", "key", "pkcs12", "pfx", "map", "pdf", "png", "jpg", "jpeg", "gif", "webp", "zip", "gz", "tar", "sqlite", "db"]


def ignored_names(root: str) -> list[str]:
    """Directory names that the tree's configuration excludes. A missing or broken file means the defaults; a file
    without the list excludes nothing."""
    try:
        with open(os.path.join(root, CONFIG), encoding="utf-8") as f:
            given = json.load(f)
    except (OSError, ValueError):
        return list(DEFAULT_IGNORE)
    names = given.get("ignore") if isinstance(given, dict) else None
    return [x for x in names if isinstance(x, str)] if isinstance(names, list) else []


def gitignore_rules(root: str) -> list[tuple[str, bool]]:
    """Regular expressions over relative paths, directories ending in ``/``, and whether a match is taken back in. Of all
    .gitignore files of the tree, the deepest first and of each the last line first, so that the first match decides."""
    root = root.removeprefix("file://").removeprefix("file:")
    out = []
    for at, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        if ".gitignore" not in files:
            continue
        try:
            with open(os.path.join(at, ".gitignore"), encoding="utf-8-sig", errors="replace") as f:
                lines = f.read().split("\n")
        except OSError:
            continue
        below = os.path.relpath(at, root).replace(os.sep, "/")
        below = "" if below == "." else below + "/"
        rules = [r for r in (_to_regex(x, below) for x in lines) if r]
        out.append((-below.count("/"), below, rules[::-1]))
    return [r for _, _, rules in sorted(out, key=lambda x: x[:2]) for r in rules]


def _to_regex(line: str, below: str) -> tuple[str, bool] | None:
    """A line of the .gitignore file of the directory ``below``; None for one that is no pattern."""
    line = line.removesuffix("\r")
    bare = line.rstrip(" \t")
    if len(bare) < len(line) and bare.endswith("\\"):
        bare += " "
    if not bare or bare.startswith("#"):
        return None
    negated = bare.startswith("!")
    p = bare[1:] if negated else bare
    folder = p.endswith("/")
    p = p.removesuffix("/")
    free = "/" not in p
    p = p.removeprefix("/")
    if not p:
        return None
    body, i = "(?:.*/)?" if free else "", 0
    while i < len(p):
        c = p[i]
        start = i == 0 or p[i - 1] == "/"
        if start and p.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif start and p[i:] == "**":
            body, i = body + ".+", i + 2
        elif c == "*":
            body, i = body + "[^/]*", i + 1
        elif c == "?":
            body, i = body + "[^/]", i + 1
        elif c == "[":
            m = re.match(r"\[([!^]?)(\]?(?:\\.|[^\]\\])*)\]", p[i:])
            if not m or not m[2]:
                return None
            inner = re.sub(r"\\(.)|([\[\]^&])", lambda x: "\\" + (x[1] or x[2]) if not (x[1] or "").isalnum() else x[1], m[2])
            body, i = body + "(?!/)[" + "^" * bool(m[1]) + inner + "]", i + m.end()
        else:
            if c == "\\":
                i += 1
                if i == len(p):
                    return None
            body, i = body + re.escape(p[i]), i + 1
    return "(?s)^" + re.escape(below) + body + r"(?<!/)" + ("/" if folder else "/?") + r"\z", negated


def gitignored(path, rules: list[tuple[str, bool]]) -> F.Column:
    """Whether a file or a directory above it is excluded; what lies in an excluded directory can't be taken back in."""
    parts = F.split(path, "/")
    n = F.size(parts)
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < n, "/").otherwise("")))

    def excluded(p):
        out = None
        for regex, negated in rules:
            hit, value = F.regexp_like(p, F.lit(regex)), F.lit(not negated)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(False)

    return F.exists(steps, excluded)


def extension(path) -> F.Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.when(F.instr(name, ".") > 1, F.element_at(F.split(name, r"\."), -1)).otherwise(""))


def safe_to_parse(path) -> F.Column:
    """Neither a lockfile, nor a secret, nor of an excluded kind."""
    name = F.element_at(F.split(path, "/"), -1)
    ok = ~name.isin(*LOCKFILES, *SECRETS) & ~extension(path).isin(*BLOCKED)
    for e in ENDINGS:
        ok = ok & ~name.endswith(e)
    return ok


def supported(path) -> F.Column:
    return extension(path).isin(*EXTENSIONS)


def scan_tree(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """``repo_id, file_path, language, size, mtime_ns, content`` of the files of a tree that may be parsed.

    Hidden and ignored directories are passed over; content is null above the size cap, so such a file has a
    row but no symbols. Unreadable files are left out.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    )
    base = "file:" + os.path.abspath(root) if "://" not in root and not root.startswith("file:") else root
    path = F.replace("path", F.lit(base.rstrip("/") + "/"), F.lit(""))
    df = raw.withColumn("file_path", path)
    dirs = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    keep = safe_to_parse(F.col("file_path")) & supported(F.col("file_path")) & ~F.exists(dirs, lambda d: d.startswith(".")) & ~F.element_at(F.split("file_path", "/"), -1).startswith(".")
    if names := ignored_names(root):
        keep = keep & ~F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in names]))
    if rules := gitignore_rules(root):
        keep = keep & ~gitignored(F.col("file_path"), rules)
    text = F.when(F.col("length") <= FILE_LIMIT, F.decode("content", "UTF-8"))
    return df.filter(keep).select(
        F.lit(repo_id).alias("repo_id"), "file_path", extension(F.col("file_path")).alias("language"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), text.alias("content"),
    )
