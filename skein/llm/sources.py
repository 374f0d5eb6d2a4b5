"""Files that were not written by hand in their repository (problem 3).

Random forests learn from compression ratio, token entropy, identifier lengths, comment
density and the like. The labels are notices that the features don't see: for generated files header
comments that name a generator, and the names by which projects mark such files (minified files and data bear no
notice); for copies of third-party code the notice above the first symbol. Copies look like any code, so their
forest also sees how much of a file other repositories hold word for word, and whether it lies in a place for such code. Not
every file of either kind bears a notice, so what a forest learns is the chance of one; files of the
kind have a high chance, others almost none, and the threshold lies far below one half (learning from
positive and unlabelled files).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import checkpoint, newest, slash

#: Files that a forest learns from (those of the smallest hashes), its trees, the chance of a notice from which a file counts as
#: generated, and as a copy in multiples of the share of files that bear one.
SAMPLE, TREES, CHANCE, COPY_LIFT = 20_000, 30, 0.2, 1.2
#: The fewest notices of copies that a forest can learn from; with fewer, files count as copies in a place for such code and from this share
#: of characters that other repositories hold.
LEAST, COPIED = 10, 0.5

# Notices of generators, of copies, and names of places.
_GENERATED = re.compile(
    r"\bauto-?generated\b|<auto-generated|@generated\b|\bgenerated (?:by|from|with|using|code|file|automatically)\b|\bautomatically generated\b|\bdo not (?:edit|modify)\b|"
    r"\bmachine[- ]made\b|\bmachine[- ]generated\b|hand edits|\bautomatisch (?:erzeugt|generiert)\b|nicht von Hand|\bgénéré (?:par|automatiquement)|\bgenerado (?:por|automáticamente)|changes will be lost",
    re.I,
)
_COPIED = re.compile(
    r"\b[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\b[^\n]*(?:https?://|distributed under|licen[cs]e)|bundled copy|vendored (?:copy|from|in)\b|do not patch locally|copied (?:verbatim )?from|third[- ]party (?:code|copy|library)",
    re.I,
)
_MARKED = (
    r"(?i)(^|/)(_{0,2}generated_{0,2}|gen|autogen|dist|packed|minified|static|public|assets|tables|fixtures|codegen/out|target/(debug|release)/build)/"
    r"|(_pb2?|\.pb|\.gen|\.g|_generated|\.generated|\.tab|_bindings|\.min|[.-]bundle|_data)\.\w+$|(^|/)db/schema"
)
PLACES = r"(?i)(^|/)(vendor|vendored|third[_-]?party|3rd[_-]?party|externals?|subprojects|deps|node_modules|bower_components|site-packages|dist-packages|pods|carthage)/"

_TOKENS = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|[^\s\w]")
_LEAD = re.compile(r"\s*((?:/\*.*?\*/\s*|//[^\n]*\n\s*|#(?!\[)[^\n]*\n\s*)+)", re.S)
_PYDOC = re.compile(r"(?:@[^\n]*\n\s*)*(?:class|def|async def)\b[^\n]*:\s*\n\s*[rRuU]?(\"\"\"|''')(.*?)\1", re.S)
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_COMMENTS = re.compile(r"/\*.*?\*/|//[^\n]*|(?m:^\s*#[^\n]*)|\"\"\".*?\"\"\"", re.S)

_SUMS = ["bytes", "packed", "lines", "long_chars", "tokens", "bits", "names", "name_chars", "short_names", "hex_names", "numbers", "comment_chars", "short_bodies", "bodies", "nodes", "body_chars", "long_body_chars", "quoted_chars"]
FEATURES = [
    "compression_ratio", "token_entropy", "mean_name_length", "short_name_share", "hex_name_share", "comment_density", "number_share",
    "long_line_share", "mean_line_length", "short_body_share", "long_body_share", "quoted_share", "tokens_per_node",
]
COPY_FEATURES = [*FEATURES, "copied_share", "in_place"]


def notice_text(text: str) -> str:
    """The comments above a symbol, or the docstring below its header."""
    m = _LEAD.match(text)
    d = _PYDOC.match(text, m.end() if m else 0)
    return (m[1] if m else "") + (d[2] if d else "")


def without_notice(text: str) -> str:
    """The text without the comments or docstring that ``notice_text`` reads."""
    m = _LEAD.match(text)
    at = m.end() if m else 0
    d = _PYDOC.match(text, at)
    return text[at : d.start(1)] + text[d.end(2) + 3 :] if d else text[at:]


def measure(text: str, function: bool) -> list[float]:
    data = text.encode("utf-8", "replace")
    toks = _TOKENS.findall(text)
    n = len(toks)
    counts = Counter(toks)
    bits = n * log2(n) - sum(c * log2(c) for c in counts.values()) if n else 0.0
    names = name_chars = short = hexes = numbers = 0
    for t, c in counts.items():
        if t[0].isalpha() or t[0] == "_":
            names += c
            name_chars += c * len(t)
            short += c * (len(t) <= 2)
            hexes += c * t.startswith("_0x")
        elif t[0].isdigit():
            numbers += c
    lines = text.split("\n")
    long_ = sum(len(x) for x in lines if len(x) > 300)
    comments = sum(len(m.group()) for m in _COMMENTS.finditer(text)) if ("/" in text or "#" in text or '"""' in text) else 0
    return [
        len(data), len(zlib.compress(data, 3)), len(lines), long_, n, bits, names, name_chars, short, hexes, numbers, comments,
        float(function and len(text) < 130), float(function), 1.0, float(len(text) * function), float(len(text) * (function and len(text) >= 130)),
        float(sum(map(len, _QUOTED.findall(text)))),
    ]


_COLS = ["id", "ingested_at", "repo_id", "path", "start"]


def _measured(batches):
    for b in batches:
        rows, gen, cop, dig = [], [], [], []
        for text, kind in zip(b.column("raw_text").to_pylist(), b.column("symbol_type").to_pylist()):
            if text is None:
                rows.append([0.0] * len(_SUMS))
                gen.append(False)
                cop.append(False)
                continue
            said = notice_text(text)
            gen.append(bool(_GENERATED.search(said)))
            cop.append(bool(_COPIED.search(said)))
            # the features don't see the notice
            rows.append(measure(without_notice(text) if gen[-1] or cop[-1] else text, (kind or "").lower() in ("function", "method")))
        cols = list(zip(*rows)) or [()] * len(_SUMS)
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in _COLS], b.column("digest"), *[pa.array(c, pa.float64()) for c in cols], pa.array(gen, pa.bool_()), pa.array(cop, pa.bool_())],
            names=[*_COLS, "digest", *_SUMS, "gen", "cop"],
        )


def measured_nodes(nodes: DataFrame) -> DataFrame:
    """Newest rows with the sums of their features; texts are measured before the shuffle, which carries none."""
    src = nodes.filter(F.col("id").isNotNull() & F.col("file_path").isNotNull() & F.col("repo_id").isNotNull()).select(
        "id", "ingested_at", "repo_id", slash("file_path").alias("path"), F.col("source_start_byte").alias("start"), "symbol_type", "raw_text",
        F.md5(F.replace("raw_text", F.lit("\r"), F.lit(""))).alias("digest"),
    )
    kind = src.schema["ingested_at"].dataType.simpleString()
    schema = f"id string, ingested_at {kind}, repo_id string, path string, start long, digest string, " + ", ".join(f"{c} double" for c in _SUMS) + ", gen boolean, cop boolean"
    return newest(src.mapInArrow(_measured, schema), "id", "ingested_at", ["repo_id", "path", "start", "digest", *_SUMS, "gen", "cop"])


def files(nodes: DataFrame) -> DataFrame:
    """One row per file: ``repo_id, path``, the features, and the labels ``notice`` and ``copy_notice``.

    Rows without id, repository or path belong to no file; null texts count as empty; repeated rows count once.
    """
    m = checkpoint(measured_nodes(nodes))
    twice = m.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("repo_id").alias("a"), F.max("repo_id").alias("b")).filter("a < b").select("digest", F.lit(True).alias("twice"))
    per = (
        m.join(twice, "digest", "left")
        .groupBy("repo_id", "path")
        .agg(
            *[F.sum(c).alias(c) for c in _SUMS], F.max("gen").alias("gen"), F.min_by("cop", F.coalesce("start", F.lit(0))).alias("cop"),
            F.sum(F.when(F.col("twice"), F.col("bytes")).otherwise(0)).alias("copied"),
        )
    )
    per_ = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return per.select(
        "repo_id", "path",
        per_("packed", "bytes").alias("compression_ratio"), per_("bits", "tokens").alias("token_entropy"), per_("name_chars", "names").alias("mean_name_length"),
        per_("short_names", "names").alias("short_name_share"), per_("hex_names", "names").alias("hex_name_share"), per_("comment_chars", "bytes").alias("comment_density"),
        per_("numbers", "tokens").alias("number_share"), per_("long_chars", "bytes").alias("long_line_share"), per_("bytes", "lines").alias("mean_line_length"),
        per_("short_bodies", "bodies").alias("short_body_share"), per_("long_body_chars", "body_chars").alias("long_body_share"),
        per_("quoted_chars", "bytes").alias("quoted_share"), per_("tokens", "nodes").alias("tokens_per_node"),
        (F.col("gen") | F.regexp_like("path", F.lit(_MARKED))).alias("notice"),
        F.col("cop").alias("copy_notice"), per_("copied", "bytes").alias("copied_share"), F.regexp_like("path", F.lit(PLACES)).cast("double").alias("in_place"),
    )


def _sample(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` files, those of the smallest hashes; rows that can't be among them are dropped where they lie."""
    h = F.xxhash64("repo_id", "path")
    share = min(1.0, 1.2 * sample / max(1, rows.count()))
    some = rows if share == 1 else rows.filter(h <= F.lit(int(-(2**63) + share * (2**64 - 2))))
    return some.orderBy(h, "repo_id", "path").limit(sample)


def _chances(every: DataFrame, own: DataFrame, label: str, features: list[str], trees: int, least: float | None, to: str, few: int = 1) -> DataFrame | None:
    """``every`` with the chance of the label, by a forest fitted on ``own``; None where all of these bear the label or fewer than ``few`` do.

    Files without a notice that a first forest gives at least ``least`` (None: COPY_LIFT times the share of files with a notice, at most 0.4) count as marked, those at half of it or more as
    unknown, and a second forest is fitted on the rest.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    kinds = own.agg(F.count_if(label).alias("a"), F.count("*").alias("b")).first()
    if not few <= kinds["a"] < kinds["b"]:
        return None
    least = min(0.4, COPY_LIFT * kinds["a"] / kinds["b"]) if least is None else least
    forest = RandomForestClassifier(
        labelCol="y", featuresCol="_x", numTrees=trees, maxDepth=6, minInstancesPerNode=max(2, min(8, kinds["b"] // 250)), subsamplingRate=0.8, seed=11
    )
    join = VectorAssembler(inputCols=features, outputCol="_x")
    p = vector_to_array("probability")[1]
    train = checkpoint(join.transform(own.select(label, *features)).select(label, "_x").coalesce(4))
    first = forest.fit(train.withColumn("y", F.col(label).cast("double")))
    known = checkpoint(first.transform(train).select("_x", F.when(F.col(label) | (p >= least), 1.0).when(p < least / 2, 0.0).alias("y")).filter("y IS NOT NULL"))
    scored = forest.fit(known).transform(join.transform(every)).withColumn(to, F.when(F.col("compression_ratio") > 0, p).otherwise(0.0))
    return scored.select(*every.columns, to)


def classify(nodes: DataFrame, sample: int = SAMPLE, trees: int = TREES, chance: float = CHANCE) -> DataFrame:
    """The files with ``copy_chance, third_party``, the chance of being a copy and whether that is at least one half or its notice
    says so; ``chance``, that of being made by a program; and ``by_hand``: neither a copy nor of a chance of one half.

    Each forest is fitted on at most ``sample`` files, that of generated files on those that aren't copies. Where all files bear a notice or too few
    do, there is nothing to learn and the notice itself decides, of copies also the place and a share of COPIED. Of files
    whose texts are all null nothing is known: they count as written by hand.
    """
    every = checkpoint(files(nodes))
    some = checkpoint(_sample(every.filter(F.col("compression_ratio") > 0), sample))
    copies = _chances(every, some, "copy_notice", COPY_FEATURES, trees, None, "copy_chance", LEAST)
    if copies is None:
        copies = every.withColumn("copy_chance", ((F.col("copied_share") >= COPIED) | (F.col("in_place") > 0)).cast("double"))
    copies = checkpoint(copies.withColumn("third_party", (F.col("copy_chance") >= 0.5) | F.col("copy_notice")))
    own = some.join(copies.filter("third_party").select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    scored = _chances(copies, own, "notice", FEATURES, trees, chance, "chance")
    if scored is None:
        scored = copies.withColumn("chance", F.col("notice").cast("double"))
    return scored.select("repo_id", "path", *COPY_FEATURES, "notice", "copy_notice", "copy_chance", "third_party", "chance", (~F.col("third_party") & (F.col("chance") < 0.5)).alias("by_hand"))
