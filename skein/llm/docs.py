"""Functions paired with their documentation (problem 4).

Each function's own documentation comment is parsed from its text by the rules of its
language: Python's docstring, JSDoc blocks, Doxygen blocks and lines, Rust's outer and
inner doc comments, the comment block above a Ruby method. Documentation tags are
resolved into a description and an inheritance mark. The class hierarchy is parsed from
the headers of classes; methods without a description of their own, or that ask for
it, are joined again and again with the method of the same name in a base class until
each has a description or runs out of bases; those are dropped.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.tables import checkpoint, newest, slash

MIN_WORDS = 6

C_FAMILY = {"c", "cc", "cpp", "cxx", "h", "hpp", "hh"}
SCRIPT = {"ts", "tsx", "js", "jsx"}

# Directives to tools, licence lines, promises to document later, tags.
_DIRECTIVE = re.compile(
    r"prettier-ignore|eslint|@ts-\w+|tslint:|jshint|jslint|istanbul ignore|[cv]8 ignore|biome-ignore|deno-lint|webpack\w+:|"
    r"noqa|pylint:|type: ?ignore|fmt: ?(?:on|off|skip)|yapf:|mypy:|isort:|pyright:|ruff:|pragma\b|nosec|doctest:|flake8|"
    r"rubocop|frozen_string_literal|:nodoc:|typed: ?\w+|sorbet|steep:|NOLINT|clang-(?:format|tidy)|cppcheck|coverity|LCOV_EXCL|GCOVR_EXCL|"
    r"rustfmt|clippy::|cbindgen|bindgen:|GCC diagnostic|^\s*#?(?:end)?region\b|-\*-|^\s*vim:|^\s*(?:en)?coding[:=]|@formatter:|spell-?checker:|cspell:|NOSONAR|codespell|lint:",
    re.I,
)
_LICENCE = re.compile(r"copyright|\(c\) |©|licen[cs]ed? |licen[cs]e\b|SPDX-|all rights reserved|redistribution and use|without warranty|permission is hereby", re.I)
_LATER = re.compile(
    r"\b(?:todo|fixme|tbd|tbc|xxx|wip)\b|\b(?:to be|will be|needs? to be|should be|must be|not yet|yet to be|still)\b[^.]{0,30}\b(?:documented|described|written|explained|filled|document|undocumented)\b|"
    r"\b(?:document|describe|explain|write)\b[^.]{0,40}\b(?:later|soon|someday|eventually|next sprint|follow-?up)\b|\b(?:documentation|description|docs?|docstring|comment)\b[^.]{0,30}\b(?:later|soon|follows?|to follow|to come|pending|missing|coming|needed|wanted|goes here|here|tbd|once)\b|"
    r"\b(?:add|write|insert|provide|put|fill in)\b[^.]{0,25}\b(?:documentation|description|docs?|docstring|comment)\b|\b(?:folgt (?:noch|später|spaeter)|noch zu (?:dokumentieren|beschreiben)|(?:doku(?:mentation)?|beschreibung) (?:folgt|fehlt|kommt)|à documenter|documentation à|por documentar|pendiente de documentar|documentar más tarde|se documentará)",
    re.I,
)
_NO_DESCRIPTION = r"param(?:eter)?s?|arg(?:ument)?s?|returns?|return|retval|throws?|exception|raises?|raise|yields?|yieldparam|yieldreturn|rtype|type|tparam|template|typeparam|prop(?:erty)?|result"
_SAYS = {"brief", "short", "description", "desc", "summary", "details", "remarks", "remark", "note", "classdesc", "overview", "attention", "warning"}
_TAG = re.compile(r"^\s*[@\\](\w+)\b[:]?\s*(.*)$", re.S)
_SECTION = re.compile(
    r"^(\s*)(?:Args|Arguments|Parameters?|Params?|Keyword Args|Keyword Arguments|Other Parameters|Returns?|Return values?|Results?|Yields?|Raises|Throws|Exceptions?|Errors?|Examples?|Attributes)\s*:\s*$", re.I
)
_HEADING = re.compile(r"^\s*#+\s*(.+?)\s*:?\s*$")
_CUT_HEADING = re.compile(r"^(?:args|arguments|param(?:eter)?s?|returns?|return values?|results?|errors?|panics?|throws|raises|exceptions?|yields?|examples?|safety|other parameters)$", re.I)
_FIELD = re.compile(r"^\s*:(?:%s|key(?:word)?|kwarg|var|ivar|cvar|meta|except)\b[^:]*:" % _NO_DESCRIPTION, re.I)
_INHERIT = re.compile(r"\{?\s*[@\\](?:inheritdoc|copydoc|copybrief)\b|\(see (?:super|base)|^\s*inherit(?:ed)? doc", re.I)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:if|for|while|switch|elif|else if|match)\b.*[:{)]\s*$|^\s*(?:else|try|finally|begin|end|do)\s*:?\s*$|^\s*(?:return|raise|throw|import|from|let|var|const|def|fn|func|function|class|pub|static|void|int|auto|assert\w*!?|debug!|elsif|unless|rescue|print|puts|logger|log|console)\b[^.]*[(=\[{:;)]|"
    r"^\s*[\w.\[\]'\"$@:>-]+\s*(?:[-+*/|&%?]?=|<<|:=)\s*[^=\s].*$|^\s*[\w.:>-]+\([^)]*\)\s*;?\s*$|^\s*[\w.]+\.\w+\(.*\)\s*(?:do\b.*|\{.*)?$|^\s*return\b\s*[\w.\[\]()'\"]*\s*;?\s*$|^\s*(?:return|raise)\b.*\b(?:if|unless)\b.*$|=>"
)
_WORD = re.compile(r"[^\W\d_](?:[\w'’\-]*\w)?")
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)


def _balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; strings are skipped."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i + 1
        elif c in "\"'":
            q = text[i : i + 3] if text[i : i + 3] in ('"""', "'''") else c
            i += len(q)
            while i < n and not text.startswith(q, i):
                i += 2 if text[i] == "\\" else 1
            i += len(q) - 1
        elif c == "#" and text[max(0, i - 1)] in " \t\n":
            while i < n and text[i] != "\n":
                i += 1
        i += 1
    return n


def _unstar(body: str) -> str:
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x) if k else x for k, x in enumerate(body.split("\n")))


def _leading(text: str, ruby: bool, rust: bool) -> tuple[list[tuple[str, str]], int]:
    """Comments and attributes before the declaration as (mark, body), and where they end."""
    out: list[tuple[str, str]] = []
    i, n = 0, len(text)
    while i < n:
        if text[i] == "\n" and out and re.match(r"\n[ \t]*\n", text[i:]):
            out.append(("blank", ""))
        if text[i].isspace():
            i += 1
        elif ruby and text.startswith("=begin", i):
            m = re.compile(r"^=end\b.*$", re.M).search(text, i)
            out.append(("#", text[i + 6 : m.start() if m else n]))
            i = m.end() if m else n
        elif ruby and text[i] == "#":
            end = text.find("\n", i)
            end = n if end < 0 else end
            out.append(("#", re.sub(r"^#+ ?", "", text[i:end])))
            i = end
        elif rust and text.startswith(("#[", "#!["), i):
            end = _balanced(text, text.index("[", i))
            if m := re.match(r"#!?\[\s*doc\s*=\s*r?#*\"(.*?)\"#*\s*\]$", text[i:end], re.S):
                out.append(("///", m[1]))
            else:
                out.append(("attr", ""))
            i = end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            body = text[i:end]
            mark = "/*"
            if body.startswith(("/**", "/*!")) and not body.startswith(("/***", "/**/", "/**<", "/*!<")):
                mark = body[:3]
            out.append((mark, _unstar(body[3 if mark != "/*" else 2 : -2 if body.endswith("*/") and len(body) > 3 else None])))
            i = end
        elif text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            line = text[i:end]
            mark = "//"
            if line.startswith(("///", "//!")) and not line.startswith(("////", "///<", "//!<")):
                mark = line[:3]
            out.append((mark, re.sub(r"^ ", "", line[len(mark):])))
            i = end
        elif text[i] == "@" and not ruby:
            m = re.match(r"@[\w.]+", text[i:])
            if not m:
                break
            i += m.end()
            if i < n and text[i] == "(":
                i = _balanced(text, i)
            out.append(("attr", ""))
        else:
            break
    return out, i


def _past_decorators(text: str) -> int:
    """The place after the comments and decorators that a Python declaration begins with."""
    i, n = 0, len(text)
    while i < n:
        if text[i].isspace():
            i += 1
        elif text[i] == "#":
            i = text.find("\n", i)
            if i < 0:
                return n
        elif text[i] == "@":
            while i < n and text[i] != "\n":
                i = _balanced(text, i) if text[i] in "([{" else i + 1
        else:
            break
    return i


def _docstring(text: str) -> str | None:
    i, n = _past_decorators(text), len(text)
    m = re.compile(r"(?:async\s+)?def\b").match(text, i)
    if not m:
        return None
    i = m.end()
    while i < n and text[i] != ":":
        i = _balanced(text, i) if text[i] in "([{" else i + 1
    m = re.compile(r":(?:\s|#[^\n]*\n|\\\n)*([rRuU]?)(\"\"\"|'''|\"|')").match(text, i)
    if not m:
        return None
    q, i = m[2], m.end()
    end = i
    while end < n and not text.startswith(q, end):
        if len(q) == 1 and text[end] == "\n":
            return None
        end += 2 if text[end] == "\\" else 1
    if end >= n or not re.compile(r"[ \t]*(?:#[^\n]*|;[^\n]*)?(?:\n|$)").match(text, end + len(q)):
        return None
    return text[i:end] if m[1] in ("r", "R") else re.sub(r"\\\n", "", text[i:end])


def own_comment(language: str | None, text: str) -> str | None:
    """The function's own documentation comment without its marks, or None."""
    language = (language or "").lower()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if language == "py":
        return _docstring(text)
    marks, end = _leading(text, language == "rb", language == "rs")
    if language == "rb":
        block: list[str] = []
        for mark, body in reversed(marks):
            if mark != "#":
                break
            block.insert(0, body)
        return "\n".join(block) if block else None
    if language in SCRIPT:
        return next((b for m, b in reversed(marks) if m == "/**"), None)
    if language == "rs":
        docs = [b for m, b in marks if m in ("///", "/**")]
        brace = text.find("{", end)
        if brace >= 0 and re.compile(r"\{\s*(?://!|/\*!)").match(text, brace):
            docs += [b for m, b in _leading(text[brace + 1 :], False, True)[0] if m in ("//!", "/*!")]
        return "\n".join(docs) if docs else None
    if language in C_FAMILY:
        docs = [b for m, b in marks if m in ("/**", "/*!", "///", "//!")]
        return "\n".join(docs) if docs else None
    return None


def description(comment: str, language: str | None = None) -> tuple[str, bool]:
    """The description in a documentation comment, empty where it says nothing, and whether it asks to inherit."""
    language = (language or "").lower()
    inherits = bool(_INHERIT.search(comment))
    lines = _FENCE.sub("", comment).expandtabs(4).split("\n")
    kept: list[str] = []
    skip: str | None = None  # what is being skipped: tag, section (with indentation), field, heading, numpy
    depth = 0
    for k, line in enumerate(lines):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        under = lines[k + 1].strip() if k + 1 < len(lines) else ""
        if m := _TAG.match(line):
            if m[1].lower() in _SAYS:
                skip = None
                kept.append(m[2])
            else:
                skip, depth = "tag", indent
            continue
        if _FIELD.match(line):
            skip, depth = "field", indent
            continue
        if m := _SECTION.match(line):
            skip, depth = "section", indent
            continue
        if bare and len(under) >= 3 and set(under) <= set("-=~"):
            skip = "numpy" if _CUT_HEADING.match(bare.rstrip(":")) else None
            continue
        if bare and set(bare) <= set("-=~*#_") and len(bare) >= 3:
            continue
        if language != "py" and (m := _HEADING.match(line)):
            skip = "heading" if _CUT_HEADING.match(m[1]) else None
            continue
        if skip == "tag":
            if language in SCRIPT or language == "py":
                continue
            if bare and (language != "rb" or indent > depth) and not (language in C_FAMILY and not lines[k - 1].strip()):
                continue
            if not bare:
                continue
            skip = None
        elif skip in ("section", "field"):
            if not bare or indent > depth:
                continue
            skip = None
        elif skip in ("heading", "numpy"):
            continue
        kept.append(line)
    said = []
    for line in kept:
        bare = re.sub(r"\{[@\\]\w+\s*([^}]*)\}", r"\1", line).strip()
        if not bare or _DIRECTIVE.search(bare) or _LICENCE.search(bare) or _CODE.search(bare):
            continue
        said.append(bare)
    text = " ".join(said)
    text = " ".join(s for s in re.split(r"(?<=[.!?])\s+", text) if not _LATER.search(s))
    return text, inherits


def words(text: str) -> int:
    return len(_WORD.findall(text))


_HEADERS = {
    "py": re.compile(r"class\s+\w+\s*(?:\[[^\]]*\]\s*)?(\()"),
    "rb": re.compile(r"class\s+[\w:]+[ \t]*<[ \t]*([\w:]+)"),
    "ts": re.compile(r"(?:(?:export|default|declare|abstract)\s+)*(?:class|interface)\s+[\w$]+(.*)", re.S),
    "c": re.compile(r"(?:template\s*<[^{;]*?>\s*)?(?:typedef\s+)?(?:class|struct)\s+(?:\[\[[^\]]*\]\]\s*)?\w+(?:::\w+)*(?:<[^{;]*?>)?\s*(?:final\s*)?:(?!:)\s*([^{;]+)", re.S),
    "rs": re.compile(r"(?:unsafe\s+)?impl\b(.*)", re.S),
    "rs trait": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+\w+(?:<[^{;]*?>)?\s*:\s*([^{;]+)", re.S),
}
_NO_BASE = {"public", "private", "protected", "virtual", "typename", "object", "where", "extends", "implements"}


def _without_brackets(text: str, pairs: str = "<>[]()") -> str:
    """The text without what stands in brackets."""
    out, depth = [], 0
    for c in text:
        k = pairs.find(c)
        if k >= 0:
            depth = depth + 1 if k % 2 == 0 else max(0, depth - 1)
        elif not depth:
            out.append(c)
    return "".join(out)


def bases_of(language: str | None, text: str) -> list[str]:
    """Names of the classes and interfaces in the header of the text's own class, in order, without the modules they are in; an inner class's
    header is not looked at. In Rust the trait that an impl is for, and the traits above a trait."""
    language = (language or "").lower()
    kind = "ts" if language in SCRIPT else "c" if language in C_FAMILY else language
    if kind not in ("py", "rb", "ts", "c", "rs"):
        return []
    text = text.replace("\r\n", "\n")
    at = _past_decorators(text) if kind == "py" else _leading(text, kind == "rb", kind == "rs")[1]
    body = text.find("{", at) if kind not in ("py", "rb") else -1
    header = text[at : body if body >= 0 else None]
    m = _HEADERS[kind].match(header)
    if kind == "rs" and not m:
        m = _HEADERS["rs trait"].match(header)
    elif kind == "rs" and m:
        before, sep, _ = _without_brackets(m[1]).partition(" for ")
        return [before.strip().split("::")[-1].lstrip("!")] if sep else []
    if not m:
        return []
    if kind == "py":
        names = header[m.end() : _balanced(header, m.start(1)) - 1]
        names = re.sub(r"#[^\n]*", "", names)
    else:
        names = m[1]
    out = []
    for part in re.split(r"[,+]|\bextends\b|\bimplements\b", _without_brackets(names)):
        words_ = [w for w in part.split() if w not in _NO_BASE]
        if words_ and "=" not in part and re.fullmatch(r"[\w$.:?']+", words_[0]):
            name = re.split(r"\.|::", words_[0])[-1].lstrip("?'")
            if name and name not in _NO_BASE:
                out.append(name)
    return list(dict.fromkeys(out))


_PARSED = "id string, ingested_at timestamp, repo_id string, file_path string, kind string, name string, start long, end long, comment string, description string, inherits boolean, bases array<string>"
_CLASSES = ("class", "impl", "trait", "struct", "interface")


def _parse(batches):
    for b in batches:
        col = {n: b.column(n).to_pylist() for n in ("language", "symbol_type", "raw_text")}
        comments, texts, inherits, bases = [], [], [], []
        for lang, kind, text in zip(*col.values()):
            comment, said, asks, base = None, "", False, []
            if text is not None and kind in ("function", "method"):
                comment = own_comment(lang, text)
                if comment is not None:
                    said, asks = description(comment, lang)
                    if words(said) < MIN_WORDS:
                        said = ""
            elif text is not None:
                base = bases_of(lang, text)
            comments.append(comment)
            texts.append(said)
            inherits.append(asks)
            bases.append(base)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("ingested_at"), b.column("repo_id"), b.column("file_path"), b.column("symbol_type"), b.column("symbol_name"),
             b.column("source_start_byte"), b.column("source_end_byte"), pa.array(comments, pa.string()), pa.array(texts, pa.string()), pa.array(inherits, pa.bool_()),
             pa.array(bases, pa.list_(pa.string()))],
            names=[x.split()[0] for x in _PARSED.split(", ")],
        )


def parsed(nodes: DataFrame) -> DataFrame:
    """Functions, methods and classes of the newest rows with what their texts say; texts are parsed before the shuffle, which carries none."""
    src = nodes.filter(F.lower("symbol_type").isin("function", "method", *_CLASSES)).select(
        "id", "ingested_at", "repo_id", slash("file_path").alias("file_path"), "language", F.lower("symbol_type").alias("symbol_type"),
        "symbol_name", "source_start_byte", "source_end_byte", "raw_text",
    )
    cols = [x.split()[0] for x in _PARSED.split(", ")][2:]
    return newest(src.mapInArrow(_parse, _PARSED.replace("timestamp", src.schema["ingested_at"].dataType.simpleString())), "id", "ingested_at", cols)


def _enclosed(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, repo_id, file_path, cls, name, description, bases`` of each method in the innermost class of its file around it.

    Classes are keyed by cells as wide as the power of two next to their length, of which each touches at most two, and a method is
    looked up in its cell of each width that its file has; so even in a file of very many symbols only
    classes around or next to a method meet it.
    """
    c = classes.filter(F.col("ce") > F.col("cs")).withColumn("w", F.ceil(F.log2(F.col("ce") - F.col("cs"))).cast("int"))
    low, high = F.expr("shiftright(cs, w)"), F.expr("shiftright(ce, w)")
    c = c.withColumn("cell", F.explode(F.sequence(low, high)))
    widths = c.select("repo_id", "file_path", "w").distinct()
    m = methods.select("id", "repo_id", "file_path", "name", "description", "start", "end").join(widths, ["repo_id", "file_path"]).withColumn("cell", F.expr("shiftright(start, w)"))
    inside = m.join(c, ["repo_id", "file_path", "w", "cell"]).filter((F.col("start") >= F.col("cs")) & (F.col("end") <= F.col("ce")))
    best = F.max_by(F.struct("repo_id", "file_path", "cls", "name", "description", F.col("cb").alias("bases")), F.struct("cs", "cls"))
    return inside.groupBy("id").agg(best.alias("m")).select("id", "m.*")


def pairs(nodes: DataFrame) -> DataFrame:
    """``id, description, source_id``: each function or method with a real description.

    ``source_id`` is the id itself for a description of its own, to which that of the overridden method is appended where the
    comment asks to inherit; else the overridden method whose
    description it inherits: the one of the same name in the nearest base class that has one. A base is the class of that name
    in the same file or, where the file has none, in the repository, through as many levels of bases as there are; a class is asked once, so cycles end. Functions whose
    description is absent, says nothing and is not inherited are dropped. Null texts, names and empty tables give no rows.
    """
    p = checkpoint(parsed(nodes))
    own = p.filter(F.col("kind").isin("function", "method") & (F.col("description") != "")).select("id", "description", F.col("id").alias("source_id"))
    classes = p.filter(F.col("kind").isin(*_CLASSES) & F.col("name").isNotNull()).select(
        "repo_id", "file_path", F.col("name").alias("cls"), F.col("start").alias("cs"), F.col("end").alias("ce"), F.col("bases").alias("cb")
    )
    members = _enclosed(p.filter(F.col("kind").isin("function", "method") & F.col("name").isNotNull()), classes)
    members = checkpoint(members)
    # a class is known in its file and, with all others of its name, in its repository
    both = lambda df: df.withColumn("scope", F.explode(F.array("file_path", F.lit(""))))
    known = both(members.filter("file_path IS NOT NULL")).groupBy("repo_id", "scope", "cls", "name").agg(
        F.min_by(F.struct("description", F.col("id").alias("source_id")), F.struct(F.col("description") == "", F.col("id"))).alias("k")
    ).select(F.col("repo_id").alias("r"), F.col("scope").alias("s"), F.col("cls").alias("c"), F.col("name").alias("n"), "k.*")
    here = classes.select(F.col("repo_id").alias("dr"), F.col("file_path").alias("df"), F.col("cls").alias("dc")).distinct()

    def scoped(rows: DataFrame, base: str, scope: str) -> DataFrame:
        j = rows.join(here, (F.col("repo_id") == F.col("dr")) & (F.col("file_path") == F.col("df")) & (F.col(base) == F.col("dc")), "left")
        return j.withColumn(scope, F.coalesce("df", F.lit(""))).drop("dr", "df", "dc")

    # of a base named several times the first place does
    up = both(scoped(classes.select("repo_id", "file_path", "cls", "cs", F.posexplode("cb").alias("hat", "hb")), "hb", "hs"))
    up = up.groupBy(F.col("repo_id").alias("hr"), F.col("scope").alias("hw"), F.col("cls").alias("hc"), "hb", "hs").agg(F.min(F.struct("file_path", "cs", "hat")).alias("hat"))
    said = known.filter("description <> ''")
    asking = p.filter("inherits").select("id")
    silent = members.filter(F.col("description") == "").union(members.filter(F.col("description") != "").join(asking, "id", "left_semi").select(members.columns))
    open_ = scoped(silent.select("id", "repo_id", "file_path", "name", F.posexplode("bases").alias("place", "base")), "base", "scope")
    open_ = open_.groupBy("id", "repo_id", "name", "base", "scope").agg(F.min("place").alias("place"))
    links, visited = None, None
    while True:
        open_ = checkpoint(open_)
        if open_.limit(1).count() == 0:
            break
        j = open_.join(said, (F.col("repo_id") == F.col("r")) & (F.col("scope") == F.col("s")) & (F.col("base") == F.col("c")) & (F.col("name") == F.col("n")) & (F.col("id") != F.col("source_id")))
        hit = checkpoint(j.groupBy("id").agg(F.min_by(F.struct("description", "source_id"), "place").alias("k")).select("id", "k.*"))
        links = hit if links is None else links.union(hit)
        pairs_ = open_.select("id", "base", "scope")
        visited = pairs_ if visited is None else visited.union(pairs_)
        far = open_.join(hit.select("id"), "id", "left_anti").join(up, (F.col("repo_id") == F.col("hr")) & (F.col("scope") == F.col("hw")) & (F.col("base") == F.col("hc")))
        far = far.groupBy("id", "repo_id", "name", F.col("hb").alias("base"), F.col("hs").alias("scope")).agg(F.min(F.struct("place", "hat")).alias("_p")).join(visited, ["id", "base", "scope"], "left_anti")
        w = Window.partitionBy("id").orderBy("_p", "base", "scope")
        open_ = far.select("id", "repo_id", "name", "base", "scope", F.row_number().over(w).alias("place"))
    if links is None:
        return own
    # what a method inherits may ask for its own base's description in turn
    at = links.select(F.col("id").alias("at"), F.col("description").alias("more"), F.col("source_id").alias("next"))
    walk = links.select("id", F.col("description").alias("text"), "source_id", F.col("source_id").alias("last"), F.array("id", "source_id").alias("path"))
    ended = None
    while True:
        walk = checkpoint(walk)
        if walk.limit(1).count() == 0:
            break
        j = walk.join(at, (F.col("last") == F.col("at")) & ~F.array_contains("path", F.col("next")), "left")
        stop = j.filter("next IS NULL").select("id", "text", "source_id")
        ended = stop if ended is None else ended.union(stop)
        walk = j.filter("next IS NOT NULL").select("id", F.concat_ws(" ", "text", "more").alias("text"), "source_id", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path"))
    if ended is None:
        return own
    both = own.join(ended.select("id", "text"), "id", "left").select("id", F.concat_ws(" ", "description", "text").alias("description"), "source_id")
    return both.union(ended.join(own.select("id"), "id", "left_anti").select("id", F.col("text").alias("description"), "source_id"))
