"""Python: exact for files that compile, by the standard parser."""

from __future__ import annotations

import ast

from skein.extract.languages import Symbol


def _line_starts(data: bytes) -> list[int]:
    starts = [0]
    for i, b in enumerate(data):
        if b == 10:
            starts.append(i + 1)
    return starts


def _callees(node: ast.AST) -> list[str]:
    out: dict[str, None] = {}
    for x in sorted((c for c in ast.walk(node) if isinstance(c, ast.Call)), key=lambda c: (c.lineno, c.col_offset)):
        f = x.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            out.setdefault(name)
    return list(out)


def symbols(text: str) -> list[Symbol]:
    """Functions, classes and type aliases; none of a file that doesn't compile."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    starts = _line_starts(text.encode())
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, name = "function", node.name
        elif isinstance(node, ast.ClassDef):
            kind, name = "class", node.name
        elif isinstance(node, ast.TypeAlias):
            kind, name = "type", node.name.id
        else:
            continue
        at = starts[node.lineno - 1] + node.col_offset
        end = starts[node.end_lineno - 1] + node.end_col_offset
        out.append(Symbol(kind, name, at, end, _callees(node) if kind != "type" else []))
    return sorted(out, key=lambda s: (s.start, -s.end))


def body_of(text: str) -> tuple[int, int] | None:
    """Byte range of the outermost body of a definition, without its indentation."""
    lines = text.split("\n")
    for source in (text, "if 1:\n " + text.replace("\n", "\n "), "\n".join([lines[0], *_dedent(lines[1:])])):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            continue
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first, last = node.body[0], node.body[-1]
                shift = 1 if source.startswith("if 1:\n ") else 0
                one, two = first.lineno - 1 - shift, last.end_lineno - 1 - shift
                data = [x.encode() + b"\n" for x in lines]
                begin = sum(map(len, data[:one]))
                head = data[one]
                begin += len(head) - len(head.lstrip()) if one > 0 else first.col_offset - shift
                return begin, min(sum(map(len, data[: two + 1])) - 1, len(text.encode()))
    return None


def _dedent(lines: list[str]) -> list[str]:
    import textwrap

    body = textwrap.dedent("\n".join(lines)).split("\n")
    return ["    " + x if x.strip() else x for x in body]
