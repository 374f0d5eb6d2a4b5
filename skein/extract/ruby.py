"""Ruby: methods, classes and modules by matching ``end``."""

from __future__ import annotations

import re

from skein.extract.languages import Symbol

_OPEN = re.compile(
    r"^\s*(?:(?:private|protected|public|module_function|private_class_method)\s+)?(def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin|while)\b"
)
_END = re.compile(r"^\s*end\b")
_NAME = re.compile(r"^\s*(?:(?:private|protected|public|module_function|private_class_method)\s+)?(def|class|module)\s+(?:self\.|[A-Z]\w*\.)?([A-Za-z_][\w:]*[?!=]?|[+\-*/%<=>!~^&|\[\]]+)")
_WORDS = frozenset("if unless while until case when and or not return yield puts raise require require_relative attr_reader attr_accessor attr_writer private protected public super defined new include extend".split())


def _bare(line: str) -> str:
    line = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', lambda m: m.group()[0] + " " * (len(m.group()) - 2) + m.group()[0], line)
    return re.sub(r"(?:^|\s)#.*", "", line)


def callees(text: str) -> list[str]:
    code = "\n".join(map(_bare, text.split("\n")))
    out = dict.fromkeys(m[1] or m[2] for m in re.finditer(r"([a-z_]\w*[?!]?)\s*\(|(?<=\.)([a-z_]\w*[?!]?)\b(?!\s*=[^=~])", code))
    return [x for x in out if x and x not in _WORDS]


def symbols(text: str) -> list[Symbol]:
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)
    stack: list[tuple[str, str, int] | None] = []
    out = []
    heredoc = None
    block = False
    for i, line in enumerate(lines):
        if line.startswith("=begin"):
            block = True
        if line.startswith("=end"):
            block = False
            continue
        if block:
            continue
        if heredoc:
            if line.strip() == heredoc:
                heredoc = None
            continue
        bare = _bare(line)
        if m := re.search(r"<<[~-]?([A-Z_]+)\b", bare):
            heredoc = m[1]
        if _END.match(bare):
            if stack and (top := stack.pop()):
                kind, name, at = top
                begin = starts[at] + len(lines[at].encode()) - len(lines[at].lstrip().encode())
                end = starts[i] + line.encode().index(b"end") + 3
                body = "\n".join(lines[at + 1 : i])
                out.append(Symbol(kind, name, begin, end, callees(body)))
            continue
        if _OPEN.search(bare) and not re.search(r"\bend\s*$", bare):
            d = _NAME.match(bare)
            if d and d[1] == "def" and re.search(r"^\s*(?:\w+\s+)?def\s+[\w.?!]+(?:\([^)]*\))?\s*=\s*\S", bare):
                begin = starts[i] + len(line) - len(line.lstrip())
                out.append(Symbol("method", d[2], begin, starts[i] + len(line.encode()), callees(bare.split("=", 1)[1])))
                continue
            stack.append(({"def": "method"}.get(d[1], d[1]), d[2], i) if d else None)
    return sorted(out, key=lambda s: (s.start, -s.end))
