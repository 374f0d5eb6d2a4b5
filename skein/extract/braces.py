"""C, C++, TypeScript and Rust: a scanner that blanks out comments and strings, then declarations with a body in braces.

Approximate where the grammar needs types or macros; the tests state what is covered.
"""

from __future__ import annotations

import re

from skein.extract.languages import C_FAMILY, Symbol, has_calls

_KEYWORDS = frozenset(
    "if for while switch catch return sizeof alignof decltype typeof new delete throw else do case match loop fn function class struct enum union trait impl "
    "namespace template using operator static_assert assert await yield super typename noexcept requires constexpr where in of as and or not unsafe move async".split()
)


_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?|`(?:\\.|[^`\\])*`?'
_PLAIN = re.compile(rf"{_COMMENT}|{_QUOTED}|'(?:\\.|[^'\\\n])*'?", re.S)
_IN_RUST = re.compile(rf"""{_COMMENT}|(?<!\w)b?r(#*)".*?(?:"\1|\Z)|{_QUOTED}|'(?:\\.[^']*|[^'\\])'""", re.S)
_VISIBLE = re.compile(r"[^\n]")


def _wiped(m: re.Match) -> str:
    s = m.group()
    if s[0] == "/":
        return _VISIBLE.sub(" ", s)
    head = s.index('"') + 1 if s[0] in "br" else 1
    tail = 0
    if len(s) > head:
        tail = len(m[1]) + 1 if s[0] in "br" else 1
        if not s.endswith(s[head - 1] + "#" * (tail - 1)):
            tail = 0
    end = len(s) - tail
    return s[:head] + _VISIBLE.sub(" ", s[head:end]) + s[end:]


def blank(text: str, rust: bool = False) -> str:
    """The text with comments and the insides of strings as spaces, of equal length and lines."""
    return (_IN_RUST if rust else _PLAIN).sub(_wiped, text)


def _match(code: str, at: int, opening: str = "{", closing: str = "}") -> int:
    """The place after the bracket that closes the one at ``at``; the end where none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(opening)}{re.escape(closing)}]").finditer(code, at):
        depth += 1 if m.group() == opening else -1
        if not depth:
            return m.end()
    return len(code)


_CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:::\s*<[^<>;{}]*>\s*|<[\w\s,:&*]*>\s*|!\s*)?\(")
_DECLARES = re.compile(r"\b(?:fn|function|get|set)\s*\*?\s*$")
_HAS_BODY = re.compile(r"\s*(?::\s*[^;{}=()]+)?(?:const\b|noexcept\b|override\b|final\b|\s)*\{")


def callees(code: str, rust: bool = False) -> list[str]:
    """Names that are called, in order of appearance; names of declarations aren't. Only in Rust can a body follow a call."""
    out: dict[str, None] = {}
    for m in _CALL.finditer(code):
        if m[1] in _KEYWORDS or _DECLARES.search(code, max(0, m.start() - 12), m.start()):
            continue
        if not rust and _HAS_BODY.match(code, _match(code, m.end() - 1, "(", ")")):
            continue
        out.setdefault(m[1])
    return list(out)


_TS = [
    ("class", re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?\bclass\s+([A-Za-z_$][\w$]*)[^{};]*\{")),
    ("interface", re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?\binterface\s+([A-Za-z_$][\w$]*)[^{};]*\{")),
    ("enum", re.compile(r"(?:export\s+)?(?:declare\s+)?(?:const\s+)?\benum\s+([A-Za-z_$][\w$]*)\s*\{")),
    ("type", re.compile(r"(?:export\s+)?(?:declare\s+)?\btype\s+([A-Za-z_$][\w$]*)[^=;{}]*=")),
    ("function", re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)?\s*(?:<[^()]*>)?\s*\(")),
]
_TS_BINDING = re.compile(
    r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*((?:React\.)?(?:memo|forwardRef)\s*(?:<[^()]*>)?\(\s*)?(?:async\s+)?(?:function\b|(?:<[^()=]*>\s*)?\([^;{}]*?\)\s*(?::[^=;{}]+?)?=>|[A-Za-z_$][\w$]*\s*=>)",
    re.M,
)
_TS_METHOD = re.compile(r"(?:^|[;{}\n])\s*((?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?\s*([A-Za-z_$#][\w$]*)\s*(?:<[^()]*>)?\()")
_RUST = [
    ("struct", re.compile(r"(?:pub(?:\([^)]*\))?\s+)?\bstruct\s+([A-Za-z_]\w*)")),
    ("enum", re.compile(r"(?:pub(?:\([^)]*\))?\s+)?\benum\s+([A-Za-z_]\w*)")),
    ("union", re.compile(r"(?:pub(?:\([^)]*\))?\s+)?\bunion\s+([A-Za-z_]\w*)\s*(?:<[^{;]*>)?\s*\{")),
    ("trait", re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?\btrait\s+([A-Za-z_]\w*)")),
    ("impl", re.compile(r"(?:unsafe\s+)?\bimpl\b(?:\s*<[^{;]*?>)?\s+([^{;]+?)\s*(?:\bwhere\b[^{]*)?\{")),
    ("type", re.compile(r"(?:pub(?:\([^)]*\))?\s+)?\btype\s+([A-Za-z_]\w*)[^=;{}]*=")),
    ("macro", re.compile(r"\bmacro_rules!\s*([A-Za-z_]\w*)")),
    ("function", re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?\bfn\s+([A-Za-z_]\w*)")),
]
_C_TYPE = re.compile(r"(?:typedef\s+)?\b(class|struct|union|enum(?:\s+(?:class|struct))?)\s+(?:\[\[[^\]]*\]\]\s*)?([A-Za-z_]\w*)?\s*(?:final\b)?\s*(?::[^{;()]*)?\{")
_C_ALIAS = re.compile(r"\btypedef\b[^;{}]*;|\busing\s+([A-Za-z_]\w*)\s*=[^;]*;")
_C_FUNCTION = re.compile(
    r"(?:^|[;{}>\n])[ \t]*((?:[A-Za-z_][\w:<>,*&\s\[\]~]*?[\s*&])?((?:[A-Za-z_]\w*(?:<[^<>(){};]*>)?::)*(?:~?[A-Za-z_]\w*|operator\s*(?:\(\)|\[\]|[^\s\w(]{1,3}|[A-Za-z_][\w:<>*&\s]*)))\s*)\("
)


def special_name(name: str) -> str:
    """C++ names with their spacing made regular: ``operator ==`` to ``operator==``, ``A < B >`` to ``A<B>``."""
    name = re.sub(r"\s+", " ", name.strip())
    name = re.sub(r"operator (?=[^\w\s])", "operator", name)
    return re.sub(r"\s*([<>,:])\s*", r"\1", name) if "operator" not in name else name


def symbols(text: str, ext: str) -> list[Symbol]:
    rust = ext == "rs"
    code = blank(text, rust)
    found: list[tuple[str, str, int, int]] = []
    if rust:
        found = _rust(code)
    elif ext in C_FAMILY:
        found = _c(code)
    else:
        found = _ts(code)
    to_byte = _byte_offsets(text)
    out = [
        Symbol(kind, name, to_byte(a), to_byte(b), callees(_without_head(code[a:b]), rust) if has_calls(kind, ext) else [])
        for kind, name, a, b in dict.fromkeys(found)
    ]
    return sorted(out, key=lambda s: (s.start, -s.end))


def _without_head(code: str) -> str:
    """From the first body on, so that a declaration isn't its own callee."""
    at = code.find("{")
    arrow = code.find("=>")
    cut = min(x for x in (at, arrow, len(code)) if x >= 0)
    return code[cut:]


def _byte_offsets(text: str):
    if text.isascii():
        return lambda i: i
    sizes = [0]
    for ch in text:
        sizes.append(sizes[-1] + len(ch.encode()))
    return lambda i: sizes[i]


def _ts(code: str) -> list[tuple[str, str, int, int]]:
    out = []
    classes = []
    for kind, pat in _TS:
        for m in pat.finditer(code):
            if kind == "type":
                end = code.find(";", m.end())
                line = code.find("\n\n", m.end())
                end = min(x + (x == end) for x in (end, line, len(code)) if x >= 0)
            elif kind == "function":
                close = _match(code, m.end() - 1, "(", ")")
                body = re.compile(r"\s*(?::\s*[^;{}]+?(?:\{[^{}]*\}[^;{}]*?)?)?\s*\{").match(code, close)
                if not body:
                    continue
                end = _match(code, body.end() - 1)
            else:
                end = _match(code, m.end() - 1)
            out.append((kind, m[1] or "anonymous", m.start(), end))
            if kind == "class":
                classes.append((m.end(), end))
    for m in _TS_BINDING.finditer(code):
        arrow = re.compile(r"=>\s*").search(code, m.end() - 2)
        brace = code.find("{", m.end() - 1)
        stop = code.find(";", m.end())
        if m[2]:
            end = _match(code, code.index("(", m.start(2)), "(", ")")
        elif brace >= 0 and (stop < 0 or brace < stop) and (not arrow or re.compile(r"\s*\{").match(code, arrow.end())):
            end = _match(code, brace)
        else:
            end = stop if stop >= 0 else len(code)
        if code[end : end + 1] == ";":
            end += 1
        out.append(("function", m[1], m.start(), end))
    for lo, hi in classes:
        for m in _TS_METHOD.finditer(code, lo - 1, hi):
            if m[2] in _KEYWORDS or code.count("{", lo, m.start(1)) != code.count("}", lo, m.start(1)):
                continue
            close = _match(code, m.end() - 1, "(", ")")
            body = re.compile(r"\s*(?::\s*[^;{}]+?(?:\{[^{}]*\}[^;{}]*?)?)?\s*\{").match(code, close)
            if body:
                out.append(("method", m[2], m.start(1), _match(code, body.end() - 1)))
    return out


def _rust(code: str) -> list[tuple[str, str, int, int]]:
    out, impls = [], []
    for kind, pat in _RUST:
        for m in pat.finditer(code):
            brace, stop = code.find("{", m.end() - (kind in ("impl", "union"))), code.find(";", m.end())
            if kind == "type":
                if any(a < m.start() < b for a, b in impls):
                    continue  # associated types belong to their impl
                end = stop + 1 if stop >= 0 else len(code)
            elif brace >= 0 and (stop < 0 or brace < stop):
                end = _match(code, brace)
            elif kind in ("struct", "function", "trait") and stop >= 0:
                if kind == "function":
                    continue  # a declaration without a body
                end = stop + 1
            else:
                continue
            name = m[1]
            if kind == "impl":
                impls.append((m.start(), end))
                name = re.split(r"\bfor\s+", name)[-1].strip()
                name = re.sub(r"<.*", "", name).split("::")[-1].strip() or "anonymous"
            out.append((kind, name, m.start(), end))
    return out


def _c(code: str) -> list[tuple[str, str, int, int]]:
    code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m.group()), code)
    out = []
    for m in _C_TYPE.finditer(code):
        kind = m[1].split()[0]
        end = _match(code, m.end() - 1)
        tail = re.compile(r"\s*([^;{}]*);").match(code, end)
        if m.group().lstrip().startswith("typedef") and tail:
            for alias in tail[1].split(","):
                name = re.sub(r"[*&\s]|\[.*", "", alias)
                if name:
                    out.append(("type", name, m.start(), tail.end()))
        if m[2]:
            out.append((kind, m[2], m.start(), tail.end() if tail and not tail[1].strip() else end))
    for m in _C_ALIAS.finditer(code):
        if m[1]:
            out.append(("type", m[1], m.start(), m.end()))
            continue
        body = m.group()[:-1]
        pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", body)
        names = [pointer[1]] if pointer else [re.sub(r"\[.*|[*&\s]", "", x.split()[-1]) for x in body.split(",") if x.split()]
        out.extend(("type", x, m.start(), m.end()) for x in names if x)
    for m in _C_FUNCTION.finditer(code):
        name = special_name(m[2])
        last = name.split("::")[-1]
        if last in _KEYWORDS or last.startswith("~") is False and m[1].split()[:1] and m[1].split()[0] in ("return", "else", "new", "throw", "case", "goto"):
            continue
        close = _match(code, m.end() - 1, "(", ")")
        body = re.compile(r"\s*(?:const\b|noexcept(?:\([^)]*\))?|override\b|final\b|&&?|->\s*[\w:<>,*&\s]+|\s|:\s*[^{};]*?[)}]\s*(?:,[^{};]*?[)}]\s*)*)*\{").match(code, close)
        if body:
            out.append(("function", name, m.start(1), _match(code, body.end() - 1)))
    return out
