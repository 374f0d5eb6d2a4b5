"""What the parsers share: languages, kinds, and symbols."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Stored bodies are cut at so many bytes, with a closing remark.
BODY_LIMIT = 50_000
CUT_REMARK = "\n/* ... cut ... */"
#: Larger files have a row but no symbols.
FILE_LIMIT = 2 * 1024 * 1024

# Extensions by language family, and kinds without calls or as targets of calls.
C_FAMILY = ("c", "cpp", "cc", "cxx", "h", "hpp")
EXTENSIONS = (*C_FAMILY, "py", "ts", "tsx", "rs", "rb")
NO_CALLS = ("interface", "type", "macro")
NO_CALLS_IN_C = ("struct", "union", "enum")


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    callees: list[str] = field(default_factory=list)


def has_calls(kind: str, ext: str) -> bool:
    return kind not in NO_CALLS and not (kind in NO_CALLS_IN_C and ext in C_FAMILY)


def capped(text: str) -> str:
    """A body of at most BODY_LIMIT bytes, the character that crosses the limit kept, with a remark where it was cut."""
    from skein.functions.text import prefix_bytes

    if len(text.encode()) <= BODY_LIMIT:
        return text
    return prefix_bytes(text, BODY_LIMIT, keep_crossing=True) + CUT_REMARK
