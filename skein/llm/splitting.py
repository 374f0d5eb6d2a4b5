"""Splitting oversized texts at natural boundaries (problem 7).

Structure-tree packing. The lines of a text form a tree: in code by indentation (a declaration with the
comments and attributes above it, its body, its closing line); in markup by headings, then by
list items, elements and paragraphs. From the root on, a subtree that fits stays whole, and only oversized ones
are descended into, down to lines and, for a line that is too long itself, characters. On the way up
neighbouring siblings are merged to the limit, innermost first. Sizes are bytes of UTF-8.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import newest

#: The greatest piece and the overlap in bytes; levels of nesting that are told apart.
LIMIT, OVERLAP, DEEPEST = 6000, 200, 200

# Extensions of markup.
MARKUP = ("md", "markdown", "mdx", "rst", "txt", "adoc", "html", "htm", "xml")

_CLOSING = re.compile(rb"^(?:[)\]}>]+[;,)]*|end\b.*|\} *(?:else|catch|finally|while)\b.*|else\b.*|elsif\b.*|elif\b.*|except\b.*|rescue\b.*|finally\b.*|ensure\b.*|when\b.*|case\b.*|default\b.*)$")
_LEADING = re.compile(rb"^(?:#|//|/\*|\*|@|--)")


def _width(line: bytes) -> int:
    """Columns of indentation, a tab going to the next multiple of 4; -1 for a blank line."""
    n = 0
    for c in line:
        if c == 32:
            n += 1
        elif c == 9:
            n += 4 - n % 4
        elif c in b"\r\n":
            return -1
        else:
            return n
    return -1


class _Tree:
    """The lines of a text and the subtrees of a range of them."""

    def __init__(self, data: bytes, markup: bool):
        self.lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x))
        self.widths = [_width(x) for x in self.lines]
        self.levels = _heading_levels(self.lines) if markup else None

    def children(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The ranges of lines that lie directly below a range; the single lines of one without structure."""
        for cut in (self._sections, self._subtrees):
            parts = cut(lo, hi)
            if len(parts) > 1:
                return parts
        return [(i, i + 1) for i in range(lo, hi)]

    def _sections(self, lo: int, hi: int) -> list[tuple[int, int]]:
        if self.levels is None:
            return []
        # the heading of the range itself belongs to its first part
        below = [self.levels[i] for i in range(lo + 1, hi) if self.levels[i]]
        heads = [i for i in range(lo + 1, hi) if below and self.levels[i] == min(below)]
        if not heads:  # paragraphs: after blank lines
            heads = [i for i in range(lo + 1, hi) if self.widths[i] >= 0 and self.widths[i - 1] < 0]
        cut = [lo, *heads, hi]
        return list(zip(cut, cut[1:]))

    def _subtrees(self, lo: int, hi: int) -> list[tuple[int, int]]:
        widths, lines = self.widths, self.lines
        inner = [w for w in widths[lo:hi] if w >= 0]
        base = min(inner, default=0)
        # a first line without its own indentation heads everything below it
        if widths[lo] == base and sum(w == base for w in inner) == 1 and hi - lo > 1:
            return [(lo, lo + 1), (lo + 1, hi)]
        heads, above = [lo], None  # first lines of the subtrees; start of comments that lead the next one
        for i in range(lo, hi):
            if widths[i] != base:
                continue
            text = lines[i].strip()
            if _LEADING.match(text):
                above = i if above is None else above
            elif _CLOSING.match(text):
                above = None
            else:
                heads.append(i if above is None else above)
                above = None
        heads = sorted(set(heads))
        if len(heads) == 1:  # one subtree: its head line, its body, its closing lines
            end = hi
            while end > lo + 1 and widths[end - 1] <= base:
                end -= 1
            heads = [lo, lo + 1, *([end] if lo + 1 < end < hi else [])] if lo + 1 < end else []
        cut = [*heads, hi]
        return list(zip(cut, cut[1:]))

    def pack(self, lo: int, hi: int, room: int, first: int, depth: int = 0) -> list[tuple[int, int]]:
        """Byte ranges of at most ``room``, the first of ``first`` where that is possible, but for single lines: siblings merged bottom-up."""
        a, b = self.starts[lo], self.starts[hi]
        if b - a <= room or hi - lo == 1:
            return [(a, b)]
        out: list[tuple[int, int]] = []
        # indentation deeper than DEEPEST levels is taken line by line
        for x, y in self.children(lo, hi) if depth < DEEPEST else [(i, i + 1) for i in range(lo, hi)]:
            # what heads an oversized subtree, if it is little, goes with the beginning of it
            cap, have = first if len(out) < 2 else room, out[-1][1] - out[-1][0] if out else 0
            for c, d in self.pack(x, y, room, cap - have if 4 * have <= cap else room, depth + 1):
                if out and d - out[-1][0] <= (first if len(out) == 1 else room):
                    out[-1] = (out[-1][0], d)
                else:
                    out.append((c, d))
        return out


def _heading_levels(lines: list[bytes]) -> list[int]:
    """The level of each line that is a heading, of the others 0: marked by number signs, by an underline, or as an element."""
    out, fenced = [], False
    for i, x in enumerate(lines):
        fenced ^= x.lstrip().startswith((b"```", b"~~~"))
        under = lines[i + 1].strip() if i + 1 < len(lines) else b""
        if fenced:
            out.append(0)
        elif m := re.match(rb"(#{1,6})\s|\s*<h([1-6])\b", x):
            out.append(len(m[1]) if m[1] else int(m[2]))
        elif x.strip() and len(under) >= 3 and set(under) in ({61}, {45}):
            out.append(1 if under[:1] == b"=" else 2)
        else:
            out.append(0)
    return out


def pieces(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP, markup: bool = False) -> list[tuple[int, int]]:
    """Byte ranges of the pieces of a UTF-8 text, each at most ``limit`` long, in order; each but the first
    starts ``overlap`` bytes before the end of the one before it, or up to 3 bytes less at a character."""
    if len(data) <= limit:
        return [(0, len(data))]
    room = limit - overlap
    tree = _Tree(data, markup)
    out: list[tuple[int, int]] = []
    parts = tree.pack(0, len(tree.lines), room, room)
    if len(parts) > 1 and parts[0][1] < overlap:  # too little to be repeated
        parts[:2] = [(0, parts[1][1])]
    for lo, hi in parts:
        while lo < hi:  # a line that is too long itself is cut between characters
            end = min(hi, lo + room)
            while end < hi and data[end] & 0xC0 == 0x80:
                end -= 1
            start = max(0, lo - overlap) if out else 0
            while start < lo and data[start] & 0xC0 == 0x80:
                start += 1
            out.append((start, end))
            lo = end
    return out


def oversized(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``id, language, start_line, end_line, raw_text`` of the newest rows whose text has more than ``limit`` bytes.

    Texts within the limit are dropped before the shuffle, which carries only their time.
    """
    slim = nodes.select(
        "id", "ingested_at", "language", "start_line", "end_line", F.when(F.octet_length("raw_text") > limit, F.col("raw_text")).alias("raw_text")
    )
    return newest(slim, "id", "ingested_at", ["raw_text", "language", "start_line", "end_line"]).filter(F.col("raw_text").isNotNull()).drop("ingested_at")


def split_nodes(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id, piece, pieces, start_line, end_line, text`` of each oversized newest text, pieces from 1 on.

    Lines are those that the piece's text, its overlap included, touches, at most end_line;
    null where the node has none. Null and short texts and rows without an id give no rows.
    """
    if overlap < 0 or limit < 2 * overlap + 8:
        raise ValueError("the limit must be at least twice the overlap and 8 bytes")

    def run(batches):
        for b in batches:
            rows = []
            for id_, text, language, first, last in zip(*(b.column(i).to_pylist() for i in range(5))):
                data = text.encode()
                cuts = pieces(data, limit, overlap, (language or "").lower() in MARKUP)
                line, at = 0, 0
                for k, (lo, hi) in enumerate(cuts):
                    line, at = (line + data.count(b"\n", at, lo), lo) if lo >= at else (line, at)
                    end = line + data.count(b"\n", lo, hi - 1)
                    clamp = lambda n: None if first is None else n + first if last is None else min(n + first, last)
                    rows.append((id_, k + 1, len(cuts), clamp(line), clamp(end), data[lo:hi].decode()))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "piece", "pieces", "start_line", "end_line", "text"])

    src = oversized(nodes, limit).select("id", "raw_text", "language", "start_line", "end_line")
    return src.mapInArrow(run, "id string, piece int, pieces int, start_line long, end_line long, text string")


def reassembled(split: DataFrame) -> DataFrame:
    """``id, pieces, largest, digest`` of the pieces of each text: their number, the bytes of the largest, and the MD5 digest of
    what they give without the bytes that each repeats of the one before."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("piece").to_pylist(), table.column("text").to_pylist()))
        data, largest = b"", 0
        for k, text in rows:
            own = text.encode()
            largest = max(largest, len(own))
            repeated = 0 if k == 1 else next(n for n in range(OVERLAP, OVERLAP - 4, -1) if data.endswith(own[:n]))
            data += own[repeated:]
        return pa.table({"id": [table.column("id")[0].as_py()], "pieces": pa.array([len(rows)], pa.int64()), "largest": pa.array([largest], pa.int64()), "digest": [hashlib.md5(data).hexdigest()]})

    return split.select("id", "piece", "text").groupBy("id").applyInArrow(run, "id string, pieces long, largest long, digest string")
