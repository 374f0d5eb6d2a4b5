"""Encoding texts with a public byte-level BPE vocabulary (problem 8).

A text is read in chunks of bounded size by two transducers in a row, whatever its length:

1. The splitter cuts it into pieces. A piece that another one follows is final, but for a lone
   apostrophe (a contraction such as ``'ll`` can still arise). A piece that a chunk ends in and
   that is longer than LONG is passed on as it comes; of a run of blanks the last one is held back, as
   it may belong to the next word.
2. The merger takes the bytes of a piece one by one. The last token of the encoding of a prefix is
   the one token that ends there and fits the last token of the prefix before it. No token
   of the merge list is longer than L bytes, so the encoding of every longer prefix runs through
   one of the last L places: that is the lookahead that suffices. Once all of them lead back to
   the same place, the tokens before it are final; they are emitted and forgotten.

What the merger makes of short pieces is kept in a bounded table. Ids decode through an incremental byte-to-text state machine.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The splitting pattern of the public vocabulary, with its classes for
# ASCII texts and in full (white space as in Unicode's White_Space).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_ASCII = {"L": "A-Za-z", "N": "0-9", "S": r"\t-\r "}
_FULL = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"}


def _pattern(classes: dict[str, str]) -> str:
    pattern = _PATTERN
    for k, v in classes.items():
        pattern = pattern.replace("{%s}" % k, v)
    return pattern


_split_ascii = re.compile(_pattern(_ASCII)).findall
_split_full = regex.compile(_pattern(_FULL)).findall

#: Characters of a text that are read at a time, the length from which an open piece is passed on, and entries of a table.
CHUNK, LONG, CACHE = 1 << 16, 64, 1 << 17

_RUNS = [(regex.compile(r"[%s]" % c), regex.compile(r"[%s]*" % c)) for c in (_FULL["L"], _FULL["N"], _FULL["S"], "^" + "".join(_FULL.values()))]
_BLANKS = _RUNS[2][1]


def split(text: str) -> list[str]:
    return (_split_ascii if text.isascii() else _split_full)(text)


class Merger:
    """The ids of one piece whose bytes come bit by bit."""

    __slots__ = ("enc", "window", "last", "before")

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.window = bytearray()  # bytes since the last emitted token
        self.last: list[tuple[int, int]] = []  # for each of them, the token that ends there and its start
        self.before: int | None = None  # the last emitted token

    def push(self, data: bytes) -> list[int]:
        """The ids that became final."""
        enc, window, last, out = self.enc, self.window, self.last, []
        ranks, sizes, fits, look = enc.ranks, enc.sizes, enc.fits, enc.lookahead
        for byte in data:
            window.append(byte)
            n = len(window)
            for size in sizes[bytes(window[-2:])] if n > 1 else (1,):
                if size > n:
                    continue
                t = ranks.get(bytes(window[n - size :]))
                if t is None:
                    continue
                p = last[n - size - 1][0] if n > size else self.before
                if p is None or fits[p, t]:
                    last.append((t, n - size))
                    break
            if n >= 4 * look and n % look == 0:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Emit what all of the last places lead back to."""
        last, n = self.last, len(self.window)
        live, at = set(range(n - self.enc.lookahead + 1, n + 1)), n
        while len(live) > 1:
            if at in live:
                live.remove(at)
                live.add(last[at - 1][1])
            at -= 1
        cut = live.pop()
        ids = self._back(cut)
        if ids:
            self.before = ids[-1]
            del self.window[:cut]
            last[:] = [(t, s - cut) for t, s in last[cut:]]
        return ids

    def _back(self, at: int) -> list[int]:
        ids = []
        while at > 0:
            t, at = self.last[at - 1]
            ids.append(t)
        return ids[::-1]

    def end(self) -> list[int]:
        return self._back(len(self.window))


class _Fits(dict):
    """Whether a token followed by another is how the bytes of both are encoded."""

    def __init__(self, enc: Encoder):
        self.enc = enc

    def __missing__(self, key: tuple[int, int]) -> bool:
        if len(self) >= CACHE:
            self.clear()
        tokens = self.enc.tokens
        self[key] = ok = self.enc.merge(tokens[key[0]] + tokens[key[1]]) == list(key)
        return ok


class _Sizes(dict):
    """Lengths of the tokens that end in two bytes, the longest first; of any two bytes at least that of the single byte."""

    def __missing__(self, key: bytes) -> tuple[int, ...]:
        return (1,)


class Encoder(dict):
    """Maps a piece to its ids; a dict, so that looking up known pieces stays in C."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.fits = _Fits(self)
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > 1:
                ends.setdefault(t[-2:], {1}).add(len(t))
        self.sizes = _Sizes((k, tuple(sorted(v, reverse=True))) for k, v in ends.items())
        #: The sufficient lookahead, from the merge list: the length of its longest token.
        self.lookahead = max(map(len, ranks))

    def __missing__(self, piece: str) -> list[int]:
        m = Merger(self)
        ids = m.push(piece.encode("utf-8", "replace")) + m.end()
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        """The merges of a few bytes in order of rank, the leftmost of equal ones first."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """The ids of a text that comes in chunks, as they become final."""
        held, run, merger = "", None, None
        for chunk in chunks:
            text = held + chunk
            if merger:  # the piece that the last chunk ended in goes on
                stop = run.match(text).end()
                keep = 1 if run is _BLANKS else 0
                yield merger.push(text[: stop - keep].encode("utf-8", "replace"))
                if stop == len(text):
                    held = text[stop - keep :]
                    continue
                yield merger.end()
                text, merger = text[stop - keep :], None
            pieces = split(text)
            held = pieces.pop() if pieces else ""
            if pieces and pieces[-1] == "'":
                held = pieces.pop() + held
            yield list(chain.from_iterable(map(self.__getitem__, pieces)))
            if len(held) > LONG:
                run = next(r for one, r in _RUNS if one.match(held[-1]))
                keep = 1 if run is _BLANKS else 0
                merger = Merger(self)
                yield merger.push(held[: len(held) - keep].encode("utf-8", "replace"))
                held = held[len(held) - keep :]
        if merger:
            yield merger.push(held.encode("utf-8", "replace"))
            yield merger.end()
        else:
            yield list(chain.from_iterable(map(self.__getitem__, split(held))))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; of null and empty texts none."""
        if not text:
            return []
        return list(chain.from_iterable(self.stream(text[i : i + CHUNK] for i in range(0, len(text), CHUNK))))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := state.decode(self.tokens[i]):
                yield out
        if out := state.decode(b"", True):
            yield out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a rank file: lines of a base64 token and its rank. One per Python worker."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key, ids``: one row per row of df, also for null and empty texts, whose list is empty. Other columns are not read."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            flat, ends = [], [0]
            for t in b.column(1):
                flat += enc.encode(t.as_py())
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key, tokens``: the number of tokens of each text, 0 for null and empty ones."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "tokens"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, tokens long")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key, digest``: the MD5 digest of what the ids of a text decode to (of null that of the empty text)."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            digests = [hashlib.md5(enc.decode(enc.encode(t.as_py())).encode()).hexdigest() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], names=[key, "digest"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, digest string").select(key, F.col("digest"))
