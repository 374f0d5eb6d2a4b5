"""Scalar functions over text: path folding, byte budgets, token estimates, hashes, tokenisers, categories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 64-bit FNV-1a constants.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
# Words that a task description is searched without.
STOPWORDS = (
    "the", "and", "for", "with", "from", "into", "this", "that", "what", "when", "where",
    "why", "how", "does", "will", "would", "should", "could", "code", "repo", "project",
)


def fnv1a64(data: bytes) -> str:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a64_many(texts: list[str | None]) -> list[str | None]:
    """Hashes of many texts at once: byte k of all texts that long is folded in one vector step."""
    data = [t.encode() if t is not None else b"" for t in texts]
    order = np.argsort([-len(d) for d in data], kind="stable")
    sizes = np.array([len(data[i]) for i in order], dtype=np.int64)
    h = np.full(len(data), FNV_OFFSET, dtype=np.uint64)
    if len(data) and sizes[0]:
        flat = np.frombuffer(b"".join(data[i] for i in order), dtype=np.uint8).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        prime, live = np.uint64(FNV_PRIME), len(data)
        for k in range(int(sizes[0])):
            while live and sizes[live - 1] <= k:
                live -= 1
            if live < 8:  # a few long texts are left
                for j in range(live):
                    x = int(h[j])
                    for b in data[order[j]][k:]:
                        x = ((x ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
                    h[j] = x
                break
            h[:live] = (h[:live] ^ flat[starts[:live] + k]) * prime
    out: list[str | None] = [None] * len(data)
    for j, i in enumerate(order):
        if texts[i] is not None:
            out[i] = f"{int(h[j]):016x}"
    return out


def with_fnv(df: DataFrame, text: str, to: str) -> DataFrame:
    """df without the text column but with its FNV-1a hash (null of null); other columns pass through."""
    keep = [c for c in df.columns if c != text]

    def run(batches):
        for b in batches:
            h = pa.array(fnv1a64_many(b.column(text).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], h], names=[*keep, to])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{fields}, `{to}` string" if keep else f"`{to}` string")


def tokens_up(text: Column) -> Column:
    """Packet estimate: bytes / 4, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def tokens_down(text: Column) -> Column:
    """Capsule estimate: bytes / 4, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def saved_share(full: Column, used: Column) -> Column:
    """Percentage saved, 0 where there was nothing."""
    return F.when(full > 0, F.greatest(full - used, F.lit(0)) * 100.0 / full).otherwise(0.0)


def prefix_bytes(text: str, limit: int, keep_crossing: bool = False) -> str:
    """The longest prefix of at most ``limit`` bytes; with ``keep_crossing`` the character that crosses the limit stays."""
    data = text.encode()
    if len(data) <= limit:
        return text
    cut = limit
    while cut > 0 and data[cut] & 0xC0 == 0x80:
        cut -= 1
    if keep_crossing and cut < limit:
        cut += 1
        while cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut += 1
    return data[:cut].decode()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def match_lower(text: Column) -> Column:
    """Lower case to look for ASCII words in: faster than folding ASCII alone, as signs that would become ASCII letters are taken out."""
    for sign in ("\u212a", "\u0130"):
        text = F.replace(text, F.lit(sign), F.lit("\ufffd"))
    return F.lower(text)


def contains_folded(text: Column, part: str) -> Column:
    """LIKE '%part%' without regard to ASCII case, with nothing in part taken as a wildcard."""
    return ascii_lower(text).contains(part.lower())


def search_tokens(c: Column) -> Column:
    """Runs of letters and digits, lower case, without diacritics."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def task_terms(task: str) -> list[str]:
    """Sorted distinct terms of a task: runs of ASCII letters, digits and underscores, lower case, of 3 or more, without stopwords."""
    low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in task)
    words = "".join(ch if ("a" <= ch <= "z") or ch.isdigit() and ch.isascii() or ch == "_" else " " for ch in low).split()
    return sorted({w for w in words if len(w) >= 3 and w not in STOPWORDS})


def capped_count(text: Column, term: str, cap: int = 5) -> Column:
    """Occurrences of a term that don't overlap, at most ``cap``; none in null."""
    n = ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")
    return F.least(F.coalesce(n, F.lit(0)), F.lit(cap))


# Parts of failure messages and their category; the first that occurs decides.
FAILURES = (
    ("not found in repo", "symbol_not_found"),
    ("registered workspace", "repo_not_found"),
    ("missing required argument", "invalid_params"),
    ("invalid", "invalid_params"),
    ("mutex", "internal"),
    ("poisoned", "internal"),
)


def failure_category(message: Column) -> Column:
    """One of five categories; of a null message ``other``."""
    out = None
    for part, name in FAILURES:
        hit = message.contains(part)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def thousands(n: int) -> str:
    return f"{n:,}"


def human_size(n: float) -> str:
    return f"{n:.0f}" if n < 1000 else f"{n / 1000:.1f}k" if n < 1_000_000 else f"{n / 1_000_000:.1f}M"
