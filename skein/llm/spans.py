"""Long exact spans shared between records (problem 1).

A log-structured fingerprint index: texts arrive in batches; of each batch the window hashes
are chosen by winnowing and written as one immutable run, bucketed and sorted by hash; the
run is merge-joined with every earlier run, bucket by bucket and without moving the
history; what they share is verified on the texts; when there are enough runs they
are compacted into one.

Winnowing keeps, of every W consecutive hashes of K characters, the smallest. With
W + K - 1 = the least span length, two texts that share a span of that length have a
chosen window in common inside it, so nothing is missed. Verification compares the
characters around each common window: a span holds it exactly if the equal characters to
its left and right, with its own, are enough. A window that very many different
surroundings share (a short common header, say) isn't compared pair by pair: each
occurrence is keyed by the digests of the spans of least length that hold it, so that
only equal spans meet.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources.tables import checkpoint, drop_shared, newest, read_shared, shared_dir, write_shared

MIN_LENGTH = 300
#: Batches of a whole table; runs that are compacted into one; different surroundings of a window that are compared pairwise.
BATCHES, FAN_IN, PAIRWISE = 3, 2, 64
#: Texts that one bucket holds on average, and the most buckets.
PER_BUCKET, MOST_BUCKETS = 20_000, 20_000
#: The digests of at most so many texts (some 50 bytes each) are broadcast to pick them; more are picked by a join.
BROADCAST_TEXTS = 100_000

_BASE = 6364136223846793005
_INVERSE = pow(_BASE, -1, 1 << 64)
_u = np.uint64


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if cache.get("n", 0) < n:
        n = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("q", _INVERSE)):
            cache[key] = np.cumprod(np.concatenate([[_u(1)], np.full(n, base, dtype=_u)]))
        cache["n"] = n
    return cache["p"], cache["q"]


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(a)
    pad = -n % w
    x = np.concatenate([a, np.full(pad, a.dtype.type(np.iinfo(a.dtype).max))]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def fingerprints(text: str, length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Chosen window hashes of a text and their positions; none of a text shorter than ``length``."""
    k = length // 3
    w = length - k + 1
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_u)
    n = len(a)
    p, q = _powers(n)
    a *= _u(0x9E3779B97F4A7C15)
    a ^= a >> _u(29)
    a *= p[:n]
    s = np.concatenate([[_u(0)], np.cumsum(a)])
    h = (s[k:] - s[:-k]) * q[: n - k + 1]
    h ^= h >> _u(32)
    h *= _u(0xD6E8FEB86659FD93)
    h ^= h >> _u(29)
    low = _sliding_min(h, w)
    edge = np.zeros(w - 1, dtype=_u)
    # a hash is chosen if it is the least of some window: the greatest of the minima around it is itself
    top = ~_sliding_min(~np.concatenate([edge, low, edge]), w)
    at = np.flatnonzero(top[: len(h)] == h)
    return h[at].view(np.int64), at.astype(np.int32)


class SpanIndex:
    """Sorted immutable runs of window hashes ``h, t, pos, lo, hi``: t identifies the text, lo and hi are the
    least and greatest number of the repositories that hold it."""

    def __init__(self, spark: SparkSession, buckets: int, length: int = MIN_LENGTH):
        self.spark, self.buckets, self.length = spark, buckets, length
        self.k = length // 3
        self.runs: list[str] = []
        self.places: dict[str, str] = {}

    def save(self, df: DataFrame, key: str) -> str:
        """Write df, which is partitioned by the key into as many parts as there are buckets."""
        name = f"skein_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        df.write.bucketBy(self.buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
        self.places[name] = path
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_shared(self.spark, self.places.pop(name))

    def close(self) -> None:
        for name in list(self.places):
            self.drop(name)

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            old = self.runs
            every = self.spark.table(old[0])
            for r in old[1:]:
                every = every.union(self.spark.table(r))
            self.runs = [self.save(every.repartition(self.buckets, "h"), "h")]
            for r in old:
                self.drop(r)

    def add(self, texts: DataFrame) -> DataFrame:
        """Index a batch ``t, hs, ps, lo, hi`` (hs and ps: the fingerprints of a text and their places) and return the
        occurrences ``h, t, pos, lo, hi`` of the windows that the batch shares with other repositories, in it or in the history.

        Runs are met bucket by bucket; neither they nor the batch are moved once written.
        """
        if len(self.runs) >= FAN_IN:
            self.compact()
        rows = texts.select("t", F.explode(F.arrays_zip("hs", "ps")).alias("f"), "lo", "hi")
        rows = rows.select(F.col("f.hs").alias("h"), "t", F.col("f.ps").alias("pos"), "lo", "hi")
        fresh = self.save(rows.repartition(self.buckets, "h"), "h")
        met = self.spark.table(fresh).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        for i, r in enumerate(self.runs):
            old = self.spark.table(r).groupBy("h").agg(F.min("lo").alias(f"lo{i}"), F.max("hi").alias(f"hi{i}"))
            met = met.join(old.hint("merge"), "h", "left")
        several = range(len(self.runs))
        low, high = F.least("lo", *[f"lo{i}" for i in several]) if self.runs else F.col("lo"), F.greatest("hi", *[f"hi{i}" for i in several]) if self.runs else F.col("hi")
        self.runs.append(fresh)
        hot = checkpoint(met.filter(low < high).select("h").distinct())
        found = None
        for r in self.runs:
            o = self.spark.table(r).join(hot, "h", "left_semi")
            found = o if found is None else found.union(o)
        # what is shared is little: the exchange gathers it from the buckets into a few parts
        return checkpoint(found.distinct())


def _surroundings(nodes: DataFrame, each: DataFrame, occurrences: DataFrame, length: int) -> DataFrame:
    """Each occurrence with the characters around its window: ``h, m, pos, lo, hi, left, ctx``. Texts are read again, so
    that only those with an occurrence are moved; of repeated texts one a task."""
    k = length // 3
    reach = length - k
    per_text = occurrences.groupBy("t").agg(F.collect_set(F.struct("h", "pos")).alias("at"))
    per_text = checkpoint(per_text.join(each.select("t", F.col("_m").alias("m"), "lo", "hi"), "t").drop("t"))
    texts = nodes.filter(F.length("raw_text") >= length).select(F.md5("raw_text").alias("m"), F.col("raw_text").alias("text"))
    if per_text.count() <= BROADCAST_TEXTS:
        texts = texts.join(F.broadcast(per_text.select("m")), "m", "left_semi")
    joined = texts.dropDuplicates(["m"]).join(per_text, "m")

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for m, text, lo, hi, at in zip(*(b.column(c).to_pylist() for c in ("m", "text", "lo", "hi", "at"))):
                for x in at:
                    pos = x["pos"]
                    start = max(0, pos - reach)
                    if pos + k <= len(text):
                        for c, v in zip(cols, (x["h"], m, pos, lo, hi, pos - start, text[start : pos + k + reach])):
                            c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["h", "m", "pos", "lo", "hi", "left", "ctx"])

    return joined.select("m", "text", "lo", "hi", "at").mapInArrow(run, "h long, m string, pos int, lo int, hi int, left int, ctx string")


def _reach(a: str, la: int, b: str, lb: int, k: int) -> tuple[int, int] | None:
    """Equal characters to the left and right of the windows of two surroundings; None if the windows differ."""
    if a[la : la + k] != b[lb : lb + k]:
        return None
    x, y, n = a[:la][::-1], b[:lb][::-1], min(la, lb)
    left = n if x[:n] == y[:n] else next(i for i in range(n) if x[i] != y[i])
    x, y = a[la + k :], b[lb + k :]
    n = min(len(x), len(y))
    right = n if x[:n] == y[:n] else next(i for i in range(n) if x[i] != y[i])
    return left, right


_LINKS = "a string, b string, left int, right int"


def _compare(length: int):
    k = length // 3

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("c", "left", "ctx", "lo", "hi"))))
        out = []
        for i, (ca, la, a, lo, hi) in enumerate(rows):
            for cb, lb, b, lo2, hi2 in rows[i:]:
                if min(lo, lo2) == max(hi, hi2):
                    continue
                near = _reach(a, la, b, lb, k)
                if near and sum(near) + k >= length:
                    out.append((ca, cb, *near))
        return pa.Table.from_arrays(
            [pa.array([x[i] for x in out], pa.string() if i < 2 else pa.int32()) for i in range(4)], names=["a", "b", "left", "right"]
        )

    return run


def _digests(length: int):
    """Of each surroundings the digests of the spans of least length that hold the window, with the span's offset to it."""
    k = length // 3

    def run(batches):
        for b in batches:
            cs, ds, offs = [], [], []
            for c, left, ctx in zip(*(b.column(x).to_pylist() for x in ("c", "left", "ctx"))):
                for s in range(max(0, left + k - length), min(left, len(ctx) - length) + 1):
                    cs.append(c)
                    ds.append(hashlib.blake2b(ctx[s : s + length].encode(), digest_size=16).digest())
                    offs.append(left - s)
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.string()), pa.array(ds, pa.binary()), pa.array(offs, pa.int32())], names=["c", "d", "off"])

    return run


class Verified:
    """Surroundings ``c, m, pos, lo, hi`` of the texts, and verified links between surroundings: pairs ``a, b, left, right``
    and groups ``c, d, off`` of equal spans d."""

    def __init__(self, around: DataFrame, length: int):
        spark = around.sparkSession
        key = F.md5(F.concat_ws("\u0000", F.col("h").cast("string"), F.col("left").cast("string"), "ctx"))
        place = write_shared(around.withColumn("c", key).repartition("h"), "surroundings")
        around = read_shared(spark, place)
        kinds = around.groupBy("h", "c", "left").agg(F.first("ctx").alias("ctx"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        kinds = kinds.withColumn("n", F.count("*").over(Window.partitionBy("h")))
        self.members = checkpoint(around.select("c", "m", "pos", "lo", "hi").distinct())
        cols = ["h", "c", "left", "ctx", "lo", "hi"]
        self.pairs = checkpoint(kinds.filter((F.col("n") <= PAIRWISE) & ((F.col("n") > 1) | (F.col("lo") < F.col("hi")))).select(cols).groupBy("h").applyInArrow(_compare(length), _LINKS))
        self.groups = checkpoint(kinds.filter(F.col("n") > PAIRWISE).select("c", "left", "ctx").mapInArrow(_digests(length), "c string, d binary, off int"))
        drop_shared(spark, place)
        self.length, self.spark = length, spark


def _current(nodes: DataFrame, length: int) -> DataFrame:
    """Newest rows ``id, repo, m, chars, at`` with a text of at least ``length`` characters in a known repository, the
    repositories numbered."""
    rows = nodes.filter(F.col("id").isNotNull()).select(
        "id", "ingested_at", "repo_id", F.when(F.length("raw_text") >= length, F.md5("raw_text")).alias("m"), F.length("raw_text").alias("chars")
    )
    n = newest(rows, "id", "ingested_at", ["repo_id", "m", "chars"]).filter("m IS NOT NULL AND repo_id IS NOT NULL")
    # one row a repository: a short table
    numbers = nodes.select("repo_id").filter("repo_id IS NOT NULL").distinct().withColumn("repo", F.row_number().over(Window.orderBy("repo_id")))
    return n.join(numbers, "repo_id").select("id", "repo", "m", "chars", F.col("ingested_at").alias("at"))


def _fingerprinted(nodes: DataFrame, length: int, buckets: int) -> DataFrame:
    """The fingerprints ``t, m, hs, ps`` of distinct texts, partitioned by t. Repeated texts of a task are dropped before
    the exchange, which no text goes through."""

    def run(batches):
        seen: set[str] = set()
        for b in batches:
            keep, hs, ps = [], [], []
            for i, (m, text) in enumerate(zip(b.column("m").to_pylist(), b.column("text").to_pylist())):
                if m in seen:
                    continue
                seen.add(m)
                h, p = fingerprints(text, length)
                keep.append(i)
                hs.append(h)
                ps.append(p)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hs])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.empty(0, dt), kind)) for x, dt, kind in ((hs, np.int64, pa.int64()), (ps, np.int32, pa.int32()))]
            kept = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(kept) for c in ("t", "m")], *lists], names=["t", "m", "hs", "ps"])

    src = nodes.filter(F.length("raw_text") >= length).select(F.md5("raw_text").alias("m"), F.col("raw_text").alias("text")).select(F.xxhash64("m").alias("t"), "m", "text")
    one = src.mapInArrow(run, "t long, m string, hs array<long>, ps array<int>").repartition(buckets, "t")
    return one.dropDuplicates(["t", "m"])


def shared_spans(nodes: DataFrame, length: int = MIN_LENGTH, batches: int = BATCHES) -> tuple[DataFrame, Verified]:
    """The newest rows (``id, repo, m, chars``) and the verified links between their texts (m: the text's digest).

    Texts are compared as stored, by characters. Null and shorter texts, and rows without an id or repository, share nothing.
    Repeated rows count once. Texts enter the index by the time they were first seen.
    """
    spark = nodes.sparkSession
    now = checkpoint(_current(nodes, length))
    each = now.groupBy("m").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.min("at").alias("at"))
    at = F.unix_micros(F.col("at").cast("timestamp"))
    cuts = each.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    batch = F.lit(0)
    for c in cuts or []:
        batch = batch + F.when(at > c, 1).otherwise(0)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // PER_BUCKET))
    index = SpanIndex(spark, min(MOST_BUCKETS, buckets), length)
    each = each.select(F.xxhash64("m").alias("t"), F.col("m").alias("_m"), "lo", "hi", batch.alias("batch"))
    texts = _fingerprinted(nodes, length, index.buckets).join(each, "t").filter("m = _m").drop("m", "_m")
    store = spark.table(index.save(texts, "t"))
    found = None
    for i in range(batches):
        new = index.add(store.filter(F.col("batch") == i).select("t", "hs", "ps", "lo", "hi"))
        found = new if found is None else found.union(new)
    v = Verified(_surroundings(nodes, each, found, length), length)
    index.close()
    return now, v


def text_links(v: Verified) -> DataFrame:
    """Pairs ``x, y`` of different texts that share a span, x < y."""
    member = v.members.select("c", "m").distinct()
    a = v.pairs.select("a", "b").distinct().join(member.select(F.col("c").alias("a"), F.col("m").alias("x")), "a").join(member.select(F.col("c").alias("b"), F.col("m").alias("y")), "b")
    g = v.groups.select("c", "d").join(member, "c").select("d", "m").distinct()
    b = g.select("d", F.col("m").alias("x")).join(g.select("d", F.col("m").alias("y")), "d")
    return a.select("x", "y").union(b.select("x", "y")).filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def node_pairs(now: DataFrame, v: Verified) -> DataFrame:
    """Pairs ``id_a, id_b`` of nodes of different repositories that share a span, id_a < id_b."""
    left = now.select(F.col("id").alias("i"), F.col("repo").alias("ri"), F.col("m").alias("x"))
    right = now.select(F.col("id").alias("j"), F.col("repo").alias("rj"), F.col("m").alias("y"))
    many = now.groupBy("m").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi")).filter("lo < hi").select("m")
    same = left.join(many, F.col("x") == F.col("m"), "left_semi").join(right, F.col("x") == F.col("y"))
    linked = text_links(v).join(left, "x").join(right, "y")
    every = same.select("i", "ri", "j", "rj").union(linked.select("i", "ri", "j", "rj")).filter("ri <> rj")
    return every.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def coverage(now: DataFrame, v: Verified) -> DataFrame:
    """``id, partners, shared_chars, chars`` of each node that shares spans with nodes of other repositories: how many such
    nodes, and how many of its characters lie in a span that another repository holds too."""
    k = v.length // 3
    kinds = v.members.groupBy("c").agg(F.min("lo").alias("plo"), F.max("hi").alias("phi"))
    both = v.pairs.select("a", "b", "left", "right").union(v.pairs.filter("a <> b").select("b", "a", "left", "right"))
    p = (
        both.join(kinds.withColumnRenamed("c", "b"), "b").join(v.members.select(F.col("c").alias("a"), "m", "pos"), "a")
        .select("m", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + k + F.col("right")).alias("e"), "plo", "phi")
    )
    span = v.groups.join(v.members, "c")
    wide = span.groupBy("d").agg(F.min("lo").alias("plo"), F.max("hi").alias("phi")).filter("plo < phi")
    g = span.join(wide, "d").select("m", (F.col("pos") - F.col("off")).alias("s"), (F.col("pos") - F.col("off") + v.length).alias("e"), "plo", "phi")
    whole = now.groupBy("m").agg(F.min("repo").alias("plo"), F.max("repo").alias("phi"), F.max("chars").alias("e")).filter("plo < phi")
    w = whole.select("m", F.lit(0).alias("s"), "e", "plo", "phi")
    cuts = p.union(g).union(w).distinct().join(now.select("id", "repo", "m"), "m").filter("plo <> repo OR phi <> repo").select("id", "s", "e").distinct()
    before = F.max("e").over(Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    shared = (
        cuts.withColumn("to", F.coalesce(before, F.lit(0)))
        .groupBy("id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "to"))).alias("shared_chars"))
    )
    pairs = node_pairs(now, v)
    ends = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).groupBy("id").agg(F.count("*").alias("partners"))
    return shared.join(ends, "id", "left").join(now.select("id", "chars"), "id").select("id", F.coalesce("partners", F.lit(0)).alias("partners"), "shared_chars", "chars")
