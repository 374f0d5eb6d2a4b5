"""Parent-child links to full hierarchies (problem 6).

Weighted disjoint sets: links are range-partitioned by child, so that the links of one file and
repository lie together; each task unites the links of its range in a forest that keeps
every node's offset to its root. Only nodes that another range's root points at stay in play. They
are merged hierarchically: FAN_IN neighbouring ranges are united at a time, and again, until
nothing points out of its range or one range is left; offsets are added on the way back
down. A cycle is closed in the range in which its last link is united, and named there.

Paths are materialised by traversal along a parent index: within a range each node's parent is looked
up until the range's own root; the paths of those roots, which are few, were put together in
the same merges. So no path is moved but those of the roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import checkpoint

#: Links that one task unites, and ranges that are merged at a time; a merge takes at most twice as many rows as a range has links.
LINKS_PER_TASK, FAN_IN = 200_000, 4
#: Rows of a batch.
BATCH = 20_000

_LINKS = "part long, node string, up string, dist long, low string, cycle string, parent string"
_MERGED = "part long, node string, up string, dist long, low string, cycle string, seg array<string>"


def links_of(edges: DataFrame, kind: str = "IMPORTS") -> DataFrame:
    """Distinct ``child, parent`` of the edges of a type (without regard to case) with a non-null target.

    A child with several parents (not in this data) takes the smallest id; one without any is a root.
    """
    return (
        edges.filter((F.upper("relationship_type") == kind) & F.col("target_id").isNotNull())
        .groupBy(F.col("target_id").alias("child"))
        .agg(F.min("source_id").alias("parent"))
    )


class Forest:
    """Weighted disjoint sets over links from a node to the one above it. ``up`` holds of a node one above it, the number of links
    to that and the least id from the node to below it; ``rings`` the least id of the cycle that a root closes."""

    def __init__(self) -> None:
        self.up: dict[str, tuple[str, int, str]] = {}
        self.rings: dict[str, str] = {}

    def find(self, x: str) -> tuple[str, int, str | None]:
        """The root of x, the links to it, and the least id from x to below it; the way is shortened."""
        trail = []
        while x in self.up:
            trail.append(x)
            x = self.up[x][0]
        dist, low = 0, None
        for y in reversed(trail):
            _, d, least = self.up[y]
            dist, low = dist + d, least if low is None else min(low, least)
            self.up[y] = (x, dist, low)
        return x, dist, low

    def unite(self, x: str, above: str, dist: int, low: str) -> None:
        """Hang the root x below another node."""
        root, d, least = self.find(above)
        low = low if least is None else min(low, least)
        if root == x:
            self.rings[x] = low
        else:
            self.up[x] = (root, dist + d, low)

    def place(self, x: str) -> tuple[str | None, int, str | None, str | None]:
        """``up, dist, low, cycle`` of a node that was united."""
        root, dist, low = self.find(x)
        if root in self.rings:
            return None, 0, None, self.rings[root]
        return root, dist, low, None


def _arrow(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"part": pa.int64(), "dist": pa.int64(), "depth": pa.int64(), "seg": pa.list_(pa.string()), "path": pa.list_(pa.string())}
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, cols)], names=names)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _unite_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[str, str] = {}
    for b in batches:
        parent.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    f, part = Forest(), TaskContext.get().partitionId()
    for x, p in parent.items():
        f.unite(x, p, 1, x)
    rows = []
    for x, p in parent.items():
        rows.append((part, x, *f.place(x), p))
        if len(rows) == BATCH:
            yield _arrow(rows, _names(_LINKS))
            rows = []
    yield _arrow(rows, _names(_LINKS))


def _merge(table: pa.Table) -> pa.Table:
    """United rows of several ranges, with the ids between a node and the one above it."""
    cols = [table.column(c).to_pylist() for c in _names(_MERGED)]
    f = Forest()
    for node, up, dist, low, cycle in zip(*cols[1:6]):
        if cycle is None:
            f.unite(node, up, dist, low)
        else:
            f.rings[node] = cycle
    paths = table.column("seg").null_count < table.num_rows
    at = dict(zip(cols[1], zip(cols[2], cols[6]))) if paths else {}
    out = []
    for part, node, seg in zip(cols[0], cols[1], cols[6]):
        up, dist, low, cycle = f.place(node)
        if paths and seg is not None and cycle is None:
            parts, x = [], node
            while x in at:
                x, own = at[x]
                parts.append(own)
            seg = [i for p in reversed(parts) for i in p]
        out.append((part, node, up, dist, low, cycle, None if cycle is not None else seg))
    return pa.Table.from_batches([_arrow(out, _names(_MERGED))])


def _local(links: DataFrame) -> DataFrame:
    given = checkpoint(links.filter(F.col("parent").isNotNull()))
    parts = max(1, -(-given.count() // LINKS_PER_TASK), min(6, links.sparkSession.sparkContext.defaultParallelism))
    return checkpoint(given.repartitionByRange(parts, "child").mapInArrow(_unite_range, _LINKS))


def _pointed_at(rows: DataFrame) -> DataFrame:
    """Rows of nodes that a root of another range is."""
    tops = rows.filter(F.col("up").isNotNull()).select(F.col("up").alias("_top")).distinct()
    return rows.join(tops, F.col("node") == F.col("_top"), "left_semi")


def _merged(carried: DataFrame) -> DataFrame:
    """``node, up, dist, cycle, seg`` of the carried rows, with ``up`` a root (null on or below a cycle)."""
    levels, seg = [], carried.schema["seg"].dataType
    while True:
        carried = checkpoint(carried.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")))
        largest = carried.groupBy("part").count().agg(F.max("count").alias("n")).first()["n"]
        if not largest:
            break
        if largest > 2 * LINKS_PER_TASK:
            # ranges that hardly share their links would outgrow a task: the rest is resolved by doubling
            levels.append(_double(carried))
            break
        level = checkpoint(carried.groupBy("part").applyInArrow(_merge, _MERGED))
        levels.append(level)
        carried = _pointed_at(level)
    if not levels:
        return carried.select("node", "up", "dist", "cycle", F.col("seg").cast(seg))
    done = levels[-1].select("node", "up", "dist", "cycle", "seg")
    for level in reversed(levels[:-1]):
        done = checkpoint(_below(level, done))
    return done


def _below(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose ``up`` may be a node of done, up to the roots."""
    d = done.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("dist").alias("_d"), F.col("cycle").alias("_c"), F.col("seg").alias("_s"))
    j = rows.join(d, rows.up == F.col("_n"), "left")
    ring = F.coalesce("cycle", "_c")
    return j.select(
        "node", F.when(ring.isNull(), F.coalesce("_u", "up")).alias("up"), F.when(ring.isNull(), F.col("dist") + F.coalesce("_d", F.lit(0))).otherwise(0).alias("dist"),
        ring.alias("cycle"), F.when(F.col("_s").isNull(), F.col("seg")).otherwise(F.concat("_s", "seg")).alias("seg"),
    )


def _double(rows: DataFrame) -> DataFrame:
    """As merging, by pointer doubling, for rows of any number."""
    state, before = rows.select("part", "node", "up", "dist", "low", "cycle", "seg"), None
    while True:
        # open: the pointer is itself an unresolved child
        t = state.select(*[F.col(c).alias(f"_{c}") for c in ("node", "up", "dist", "low", "cycle", "seg")])
        j = state.join(t, (state.up == F.col("_node")) & state.cycle.isNull(), "left")
        nxt = checkpoint(j.select(
            "part", "node",
            F.when(F.col("_cycle").isNull(), F.coalesce("_up", "up")).alias("up"),
            (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            F.least("low", "_low").alias("low"),
            F.coalesce("cycle", "_cycle").alias("cycle"),
            F.when(F.col("_seg").isNull(), F.col("seg")).otherwise(F.concat("_seg", "seg")).alias("seg"),
            F.col("_up").isNotNull().alias("open"),
        ))
        now = nxt.agg(F.count_if("open").alias("a"), F.count_distinct(F.when(F.col("open"), F.col("up"))).alias("b")).first()
        state = nxt.drop("open")
        if not now["a"]:
            return state
        if before == (now["a"], now["b"]):
            break
        before = (now["a"], now["b"])
    # what is open now runs into cycles, and its pointers are exactly the nodes on them
    still = nxt.filter("open").drop("open")
    ring = checkpoint(still.join(still.select(F.col("up").alias("_r")).distinct(), F.col("node") == F.col("_r"), "left_semi").select("node", "up", "low"))
    while True:
        t = ring.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("low").alias("_l"))
        both = checkpoint(ring.join(t, ring.up == F.col("_n")).select("node", F.col("_u").alias("up"), F.least("low", "_l").alias("low"), (F.col("_l") < F.col("low")).alias("moved")))
        ring = both.drop("moved")
        if not both.filter("moved").limit(1).count():
            break
    r = ring.select(F.col("node").alias("_n"), F.col("low").alias("_low"))
    j = state.join(r, state.up == F.col("_n"), "left")
    return checkpoint(j.select("part", "node", F.when(F.col("_low").isNull(), F.col("up")).alias("up"), "dist", "low", F.coalesce("cycle", "_low").alias("cycle"), "seg"))


def _no_seg(rows: DataFrame) -> DataFrame:
    return rows.select("part", "node", "up", "dist", "low", "cycle", F.lit(None).cast("array<string>").alias("seg"))


def _tops(links: DataFrame, local: DataFrame) -> DataFrame:
    """Roots of the whole forest: local roots and lone nodes that are no children."""
    tops = local.select(F.col("up").alias("node")).filter(F.col("node").isNotNull()).union(links.filter(F.col("parent").isNull()).select("child")).distinct()
    return tops.join(local.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")


def resolve(links: DataFrame) -> DataFrame:
    """``node, root, depth, cycle``: root and depth for nodes of trees,
    the smallest id of the cycle (root and depth null) for nodes on or below a cycle.

    Has one row for each child and each root. Empty links give no rows.
    """
    links = checkpoint(links)
    local = _local(links)
    every = _below(_no_seg(local), _merged(_no_seg(_pointed_at(local))))
    below = every.select("node", F.col("up").alias("root"), F.when(F.col("cycle").isNull(), F.col("dist")).alias("depth"), "cycle")
    return below.union(_tops(links, local).select("node", F.col("node"), F.lit(0).cast("long"), F.lit(None).cast("string")))


def _trace(out: str):
    """Walks along the parent index of a range, for rows sorted by range and, in it, ``kind``: 0 the paths of roots from elsewhere, 1 the
    links, 2 nodes that are asked for. Gives segments of those asked for (out is ``seg``) or the paths of all (``path``)."""
    names = ["part", "node", "seg"] if out == "seg" else ["node", "root", "depth", "path"]

    def run(batches):
        part, parent, heads, rows = None, {}, {}, []

        def walk(x: str) -> list[str] | None:
            seg = []
            while x in parent:
                seg.append(x)
                x = parent[x]
            if out == "seg":
                return seg[::-1]
            head = heads.get(x)
            return None if head is None else head + seg[::-1]

        def paths():
            for x in parent if out == "path" else ():
                if (p := walk(x)) is not None:
                    yield (x, p[0], len(p) - 1, p)

        for b in batches:
            for g, kind, node, up, path in zip(*(b.column(i).to_pylist() for i in range(5))):
                if g != part:
                    for r in paths():
                        rows.append(r)
                        if len(rows) == BATCH:
                            yield _arrow(rows, names)
                            rows = []
                    part, parent, heads = g, {}, {}
                if kind == 0:
                    heads[node] = path
                elif kind == 1:
                    parent[node] = up
                else:
                    rows.append((g, node, walk(node)))
            if len(rows) >= BATCH:
                yield _arrow(rows, names)
                rows = []
        for r in paths():
            rows.append(r)
            if len(rows) == BATCH:
                yield _arrow(rows, names)
                rows = []
        yield _arrow(rows, names)

    return run


def _by_range(links: DataFrame, more: DataFrame) -> DataFrame:
    """Both as ``part, kind, node, up, path``, each range in one task."""
    every = links.select("part", F.lit(1).alias("kind"), "node", F.col("parent").alias("up"), F.lit(None).cast("array<string>").alias("path")).union(more)
    return every.repartition("part").sortWithinPartitions("part", "kind")


def hierarchy(links: DataFrame) -> DataFrame:
    """``node, root, depth, path``: the path from the root to each node of a tree, as an array of ids. Nodes on or below a cycle have none."""
    links = checkpoint(links)
    local = _local(links)
    sound = local.filter(F.col("cycle").isNull())
    none = F.lit(None).cast("array<string>")
    carried = checkpoint(_pointed_at(local))
    asked = carried.filter(F.col("cycle").isNull()).select("part", F.lit(2), "node", F.lit(None).cast("string"), none)
    segs = _by_range(sound, asked).mapInArrow(_trace("seg"), "part long, node string, seg array<string>")
    carried = carried.join(segs, ["part", "node"], "left").select("part", "node", "up", "dist", "low", "cycle", "seg")
    merged = checkpoint(_merged(carried)).filter(F.col("cycle").isNull())
    merged = merged.select(F.col("node").alias("_n"), F.concat(F.array("up"), "seg").alias("_path"))
    roots = checkpoint(_tops(links, local))
    heads = sound.select("part", "up").distinct().join(merged, F.col("up") == F.col("_n"), "left").join(roots.select(F.col("node").alias("_r")), F.col("up") == F.col("_r"), "left")
    heads = heads.filter("_path IS NOT NULL OR _r IS NOT NULL").select("part", F.lit(0), "up", F.lit(None).cast("string"), F.coalesce("_path", F.array("up")))
    out = _by_range(sound, heads).mapInArrow(_trace("path"), "node string, root string, depth long, path array<string>")
    return out.union(roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long"), F.array("node")))


def descendants(paths: DataFrame) -> DataFrame:
    """``node, descendant, distance`` of each node and each node below it in its tree."""
    return paths.select(
        F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("i", "node")
    ).select("node", "descendant", (F.col("depth") - F.col("i")).alias("distance"))


def cycles(resolved: DataFrame) -> DataFrame:
    """Each cycle by its smallest id, with the number of nodes on or below it."""
    return resolved.filter(F.col("cycle").isNotNull()).groupBy("cycle").agg(F.count("*").alias("nodes"))
