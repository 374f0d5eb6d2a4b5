"""The general data problems on small tables: nulls, ties, repeats, cycles, empty tables, extra columns; and against brute force."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import forest, heavy_keys, orphans

EDGES = "source_id string, target_id string, relationship_type string, seen_at timestamp"
NODES = "id string, repo_id string, file_path string, symbol_name string, ingested_at timestamp"
T = [datetime(2024, m, 1) for m in range(1, 13)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_targets_count_distinct_triples_and_repositories(spark):
    e = spark.createDataFrame(
        [("r1:a", "x", "CALLS", T[0]), ("r1:a", "x", "calls", T[1]), ("r1:a", "x", "IMPORTS", T[0]), ("r2:b", "x", "CALLS", None), ("r9:gone", "x", "CALLS", None), (None, "x", "CALLS", None), ("r1:a", None, "CALLS", T[0])], EDGES
    ).withColumn("repo_id", F.lit("clash"))
    n = spark.createDataFrame([("r1:a", "one", "f", "a", T[0]), ("r1:a", "one", "f", "a", T[0]), ("r2:b", "two", "f", "b", None)], NODES)
    assert rows(heavy_keys.target_counts(e, n)) == [("x", 5, 3)]


def test_names_without_a_name_count_in_the_total_only(spark):
    n = spark.createDataFrame([(str(i), "r", "f", None if i < 90 else "a" if i < 99 else "b", T[0]) for i in range(100)], NODES)
    c = heavy_keys.name_counts(n.union(n))
    assert rows(heavy_keys.heavy_keys(c, "symbol_name", 0.05)) == [("symbol_name", "a", 9, 1)]
    assert rows(heavy_keys.heavy_keys(c, "symbol_name", 0.01)) == [("symbol_name", "a", 9, 1), ("symbol_name", "b", 1, 1)]


def test_heavy_keys_of_empty_tables(spark):
    e, n = spark.createDataFrame([], EDGES), spark.createDataFrame([], NODES)
    assert rows(heavy_keys.heavy_keys(heavy_keys.target_counts(e, n), "t")) == []
    assert rows(heavy_keys.heavy_keys(heavy_keys.name_counts(n), "t")) == []


def _orphans(spark, edges, obs, nodes, removed=(), files=(), shared=()):
    return orphans.orphan_references(
        spark.createDataFrame(list(edges), EDGES),
        spark.createDataFrame(list(obs), "id long, repo_id string, symbol_name string, filepath string, timestamp timestamp"),
        spark.createDataFrame(list(nodes), NODES), spark.createDataFrame(list(shared), NODES),
        spark.createDataFrame(list(removed), "node_id string, repo_id string, removed_at timestamp"),
        spark.createDataFrame(list(files), "repo_id string, file_path string, content_hash string"),
    )


def test_orphans_of_each_kind(spark):
    nodes = [("a", "r", "d\\f.py", "a", T[1]), ("b", "r", "f", "b", T[1]), ("b", "r", "f", "b", T[1]), ("c", "r", "f", "c", T[5])]
    removed = [("b", "r", T[2]), ("c", "r", T[3]), ("c", "r", T[3]), ("a", "r", None)]
    edges = [("a", "b", "CALLS", T[4]), ("a", "b", "IMPORTS", T[3]), ("a", "c", "CALLS", T[1]), ("a", "no", "CALLS", None), ("a", None, "CALLS", T[1]), ("a", "s", "CALLS", T[1])]
    obs = [(1, "r", "a", "d/f.py", T[0]), (2, "r", "gone", "d\\f.py", None), (2, "r", "gone", "d\\f.py", None), (3, "r", None, "no.py", T[0]), (4, None, "a", "d/f.py", T[0]), (5, "r", "b", "f", T[0]), (6, "r", None, None, None)]
    got = rows(_orphans(spark, edges, obs, nodes, removed, [("r", "d/f.py", None), ("r", "f", "h")], [("s", "q", "f", "s", None)]).drop("period"))
    assert got == [
        ("edges", "target_id", "a", "b"), ("edges", "target_id", "a", "no"), ("observations", "filepath", "3", "no.py"), ("observations", "filepath", "4", "d/f.py"),
        ("observations", "symbol_name", "2", "gone"), ("observations", "symbol_name", "4", "a"), ("observations", "symbol_name", "5", "b"),
    ]


def test_orphan_periods_and_report(spark):
    o = _orphans(spark, [("a", "x", "CALLS", T[4]), ("a", "x", "CALLS", T[2]), ("b", "x", "CALLS", None)], [], [])
    got = orphans.orphan_report(o).na.fill("none", ["period"])
    assert rows(got) == [("edges", "target_id", "2024-03", 1), ("edges", "target_id", "none", 1)]


def test_no_references_no_orphans(spark):
    assert rows(_orphans(spark, [], [], [])) == []


def test_missing_keys_against_sets(spark):
    rng = random.Random(5)
    have = {f"k{rng.randrange(900)}" for _ in range(500)}
    want = [f"k{rng.randrange(900)}" for _ in range(800)] + ["k1"] * 500
    p = spark.createDataFrame([(k,) for k in have] + [(None,)], "key string")
    r = spark.createDataFrame([(k,) for k in want] + [(None,)], "key string")
    assert {x.key for x in orphans.missing_keys(p, r, 8).collect()} == set(want) - have


def _brute(links):
    parent = {}
    for c, p in links:
        parent[c] = min(parent.get(c, p), p)
    out = {}
    for v in {x for link in links for x in link}:
        trail, u = [], v
        while u in parent and u not in trail:
            trail.append(u)
            u = parent[u]
        out[v] = (None, None, min(trail[trail.index(u):])) if u in trail else (u, len(trail), None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_forest_against_walks(spark, seed, monkeypatch):
    monkeypatch.setattr(forest, "LINKS_PER_TASK", 120)
    rng = random.Random(seed)
    n = 200
    links = [(f"n{i:03d}", f"n{(rng.randrange(i) if i and rng.random() < 0.8 else max(0, i - 1)) if rng.random() < 0.97 else rng.randrange(n):03d}") for i in range(1, n)]
    df = spark.createDataFrame([(p, c, "imports", None) for c, p in links], EDGES)
    got = {r.node: (r.root, r.depth, r.cycle) for r in forest.resolve(forest.links_of(df)).collect()}
    want = _brute(links)
    assert got == want
    paths = {r.node: (r.root, r.depth, r.path) for r in forest.hierarchy(forest.links_of(df)).collect()}
    assert {k: v[:2] for k, v in paths.items()} == {k: v[:2] for k, v in want.items() if v[0]}
    up = dict(links)
    assert all(p[0] == r and p[-1] == k and all(up[b] == a for a, b in zip(p, p[1:])) for k, (r, _, p) in paths.items())


def test_chain_across_ranges_and_a_long_cycle(spark, monkeypatch):
    monkeypatch.setattr(forest, "LINKS_PER_TASK", 5)
    chain = [(f"c{(i * 37) % 101:03d}", f"c{((i - 1) * 37) % 101:03d}") for i in range(1, 101)]
    ring = [(f"r{(i * 7) % 30:02d}", f"r{((i + 1) * 7) % 30:02d}") for i in range(30)] + [("t1", "t2"), ("t2", "t0"), ("t0", "r05")]
    df = spark.createDataFrame([(p, c, "IMPORTS", None) for c, p in chain + ring] + [(None, "lone", "IMPORTS", None), ("x", None, "IMPORTS", None), ("self", "self", "IMPORTS", None)], EDGES)
    res = forest.resolve(forest.links_of(df))
    got = {r.node: (r.root, r.depth, r.cycle) for r in res.collect()}
    paths = {r.node: r.path for r in forest.hierarchy(forest.links_of(df)).collect()}
    assert paths[chain[-1][0]] == [chain[0][1]] + [c for c, _ in chain] and len(paths) == 102
    want = _brute(chain + ring) | {"lone": ("lone", 0, None), "self": (None, None, "self")}
    assert got == want


def test_paths_descendants_cycles(spark):
    df = spark.createDataFrame([("a", "b", "IMPORTS", None), ("b", "c", "IMPORTS", None), ("a", "d", "IMPORTS", None), ("y", "x", "IMPORTS", None), ("x", "y", "IMPORTS", None)], EDGES)
    links = forest.links_of(df)
    res = forest.resolve(links)
    paths = forest.hierarchy(links)
    assert {r.node: r.path for r in paths.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "d"]}
    assert rows(forest.descendants(paths)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]
    assert rows(forest.cycles(res)) == [("x", 2)]


def test_ranges_that_outgrow_a_task_are_doubled(spark, monkeypatch):
    monkeypatch.setattr(forest, "LINKS_PER_TASK", 3)
    monkeypatch.setattr(forest, "FAN_IN", 2)
    links = [(f"c{(i * 37) % 101:03d}", f"c{((i - 1) * 37) % 101:03d}") for i in range(1, 101)] + [(f"r{(i * 7) % 30:02d}", f"r{((i + 1) * 7) % 30:02d}") for i in range(30)]
    df = spark.createDataFrame([(p, c, "IMPORTS", None) for c, p in links], EDGES)
    assert {r.node: (r.root, r.depth, r.cycle) for r in forest.resolve(forest.links_of(df)).collect()} == _brute(links)
    assert {r.node: len(r.path) for r in forest.hierarchy(forest.links_of(df)).collect()} == {k: v[1] + 1 for k, v in _brute(links).items() if v[0]}


def test_no_links(spark):
    links = forest.links_of(spark.createDataFrame([], EDGES))
    res = forest.resolve(links)
    assert rows(res) == [] and rows(forest.hierarchy(links)) == []
