"""Graph operators on small literal graphs, and random graphs against plain walks."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from skein.operators import capsule, graph, memory, packet, resolve, search

COLS = "id string, repo_id string, file_path string, language string, symbol_name string, symbol_type string, source_start_byte long, source_end_byte long, start_line long, start_column long, end_line long, end_column long"
EDGE = "source_id string, target_id string, kind string"
T = [datetime(2024, 1, d) for d in range(1, 9)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def nodes_of(spark, *specs):
    """Specs: id, or (id, repo, path, name, kind)."""
    out = []
    for k, s in enumerate(specs):
        s = (s,) if isinstance(s, str) else s
        id_, repo, path, name, kind = (*s, *(None, "r", "f.py", s[0], "function")[len(s) :])
        out.append((id_, repo, path, path.rsplit(".", 1)[-1] if path else None, name, kind, k * 10, k * 10 + 5, 1, 1, 2, 1))
    return spark.createDataFrame(out, COLS)


def edges_of(spark, *pairs):
    return spark.createDataFrame([(a, b, k[0] if k else "CALLS") for a, b, *k in pairs], EDGE)


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_current_nodes(spark):
    base = nodes_of(spark, "a", "b", "c", ("w", "r", "d\\e.py", "w", "function"), "d").collect()
    at = {"a": T[0], "b": T[0], "c": T[3], "w": None, "d": None}
    rows_ = [(*r, at[r.id], "clash") for r in base] + [(*base[0][:4], "newer", *base[0][5:], T[1], "clash")]
    n = spark.createDataFrame(rows_ + rows_[:2], COLS + ", ingested_at timestamp, _gone string")
    removed = spark.createDataFrame([("b", T[1]), ("c", T[2]), ("c", T[3]), ("d", T[0]), (None, T[0]), ("a", None)], "node_id string, removed_at timestamp")
    shared = nodes_of(spark, "s")
    got = graph.current_nodes(n, shared, removed).collect()
    assert {r.id: (r.symbol_name, r.file_path) for r in got} == {"a": ("newer", "f.py"), "c": ("c", "f.py"), "w": ("w", "d/e.py"), "s": ("s", "f.py")}


def test_degrees_and_top(spark):
    n = nodes_of(spark, "a", "b", "c")
    e = edges_of(spark, ("a", "a"), ("a", "b"), ("a", "b", "IMPORTS"), ("a", "gone"), ("gone", "b"))
    d = graph.degrees(n, e)
    assert rows(d) == [("a", 4), ("b", 2), ("c", 0)]
    top = graph.top_by_degree(n, d, 2)
    assert [r.id for r in top.collect()] == ["a", "b"]
    assert rows(graph.induced_edges(e, top)) == [("a", "a", "CALLS"), ("a", "b", "CALLS"), ("a", "b", "IMPORTS")]
    assert rows(graph.neighbours(ids(spark, "b"), n, e)) == [("b", "a", 5), ("b", "b", 3)]


def test_impact_depths_cycles_and_isolated(spark):
    n = nodes_of(spark, "base", "mid", ("top", "other", "g.py", "top", "function"), "alone", "x", "y")
    e = edges_of(spark, ("mid", "base"), ("top", "mid"), ("top", "base", "IMPORTS"), ("x", "y"), ("y", "x"))
    got = rows(graph.impact(ids(spark, "base", "alone", "x"), n, e))
    assert got == [("base", "mid", 1, "CALLS", False), ("base", "top", 1, "IMPORTS", False), ("x", "y", 1, "CALLS", False)]
    e2 = edges_of(spark, ("mid", "base"), ("top", "mid"))
    assert rows(graph.impact(ids(spark, "base"), n, e2)) == [("base", "mid", 1, "CALLS", False), ("base", "top", 2, "CALLS", False)]
    assert rows(graph.impact(ids(spark, "base"), n, e2, depth=1)) == [("base", "mid", 1, "CALLS", False)]
    assert rows(graph.impact(ids(spark, "base"), n, e2, cap=1)) == [("base", "mid", 1, "CALLS", True)]


def test_reach_against_breadth_first(spark):
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)}
    e = edges_of(spark, *pairs)
    starts = ["n1", "n2", "n3"]
    want = set()
    for s in starts:
        seen, front = {s: 0}, [s]
        for d in range(1, 5):
            front = [b for a in front for x, b in pairs if x == a and b not in seen and not seen.update({b: d})]
        want |= {(s, v, d) for v, d in seen.items() if d}
    assert {(r.pivot_id, r.id, r.depth) for r in graph.reach(ids(spark, *starts), e, 4, False).collect()} == want


def test_dependency_graph_shares_its_cap(spark):
    n = nodes_of(spark, "p", "a", "b", "c", "d")
    e = edges_of(spark, ("a", "p"), ("b", "p"), ("p", "c"), ("p", "d"))
    got = graph.dependency_graph(ids(spark, "p"), n, e, cap=4).orderBy("position").collect()
    assert [(r.direction, r.id) for r in got] == [("callers", "a"), ("callers", "b"), ("callees", "c")]
    assert [r.id for r in graph.dependency_graph(ids(spark, "p"), n, e, direction="callees").orderBy("position").collect()] == ["c", "d"]


def _walk(start, facts, edges, depth, ways, cap):
    """A queue per direction, one visited set: entries in order, edges met, truncated."""
    seen, out, met, cut = {start}, [], 0, False
    for way in ways:
        queue = [(start, 0)]
        while queue:
            at, d = queue.pop(0)
            if d >= depth:
                continue
            near = [(k, *facts[b], b) for a, b, k in edges if a == at and b in facts] if way == "callees" else [(k, *facts[a], a) for a, b, k in edges if b == at and a in facts]
            for k, *_, to in sorted(near):
                met += 1
                if to in seen:
                    out.append((way, d + 1, to, k, at, True))
                elif len(seen) >= cap:
                    cut = True
                else:
                    seen.add(to)
                    queue.append((to, d + 1))
                    out.append((way, d + 1, to, k, at, False))
    return out, len(seen), met, cut


def test_dependency_graph_against_a_queue(spark):
    rng = random.Random(7)
    names = [f"n{i}" for i in range(30)]
    facts = {x: (f"s{rng.randrange(6)}", f"f{rng.randrange(3)}.py") for x in names}
    pairs = sorted({(rng.choice(names[:12] + ["gone"]), rng.choice(names), rng.choice(["CALLS", "IMPORTS"])) for _ in range(110)})
    n, e = nodes_of(spark, *[(x, "r", p, s, "function") for x, (s, p) in facts.items()]), edges_of(spark, *pairs)
    starts = ["n0", "n3", "n5", "n20"]
    for depth, direction, cap in ((2, "both", 200), (3, "both", 9), (2, "both", 5), (3, "callees", 6), (2, "callers", 4), (2, "both", 1)):
        ways = ["callers", "callees"] if direction == "both" else [direction]
        entries, totals = graph.dependency_walk(ids(spark, *starts), n, e, depth, direction, cap)
        got, sums = entries.collect(), {r.pivot_id: (r.nodes, r.edges, r.truncated) for r in totals.collect()}
        for s in starts:
            want, *rest = _walk(s, facts, pairs, depth, ways, cap)
            mine = sorted((r for r in got if r.pivot_id == s), key=lambda r: r.position)
            assert [r.position for r in mine] == list(range(1, len(mine) + 1))
            assert [(r.direction, r.depth, r.id, r.kind, r.parent_id, r.already_seen) for r in mine] == want
            assert sums[s] == tuple(rest)


def test_adjacent_limits_each_side(spark):
    n = nodes_of(spark, "p", *[f"c{i}" for i in range(9)])
    e = edges_of(spark, *[(f"c{i}", "p") for i in range(9)], ("p", "c3"), ("p", "p"), ("p", "none"))
    got = [r for r in graph.adjacent(n, e, 5, 4).collect() if r.pivot_id == "p"]
    assert sorted(r.id for r in got if r.direction == "in") == ["c0", "c1", "c2", "c3"] and [r.id for r in got if r.direction == "out"] == ["c3"]


def test_repo_scope_and_categories(spark):
    n = nodes_of(spark, ("a", "r1", "f", "a", "x"), ("b", "r1", "f", "b", "x"), ("c", "r2", "f", "c", "x"))
    f = spark.createDataFrame([("r1", "d\\x"), ("r1", "d/x"), ("r3", "q")], "repo_id string, file_path string")
    assert rows(graph.repo_scope(n, f, edges_of(spark, ("a", "c"), ("b", "zz")))) == [("r1", 2, 1, 2), ("r2", 1, 0, 0), ("r3", 0, 1, 0)]
    p = spark.createDataFrame([("app/Models/a",), ("x/spec/b",), ("spectral/b",), ("jobs/services/c",)], "p string")
    assert [r[0] for r in p.select(graph.path_category(p.p)).collect()] == ["models", "tests", "other", "jobs"]


def test_degree_cache(spark):
    n = nodes_of(spark, ("a", "r1", "f", "a", "x"), ("b", "r2", "f", "b", "x"), ("c", "r3", "f", "c", "x"), ("d", "r4", "f", "d", "x"))
    cache = spark.createDataFrame([("r1", "a", 0), ("r2", "b", 0), ("r3", "c", 0), ("r3", "old", 0)], "repo_id string, node_id string, degree int")
    meta = spark.createDataFrame([("r1", 1, False), ("r2", 1, True), ("r3", 1, False)], "repo_id string, node_count int, dirty boolean")
    assert rows(graph.degree_cache_fresh(n, cache, meta)) == [("r1", True), ("r2", False), ("r3", False), ("r4", False)]


def test_resolve_symbols(spark):
    n = nodes_of(spark, ("1", "r", "b.py", "dup", "x"), ("2", "r", "a\\c.py", "dup", "x"), ("3", "r", "a.py", "one", "x"))
    a = spark.createDataFrame([("q1", "r", "dup", None), ("q2", "r", "dup", "a/c.py"), ("q3", "r", "no", None), ("q4", "r", "dup", "a\\c.py")], "ask_id string, repo_id string, symbol_name string, file_path string")
    got = rows(search.resolve_symbols(a, n))
    assert got == [("q1", 1, 2, "2", "a/c.py"), ("q1", 2, 2, "1", "b.py"), ("q2", 1, 1, "2", "a/c.py"), ("q4", 1, 1, "2", "a/c.py")]
    assert {r.position for r in search.resolve_symbols(a, n, show=1).collect()} == {1}


def test_find_symbols(spark):
    n = nodes_of(spark, ("1", "r", "f", "user_index", "function"), ("2", "r", "f", "getUser", "method"), ("3", "r", "f", "index_of_all_users", "function"), ("4", "q", "f", "Üser", "class"), ("5", "r", "f", None, "class"))
    assert [r.id for r in search.find_symbols(n, "user ind").collect()] == ["1", "3"]
    assert [r.id for r in search.find_symbols(n, "user").collect()] == ["4", "1", "3"]
    assert [r.id for r in search.find_symbols(n, "user", kind="FUNC", repo="r", limit=1).collect()] == ["1", "3"]
    assert [r.id for r in search.find_symbols(n, "_").collect()] == ["1", "3"] and search.find_symbols(n, "%").count() == 0
    assert [r.id for r in search.pick_symbols(n, "USER").collect()] == ["2", "3", "1"]


def test_listing_and_directories(spark):
    n = nodes_of(spark, ("1", "r", "src/a.py", "x", "function"), ("2", "r", "src2/a.py", "y", "Class"), ("3", "r", "src", "z", "macro"), ("4", "r", "src/b_c.py", "w", "blob"))
    assert [r.symbol_name for r in search.listing(n).orderBy("position").collect()] == ["z", "x", "y"]
    assert {r.id for r in search.within_directory(n, "./src/").collect()} == {"1", "3", "4"} and search.within_directory(n, ".").count() == 4
    assert search.within_directory(n, "sr_").count() == 0


def test_calls(spark):
    n = nodes_of(
        spark, ("s", "r", "a.py", "s", "function"), ("t1", "r", "a.py", "near", "function"), ("t2", "r", "b.py", "near", "function"), ("u", "r", "b.py", "far", "function"),
        ("d1", "r", "b.py", "many", "function"), ("d2", "r", "c.py", "many", "function"), ("i", "r", "b.py", "face", "interface"), ("o", "q", "z.py", "other", "function"), ("cs", "r", "x.c", "cs", "struct"),
    )
    c = spark.createDataFrame([("s", "r", "a.py", x) for x in ("near", "far", "many", "face", "other", "s", "cs", "near")], "source_id string, repo_id string, file_path string, callee string")
    assert rows(resolve.resolve_calls(c, n)) == [("s", "t1", "CALLS"), ("s", "u", "CALLS")]


def test_self_named_callee_stays_in_its_file(spark):
    n = nodes_of(spark, ("s", "r", "a.py", "run", "function"))
    c = spark.createDataFrame([("s", "r", "a.py", "run")], "source_id string, repo_id string, file_path string, callee string")
    assert rows(resolve.resolve_calls(c, n)) == []


def test_imports_only_where_unambiguous(spark):
    n = nodes_of(spark, ("a2", "r1", "a.py", "q", "function"), ("a1", "r1", "a.py", "p", "function"), ("x", "r2", "x.py", "one", "class"), ("y", "r2", "y.py", "two", "class"), ("z", "r3", "z.py", "two", "class"), ("own", "r1", "b.py", "three", "class"), ("w", "r2", "w.py", "three", "class"))
    i = spark.createDataFrame([("r1", "a.py", m) for m in ("one", "two", "three", "p", "none", "one")], "repo_id string, file_path string, import_name string")
    assert rows(resolve.resolve_imports(i, n)) == [("a1", "w", "IMPORTS"), ("a1", "x", "IMPORTS")]


def test_changes(spark):
    f = lambda *x: spark.createDataFrame(list(x), "repo_id string, file_path string, content_hash string")
    got = rows(resolve.change_set(f(("r", "same", "1"), ("r", "dif", "1"), ("r", "gone", "1"), ("r", "nul", None), ("r", "w\\x", "1")), f(("r", "same", "1"), ("r", "dif", "2"), ("r", "new", "1"), ("r", "nul", None), ("r", "w/x", "1"))))
    assert got == [("r", "dif", "changed"), ("r", "gone", "removed"), ("r", "new", "added"), ("r", "nul", "changed"), ("r", "same", "unchanged"), ("r", "w/x", "unchanged")]
    assert rows(resolve.vanished(ids(spark, "a", "b", "b"), ids(spark, "b"))) == [("a",)]


@pytest.mark.parametrize("seed", range(2))
def test_incremental_apply_equals_rebuild(spark, seed):
    from skein.plans import ingest

    rng = random.Random(seed)
    names = ["f", "g", "h", "k", "m"]

    def source():
        head = "from other import " + rng.choice(names) + "\n" if rng.random() < 0.5 else ""
        return head + "\n" * rng.randrange(3) + "".join(f"def {x}():\n    {rng.choice(names)}()\n    {rng.choice(names)}()\n\n" for x in rng.sample(names, rng.randrange(1, 4)))

    def scan(files):
        rows_ = [(r, p, "py", len(t), 1, t) for (r, p), t in files.items()]
        return spark.createDataFrame(rows_, "repo_id string, file_path string, language string, size long, mtime_ns long, content string")

    v1 = {(r, f"{p}.py"): source() for r in ("r", "s") for p in "abcd"}
    v2 = dict(v1)
    for key in rng.sample(sorted(v1), 3):
        v2[key] = source()
    del v2[rng.choice(sorted(v2))]
    v2["r", "new.py"] = source()
    got, changes = ingest.ingest_changes(ingest.ingest(scan(v1)), scan(v2))
    want = ingest.ingest(scan(v2))
    assert {r.status for r in changes.collect()} == {"added", "changed", "removed", "unchanged"}
    assert rows(got.edges) == rows(want.edges) and any(r.kind == "IMPORTS" for r in got.edges.collect()) | any(r.kind == "CALLS" for r in got.edges.collect())
    assert rows(got.nodes.select("id")) == rows(want.nodes.select("id")) and rows(got.files.select("repo_id", "file_path")) == rows(want.files.select("repo_id", "file_path"))


def test_a_moved_target_keeps_its_callers(spark):
    from skein.extract.table import callee_rows, extract_symbols

    build = lambda v: extract_symbols(spark.createDataFrame(v, "repo_id string, file_path string, content string"))
    files = lambda v: spark.createDataFrame(v, "repo_id string, file_path string, content_hash string")
    v1 = [("r", "a.py", "def f():\n    g()\n"), ("r", "b.py", "def g():\n    pass\n")]
    moved = [("r", "b.py", "\n\ndef g():\n    pass\n")]
    s1 = build(v1)
    _, e, _ = resolve.apply_changes(s1, resolve.resolve_calls(callee_rows(s1), s1), files(v1), build(moved), files(moved), spark.createDataFrame([], "repo_id string, file_path string"))
    assert rows(e) == [("r:a.py:function:f:0", "r:b.py:function:g:2", "CALLS")]


def test_capsules_traces_and_maps(spark):
    n = nodes_of(spark, "p", "a", ("b", "r", "models/x.py", "b", "function"))
    e = edges_of(spark, ("p", "a"), ("b", "p"))
    text = {"p": "def p():\n    return a()", "a": "\ndef a(x):\n    return 1", "b": "def b():\n    p()"}
    texts = lambda i: i.join(spark.createDataFrame([(k, "py", k, v) for k, v in text.items()], "id string, language string, symbol_name string, raw_text string"), "id")
    c = capsule.capsules(ids(spark, "p"), n, e, texts)
    assert {(r.direction, r.id): r.shown for r in c.collect()} == {("self", "p"): text["p"], ("out", "a"): "def a(x):", ("in", "b"): "def b():"}
    full = spark.createDataFrame(list(text.items()), "id string, raw_text string")
    t = capsule.capsule_tokens(c, full).first()
    assert t.baseline == sum(len(x) // 4 for x in text.values()) and 0 < t.saved_pct < 100
    assert {r.id: r.text for r in capsule.traces(ids(spark, "p"), n, e, texts).collect()} == {"p": text["p"], "a": "\ndef a(x):\n    pass"}
    assert rows(capsule.neighbour_categories(ids(spark, "p"), n, e)) == [("p", "models", 1), ("p", "other", 1)]
    assert {(r.part, r.key) for r in capsule.class_map(ids(spark, "p"), n, e).collect()} == {("file", "p"), ("file", "a"), ("callers", "b"), ("callees", "a"), ("category", "models"), ("category", "other")}


def test_long_pivots_are_condensed(spark):
    n, e = nodes_of(spark, "p"), edges_of(spark, ("x", "y"))
    big = "def p():\n    x = 1\n" + "    y = 2\n" * 3000
    texts = lambda i: i.join(spark.createDataFrame([("p", "py", "p", big)], "id string, language string, symbol_name string, raw_text string"), "id")
    assert capsule.capsules(ids(spark, "p"), n, e, texts).first().shown.startswith("def p():\n    pass")


def test_sampled_paths_and_byte_budget(spark):
    p = spark.createDataFrame([("r", f"f{i:02d}") for i in range(15)] + [("q", "a"), ("q", "a")], "repo_id string, file_path string")
    got = capsule.sample_paths(p, 8)
    assert [r.file_path for r in got.filter("repo_id = 'r'").orderBy("position").collect()] == [f"f{i * 14 // 7:02d}" for i in range(8)]
    assert rows(got.filter("repo_id = 'q'")) == [("q", 0, "a")]
    t = spark.createDataFrame([("g", 1, "aé"), ("g", 2, "bbbb"), ("g", 3, "c")], "g string, o int, t string")
    assert [r.o for r in capsule.byte_budget(t, "g", ["o"], "t", 7).orderBy("o").collect()] == [1, 2]


def test_scores_routes_and_budgets(spark):
    n = spark.createDataFrame([("1", "cursor_x", "src/cursor/a.py", "function", "Cursor " * 9), ("2", None, None, None, None), ("3", "y", "f", "class", "a cursor")], "id string, symbol_name string, file_path string, symbol_type string, raw_text string")
    assert {r.id: r.score for r in packet.scored(n, "the cursor").collect()} == {"1": 12 + 6 + 5, "2": 0, "3": 1}
    assert packet.route("trace callers of x", 5) == "hybrid" and packet.route("trace x", 5) == "use_graph" and packet.route("whole thing", 3) == "use_native" and packet.route("x", 0) == "use_native" and packet.route("x", 9, False) == "needs_index"
    assert packet.entry_budget(20, packet.PROFILES["cloud"]) == 0 and packet.entry_budget(12_000, packet.PROFILES["cloud"]) == 7200 - 180


def test_greedy_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([50, 60, 40, 20, 10])] + [("h", 0, 500)], "g string, o int, c int")
    assert sorted(r.o for r in packet.greedy(df, "g", "o", "c", 100).collect()) == [0, 2, 4]


def test_packet_over_budget_is_empty(spark):
    n = nodes_of(spark, "cursor")
    s = n.withColumn("score", n.start_line * 9)
    d = spark.createDataFrame([("cursor", 1)], "id string, degree long")
    texts = lambda i: i.join(spark.createDataFrame([("cursor", "py", "def cursor():\n    pass")], "id string, language string, raw_text string"), "id")
    e = edges_of(spark, ("cursor", "zz"))
    assert packet.packet(s, e, d, texts, request=20).count() == 0
    assert [(r.rank, r.context_type, r.id) for r in packet.packet(s, e, d, texts).collect()] == [(1, "exact_source", "cursor")]


def test_freshness(spark):
    f = lambda *x: spark.createDataFrame(list(x), "repo_id string, file_path string, content_hash string")
    n = nodes_of(spark, ("1", "a", "f", "x", "y"), ("2", "b", "f", "x", "y"), ("3", "c", "f", "x", "y"))
    got = packet.freshness(f(("a", "1", "h"), ("b", "1", "h"), ("b", "2", "h"), ("c", "1", "h"), ("d", "1", "h")), f(("a", "1", "h"), ("b", "1", "g"), ("c", "2", "h"), ("d", "1", "h")), n)
    assert {r.repo_id: r.status for r in got.collect()} == {"a": "fresh", "b": "stale", "c": "unavailable", "d": "missing"}


def test_notes(spark):
    n = spark.createDataFrame([("1", "r", "d\\f.py", "s", "abc"), ("2", "r", "g.py", "t", None)], "id string, repo_id string, file_path string, symbol_name string, raw_text string")
    from skein.sources.tables import slash

    h = memory.hashed(n.withColumn("file_path", slash("file_path")))
    assert {r.id: r.content_hash for r in h.collect()} == {"1": "e71fa2190541574b", "2": None}
    new = spark.createDataFrame([(1, "r", "s", "d/f.py", "note", T[0]), (2, "r", "no", "d/f.py", "note", T[0])], "id long, repo_id string, symbol_name string, filepath string, observation_text string, timestamp timestamp")
    saved = memory.save_observations(new, h)
    assert [(r.id, r.last_known_hash, r.is_stale) for r in saved.collect()] == [(1, "e71fa2190541574b", False)]
    o = spark.createDataFrame([(1, "r", "s", "d/f.py", "e71fa2190541574b", False), (2, "r", "s", "d\\f.py", "old", None), (3, "r", "gone", "d/f.py", "x", False), (4, "r", None, "no.py", None, False), (5, "r", "s", "d/f.py", "e71fa2190541574b", True), (5, "r", "s", "d/f.py", "e71fa2190541574b", True)], "id long, repo_id string, symbol_name string, filepath string, last_known_hash string, is_stale boolean")
    files = spark.createDataFrame([("r", "d/f.py"), ("r", "g.py")], "repo_id string, file_path string")
    assert {r.id: r.is_stale for r in memory.mark_stale(o, h, files).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    notes = memory.session_context(saved.union(saved), repo="r", path="d\\f.py")
    assert [r.note for r in notes.collect()] == ["note"]


def test_greedy_in_order_goes_on_through_the_whole_group(spark):
    rng = random.Random(3)
    notes = [(g, i, rng.choice([0, 3, 40, 90])) for g in ("a", "b", "c") for i in range(300)] + [("d", 0, 500), ("d", 1, 200)]
    want = set()
    for g in "abcd":
        used = 0
        for place, (_, i, c) in enumerate(sorted((x for x in notes if x[0] == g), key=lambda x: -x[1]), 1):
            if used + c <= 200:
                used += c
                want.add((g, i, place, c))
    df = spark.createDataFrame(rng.sample(notes, len(notes)), "g string, i long, cost long")
    got = {tuple(r) for r in packet.greedy_in_order(df, "g", [df.i.desc()], "i", "cost", 200).collect()}
    assert got == want and max(p for _, _, p, _ in got) > 64


def test_greedy_budget_takes_notes_past_the_64th(spark, tmp_path):
    from skein.plans.graph_queries import greedy_budget

    o = [(f"o{i:03}", "r", datetime(2024, 1, 1, i // 60, i % 60), "x" * 120 if i >= 36 else None) for i in range(100)]
    spark.createDataFrame(o, "id string, repo_id string, timestamp timestamp, observation_text string").write.parquet(str(tmp_path / "observations.parquet"))
    got = {r.id for r in greedy_budget(spark, str(tmp_path)).collect()}
    assert {f"o{i:03}" for i in range(36)} <= got and 0 < len(got) - 36 < 64
