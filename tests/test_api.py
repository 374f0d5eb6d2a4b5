"""Trees to graphs, whole and by changes; intents, errors and batches."""

from __future__ import annotations

import pytest

from skein.api import Ambiguous, NotFound, Pipeline, Query
from skein.plans import ingest


def write(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    one, two = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("two")
    write(one, {"src/request.py": "from other import helper\n\ndef handle(a):\n    parse(a)\n    return build(a)\n\ndef parse(a):\n    return a\n\ndef build(a):\n    return helper(a)\n", "src/admin.py": "def parse(b):\n    return b\n"})
    write(two, {"lib/h.py": "def helper(x):\n    return 1\n", "w.ts": "export class Widget {\n  draw(): void { paint(); }\n}\nfunction paint() { return 1; }\n"})
    roots = {"one": str(one), "two": str(two)}
    return one, roots, ingest.ingest(ingest.scan_all(spark, roots))


def edges(g):
    name = lambda i: ":".join(i.split(":")[k] for k in (0, 3))
    return {(name(r.source_id), name(r.target_id), r.kind) for r in g.edges.collect()}


def test_graph_of_two_trees(built):
    _, _, g = built
    assert edges(g) == {("one:handle", "one:parse", "CALLS"), ("one:handle", "one:build", "CALLS"), ("two:draw", "two:paint", "CALLS"), ("two:Widget", "two:paint", "CALLS"), ("one:build", "two:helper", "IMPORTS")}
    assert {r.file_path for r in g.files.collect()} == {"src/request.py", "src/admin.py", "lib/h.py", "w.ts"}
    assert all(r.found_slash and r.found_backslash for r in ingest.self_check(g.nodes).collect())


def pipeline(g):
    return Pipeline(g.nodes, g.edges, lambda ids: g.nodes.join(ids, "id", "left_semi"))


def test_intents(built):
    p = pipeline(built[2])
    assert {r.depth for r in p.run(Query("refactor_symbol", "two", "helper")).collect()} == {1, 2}
    assert [r.symbol_name for r in p.run(Query("find_symbol", target="par")).collect()] == ["parse", "parse"]
    assert {r.symbol_name for r in p.run(Query("get_skeleton", "one", "src")).collect()} == {"handle", "parse", "build"}
    shown = {(r.direction, r.shown) for r in p.run(Query("explore_symbol", "one", "handle")).collect()}
    assert ("out", "def build(a):") in shown and any(d == "self" and "parse(a)" in t for d, t in shown)
    assert p.run(Query("dependency_graph", "one", "build", direction="callers")).count() == 1
    assert p.run(Query("trace_flow", "one", "handle")).count() == 3 and p.run(Query("map_class", "two", "Widget")).count() >= 3
    assert "def build(a):" in p.report(Query("explore_symbol", "one", "handle"))


def test_errors_and_batches(built):
    p = pipeline(built[2])
    with pytest.raises(Ambiguous) as e:
        p.run(Query("explore_symbol", "one", "parse"))
    assert [c["file_path"] for c in e.value.candidates] == ["src/admin.py", "src/request.py"]
    assert p.run(Query("explore_symbol", "one", "parse", filepath="src\\admin.py")).count() == 1
    with pytest.raises(NotFound):
        p.run(Query("read_node", "one", "none"))
    for bad in (Query("x", target="a"), Query("find_symbol"), Query("trace_flow", target="a", depth=6), Query("trace_flow", target="a", direction="up"), Query("trace_flow", target="a", max_nodes=201)):
        with pytest.raises(ValueError):
            p.run(bad)
    out = p.batch([Query("find_symbol", target="helper"), Query("read_node", "one", "none"), Query("find_symbol", target="helper"), Query("find_symbol", target="helper", depth=2)])
    assert "helper" in out[0][1] and out[1][1].startswith("error: none not found") and out[2][1] == "Same as 1" and "helper" in out[3][1]
    assert p.failures[-1][0] == "read_node"
    cut = p.batch([Query("find_symbol", target="helper"), Query("find_symbol", target="parse")], limit=10)
    assert [i for i, _ in cut] == [1, 2] and cut[0][1].endswith("[truncated]") and cut[1][1].startswith("[left out")
    with pytest.raises(ValueError):
        p.batch([])


def test_changes(spark, built):
    one, roots, g = built
    write(one, {"src/request.py": "def handle(a):\n    return build(a)\n\ndef build(a):\n    return a\n", "src/new.py": "def fresh():\n    handle(1)\n"})
    (one / "src/admin.py").unlink()
    g2, changes = ingest.ingest_changes(g, ingest.scan_all(spark, roots))
    assert {(r.file_path, r.status) for r in changes.collect()} == {("src/request.py", "changed"), ("src/new.py", "added"), ("src/admin.py", "removed"), ("lib/h.py", "unchanged"), ("w.ts", "unchanged")}
    whole = ingest.ingest(ingest.scan_all(spark, roots))
    assert edges(g2) == edges(whole) and {r.id for r in g2.nodes.collect()} == {r.id for r in whole.nodes.collect()}
    assert {(r.file_path, r.content_hash) for r in g2.files.collect()} == {(r.file_path, r.content_hash) for r in whole.files.collect()}
