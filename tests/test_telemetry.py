"""Counters, rings, registries, audits, streams, rendering."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from skein import render
from skein.functions import text
from skein.operators import audit, memory, registry, telemetry
from skein.streaming import watch

T = [datetime(2024, 1, d) for d in range(1, 9)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counters(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "key string, delta int")
    c = telemetry.counters(d)
    assert rows(c) == [("a", 3), ("b", 0)] and rows(telemetry.read_counters(c, ["a", "z"])) == [("a", 3), ("z", 0)]


def test_lifetime_guards_zero(spark):
    r = telemetry.lifetime(spark.createDataFrame([], "workspace_id string, key string, value long")).first()
    assert r.reduction_pct == 0 and r.compliance_pct == 0 and r.total_requests == 0
    r = telemetry.lifetime(spark.createDataFrame([("w", "total_file_tokens", 200), ("v", "total_tokens_saved", 50), ("w", "pipeline_requests", 3), ("w", "direct_low_level_autorouted", 1)], "workspace_id string, key string, value long")).first()
    assert r.reduction_pct == 25 and r.compliance_pct == 75


def test_sessions_never_save_less_than_nothing_but_the_sum_is_signed(spark):
    c = spark.createDataFrame([("s", 10, 4), ("s", 1, 6), ("s", None, 2)], "session string, file_tokens int, used_tokens int")
    assert rows(telemetry.sessions(c)) == [("s", 3, 11, 12, 6, -1)]


def test_failures(spark):
    f = spark.createDataFrame([(i, m) for i, m in enumerate(["x not found in repo y", "no registered workspace", "missing required argument a", "invalid b", "mutex poisoned", "else", None])], "id int, message string")
    assert rows(telemetry.failure_counts(f)) == [("internal", 1), ("invalid_params", 2), ("other", 2), ("repo_not_found", 1), ("symbol_not_found", 1)]
    assert [r.id for r in telemetry.failure_ring(f, 3).collect()] == [6, 5, 4]


def test_activities_and_compare(spark):
    a = spark.createDataFrame([(1, "k", "start", T[0]), (1, "k", "done", T[1]), (2, "k", "start", T[0])], "id int, kind string, state string, at timestamp")
    assert [(r.id, r.state) for r in telemetry.activities(a).orderBy("id").collect()] == [(1, "done"), (2, "start")]
    b, c = (spark.createDataFrame([("k", t)], "key string, text string") for t in ("a\nb", "b\nc"))
    assert rows(telemetry.capsule_compare(b, c)) == [("k", "added", "c"), ("k", "removed", "a")]


def test_registry(spark):
    cols = "workspace_id string, workspace_root string, graph_path string, display_name string, status string, registered_at long, last_seen_at long"
    known = spark.createDataFrame([("w", "/a", "g", "Name", "available", 5, 6)], cols)
    new = spark.createDataFrame([("w", "/b", "g", None, "empty", 9, 9), ("x", "/tmp/z", "g", None, "empty", 9, 9)], cols)
    r = registry.register(known, new)
    assert rows(r) == [("w", "/b", "g", "Name", "empty", 5, 9), ("x", "/tmp/z", "g", None, "empty", 9, 9)]
    assert registry.workspace_id("/x/My Repo!") == f"My-Repo-{text.fnv1a64(b'/x/My Repo!')[:8]}"
    scope = spark.createDataFrame([("w", "r", 3, 1), ("x", None, 0, 0)], "workspace_id string, repo_id string, symbols long, files long")
    err = spark.createDataFrame([], "workspace_id string, message string")
    inv = registry.inventory(r, scope, err)
    assert [(i.workspace_id, i.status, i.symbols) for i in inv.collect()] == [("x", "empty", 0), ("w", "available", 3)]
    bad = registry.inventory(r, scope.limit(0), spark.createDataFrame([("w", "database is locked")], "workspace_id string, message string"))
    assert {i.workspace_id: i.status for i in bad.collect()} == {"w": "locked", "x": "missing_db"}
    assert rows(registry.totals(inv)) == [(2, 1, 3, 1)]
    assert rows(registry.owner(scope, r, spark.createDataFrame([("r",), ("q",)], "repo_id string"))) == [("r", "w")]
    assert [d.workspace_id for d in registry.dead_workspaces(r, spark.createDataFrame([("/b",)], "workspace_root string"), ["/tmp/"]).collect()] == ["x"]
    assert {k: d.count() for k, d in registry.clear({"nodes": r, "observations": r}).items()} == {"nodes": 0, "observations": 2}


def line(mid, model="m-1", inp=5, stop=None, content=(), kind="assistant"):
    return json.dumps({"type": kind, "timestamp": "2024-01-01T00:00:00Z", "message": {"id": mid, "model": model, "stop_reason": stop, "usage": {"input_tokens": inp, "output_tokens": 1}, "content": list(content)}})


def test_audit(spark):
    use = lambda i: {"type": "tool_use", "name": "read", "id": i}
    lines = [line("a", inp=5), line("a", inp=99, stop="end", content=[use("t1")]), "", "{broken", line("b", content=[use("t2")]), line(None, kind="user", content=[{"type": "tool_result", "tool_use_id": "t1"}])]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)] + [("u", 0, line("a", "p/m-2", 7))], "session string, line_no int, value string")
    p = audit.read_lines(df)
    q = audit.requests(p)
    assert rows(q.select("session", "message_id", "input_tokens", "stop_reason")) == [("s", "a", 5, "end"), ("s", "b", 5, None), ("u", "a", 7, None)]
    calls = audit.tool_calls(q, p)
    assert rows(calls.select("call_id", "answered")) == [("t1", True), ("t2", False)] and rows(audit.by_tool(calls)) == [("s", "read", 2)]
    prices = spark.createDataFrame([("bundled", "m", 1.0, 0.0, 0.0, 0.0), ("family", "m-1", 2.0, 0.0, 0.0, 0.0), ("exact", "x/m-2", 3.0, 1.0, 0.0, 0.0)], "tier string, pattern string, input double, output double, cache_write double, cache_read double")
    assert {(r.session, r.message_id): (r.tier, r.cost) for r in audit.priced(q, prices).collect()} == {("s", "a"): ("family", 10.0), ("s", "b"): ("family", 10.0), ("u", "a"): ("exact", 22.0)}
    c = {r.metric: (r.a, r.b, r.delta) for r in audit.compare(q, calls, "s", "u").collect()}
    assert c["requests"] == (2, 1, -1) and c["tool:read"] == (2, 0, -2) and c["input_tokens"] == (10, 7, -3)


def test_watch_applies_the_last_event_of_each_file(spark, tmp_path):
    def put(name, events):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(e) for e in events))

    ev = lambda p, k, s, c=None: {"path": p, "kind": k, "at": f"2024-01-01T00:00:{s:02d}Z", "content": c}
    put("1.json", [ev("/w/a/x.py", "modified", 1, "old"), ev("/w/a/x.py", "modified", 2, "new"), ev("/w/a/y.rb", "modified", 1, "y"), ev("/w/a/y.rb", "deleted", 3), ev("/w/a/z.png", "modified", 1), ev("/else/q.py", "modified", 1, "q"), ev("/w\\b\\k.ts", "modified", 1, "k")])
    roots = spark.createDataFrame([(0, "a", "/w/a"), (1, "w", "/w/")], "position int, repo_id string, root string")
    got = []
    q = watch.watch(watch.read_events(spark, str(tmp_path / "in")), roots, lambda c, d, n: got.append((rows(c.select("repo_id", "file_path", "content")), rows(d.select("repo_id", "file_path")))), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [g for g in got if g[0] or g[1]] == [([("a", "x.py", "new"), ("w", "b/k.ts", "k")], [("a", "y.rb")])]


def test_stream_counters(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.json").write_text('{"key":"a","delta":2}\n{"key":"a","delta":3}\n{"key":"b","delta":1}')
    s = watch.running_counters(spark.readStream.schema("key string, delta long").json(str(tmp_path / "d")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("counts")) == [("a", 5), ("b", 1)]


def test_render(spark):
    df = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "n int, t string")
    assert render.to_markdown(df) == "| n | t |\n|---|---|\n| 1 | a\\|b c |\n| 2 |  |"
    assert json.loads(render.to_json(df))[0] == {"n": 1, "t": "a|b\nc"}
    assert render.to_text(df, 3).endswith("[truncated]")
    many = df.sparkSession.range(6000)
    assert len(json.loads(render.to_json(many))) == 6000 and render.to_markdown(many).count("\n") == 6001 and render.to_text(many).count("\n") == 5999


def test_context_needs_a_filter(spark):
    with pytest.raises(ValueError):
        memory.session_context(None)


def test_command_line_and_transcripts(spark, tmp_path, capsys):
    from skein.__main__ import main

    line = lambda i, tool: json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:00:00", "message": {"id": i, "model": "m", "usage": {"input_tokens": 3, "output_tokens": 2}, "content": [{"type": "tool_use", "name": tool, "id": "t" + i}]}})
    (tmp_path / "s1" / "subagents").mkdir(parents=True)
    (tmp_path / "s1.jsonl").write_text(line("1", "read") + "\n\nbroken\n" + line("2", "read") + "\n")
    (tmp_path / "s1" / "subagents" / "x.jsonl").write_text(line("3", "find") + "\n")
    (tmp_path / "s2.jsonl").write_text(line("9", "read") + "\n")
    assert main(["audit", str(tmp_path), "--format", "json"], spark) == 0
    got = {r["session"]: (r["requests"], r["input_tokens"]) for r in json.loads(capsys.readouterr().out)}
    assert got == {"s1": (3, 9), "s2": (1, 3)}
    assert main(["audit", str(tmp_path), "--compare", "s1", "s2", "--format", "json"], spark) == 0
    deltas = {r["metric"]: r["delta"] for r in json.loads(capsys.readouterr().out)}
    assert deltas["requests"] == -2 and deltas["tool:find"] == -1
    assert main(["list"]) == 0 and "p2_found" in capsys.readouterr().out
