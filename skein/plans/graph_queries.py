"""The graph engine's queries over the project's tables, and their SQL.

Every query runs over the whole tables; a limit occurs only where it is the feature (top-k, rings, caps per pivot).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.extract.condense import signature, with_condensed
from skein.extract.table import callee_rows, with_called_names
from skein.functions.text import tokens_down, tokens_up
from skein.operators import audit, capsule, graph, memory, packet, registry, resolve, search, telemetry
from skein.plans import ingest
from skein.sources.tables import checkpoint, slash, table
from skein.sources.tree import extension

TASK = "trace how the registry cursor updates the index budget"
HUBS = 5
#: What most questions need of a node.
NAMES = ("repo_id", "file_path", "language", "symbol_name", "symbol_type")


def _nodes(spark: SparkSession, sf: str, derive: Callable[[DataFrame], DataFrame] | None = None, *extra: str) -> DataFrame:
    """Current nodes; with ``extra`` columns that ``derive`` computes from the texts where they lie, before any exchange."""
    n, s = table(spark, sf, "nodes"), table(spark, sf, "shared_nodes")
    if derive:
        n, s = derive(n), derive(s)
    return graph.current_nodes(n, s, table(spark, sf, "removed_nodes"), extra, NAMES)


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a query that needs them several times, worked out once."""
    return checkpoint(_nodes(spark, sf)), checkpoint(_edges(spark, sf))


def graph_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Current nodes with places and edges, for the API."""
    n = graph.current_nodes(table(spark, sf, "nodes"), table(spark, sf, "shared_nodes"), table(spark, sf, "removed_nodes"))
    return checkpoint(n), checkpoint(_edges(spark, sf))


def texts_of(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    return _texts(spark, sf)


def _texts(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    """Texts of given ids: rows of other ids are dropped before the newest are chosen."""
    return lambda ids: _nodes(spark, sf, lambda df: df.join(ids, "id", "left_semi"), "raw_text")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_set(table(spark, sf, "edges"))


def _hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that most edges point at."""
    n = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return checkpoint(n.join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("n"), "id").limit(HUBS).select("id"))


def degree_ranking(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return graph.top_by_degree(n, graph.degrees(n, e)).select("id", "file_path", "symbol_name", "degree")


def top_k_subgraph_edges(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return graph.induced_edges(e, graph.top_by_degree(n, graph.degrees(n, e)))


def neighbor_degrees(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return graph.neighbours(_hubs(n, e), n, e)


def repo_scope_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.repo_scope(_nodes(spark, sf), table(spark, sf, "files"), _edges(spark, sf))


def capsule_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacent(_nodes(spark, sf), _edges(spark, sf))


def impact_hubs(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return graph.impact(_hubs(n, e), n, e)


def dependency_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Each direction alone, ranked by depth. The walk with one visited set is dependency_walk."""
    n, e = _graph(spark, sf)
    return graph.nearest_by_direction(_hubs(n, e), n, e)


def dependency_walk(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return graph.dependency_graph(_hubs(n, e), n, e)


def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    v = graph.valid_edges(e, _nodes(spark, sf)).groupBy("kind").agg(F.count("*").alias("valid"))
    return e.groupBy("kind").agg(F.count("*").alias("edges")).join(v, "kind", "left").select("kind", "edges", (F.col("edges") - F.coalesce("valid", F.lit(0))).alias("dangling"))


def resolve_candidates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "observations").filter("symbol_name IS NOT NULL AND repo_id IS NOT NULL").select("repo_id", "symbol_name").distinct()
    asked = o.select(F.concat_ws("|", "repo_id", "symbol_name").alias("ask_id"), "repo_id", "symbol_name", F.lit(None).cast("string").alias("file_path"))
    return search.resolve_symbols(asked, _nodes(spark, sf))


def find_symbol_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_symbols(_nodes(spark, sf), "ind bud")


def find_symbol_like(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_symbols(_nodes(spark, sf), "_", kind="method")


def pick_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return search.pick_symbols(_nodes(spark, sf), "Cursor")


def skeleton_listing(spark: SparkSession, sf: str) -> DataFrame:
    return search.listing(_nodes(spark, sf, lambda df: df, "source_start_byte", "start_line"))


def directory_listing(spark: SparkSession, sf: str) -> DataFrame:
    n = search.within_directory(_nodes(spark, sf), "./src/core/")
    return n.groupBy("repo_id").agg(F.count("*").alias("symbols"))


def path_categories(spark: SparkSession, sf: str) -> DataFrame:
    f = _nodes(spark, sf).select("repo_id", "file_path").distinct()
    return f.groupBy(graph.path_category(F.col("file_path")).alias("category")).agg(F.count("*").alias("files"))


def neighbour_categories(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return capsule.neighbour_categories(_hubs(n, e), n, e)


def sampled_paths(spark: SparkSession, sf: str) -> DataFrame:
    return capsule.sample_paths(_nodes(spark, sf).filter("repo_id IS NOT NULL AND file_path IS NOT NULL"))


def _scores_of(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf, lambda df: packet.scored(df, TASK), "score")


def task_score_topk(spark: SparkSession, sf: str) -> DataFrame:
    scores = checkpoint(_scores_of(spark, sf))
    return packet.candidates(scores, graph.degrees(scores, _edges(spark, sf)), 25)


def packet_token_costs(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("raw_text", F.lit(""))
    n = _nodes(spark, sf, lambda df: df.withColumn("up", tokens_up(t)).withColumn("down", tokens_down(t)), "up", "down")
    return n.groupBy("repo_id").agg(F.sum("up").alias("packet_tokens"), F.sum("down").alias("capsule_tokens"))


def context_packet(spark: SparkSession, sf: str) -> DataFrame:
    scores, e = checkpoint(_scores_of(spark, sf)), checkpoint(_edges(spark, sf))
    return packet.packet(scores, e, graph.degrees(scores, e), _texts(spark, sf))


def greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Of each observation's repository, the newest notes that fit a budget of 200 tokens."""
    o = table(spark, sf, "observations").select("id", "repo_id", "timestamp", "observation_text").distinct().filter("repo_id IS NOT NULL")
    rows = o.select("repo_id", "id", "timestamp", tokens_up(F.coalesce("observation_text", F.lit(""))).alias("cost"))
    return packet.greedy_in_order(rows, "repo_id", [F.desc_nulls_last("timestamp"), F.desc("id")], "id", "cost", 200)


def condensed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    def derive(df: DataFrame) -> DataFrame:
        c = with_condensed(df)
        return c.withColumn("chars", F.length("condensed").cast("long")).withColumn("signature", signature(F.col("condensed"), F.col("symbol_name")))

    return _nodes(spark, sf, derive, "chars", "signature").select("id", "chars", "signature")


def capsules(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return capsule.capsules(_hubs(n, e), n, e, _texts(spark, sf))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return capsule.traces(_hubs(n, e), n, e, _texts(spark, sf))


def class_map(spark: SparkSession, sf: str) -> DataFrame:
    n, e = _graph(spark, sf)
    return capsule.class_map(_hubs(n, e), n, e)


def call_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_calls(callee_rows(_nodes(spark, sf, with_called_names, "callees")), _nodes(spark, sf))


def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    names = callee_rows(_nodes(spark, sf, with_called_names, "callees")).select("repo_id", "file_path", F.col("callee").alias("import_name"))
    return resolve.resolve_imports(names, _nodes(spark, sf))


def file_changeset(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files").select("repo_id", slash("file_path").alias("file_path"), "content_hash")
    seen = _nodes(spark, sf).select("repo_id", "file_path").distinct().join(f.groupBy("repo_id", "file_path").agg(F.max("content_hash").alias("content_hash")), ["repo_id", "file_path"], "left")
    return resolve.change_set(f, seen)


def _snapshot(rows: DataFrame) -> DataFrame:
    """``repo_id, file_path, content_hash`` of symbols ``id, repo_id, file_path, digest``: the digest of a file's symbols in order of their ids."""
    one = F.concat_ws(":", "id", F.coalesce("digest", F.lit("")))
    return rows.groupBy("repo_id", slash("file_path").alias("file_path")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(one)), ",")).alias("content_hash"))


def snapshot_changeset(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the oldest rows of nodes against those of the current ones, by what their symbols' texts were and are."""
    digest = lambda df: df.withColumn("digest", F.md5("raw_text"))
    old = digest(table(spark, sf, "nodes")).filter("id IS NOT NULL AND ingested_at IS NOT NULL")
    first = old.groupBy("id").agg(F.min(F.struct("ingested_at", "repo_id", slash("file_path").alias("file_path"), F.coalesce("digest", F.lit("")).alias("digest"))).alias("m")).select("id", "m.*")
    known = lambda df: df.filter("repo_id IS NOT NULL AND file_path IS NOT NULL")
    return resolve.change_set(_snapshot(known(first)), _snapshot(known(_nodes(spark, sf, digest, "digest"))))


def absolute_paths(spark: SparkSession, sf: str) -> DataFrame:
    return graph.absolute_paths(_nodes(spark, sf), table(spark, sf, "repositories"))


def vanished_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.vanished(table(spark, sf, "nodes").filter("id IS NOT NULL"), _nodes(spark, sf))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf, memory.hashed, "content_hash").select("id", "content_hash")


def observation_staleness(spark: SparkSession, sf: str) -> DataFrame:
    return memory.mark_stale(table(spark, sf, "observations"), _nodes(spark, sf, memory.hashed, "content_hash"), table(spark, sf, "files"))


def session_notes(spark: SparkSession, sf: str) -> DataFrame:
    return memory.session_context(table(spark, sf, "observations"), repo="granite-hub")


def freshness_audit(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "files").select("repo_id", slash("file_path").alias("file_path"), "content_hash")
    n = _nodes(spark, sf)
    stored = n.select("repo_id", "file_path", F.lit(None).cast("string").alias("content_hash")).filter("repo_id IS NOT NULL").distinct().unionByName(f)
    return packet.freshness(stored, f, n)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def counter_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.counters(_log(spark, sf).select(F.col("event_type").alias("key"), F.floor("value").alias("delta")))


_COUNTERS = ["total_requests", "total_tokens_saved", "total_file_tokens", "pipeline_requests", "direct_low_level_autorouted", "direct_low_level_rejected"]


def lifetime_stats(spark: SparkSession, sf: str) -> DataFrame:
    key = F.element_at(F.array(*[F.lit(k) for k in _COUNTERS]), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    per = _log(spark, sf).groupBy(F.col("user_id").alias("workspace_id"), key.alias("key")).agg(F.sum(F.floor("value")).alias("value"))
    return telemetry.lifetime(per)


def session_savings(spark: SparkSession, sf: str) -> DataFrame:
    calls = _log(spark, sf).select(F.col("user_id").alias("session"), F.floor(F.col("value") * 7).alias("file_tokens"), (F.pmod("event_id", F.lit(500))).alias("used_tokens"))
    return telemetry.sessions(calls)


def failure_ring(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.failure_ring(_log(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("tool")))


def failure_categories(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.failure_counts(table(spark, sf, "documents").select(F.col("text").alias("message")))


def activity_states(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf).select(F.col("user_id").alias("id"), F.lit("index").alias("kind"), F.col("event_type").alias("state"), F.col("ts").alias("at"))
    return telemetry.activities(log)


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of transcripts: three lines a message, every fifth line a tool use."""
    m = F.floor(F.col("event_id") / 3).cast("string")
    use = F.when(F.pmod("event_id", F.lit(5)) == 0, F.array(F.struct(F.lit("tool_use").alias("type"), F.col("event_type").alias("name"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"))))
    usage = F.struct(F.floor("value").cast("long").alias("input_tokens"), F.pmod("event_id", F.lit(97)).cast("long").alias("output_tokens"))
    line = F.struct(F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct(m.alias("id"), F.col("event_type").alias("model"), usage.alias("usage"), use.alias("content")).alias("message"))
    return _log(spark, sf).select(F.pmod("user_id", F.lit(50)).cast("string").alias("session"), F.col("event_id").alias("line_no"), F.to_json(line).alias("value"))


def transcript_usage(spark: SparkSession, sf: str) -> DataFrame:
    reqs = audit.requests(audit.read_lines(_transcripts(spark, sf)))
    return audit.by_model(reqs).select("session", "model", "requests", "input_tokens", "output_tokens")


def transcript_tools(spark: SparkSession, sf: str) -> DataFrame:
    p = audit.read_lines(_transcripts(spark, sf))
    return audit.by_tool(audit.tool_calls(audit.requests(p), p))


def workspace_inventory(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "repositories").groupBy(F.col("id").alias("workspace_id")).agg(F.min("root_path").alias("workspace_root")).withColumn("display_name", F.lit(None).cast("string"))
    scope = graph.repo_scope(_nodes(spark, sf), table(spark, sf, "files"), _edges(spark, sf)).select(F.col("repo_id").alias("workspace_id"), "repo_id", "symbols", "files")
    return registry.inventory(w, scope, scope.select("workspace_id", F.lit("").alias("message")).limit(0))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: events per hour and type."""
    return _log(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"))


def language_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The three commonest extensions of each repository's files."""
    f = table(spark, sf, "files").select("repo_id", slash("file_path").alias("p")).distinct().filter("repo_id IS NOT NULL")
    n = f.groupBy("repo_id", extension(F.col("p")).alias("language")).agg(F.count("*").alias("files"))
    return telemetry.ranked_per_key(n, "repo_id", [F.desc("files"), "language"], 3).select("repo_id", F.col("rank").cast("long").alias("rank"), "language", "files")


def self_check(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.self_check(_nodes(spark, sf).filter("repo_id IS NOT NULL AND file_path IS NOT NULL"))


def distinct_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf).select("symbol_type").distinct()


def symbol_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf).filter("symbol_name IS NOT NULL").select("repo_id", "symbol_name").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        degree_ranking, top_k_subgraph_edges, neighbor_degrees, repo_scope_counts, capsule_neighbors, impact_hubs, dependency_graph, dependency_walk, dangling_edges,
        resolve_candidates, find_symbol_prefix, find_symbol_like, pick_symbols, skeleton_listing, directory_listing, path_categories, neighbour_categories,
        sampled_paths, task_score_topk, packet_token_costs, context_packet, greedy_budget, condensed_bodies, capsules, traces, class_map, call_resolution,
        import_resolution, file_changeset, snapshot_changeset, absolute_paths, vanished_symbols, content_hash, observation_staleness, session_notes, freshness_audit, counter_rollup, lifetime_stats,
        session_savings, failure_ring, failure_categories, activity_states, transcript_usage, transcript_tools, workspace_inventory, event_windows,
        language_mix, self_check, distinct_kinds, symbol_sweep,
    )
}

_CUR = """WITH RECURSIVE newest AS (SELECT * FROM (
  SELECT id, ingested_at, repo_id, replace(file_path, '\\', '/') AS file_path, language, symbol_name, symbol_type, raw_text, source_start_byte, start_line,
    row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, symbol_name DESC NULLS LAST, raw_text DESC NULLS LAST) AS k
  FROM nodes WHERE id IS NOT NULL) WHERE k = 1),
gone AS (SELECT node_id, max(removed_at) AS removed_at FROM removed_nodes WHERE node_id IS NOT NULL AND removed_at IS NOT NULL GROUP BY 1),
cur AS (
  SELECT id, repo_id, file_path, language, symbol_name, symbol_type, raw_text, source_start_byte, start_line FROM newest LEFT JOIN gone ON id = node_id
  WHERE removed_at IS NULL OR removed_at <= ingested_at
  UNION ALL SELECT id, repo_id, replace(file_path, '\\', '/'), language, symbol_name, symbol_type, raw_text, source_start_byte, start_line FROM shared_nodes),
e AS (SELECT DISTINCT source_id, target_id, upper(relationship_type) AS kind FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
v AS (SELECT * FROM e WHERE source_id IN (SELECT id FROM cur) AND target_id IN (SELECT id FROM cur)),
ends AS (SELECT source_id AS id FROM v UNION ALL SELECT target_id FROM v),
degree AS (SELECT cur.id, CAST(coalesce(n, 0) AS BIGINT) AS degree FROM cur LEFT JOIN (SELECT id, count(*) AS n FROM ends GROUP BY 1) d ON d.id = cur.id),
top AS (SELECT cur.id, file_path, symbol_name, degree FROM cur JOIN degree ON degree.id = cur.id
  ORDER BY degree DESC, file_path NULLS LAST, symbol_name NULLS LAST, cur.id LIMIT 500),
hubs AS (SELECT target_id AS id FROM e WHERE target_id IN (SELECT id FROM cur) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
called AS (SELECT DISTINCT id AS source_id, repo_id, file_path, unnest(regexp_extract_all(raw_text, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS callee FROM cur),
f AS (SELECT DISTINCT repo_id, replace(file_path, '\\', '/') AS file_path FROM files),
fh AS (SELECT repo_id, replace(file_path, '\\', '/') AS file_path, max(content_hash) AS h FROM files GROUP BY 1, 2)
"""


def _walk(name: str, frm: str, to: str, depth: int) -> str:
    return f"""{name}_w(pivot_id, id, depth) AS (
  SELECT id, id, 0 FROM hubs UNION SELECT w.pivot_id, e.{to}, w.depth + 1 FROM {name}_w w JOIN e ON e.{frm} = w.id WHERE w.depth < {depth}),
{name}_d AS (SELECT pivot_id, id, min(depth) AS depth FROM {name}_w GROUP BY 1, 2),
{name} AS (SELECT d.pivot_id, d.id, d.depth, min(e.kind) AS kind FROM {name}_d d JOIN e ON e.{to} = d.id
  JOIN {name}_d b ON b.pivot_id = d.pivot_id AND b.id = e.{frm} AND b.depth = d.depth - 1 WHERE d.depth > 0 GROUP BY 1, 2, 3)"""


def _queue(k: int, way: int, depth: int, front: str, visited: str) -> str:
    """One level of the breadth-first walk: links met in queue order, new nodes admitted up to 200 in all, entries."""
    frm, to = ("source_id", "target_id") if way else ("target_id", "source_id")
    return f"""met{k} AS (SELECT f.pivot_id, f.id AS parent_id, f.seq AS parent, e.kind, n.id, n.symbol_name, n.file_path,
  row_number() OVER (PARTITION BY f.pivot_id ORDER BY f.seq, e.kind, n.symbol_name NULLS LAST, n.file_path NULLS LAST, n.id) AS o
  FROM {front} f JOIN e ON e.{frm} = f.id JOIN cur n ON n.id = e.{to}),
new{k} AS (SELECT pivot_id, id, o, seq, seq + (SELECT count(*) FROM {visited} v WHERE v.pivot_id = x.pivot_id) <= 200 AS room FROM (
  SELECT pivot_id, id, min(o) AS o, row_number() OVER (PARTITION BY pivot_id ORDER BY min(o)) AS seq FROM met{k} m
  WHERE NOT EXISTS (SELECT 1 FROM {visited} v WHERE v.pivot_id = m.pivot_id AND v.id = m.id) GROUP BY pivot_id, id) x),
front{k} AS (SELECT pivot_id, id, o, seq FROM new{k} WHERE room),
seen{k} AS (SELECT pivot_id, id FROM {visited} UNION ALL SELECT pivot_id, id FROM front{k}),
entry{k} AS (SELECT m.pivot_id, {way} AS way, {depth} AS depth, m.o, m.parent_id, m.kind, m.id, f.o IS NULL OR f.o <> m.o AS already_seen
  FROM met{k} m SEMI JOIN seen{k} s ON s.pivot_id = m.pivot_id AND s.id = m.id LEFT JOIN front{k} f ON f.pivot_id = m.pivot_id AND f.id = m.id)"""


_QUEUE = ", " + ", ".join([
    "start AS (SELECT id AS pivot_id, id, 0 AS seq FROM hubs)", _queue(1, 0, 1, "start", "start"), _queue(2, 0, 2, "front1", "seen1"),
    _queue(3, 1, 1, "start", "seen2"), _queue(4, 1, 2, "front3", "seen3"),
    """entries AS (SELECT pivot_id, CASE way WHEN 0 THEN 'callers' ELSE 'callees' END AS direction, CAST(depth AS BIGINT) AS depth,
  CAST(row_number() OVER (PARTITION BY pivot_id ORDER BY way, depth, o) AS BIGINT) AS position, id, kind, parent_id, already_seen
  FROM (SELECT * FROM entry1 UNION ALL SELECT * FROM entry2 UNION ALL SELECT * FROM entry3 UNION ALL SELECT * FROM entry4))""",
    """walk AS (SELECT pivot_id, CAST(count(*) AS BIGINT) AS nodes,
  CAST((SELECT count(*) FROM met1 m WHERE m.pivot_id = s.pivot_id) + (SELECT count(*) FROM met2 m WHERE m.pivot_id = s.pivot_id)
    + (SELECT count(*) FROM met3 m WHERE m.pivot_id = s.pivot_id) + (SELECT count(*) FROM met4 m WHERE m.pivot_id = s.pivot_id) AS BIGINT) AS edges,
  EXISTS (SELECT 1 FROM (SELECT * FROM new1 UNION ALL SELECT * FROM new2 UNION ALL SELECT * FROM new3 UNION ALL SELECT * FROM new4) n
    WHERE n.pivot_id = s.pivot_id AND NOT room) AS truncated FROM seen4 s GROUP BY pivot_id)""",
]) + "\n"

#: The FNV-1a hash of a text's bytes, as 16 hexadecimal digits.
_FNV = """lpad(lower(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(regexp_extract_all(hex(encode({0})), '..'),
  lambda x: CAST('0x' || x AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0')"""

_CATEGORY = """CASE WHEN list_contains(p, 'controllers') THEN 'controllers' WHEN list_contains(p, 'jobs') THEN 'jobs' WHEN list_contains(p, 'services') THEN 'services'
  WHEN list_contains(p, 'models') THEN 'models' WHEN list_contains(p, 'tests') OR list_contains(p, 'spec') THEN 'tests' ELSE 'other' END"""


def _scores() -> str:
    from skein.functions.text import task_terms

    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = []
    for t in task_terms(TASK):
        for c, p in (("symbol_name", 12), ("file_path", 6), ("symbol_type", 2)):
            out.append(f"CASE WHEN contains({low(c)}, '{t}') THEN {p} ELSE 0 END")
        out.append(f"least(coalesce((length({low('raw_text')}) - length(replace({low('raw_text')}, '{t}', ''))) // {len(t)}, 0), 5)")
    return " + ".join(out)


_SIDE = """SELECT pivot_id, '{way}' AS direction, CAST(rank AS BIGINT) AS rank, id, symbol_name, file_path, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY pivot_id ORDER BY symbol_name NULLS LAST, file_path NULLS LAST, id) AS rank FROM (
    SELECT {frm} AS pivot_id, {to} AS id, min(kind) AS kind FROM e WHERE source_id <> target_id GROUP BY 1, 2) JOIN cur USING (id)
  WHERE pivot_id IN (SELECT id FROM cur)) WHERE rank <= {limit}"""

_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(symbol_name)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

SQL = {
    "degree_ranking": _CUR + "SELECT * FROM top",
    "top_k_subgraph_edges": _CUR + "SELECT * FROM e WHERE source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top)",
    "neighbor_degrees": _CUR
    + """, near AS (SELECT h.id AS pivot_id, target_id AS id FROM hubs h JOIN e ON source_id = h.id UNION SELECT h.id, source_id FROM hubs h JOIN e ON target_id = h.id
  UNION SELECT id, id FROM hubs), d AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY 1)
SELECT pivot_id, near.id, CAST(coalesce(n, 0) AS BIGINT) AS degree FROM near LEFT JOIN d ON d.id = near.id WHERE near.id IN (SELECT id FROM cur)""",
    "repo_scope_counts": _CUR
    + """SELECT repo_id, CAST(coalesce(symbols, 0) AS BIGINT) AS symbols, CAST(coalesce(nf, 0) AS BIGINT) AS files, CAST(coalesce(oe, 0) AS BIGINT) AS out_edges
FROM (SELECT repo_id, count(*) AS symbols FROM cur GROUP BY 1) FULL JOIN (SELECT repo_id, count(*) AS nf FROM f GROUP BY 1) USING (repo_id)
LEFT JOIN (SELECT repo_id, count(*) AS oe FROM e JOIN cur ON source_id = id GROUP BY 1) USING (repo_id) WHERE repo_id IS NOT NULL""",
    "capsule_neighbors": _CUR + _SIDE.format(way="out", frm="source_id", to="target_id", limit=50) + " UNION ALL " + _SIDE.format(way="in", frm="target_id", to="source_id", limit=64),
    "impact_hubs": _CUR
    + f""", {_walk("r", "target_id", "source_id", 10)},
n AS (SELECT *, row_number() OVER (PARTITION BY pivot_id ORDER BY depth, id) AS k FROM r WHERE id IN (SELECT id FROM cur))
SELECT pivot_id, id, CAST(depth AS BIGINT) AS depth, kind, count(*) OVER (PARTITION BY pivot_id) >= 5000 AS truncated FROM n WHERE k <= 5000""",
    "dependency_graph": _CUR
    + f""", {_walk("a", "target_id", "source_id", 2)}, {_walk("b", "source_id", "target_id", 2)},
u AS (SELECT *, 0 AS way FROM a UNION ALL SELECT *, 1 FROM b),
n AS (SELECT u.*, row_number() OVER (PARTITION BY pivot_id ORDER BY way, depth, kind, symbol_name NULLS LAST, file_path NULLS LAST, u.id) AS position FROM u JOIN cur ON cur.id = u.id)
SELECT pivot_id, CASE WHEN way = 0 THEN 'callers' ELSE 'callees' END AS direction, CAST(depth AS BIGINT) AS depth, CAST(position AS BIGINT) AS position, id, kind FROM n WHERE position < 200""",
    "dependency_walk": _CUR + _QUEUE + "SELECT * FROM entries JOIN walk USING (pivot_id)",
    "class_map": _CUR
    + _QUEUE
    + f""", near AS (SELECT h.id AS pivot_id, target_id AS id FROM hubs h JOIN e ON source_id = h.id UNION SELECT h.id, source_id FROM hubs h JOIN e ON target_id = h.id)
SELECT h.id AS pivot_id, 'file' AS part, m.id AS key, CAST(0 AS BIGINT) AS value FROM hubs h JOIN cur c ON c.id = h.id JOIN cur m ON m.repo_id = c.repo_id AND m.file_path = c.file_path
UNION ALL SELECT pivot_id, direction, id, depth FROM entries WHERE NOT already_seen
UNION ALL SELECT pivot_id, 'category', {_CATEGORY}, CAST(count(*) AS BIGINT) FROM (
  SELECT DISTINCT pivot_id, file_path, string_split(lower(file_path), '/') AS p FROM near JOIN cur ON cur.id = near.id) GROUP BY 1, 3""",
    "greedy_budget": """WITH o AS (SELECT DISTINCT id, repo_id, "timestamp", observation_text FROM observations WHERE repo_id IS NOT NULL),
c AS (SELECT *, CAST((strlen(coalesce(observation_text, '')) + 3) // 4 AS BIGINT) AS cost, row_number() OVER (PARTITION BY repo_id ORDER BY "timestamp" DESC NULLS LAST, id DESC) AS position FROM o),
k AS (SELECT repo_id, unnest(list_reduce(list_prepend({'used': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[])}, list({'used': cost, 'kept': [position]} ORDER BY position)),
  lambda a, x: CASE WHEN a.used + x.used <= 200 THEN {'used': a.used + x.used, 'kept': list_concat(a.kept, x.kept)} ELSE a END).kept) AS position FROM c GROUP BY 1)
SELECT repo_id, id, CAST(position AS BIGINT) AS position, cost FROM c JOIN k USING (repo_id, position)""",
    "content_hash": _CUR + f"SELECT id, CASE WHEN raw_text IS NOT NULL THEN {_FNV.format('raw_text')} END AS content_hash FROM cur",
    "observation_staleness": _CUR
    + f""", o AS (SELECT DISTINCT id, repo_id, symbol_name, replace(filepath, '\\', '/') AS file_path, last_known_hash, coalesce(is_stale, FALSE) AS is_stale FROM observations),
h AS (SELECT repo_id, file_path, symbol_name, min(h) AS lo, max(h) AS hi FROM (
  SELECT repo_id, file_path, symbol_name, {_FNV.format('raw_text')} AS h FROM cur SEMI JOIN o USING (repo_id, file_path, symbol_name) WHERE raw_text IS NOT NULL) GROUP BY 1, 2, 3)
SELECT o.id, o.repo_id, o.symbol_name, o.file_path, o.is_stale OR coalesce(lo <> last_known_hash OR hi <> last_known_hash, FALSE)
  OR NOT EXISTS (SELECT 1 FROM f WHERE f.repo_id = o.repo_id AND f.file_path = o.file_path) AS is_stale
FROM o LEFT JOIN h ON h.repo_id = o.repo_id AND h.file_path = o.file_path AND h.symbol_name = o.symbol_name""",
    "dangling_edges": _CUR
    + "SELECT kind, CAST(count(*) AS BIGINT) AS edges, CAST(count(*) - coalesce((SELECT count(*) FROM v WHERE v.kind = e.kind), 0) AS BIGINT) AS dangling FROM e GROUP BY kind",
    "resolve_candidates": _CUR
    + """, a AS (SELECT DISTINCT repo_id, symbol_name FROM observations WHERE symbol_name IS NOT NULL AND repo_id IS NOT NULL),
j AS (SELECT a.repo_id || '|' || a.symbol_name AS ask_id, id, file_path FROM a JOIN cur ON cur.repo_id = a.repo_id AND cur.symbol_name = a.symbol_name)
SELECT ask_id, CAST(p AS BIGINT) AS position, CAST(m AS BIGINT) AS matches, id, file_path FROM (
  SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY file_path NULLS LAST, id) AS p, count(*) OVER (PARTITION BY ask_id) AS m FROM j) WHERE p <= 20""",
    "find_symbol_prefix": _CUR
    + f""", t AS (SELECT id, symbol_name, file_path, {_TOKENS} AS t FROM cur WHERE symbol_name IS NOT NULL),
c AS (SELECT *, len(t) AS n, len(list_filter(t, lambda x: starts_with(x, 'ind'))) AS a, len(list_filter(t, lambda x: starts_with(x, 'bud'))) AS b FROM t),
s AS (SELECT count(*) AS n, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
h AS (SELECT id, symbol_name, file_path,
  ln((s.n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * c.n / m)) + ln((s.n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * c.n / m)) AS score
  FROM c, s WHERE a > 0 AND b > 0)
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, symbol_name, file_path NULLS LAST, id) AS BIGINT) AS rank, id, symbol_name, file_path, round(score, 6) AS score FROM h
ORDER BY rank LIMIT 51""",
    "find_symbol_like": _CUR
    + """SELECT CAST(row_number() OVER (ORDER BY length(symbol_name), symbol_name, file_path NULLS LAST, id) AS BIGINT) AS rank, id, symbol_name, file_path, CAST(0 AS DOUBLE) AS score FROM cur
WHERE contains(symbol_name, '_') AND contains(lower(symbol_type), 'method') ORDER BY rank LIMIT 51""",
    "pick_symbols": _CUR
    + """SELECT id, symbol_name, file_path FROM cur WHERE contains(lower(symbol_name), 'cursor') OR contains(lower(file_path), 'cursor')
ORDER BY translate(symbol_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') NULLS FIRST, file_path, id LIMIT 21""",
    "skeleton_listing": _CUR
    + """SELECT repo_id, CAST(k AS BIGINT) AS position, file_path, symbol_name, symbol_type, start_line FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path NULLS LAST, source_start_byte NULLS LAST, id) AS k FROM cur
  WHERE regexp_matches(symbol_type, '(?i)function|class|struct|trait|interface|method|enum|impl|module|type|union|macro')) WHERE k <= 2000""",
    "directory_listing": _CUR + "SELECT repo_id, CAST(count(*) AS BIGINT) AS symbols FROM cur WHERE file_path = 'src/core' OR starts_with(file_path, 'src/core/') GROUP BY 1",
    "path_categories": _CUR
    + f"SELECT {_CATEGORY} AS category, CAST(count(*) AS BIGINT) AS files FROM (SELECT DISTINCT repo_id, file_path, string_split(lower(file_path), '/') AS p FROM cur) GROUP BY 1",
    "neighbour_categories": _CUR
    + f""", near AS (SELECT h.id AS pivot_id, target_id AS id FROM hubs h JOIN e ON source_id = h.id UNION SELECT h.id, source_id FROM hubs h JOIN e ON target_id = h.id)
SELECT pivot_id, {_CATEGORY} AS category, CAST(count(*) AS BIGINT) AS files FROM (
  SELECT DISTINCT pivot_id, file_path, string_split(lower(file_path), '/') AS p FROM near JOIN cur ON cur.id = near.id) GROUP BY 1, 2""",
    "sampled_paths": _CUR
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) - 1 AS i, count(*) OVER (PARTITION BY repo_id) AS n FROM (
  SELECT DISTINCT repo_id, file_path FROM cur WHERE repo_id IS NOT NULL AND file_path IS NOT NULL)),
k AS (SELECT unnest(range(8)) AS position)
SELECT repo_id, CAST(position AS BIGINT) AS position, file_path FROM p, k WHERE position < n AND i = CASE WHEN n <= 8 THEN position ELSE position * (n - 1) // 7 END""",
    "task_score_topk": _CUR
    + f"""SELECT cur.id, file_path, symbol_name, CAST(s AS BIGINT) AS score, degree FROM (SELECT *, {_scores()} AS s FROM cur) cur JOIN degree ON degree.id = cur.id WHERE s > 0
ORDER BY s DESC, degree DESC, file_path NULLS LAST, symbol_name NULLS LAST, cur.id LIMIT 25""",
    "packet_token_costs": _CUR
    + """SELECT repo_id, CAST(sum((b + 3) // 4) AS BIGINT) AS packet_tokens, CAST(sum(b // 4) AS BIGINT) AS capsule_tokens FROM (
  SELECT repo_id, strlen(coalesce(raw_text, '')) AS b FROM cur) GROUP BY 1""",
    "call_resolution": _CUR
    + """, t AS (SELECT repo_id, file_path, symbol_name AS callee, id FROM cur WHERE symbol_name IS NOT NULL AND symbol_type NOT IN ('interface', 'type', 'union', 'macro')
  AND NOT (symbol_type IN ('struct', 'enum') AND language IN ('c', 'cpp', 'cc', 'cxx', 'h', 'hpp'))),
one AS (SELECT repo_id, callee, min(id) AS id FROM t GROUP BY 1, 2 HAVING count(*) = 1),
near AS (SELECT source_id, t.id AS target_id FROM called c JOIN t ON t.repo_id = c.repo_id AND t.file_path = c.file_path AND t.callee = c.callee),
far AS (SELECT source_id, one.id AS target_id FROM called c JOIN one ON one.repo_id = c.repo_id AND one.callee = c.callee
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.repo_id = c.repo_id AND t.file_path = c.file_path AND t.callee = c.callee))
SELECT DISTINCT source_id, target_id, 'CALLS' AS kind FROM (SELECT * FROM near UNION ALL SELECT * FROM far) WHERE source_id <> target_id""",
    "import_resolution": _CUR
    + """, i AS (SELECT DISTINCT repo_id, file_path, callee FROM called WHERE repo_id IS NOT NULL),
s AS (SELECT repo_id, symbol_name, count(*) AS n, min(id) AS id FROM cur WHERE symbol_name IS NOT NULL AND repo_id IS NOT NULL GROUP BY 1, 2),
hit AS (SELECT i.repo_id, i.file_path, min(s.id) AS target_id FROM i JOIN s ON s.symbol_name = i.callee AND s.repo_id <> i.repo_id GROUP BY i.repo_id, i.file_path, i.callee HAVING sum(s.n) = 1),
first AS (SELECT repo_id, file_path, min(id) AS source_id FROM cur GROUP BY 1, 2)
SELECT DISTINCT source_id, target_id, 'IMPORTS' AS kind FROM hit JOIN first ON first.repo_id = hit.repo_id AND first.file_path = hit.file_path""",
    "file_changeset": _CUR
    + """, s AS (SELECT DISTINCT repo_id, file_path, 1 AS there FROM cur)
SELECT repo_id, file_path, CASE WHEN known IS NULL THEN 'added' WHEN there IS NULL THEN 'removed' WHEN h IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT *, 1 AS known FROM fh) FULL JOIN s USING (repo_id, file_path)""",
    "snapshot_changeset": _CUR
    + """, oldest AS (SELECT id, repo_id, path, coalesce(digest, '') AS digest FROM (SELECT id, repo_id, replace(file_path, '\\', '/') AS path, md5(raw_text) AS digest,
  row_number() OVER (PARTITION BY id ORDER BY ingested_at, repo_id NULLS FIRST, replace(file_path, '\\', '/') NULLS FIRST, coalesce(md5(raw_text), '')) AS k
  FROM nodes WHERE id IS NOT NULL AND ingested_at IS NOT NULL) WHERE k = 1),
a AS (SELECT repo_id, path AS file_path, string_agg(id || ':' || digest, ',' ORDER BY id || ':' || digest) AS h FROM oldest WHERE repo_id IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
b AS (SELECT repo_id, file_path, string_agg(id || ':' || coalesce(md5(raw_text), ''), ',' ORDER BY id || ':' || coalesce(md5(raw_text), '')) AS h FROM cur
  WHERE repo_id IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2)
SELECT repo_id, file_path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (repo_id, file_path)""",
    "absolute_paths": _CUR
    + """, r AS (SELECT id AS repo_id, min(rtrim(replace(root_path, '\\', '/'), '/')) AS root FROM repositories WHERE id IS NOT NULL AND root_path IS NOT NULL GROUP BY 1)
SELECT id, root || '/' || file_path AS path FROM cur JOIN r USING (repo_id) WHERE file_path IS NOT NULL""",
    "vanished_symbols": _CUR + "SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM cur)",
    "session_notes": """SELECT DISTINCT id, repo_id, symbol_name, replace(filepath, '\\', '/') AS filepath,
  CASE WHEN coalesce(is_stale, FALSE) THEN '[stale] ' ELSE '' END || observation_text AS note, "timestamp" FROM observations WHERE repo_id = 'granite-hub'""",
    "freshness_audit": _CUR
    + """, stored AS (SELECT repo_id, file_path, max(h) AS old FROM (SELECT * FROM fh UNION ALL SELECT repo_id, file_path, NULL FROM cur WHERE repo_id IS NOT NULL) GROUP BY 1, 2),
j AS (SELECT s.repo_id, CASE WHEN fh.h IS NULL THEN 'unavailable' WHEN fh.h = old THEN 'fresh' ELSE 'stale' END AS k FROM stored s LEFT JOIN fh USING (repo_id, file_path)),
p AS (SELECT repo_id, CAST(count(*) FILTER (k = 'stale') AS BIGINT) AS stale, CAST(count(*) FILTER (k = 'unavailable') AS BIGINT) AS unavailable, CAST(count(*) FILTER (k = 'fresh') AS BIGINT) AS fresh FROM j GROUP BY 1)
SELECT repo_id, CASE WHEN repo_id NOT IN (SELECT repo_id FROM cur WHERE repo_id IS NOT NULL) THEN 'missing' WHEN stale > 0 THEN 'stale' WHEN unavailable > 0 THEN 'unavailable' ELSE 'fresh' END AS status,
  stale, unavailable, fresh FROM p""",
    "counter_rollup": "SELECT event_type AS key, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1",
    "lifetime_stats": "WITH c AS (SELECT event_id % 6 AS k, CAST(floor(value) AS BIGINT) AS v FROM events), t AS (SELECT "
    + ", ".join(f"CAST(coalesce(sum(v) FILTER (k = {i}), 0) AS BIGINT) AS {k}" for i, k in enumerate(_COUNTERS))
    + """ FROM c) SELECT *, CASE WHEN total_file_tokens > 0 THEN total_tokens_saved * 100.0 / total_file_tokens ELSE 0 END AS reduction_pct,
CASE WHEN pipeline_requests + direct_low_level_autorouted + direct_low_level_rejected > 0
  THEN pipeline_requests * 100.0 / (pipeline_requests + direct_low_level_autorouted + direct_low_level_rejected) ELSE 0 END AS compliance_pct FROM t""",
    "session_savings": """WITH c AS (SELECT user_id AS session, CAST(floor(value * 7) AS BIGINT) AS f, event_id % 500 AS u FROM events)
SELECT session, CAST(count(*) AS BIGINT) AS calls, CAST(sum(f) AS BIGINT) AS file_tokens, CAST(sum(u) AS BIGINT) AS used_tokens,
  CAST(sum(greatest(f - u, 0)) AS BIGINT) AS saved, CAST(sum(f - u) AS BIGINT) AS signed FROM c GROUP BY 1""",
    "failure_ring": "SELECT event_id AS id, event_type AS tool FROM events ORDER BY event_id DESC LIMIT 50",
    "failure_categories": """SELECT CASE WHEN contains(text, 'not found in repo') THEN 'symbol_not_found' WHEN contains(text, 'registered workspace') THEN 'repo_not_found'
  WHEN contains(text, 'missing required argument') OR contains(text, 'invalid') THEN 'invalid_params' WHEN contains(text, 'mutex') OR contains(text, 'poisoned') THEN 'internal'
  ELSE 'other' END AS category, CAST(count(*) AS BIGINT) AS failures FROM documents GROUP BY 1""",
    "activity_states": """SELECT id, 'index' AS kind, state, "at" FROM (SELECT user_id AS id, event_type AS state, ts AS "at",
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) WHERE k = 1""",
    "transcript_usage": """WITH l AS (SELECT CAST(user_id % 50 AS VARCHAR) AS session, event_id // 3 AS m, event_type AS model, CAST(floor(value) AS BIGINT) AS i, event_id % 97 AS o,
  row_number() OVER (PARTITION BY user_id % 50, event_id // 3 ORDER BY event_id) AS k FROM events)
SELECT session, model, CAST(count(*) AS BIGINT) AS requests, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM l WHERE k = 1 GROUP BY 1, 2""",
    "transcript_tools": "SELECT CAST(user_id % 50 AS VARCHAR) AS session, event_type AS tool, CAST(count(*) AS BIGINT) AS calls FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2",
    "workspace_inventory": _CUR
    + """, w AS (SELECT id AS workspace_id, min(root_path) AS label FROM repositories GROUP BY 1),
s AS (SELECT repo_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT repo_id, count(*) AS a FROM cur GROUP BY 1) FULL JOIN (SELECT repo_id, count(*) AS b FROM f GROUP BY 1) USING (repo_id) WHERE repo_id IS NOT NULL)
SELECT workspace_id, label, CASE WHEN s.repo_id IS NULL THEN 'missing_db' WHEN a = 0 AND b = 0 THEN 'empty' ELSE 'available' END AS status,
  CAST(CASE WHEN s.repo_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS repos, CAST(coalesce(a, 0) AS BIGINT) AS symbols, CAST(coalesce(b, 0) AS BIGINT) AS files FROM w LEFT JOIN s ON s.repo_id = workspace_id""",
    "language_mix": """WITH f AS (SELECT DISTINCT repo_id, replace(file_path, '\\', '/') AS p FROM files WHERE repo_id IS NOT NULL),
n AS (SELECT repo_id, lower(split_part(p, '.', -1)) AS language, count(*) AS files FROM f GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY files DESC, language) AS rank FROM n)
SELECT repo_id, CAST(rank AS BIGINT) AS rank, language, CAST(files AS BIGINT) AS files FROM k WHERE rank <= 3""",
    "self_check": _CUR + """SELECT repo_id, file_path, min(symbol_name) AS symbol_name, TRUE AS found_slash, TRUE AS found_backslash FROM cur
WHERE symbol_name IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2""",
    "distinct_kinds": _CUR + "SELECT DISTINCT symbol_type FROM cur",
    "symbol_sweep": _CUR + "SELECT DISTINCT repo_id, symbol_name FROM cur WHERE symbol_name IS NOT NULL",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1, 2",
}
