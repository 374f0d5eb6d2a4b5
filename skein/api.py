"""One entry for structural questions: intents with checked parameters, alone or in a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import render
from skein.operators import capsule, graph, search
from skein.sources.tables import slash

# Intents and their other names.
INTENTS = ("analyze_repo", "find_symbol", "explore_symbol", "trace_flow", "refactor_symbol", "explore_batch", "dependency_graph", "map_class", "read_node")
ALIASES = {"analyze_impact": "refactor_symbol", "get_context_capsule": "explore_symbol", "get_skeleton": "analyze_repo"}


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    """More than one symbol; ``candidates`` lists the first of them."""

    def __init__(self, name: str, candidates: list[dict], matches: int):
        super().__init__(f"{name} names {matches} symbols")
        self.candidates, self.matches = candidates, matches


@dataclass(frozen=True)
class Query:
    intent: str
    repo_id: str | None = None
    target: str | None = None
    filepath: str | None = None
    depth: int | None = None
    direction: str = "both"
    kind: str | None = None
    limit: int = 50
    max_nodes: int = 200
    include_source: bool = False

    def checked(self) -> Query:
        intent = ALIASES.get(self.intent, self.intent)
        if intent not in INTENTS:
            raise ValueError(f"invalid intent {self.intent}")
        if intent != "analyze_repo" and not self.target:
            raise ValueError("missing required argument target")
        if self.depth is not None and not 1 <= self.depth <= (10 if intent == "refactor_symbol" else 5):
            raise ValueError("invalid depth")
        if self.direction not in ("both", "callers", "callees"):
            raise ValueError("invalid direction")
        if not 1 <= self.max_nodes <= 200 or self.limit < 1:
            raise ValueError("invalid limit")
        return self if intent == self.intent else Query(**(self.__dict__ | {"intent": intent}))


@dataclass
class Pipeline:
    """Questions to one graph: current nodes, edges ``source_id, target_id, kind``, and texts of given ids."""

    nodes: DataFrame
    edges: DataFrame
    texts: Callable[[DataFrame], DataFrame]
    failures: list[tuple[str, str]] = field(default_factory=list)

    def pivot(self, q: Query) -> DataFrame:
        """The one symbol that a query means."""
        df = self.nodes.filter((F.col("symbol_name") == q.target) & (F.lit(True) if q.repo_id is None else F.col("repo_id") == q.repo_id))
        if q.filepath:
            df = df.filter(slash("file_path") == q.filepath.replace("\\", "/"))
        rows = df.select("id", "file_path").orderBy(F.asc_nulls_last("file_path"), "id").limit(21).collect()
        if not rows:
            raise NotFound(f"{q.target} not found in repo {q.repo_id}")
        if len(rows) > 1:
            raise Ambiguous(q.target, [r.asDict() for r in rows[:20]], df.count() if len(rows) > 20 else len(rows))
        return self.nodes.sparkSession.createDataFrame([(rows[0]["id"],)], "id string")

    def run(self, query: Query) -> DataFrame:
        q = query.checked()
        if q.intent == "analyze_repo":
            df = self.nodes if q.repo_id is None else self.nodes.filter(F.col("repo_id") == q.repo_id)
            return search.listing(search.within_directory(df, q.target or "."))
        if q.intent == "find_symbol":
            return search.find_symbols(self.nodes, q.target, q.kind, q.repo_id, q.limit)
        p = self.pivot(q)
        if q.intent == "refactor_symbol":
            return graph.impact(p, self.nodes, self.edges, q.depth or 10)
        if q.intent == "dependency_graph":
            return graph.dependency_graph(p, self.nodes, self.edges, q.depth or 2, q.direction, q.max_nodes)
        if q.intent == "trace_flow":
            return capsule.traces(p, self.nodes, self.edges, self.texts)
        if q.intent == "map_class":
            return capsule.class_map(p, self.nodes, self.edges)
        return capsule.capsules(p, self.nodes, self.edges, self.texts)

    def batch(self, queries: list[Query], limit: int = render.RESPONSE_BYTES) -> list[tuple[int, str]]:
        """The rendered answer of each of 1 to 20 queries: an equal query refers to the first, an error stays within its
        section, and the sections share a byte budget, first come first served. A section that the budget cuts says so, and
        those after it say that they were left out; every query has a section."""
        if not 1 <= len(queries) <= 20:
            raise ValueError("invalid number of queries")
        seen: dict[Query, int] = {}
        out: list[tuple[int, str]] = []
        left = limit
        for i, q in enumerate(queries, 1):
            if q in seen:
                text = f"Same as {seen[q]}"
            elif left <= 0:
                text = "[left out: the budget is used]"
            else:
                seen[q] = i
                try:
                    text = render.to_text(self.run(q), left)
                except (LookupError, ValueError) as e:
                    self.failures.append((q.intent, str(e)))
                    text = f"error: {e}"
            left -= len(text.encode())
            out.append((i, text))
        return out

    def report(self, query: Query) -> str:
        """A capsule and the impact of one symbol as text."""
        base = query.__dict__ | {"depth": None}
        parts = [render.to_text(self.run(Query(**(base | {"intent": i})))) for i in ("explore_symbol", "refactor_symbol")]
        return "\n\n".join(parts)
