"""The ten questions of an index as methods, and their JSON envelopes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, intent, search, stats
from .operators.store import VERSION, Snapshot, Store

CPP_NOTE = "The graph of C++ code holds only what could be resolved without a compiler."


class Engine:
    """Answers over a snapshot. Methods return DataFrames; envelope() makes the JSON that tools are sent."""

    def __init__(self, state: Snapshot, meta: dict | None = None, stemmed: bool = True, index: search.Index | None = None):
        self.state, self.meta = state, meta or {}
        self.index = index or search.Index.build(state.chunks, stemmed)

    @classmethod
    def open(cls, store: Store) -> Engine:
        """With the text index that the store keeps in step with its chunks."""
        return cls(store.open(), store.meta(), index=store.index())

    @property
    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.state.entities, self.state.edges, self.state.chunks

    def search(self, query: str, kind: str = "", limit: int = 20, offset: int = 0, path_prefix: str = "") -> DataFrame:
        """A page of hits, best first, each with a snippet of its chunk."""
        hits = search.search(self.index, *self._tables, query, kind, limit, offset, path_prefix)
        return search.snippets(hits, self.state.chunks, query).orderBy("score", "id")

    def get_entity(self, id: str, cap: int = 50) -> dict[str, DataFrame]:
        return graph.entity_detail(*self._tables, id, cap)

    def children(self, id: str, class_filter: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
        return graph.children(self.state.entities, id, class_filter, limit, offset)

    def references(self, id: str, direction: str = "both", depth: int = 1, edge_type: str = "", kind: str = "", limit: int = 200, offset: int = 0) -> DataFrame:
        return graph.references(self.state.entities, self.state.edges, id, direction, depth, edge_type, kind, limit, offset)

    def impact(self, id: str, max_depth: int = 4, limit: int = 200) -> DataFrame:
        return graph.impact(self.state.entities, self.state.edges, id, max_depth, limit)

    def impact_answer(self, id: str, max_depth: int = 4, limit: int = 200) -> dict[str, DataFrame]:
        """The page, with the number of all dependents, whether some are left out, and counts by kind."""
        tables = self.state.entities, self.state.edges
        return {"affected": self.impact(id, max_depth, limit), "summary": graph.impact_summary(*tables, id, max_depth, limit), "byKind": graph.impact_by_kind(*tables, id, max_depth)}

    def explain(self, topic: str, limit: int = 8) -> DataFrame:
        return search.explain(self.index, *self._tables, topic, limit if limit > 0 else 8)

    def project_stats(self, facet: str = "") -> DataFrame:
        held = [(k, str(v)) for k, v in self.meta.items() if isinstance(v, (str, int))]
        meta = self.state.entities.sparkSession.createDataFrame(held, "key string, value string") if held else None
        return stats.project_stats(self.state.entities, self.state.edges, facet, meta)

    def coverage(self, doc_type: str = "", limit: int = 500) -> DataFrame:
        return intent.coverage(self.state.entities, self.state.edges, doc_type, limit)

    def drift(self, limit: int = 200, six: bool = False) -> DataFrame:
        return intent.drift(*self._tables, limit, six)

    def doctor(self, now: str | None = None) -> DataFrame:
        """check, n, ok: the tables' health, the version of the schema, the text index against the chunks, what the store
        notes of its builds (and of the sources, if their fingerprint `now` is given), and the verdict (n: problems)."""
        checks = stats.doctor(*self._tables).unionByName(stats.upkeep(self.state.chunks, self.index.lengths, self.meta.get("version", VERSION)))
        if self.meta:
            checks = checks.unionByName(stats.freshness(self.state.entities.sparkSession, self.meta, now))
        return stats.verdict(checks)

    def envelope(self, answer: DataFrame | dict[str, DataFrame] | None, root: str = "", error: str = "") -> str:
        """{result, index, note?} or {error}. Answers are pages or capped parts, so they are small enough to collect."""
        if error or answer is None:
            return json.dumps({"error": error or "no index"})
        rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]
        result = {k: rows(v) for k, v in answer.items()} if isinstance(answer, dict) else rows(answer)
        if isinstance(answer, dict) and "entity" in result and not result["entity"]:
            result = {"error": f"unknown entity {root}"}
        out = {"result": result, "index": {k: self.meta.get(k) for k in ("lastIngestAtIso", "lastGeneratedAtIso", "projectName")}}
        if root.startswith("cpp:"):
            out["note"] = CPP_NOTE
        return json.dumps(out, ensure_ascii=False)
