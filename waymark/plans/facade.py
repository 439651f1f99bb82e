"""One object over a written index: the lookups and reports that a tool server would offer, each validated and each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.config import Settings, gate_ids
from waymark.operators import gates, handoff, memory, retrieve, search, sinks
from waymark.sources.files import load_index, scan_notes

MOST = 100


class Waymark:
    """Reads the tables of an index once; the point lookups filter them, the others run over all of them."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings) -> None:
        self.spark, self.settings = spark, settings
        self.tables = load_index(spark, path)

    def _term(self, term: str) -> DataFrame:
        if not isinstance(term, str) or not term.strip():
            raise ValueError("term must be a text")
        return self.spark.createDataFrame([(1, term)], "query_id int, term string")

    def _limit(self, limit: int) -> int:
        if not 1 <= int(limit) <= MOST:
            raise ValueError(f"limit must be from 1 to {MOST}")
        return int(limit)

    def handoff_resolve(self, ident: str) -> DataFrame:
        """The handoff of a package; unknown ids are an error."""
        got = handoff.resolve(self.spark.createDataFrame([(ident,)], "id string"), self.tables["handoff"], self.tables["ownership"], self.settings).where("found").drop("found", "id")
        if got.isEmpty():
            raise KeyError(ident)
        return got

    def search(self, term: str, limit: int = search.K) -> DataFrame:
        return search.search(self.tables["knowledge"], self.tables["ownership"], self._term(term), self._limit(limit)).drop("query_id")

    def document(self, ref: str) -> DataFrame:
        got = handoff.fetch_document(self.tables["knowledge"], ref)
        if got.isEmpty():
            raise KeyError(ref)
        return got

    def retrieve(self, term: str, limit: int = retrieve.K) -> DataFrame:
        k = self._limit(limit)
        found = search.search(self.tables["knowledge"], self.tables["ownership"], self._term(term), k)
        return retrieve.retrieve(found, self.tables["knowledge"], self.tables["ownership"], self.settings.project or "local", k).drop("query_id")

    def gate_status(self, docs: DataFrame, human: DataFrame, current_hash: str) -> DataFrame:
        """Results of the settings' gates over the documents (path, raw), the human pages and the hash of the current inputs."""
        stored = self.tables["meta"].first()["contentHash"]
        runs = {
            "index-freshness": lambda: gates.freshness(stored, current_hash, self.spark, self.settings.tool),
            "human-guide-links": lambda: gates.human_links(self.tables["handoff"], human),
            "okf-type": lambda: gates.type_gate(docs, self.settings),
            "docs-style": lambda: gates.style_gate(docs, self.settings),
        }
        return gates.run([runs[g]() for g in gate_ids(self.settings) if g in runs])

    def listing(self, kind: str) -> DataFrame:
        """Ids of packages, or id, title and path of knowledge, in their order."""
        if kind == "packages":
            return handoff.listing(self.tables["ownership"].orderBy("pos"))
        if kind == "knowledge":
            return handoff.listing(self.tables["knowledge"].orderBy("pos"), "title", "path")
        raise ValueError("kind must be packages or knowledge")

    def capabilities(self, project: str) -> str:
        """What the index offers, as JSON."""
        return sinks.capabilities(self.settings, project, self.tables["meta"].first()["contentHash"])

    def memory_ingest(self, root: str) -> DataFrame:
        """Candidates of the notes below root, one of each id."""
        return memory.first_candidates(memory.ingest(scan_notes(self.spark, root)))

    def memory_classify(self, candidates: DataFrame) -> DataFrame:
        return memory.classify(candidates, self.tables["knowledge"], self.tables["ownership"])

    def memory_draft(self, candidates: DataFrame) -> DataFrame:
        """candidates with pos."""
        return memory.draft(self.memory_classify(candidates), memory.safety(candidates))
