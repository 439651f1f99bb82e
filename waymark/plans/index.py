"""Build, write and check an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import tables
from waymark.config import Settings
from waymark.operators import handoff as H
from waymark.operators import sinks, validate


@dataclass
class Index:
    knowledge: DataFrame
    ownership: DataFrame
    handoff: DataFrame

    def close(self) -> None:
        """Delete the working tables that a build left in the shared folder; the index can't be read after that."""
        tables.drop(*[df for df in (self.knowledge, self.ownership) if hasattr(df, "written_at")])

    def hash(self) -> str:
        return sinks.index_hash(self.knowledge, self.ownership, self.handoff).first()[0]


def build(spark: SparkSession, docs: DataFrame, human: DataFrame, settings: Settings, discovered: DataFrame | None = None, checks: dict | None = None) -> Index:
    """docs (path, raw) and human (id, url, path, pos) -> the index tables.

    Documents are parsed once: knowledge, seeds and ownership are written to the shared folder, where later steps read the columns they need.
    Without the texts' own column raw; close() deletes them.
    """
    know = tables.written(H.build_knowledge(docs, settings).drop("raw"))
    seeds = tables.written(H.seeds(know))
    explicit = H.explicit_owners(spark, settings)
    found = discovered if discovered is not None else spark.createDataFrame([], tables.DISCOVERED)
    packages = tables.written(H.merge_packages(explicit, found, seeds if settings.ownership_from_corpus else seeds.where("origin = 'frontmatter'")))
    owners = tables.written(H.build_ownership(packages, explicit, seeds, know, human, settings, checks))
    tables.drop(seeds, packages)
    return Index(know, owners, H.handoffs(owners, settings))


def write(index: Index, path: str) -> str:
    """Write the tables, checked, and return the content hash. An index of the same hash is left as it is."""
    bad = validate.handoffs(index.handoff).where(F.size("issues") > 0).select("target.id", "issues").limit(5).collect()
    if bad:
        raise ValueError(f"handoffs break the schema: {bad}")
    spark, now = index.knowledge.sparkSession, index.hash()
    if stored_hash(spark, path) != now:
        index.knowledge.drop("frontmatter").write.mode("overwrite").parquet(f"{path}/knowledge")
        index.ownership.write.mode("overwrite").parquet(f"{path}/ownership")
        index.handoff.write.mode("overwrite").parquet(f"{path}/handoff")
        spark.createDataFrame([(1, now)], "schemaVersion int, contentHash string").withColumn("generatedAt", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/meta")
    return now


def export(index: Index, settings: Settings, project: str, generated_at: str, previous: str | None = None) -> str:
    """The JSON text of the index, for an index within the published limits; previous is the text that is there."""
    spark = index.knowledge.sparkSession
    intents = spark.createDataFrame([(i["id"], i["title"], i.get("paths", []), k) for k, i in enumerate(settings.intents)], "id string, title string, paths array<string>, pos long")
    changes = spark.createDataFrame([(c["id"], c["title"], c["startHere"], c.get("relatedPackages"), k) for k, c in enumerate(settings.changes)], "id string, title string, startHere string, relatedPackages array<string>, pos long")
    return sinks.index_json(sinks.payload(index.knowledge, index.ownership, index.handoff, intents, changes), project, generated_at, previous)


def stored_hash(spark: SparkSession, path: str) -> str | None:
    try:
        return spark.read.parquet(f"{path}/meta").first()["contentHash"]
    except AnalysisException:
        return None
