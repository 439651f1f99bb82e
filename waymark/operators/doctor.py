"""Coverage of packages by documents, a score, issues and next actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import badge_color, half_up, percent


def coverage(ownership: DataFrame, index_doc: str) -> DataFrame:
    """One row: total, with_agent_doc, with_human_doc. The corpus index is no agent document of its own."""
    has_agent = F.col("agentDoc").isNotNull() & (F.col("agentDoc") != index_doc)
    return ownership.agg(F.count("*").alias("total"), F.count_if(has_agent).alias("with_agent_doc"), F.count_if(F.col("humanDoc").isNotNull()).alias("with_human_doc"))


def document_coverage(knowledge: DataFrame, corpus: DataFrame, index_doc: str) -> DataFrame:
    """One row: total and indexed documents of the corpus without its index."""
    known = knowledge.select("path").distinct().withColumn("known", F.lit(True))
    return corpus.where(F.col("path") != index_doc).join(known, "path", "left").agg(F.count("*").alias("docs"), F.count_if("known").alias("indexed"))


def unindexed(knowledge: DataFrame, corpus: DataFrame, index_doc: str) -> DataFrame:
    return corpus.where(F.col("path") != index_doc).join(knowledge, "path", "left_anti").select("path")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def points(total: Column, with_agent: Column, with_human: Column, indexed: Column, has_index: Column, fresh: Column, gates_passed: Column, gates: Column) -> Column:
    """15 for an index, 15 if fresh, up to 35 and 20 for agent and human documents, 15 if all gates pass, else up to 10."""
    share = lambda n, most: half_up(n / total * most)
    docs = F.when(total > 0, share(with_agent, 35) + share(with_human, 20)).when(indexed > 0, 35).otherwise(0)
    gate = F.when(gates_passed == gates, 15).otherwise(half_up(gates_passed / F.greatest(gates, F.lit(1)) * 10))
    raw = F.when(has_index, 15).otherwise(0) + F.when(fresh, 15).otherwise(0) + docs + gate
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")


def score(packages: DataFrame, documents: DataFrame, gates: DataFrame, has_index: bool, fresh: bool) -> DataFrame:
    """One row of coverage, gates, score, grade and percentages."""
    g = gates.agg(F.count_if("ok").alias("gates_passed"), F.count("*").alias("gates"))
    one = packages.crossJoin(documents).crossJoin(g)  # one row each
    c = F.col
    out = one.withColumn("score", points(c("total"), c("with_agent_doc"), c("with_human_doc"), c("indexed"), F.lit(has_index), F.lit(fresh), c("gates_passed"), c("gates")))
    return out.withColumn("grade", grade(c("score"))).withColumn("handoff_pct", percent(c("with_agent_doc"), c("total"))).withColumn("bridge_pct", percent(c("with_human_doc"), c("total")))


def issues(ownership: DataFrame, gates: DataFrame, index_doc: str, has_index: bool, fresh: bool, tool: str = "waymark") -> DataFrame:
    """(kind, pos, severity, code, message, action), one row a defect, in the order kind, pos."""
    spark = ownership.sparkSession
    row = lambda df, kind, severity, code, message, action, pos: df.select(F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), severity.alias("severity"), code.alias("code"), message.alias("message"), action.alias("action"))
    lit = F.lit
    index = [(1, 0, "error", "index-missing", "No index found.", f"{tool} index")] if not has_index else [(1, 0, "error", "index-stale", f"Index is stale. Run: {tool} index", f"{tool} index")] if not fresh else []
    out = spark.createDataFrame(index, "kind int, pos long, severity string, code string, message string, action string")
    no_agent = ownership.where(F.col("agentDoc").isNull() | (F.col("agentDoc") == index_doc))
    no_human = ownership.where(F.col("humanDoc").isNull())
    bad = gates.where(~F.col("ok"))
    is_fresh = F.col("id") == "index-freshness"
    return (
        out.unionByName(row(no_agent, 2, lit("warn"), lit("missing-agent-doc"), F.format_string('Package "%s" has no dedicated agent doc.', "id"), F.format_string(f"{tool} init --scaffold-workspaces  # or edit docs/for-agents/packages/%s.md", "id"), F.col("pos")))
        .unionByName(row(no_human, 3, lit("info"), lit("missing-human-doc"), F.format_string('Package "%s" has no linked human guide.', "id"), lit(f"{tool} bootstrap agent-docs"), F.col("pos")))
        .unionByName(row(bad, 4, F.when(is_fresh, "error").otherwise("warn"), F.concat(lit("gate-"), "id"), F.col("message"), F.when(is_fresh, f"{tool} index").otherwise(f"{tool} gate run"), lit(0)))
    )


def next_actions(found: DataFrame, ownership: DataFrame, index_doc: str, tool: str = "waymark", most: int = 6) -> DataFrame:
    """(n, action): distinct actions in the order of the issues, then a query of the first defective package; most rows at most."""
    acts = found.where("action is not null").groupBy("action").agg(F.min(F.struct("kind", "pos")).alias("at"))
    first = ownership.agg(F.min_by("id", F.when(F.col("agentDoc").isNull() | (F.col("agentDoc") == index_doc), F.col("pos"))).alias("a"), F.min_by("id", F.when(F.col("humanDoc").isNull(), F.col("pos"))).alias("h"))
    sample = first.select(F.coalesce("a", "h").alias("id")).where("id is not null").select(F.format_string(f"{tool} query package %s --agent", "id").alias("action"), F.struct(F.lit(8).alias("kind"), F.lit(0).cast("long").alias("pos")).alias("at"))
    spare = ownership.sparkSession.createDataFrame([(f"{tool} mcp install --cursor", (9, 0)), (f"{tool} gate run", (9, 1))], "action string, at struct<kind: int, pos: bigint>")
    listed = acts.unionByName(sample).groupBy("action").agg(F.min("at").alias("at"))
    none = listed.limit(1).agg((F.count("*") == 0).alias("none"))
    every = listed.unionByName(spare.crossJoin(none).where("none").select("action", "at"))
    top = every.orderBy("at").limit(most)
    return top.select(F.row_number().over(Window.orderBy("at")).alias("n"), "action")  # six rows


def healthy(found: DataFrame, gates: DataFrame) -> DataFrame:
    """One row: no issue is an error and all gates pass."""
    a = found.agg((F.count_if(F.col("severity") == "error") == 0).alias("quiet"))
    return a.crossJoin(gates.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("gates_ok"))).select((F.col("quiet") & F.col("gates_ok")).alias("ok"))


def badge(scores: DataFrame) -> DataFrame:
    """(schemaVersion, handoffPct, bridgePct, score, grade, packages, markdown)."""
    image = lambda label, key, value, pct: F.format_string(f"![{label}](https://img.shields.io/badge/{key}-%d{value}-%s?style=flat-square)", pct, badge_color(pct))
    text = F.concat_ws(" ", image("handoff coverage", "handoff_coverage", "%%25", F.col("handoff_pct")), image("human bridge", "human_bridge", "%%25", F.col("bridge_pct")), image("docs score", "docs_score", "%%2F100", F.col("score")))
    return scores.select(F.lit(1).alias("schemaVersion"), F.col("handoff_pct").alias("handoffPct"), F.col("bridge_pct").alias("bridgePct"), "score", "grade", F.col("total").alias("packages"), text.alias("markdown"))
