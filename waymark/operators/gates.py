"""Gates over documents and links: each gives one result row (id, ok, message, expected, actual)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import Settings, style_rules
from waymark.functions.markdown import header_field
from waymark.functions.text import AFTER, BEFORE


#: Defects that a message names; the rest are counted, and the functions that give defects give them all as rows.
LISTED = 100


def _listed(df: DataFrame, item: Column, order: str, separator: str) -> DataFrame:
    """One row (n, text): the number of rows, and the first LISTED items in order."""
    top = df.select(F.col(order).alias("o"), item.alias("t")).orderBy("o").limit(LISTED)
    text = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), separator).alias("text"))
    more = F.when(F.col("n") > LISTED, F.concat(F.lit(f"{separator}and "), (F.col("n") - LISTED).cast("string"), F.lit(" more"))).otherwise("")
    return df.agg(F.count("*").alias("n")).crossJoin(text).select("n", F.concat("text", more).alias("text"))  # one row each


def _result(df: DataFrame, gate: str, ok: Column, good: Column, bad: Column, expected: Column, actual: Column) -> DataFrame:
    return df.select(F.lit(gate).alias("id"), ok.alias("ok"), F.when(ok, good).otherwise(bad).alias("message"), F.when(~ok, expected).alias("expected"), F.when(~ok, actual).alias("actual"))


def freshness(stored_hash: str | None, current_hash: str, spark, tool: str = "waymark") -> DataFrame:
    """Whether the stored index is that of the current inputs."""
    if stored_hash is None:
        row = ("index-freshness", False, f"No index found. Run: {tool} index", current_hash, None)
    elif stored_hash == current_hash:
        row = ("index-freshness", True, "Index is fresh", None, None)
    else:
        row = ("index-freshness", False, f"Index is stale. Run: {tool} index", current_hash, stored_hash)
    return spark.createDataFrame([row], "id string, ok boolean, message string, expected string, actual string")


def missing_links(handoffs: DataFrame, human: DataFrame) -> DataFrame:
    """Distinct local human links of handoffs that no human document has; addresses of the web are not looked up."""
    local = handoffs.where(F.col("humanDoc").isNotNull() & ~F.col("humanDoc").rlike(r"\Ahttps?://")).select(F.col("humanDoc").alias("url"))
    return local.join(human.select("url"), "url", "left_anti").distinct()


def human_links(handoffs: DataFrame, human: DataFrame) -> DataFrame:
    local = handoffs.where(F.col("humanDoc").isNotNull() & ~F.col("humanDoc").rlike(r"\Ahttps?://"))
    lost = _listed(missing_links(handoffs, human), F.col("url"), "url", ", ")
    both = lost.crossJoin(local.agg(F.count("*").alias("total")))  # one row each
    return _result(both, "human-guide-links", F.col("n") == 0, F.format_string("Resolved %d humanDoc link(s)", "total"), F.concat(F.lit("Missing humanDoc link(s): "), "text"), F.lit("all local humanDoc links resolve"), F.format_string("%d missing", "n"))


def type_defects(docs: DataFrame, allowed: list[str] | None = None, index_doc: str | None = None) -> DataFrame:
    """(path, type) of documents without a type or with one that isn't allowed; the corpus index is exempt."""
    rows = docs.where(F.col("path") != (index_doc or "")).select("path", header_field(F.col("raw"), "type").alias("type"))
    return rows.where(F.col("type").isNull() | (~F.col("type").isin(allowed) if allowed is not None else F.lit(False)))


def type_gate(docs: DataFrame, settings: Settings) -> DataFrame:
    spark = docs.sparkSession
    if not settings.type_required:
        return spark.createDataFrame([("okf-type", True, "OKF type frontmatter not required", None, None)], "id string, ok boolean, message string, expected string, actual string")
    allowed = settings.allowed_types
    bad = _listed(type_defects(docs, allowed, settings.index_doc), F.col("path"), "path", ", ")
    return _result(bad, "okf-type", F.col("n") == 0, F.lit("All agent docs have OKF type frontmatter"), F.concat(F.lit("Missing or invalid OKF type frontmatter: "), "text"), F.lit(f"type: {' | '.join(allowed)}" if allowed else "type frontmatter"), F.format_string("%d invalid", "n"))


def style_checks(raw: Column) -> dict[str, Column]:
    """Rule -> whether the document meets it. Word bounds are ASCII."""
    has = lambda field: header_field(raw, field).isNotNull()
    title = lambda words: raw.rlike(rf"(?im)^##\s+({words}){AFTER}")
    return {
        "title": raw.rlike(r"(?m)^#\s+\S+"),
        "purpose": has("purpose") | title("Purpose|Goal"),
        "audience": has("audience") | title("Audience"),
        "task-orientation": title("How to|Usage|Workflow|Tasks?"),
        "examples": title("Examples?") | raw.rlike(r"```[\s\S]*?```"),
        "owner-source": has("owner") | has("source") | raw.rlike(r"(?im)^(Owner|Source):\s+\S+"),
        "no-stale-wording": ~raw.rlike(rf"(?i){BEFORE}(TODO|TBD|coming soon|eventually|placeholder){AFTER}"),
    }


def style_defects(docs: DataFrame, rules: list[str], index_doc: str | None = None) -> DataFrame:
    """(path, missing array<string>) of documents that fail a rule, missing in the order of the rules."""
    checks = style_checks(F.col("raw"))
    missing = F.array_compact(F.array(*[F.when(~checks[r], F.lit(r)) for r in rules]))
    return docs.where(F.col("path") != (index_doc or "")).select("path", missing.alias("missing")).where(F.size("missing") > 0)


def style_gate(docs: DataFrame, settings: Settings) -> DataFrame:
    profile, rules = style_rules(settings)
    if not rules:
        return docs.sparkSession.createDataFrame([("docs-style", True, "No docs-style rules configured", None, None)], "id string, ok boolean, message string, expected string, actual string")
    item = F.format_string("%s (%s)", F.col("path"), F.array_join("missing", ", "))
    bad = _listed(style_defects(docs, rules, settings.index_doc), item, "path", "; ")
    return _result(bad, "docs-style", F.col("n") == 0, F.lit(f"All agent docs pass {profile} docs-style rules"), F.concat(F.lit("Docs style issues: "), "text"), F.lit(f"{profile}: {', '.join(rules)}"), F.format_string("%d file(s) with style issues", "n"))


def run(results: list[DataFrame]) -> DataFrame:
    """All results with ``all_ok``, whether every gate passed."""
    both = reduce(DataFrame.unionByName, results)
    return both.crossJoin(both.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok")))  # a row a gate, and one row
