"""Notes: routing, targets, duplicates, safety scan, and the draft that proposes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.markdown import first_heading, first_paragraph, non_empty, slug_from_path
from waymark.functions.text import AFTER, BEFORE
from waymark.operators.search import search

#: Search score from which the best match counts as a duplicate.
DUPLICATE = 16
#: Candidates that a draft shows.
DRAFT_LINES = 1000
# Patterns, route words, reasons and texts below are output or decide it.
SECRET = rf"(?i){BEFORE}(?:api[_-]?key|token|secret|password)\s*[:=]\s*\S+"
EMAIL = rf"(?i){BEFORE}[A-Z0-9._%+-]+@(?!example\.com{AFTER})[A-Z0-9.-]+\.[A-Z]{{2,}}{AFTER}"
_TARGET = rf"(?i){BEFORE}(?:package|module)\s+([a-z0-9._/-]+)\s+(?:owns|owner|responsible|routes?){AFTER}"


def ingest(raw: DataFrame) -> DataFrame:
    """(path, raw) notes -> candidates; .agent-memory notes have confidence 0.7, rules of an editor 0.6. Other paths are left out."""
    kind = F.when(F.col("path").rlike(r"(?:\A|/)\.agent-memory/"), "agent-memory").when(F.col("path").rlike(r"(?:\A|/)\.cursor/rules/"), "cursor")
    rows = raw.withColumn("source", kind).where(F.col("source").isNotNull() & F.col("path").rlike(r"\.(?:md|mdc)\z"))
    ident = slug_from_path(F.col("path"))
    return rows.select(
        F.lit(1).alias("schemaVersion"), ident.alias("id"), "source", F.col("path").alias("rawPath"), F.coalesce(first_paragraph(F.col("raw")), first_heading(F.col("raw")), ident).alias("fact"), F.lit(None).cast("string").alias("why"), F.lit(None).cast("string").alias("howToApply"),
        F.lit("project").alias("suggestedType"), F.when(F.col("source") == "cursor", 0.6).otherwise(0.7).alias("confidence"), F.array().cast("array<string>").alias("references"),
    )


def route(fact: Column) -> Column:
    """struct<route, reason>; the first rule that holds."""
    has = lambda words: fact.rlike(rf"(?i){BEFORE}({words}){AFTER}")
    to = lambda r, why: F.struct(F.lit(r).alias("route"), F.lit(why).alias("reason"))
    return (
        F.when(has("noise|scratch|ignore|discard"), to("discard", "marked as noise"))
        .when(has("playbook|pattern|principle|best practice"), to("playbook", "generalizable pattern"))
        .when(has("user-facing|human guide|docs site|tutorial|guide"), to("human", "user-facing documentation"))
        .otherwise(to("agent", "project convention or ownership note"))
    )


def target(fact: Column) -> Column:
    return non_empty(F.regexp_extract(fact, _TARGET, 1))


def duplicates(candidates: DataFrame, knowledge: DataFrame, ownership: DataFrame) -> DataFrame:
    """(id, duplicateOf): the path of the best match of a fact if it scores enough."""
    best = search(knowledge, ownership, candidates.select(F.col("id").alias("query_id"), F.col("fact").alias("term")), 1)
    return best.where(F.col("score") >= DUPLICATE).select(F.col("query_id").alias("id"), F.col("path").alias("duplicateOf"))


def classify(candidates: DataFrame, knowledge: DataFrame | None = None, ownership: DataFrame | None = None) -> DataFrame:
    """Candidates with route, reason, target and duplicateOf."""
    rows = candidates.withColumn("r", route(F.col("fact"))).withColumn("target", target(F.col("fact")))
    out = rows.select(*candidates.columns, "r.route", "r.reason", "target")
    if knowledge is None or ownership is None:
        return out.withColumn("duplicateOf", F.lit(None).cast("string"))
    return out.join(duplicates(candidates, knowledge, ownership), "id", "left")


def safety(candidates: DataFrame) -> DataFrame:
    """(candidateId, kind, message): facts that look like holding a secret or a private address."""
    secret = F.when(F.col("fact").rlike(SECRET), F.struct(F.lit("secret").alias("kind"), F.lit("Potential secret-like value in memory fact").alias("message")))
    email = F.when(F.col("fact").rlike(EMAIL), F.struct(F.lit("private-email").alias("kind"), F.lit("Potential private email in memory fact").alias("message")))
    return candidates.select(F.col("id").alias("candidateId"), F.explode(F.array_compact(F.array(secret, email))).alias("f")).select("candidateId", "f.*")


def line(df: DataFrame) -> DataFrame:
    """(pos, line): the draft's line of each classified candidate."""
    parts = F.concat_ws(
        " | ", F.concat(F.lit("- "), "id", F.lit(": "), "route"), F.concat(F.lit("reason="), "reason"), F.when(F.col("target") != "", F.concat(F.lit("target="), "target")), F.when(F.col("duplicateOf") != "", F.concat(F.lit("duplicateOf="), "duplicateOf")), F.concat(F.lit("fact="), "fact")
    )
    return df.select("pos", parts.alias("line"))


def draft(classified: DataFrame, findings: DataFrame) -> DataFrame:
    """One row (ok, title, body). The draft is a text for people: it shows the first DRAFT_LINES candidates by pos and counts the rest, which line() gives."""
    title = "Draft memory promotion"
    top = line(classified).orderBy("pos").limit(DRAFT_LINES)
    shown = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("shown"))
    more = F.when(F.col("n") > DRAFT_LINES, F.concat(F.lit("\n- and "), (F.col("n") - DRAFT_LINES).cast("string"), F.lit(" more"))).otherwise("")
    lines = classified.agg(F.count("*").alias("n")).crossJoin(shown).select(F.concat("shown", more).alias("lines"))  # one row each
    ok = findings.agg((F.count("*") == 0).alias("ok"))
    scan = F.when(F.col("ok"), "Safety scan: pass.").otherwise("Safety scan: blocked. Redact findings before PR.")
    body = F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), scan, F.lit(""), F.lit("## Candidates"), F.lit(""), F.when(F.col("lines") != "", F.col("lines")), F.lit(""), F.lit("## Policy"), F.lit(""), F.lit("- Draft only; never auto-merge."), F.lit("- Run the documentation gates before opening a PR."))
    return lines.crossJoin(ok).select("ok", F.lit(title).alias("title"), body.alias("body"))  # one row each


def first_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate of each id, agent memory before editor rules, then by path: a combining aggregate."""
    best = F.min_by(F.struct(*candidates.columns), F.struct(-F.col("confidence"), "rawPath"))
    return candidates.groupBy("id").agg(best.alias("r")).select("r.*")
