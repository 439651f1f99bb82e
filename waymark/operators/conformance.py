"""Documentation conformance: nine rules over evidence tables, exceptions, a summary; and the product contract's violations.

Evidence tables hold what the settings declare, one row a declared file, marker or link; ``files`` (path, size, content)
holds what exists, with a null content for files that are no readable text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.functions.markdown import trimmed

MAX_TEXT = 4 << 20


def evidence(declared: DataFrame, files: DataFrame, read_content: bool = True) -> DataFrame:
    """declared rows (path, ...) with state (ok boolean, content, detail). Paths are resolved first: a/../b is b, and what leaves the root escapes."""
    f = files.select(F.col("path").alias("at"), "size", "content", F.coalesce(F.col("is_file"), F.lit(True)).alias("is_file") if "is_file" in files.columns else F.lit(True).alias("is_file"))
    rows = declared.withColumn("at", F.when(~F.col("path").startswith("/"), paths.resolved(F.col("path")))).join(f, "at", "left")
    escapes = F.col("at").isNull()
    big = F.lit(read_content) & (F.col("size") > MAX_TEXT)
    unread = F.lit(read_content) & F.col("content").isNull()
    blank = F.lit(read_content) & (trimmed(F.col("content")) == "")
    # Details are output, as are the rules' names and messages below
    detail = (
        F.when(escapes, "Path escapes the project root.").when(F.col("size").isNull(), "File does not exist.").when(~F.col("is_file"), "Path is not a regular file.").when(F.col("size") == 0, "File is empty.")
        .when(big, f"Text evidence exceeds {MAX_TEXT} bytes.").when(unread, "File is not readable text.").when(blank, "File is empty.").otherwise("File exists and is non-empty.")
    )
    ok = ~escapes & F.col("size").isNotNull() & F.col("is_file") & (F.col("size") > 0) & ~big & ~unread & ~blank
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("detail", detail).drop("at", "size", "is_file")


def raw_sources(declared: DataFrame, text_index: str) -> DataFrame:
    """declared (path, pos) -> path: the first of those that resolve to one file, the text index itself left out."""
    key = F.coalesce(paths.resolved(F.col("path")), "path")
    rows = declared.withColumn("key", key).where(F.col("key") != text_index)
    return rows.groupBy("key").agg(F.min_by("path", "pos").alias("path")).select("path")


def _rule(df: DataFrame, rule: str, level: str, passed: Column, good: Column, bad: Column) -> DataFrame:
    passed = F.coalesce(passed, F.lit(False))
    return df.select(F.lit(rule).alias("id"), F.lit(level).alias("level"), passed.alias("passed"), F.when(passed, good).otherwise(bad).alias("message"))


def human_docs(human: DataFrame) -> DataFrame:
    n = human.agg(F.count("*").alias("n"))
    return _rule(n, "human-docs", "required", F.col("n") > 0, F.format_string("Found %d human document(s).", "n"), F.lit("No human documentation was discovered."))


def llms(committed: DataFrame, generated: DataFrame, sources: DataFrame, enabled: bool = True) -> DataFrame:
    """committed and generated (content) of one row each; sources: evidence rows of the raw sources, one a distinct path."""
    s = sources.dropDuplicates(["path"]).agg(F.count("*").alias("n"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("sources_ok"))
    both = s.crossJoin(committed.agg(F.max("content").alias("was"))).crossJoin(generated.agg(F.max("content").alias("now")))  # one row each
    passed = F.lit(enabled) & (F.col("n") > 0) & F.col("sources_ok") & (F.col("was") == F.col("now"))
    return _rule(both, "llms-and-raw-source", "required", passed, F.format_string("Resolved llms.txt and %d raw source(s).", "n"), F.lit("llms.txt must be enabled, current, and accompanied by at least one readable raw source."))


def action_ready(handoffs: DataFrame) -> DataFrame:
    ready = (F.length("startHere") > 0) & (F.size("editRoots") > 0) & (F.size("checks") > 0) & F.coalesce(F.col("bridge.humanDoc").isin("linked", "external"), F.lit(False))
    n = handoffs.agg(F.count("*").alias("total"), F.count_if(ready).alias("ready"))
    passed = (F.col("ready") > 0) & (F.col("ready") == F.col("total"))
    return _rule(n, "agent-handoffs", "required", passed, F.format_string("%d handoff(s) are action-ready and human-linked.", "ready"), F.format_string("%d/%d handoff(s) are action-ready and human-linked.", "ready", "total"))


def contribution(found: DataFrame) -> DataFrame:
    return _rule(found.agg(F.bool_or("ok").alias("any")), "contribution", "required", F.col("any"), F.lit("Contribution guidance is available."), F.lit("Contribution guidance is missing."))


def marker_details(found: DataFrame) -> DataFrame:
    """evidence rows with contains array<string> -> with the missing markers and the detail text."""
    missing = F.filter("contains", lambda m: ~F.coalesce(F.col("content"), F.lit("")).contains(m))
    text = F.when(~F.col("ok"), F.col("detail")).when(F.size("missing") > 0, F.concat(F.lit("Missing marker(s): "), F.array_join("missing", ", "))).otherwise(F.concat(F.lit("Found marker(s): "), F.array_join("contains", ", ")))
    return found.withColumn("missing", missing).withColumn("detail", text)


def markers(found: DataFrame, kind: str, level: str) -> DataFrame:
    n = marker_details(found).agg(F.bool_and(F.col("ok") & (F.size("missing") == 0)).alias("all"))
    return _rule(n, kind, level, F.col("all"), F.lit(f"{kind} evidence is complete."), F.lit(f"{kind} evidence is incomplete."))


def canonical_urls(products: DataFrame) -> DataFrame:
    """Distinct https addresses of all products' surfaces, without a final slash."""
    every = products.select(F.explode(F.array_compact(F.array(*[F.col(f"surfaces.{c}") for c in ("home", "docs", "llms", "stats")]))).alias("url"))
    return every.where(F.col("url").startswith("https://")).select(F.regexp_replace("url", r"/\z", "").alias("url")).distinct()


def cross_links(links: DataFrame, urls: DataFrame, contract_ok: bool = True) -> DataFrame:
    """links: evidence rows (url, path, ok, content), one for each source of a link; each must stand in a source and be canonical."""
    per = links.groupBy("url").agg(F.bool_or(F.col("ok") & F.col("content").contains(F.col("url"))).alias("found")).withColumn("key", F.regexp_replace("url", r"/\z", ""))
    known = per.join(urls.select(F.col("url").alias("key"), F.lit(True).alias("known")), "key", "left")
    n = known.agg(F.count("*").alias("n"), F.bool_and(F.coalesce("found", F.lit(False)) & F.coalesce("known", F.lit(False))).alias("all"))
    return _rule(n, "cross-links", "required", F.col("all") & F.lit(contract_ok), F.format_string("%d required ecosystem link(s) resolve in source.", "n"), F.lit("One or more required ecosystem links are missing from source."))


def quickstarts(rows: DataFrame) -> DataFrame:
    """rows (id, doc_ok, test_ok, test_content, contains, command)."""
    good = F.col("doc_ok") & F.col("test_ok") & F.forall("contains", lambda m: F.coalesce(F.col("test_content"), F.lit("")).contains(m)) & (trimmed(F.col("command")) != "")
    n = rows.agg(F.count("*").alias("n"), F.bool_and(good).alias("all"))
    return _rule(n, "tested-quickstarts", "required", F.col("all"), F.format_string("%d quickstart(s) have executable test evidence.", "n"), F.lit("Quickstart test evidence is incomplete."))


def visuals(found: DataFrame) -> DataFrame:
    n = found.agg(F.count("*").alias("n"), F.bool_and("ok").alias("all"))
    return _rule(n, "visual-explanations", "recommended", F.col("all"), F.format_string("%d visual asset(s) found.", "n"), F.lit("Visual explanation evidence is incomplete."))


def rules(results: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def documentation_standard(human: DataFrame, committed: DataFrame, generated: DataFrame, sources: DataFrame, handoffs: DataFrame, guidance: DataFrame, metadata: DataFrame, links: DataFrame, urls: DataFrame, starts: DataFrame, assets: DataFrame, diagrams: DataFrame, exceptions: DataFrame, text_index: bool = True, contract_ok: bool = True) -> DataFrame:
    """The nine rules' results with their exceptions: (id, level, passed, message, exception, status, ok). Each argument is what the rule of its kind takes."""
    drafts = [
        human_docs(human), llms(committed, generated, sources, text_index), action_ready(handoffs), contribution(guidance), markers(metadata, "metadata", "required"), cross_links(links, urls, contract_ok), quickstarts(starts), visuals(assets),
        markers(diagrams, "structured-diagrams", "recommended"),
    ]
    return apply_exceptions(rules(drafts), exceptions)


def apply_exceptions(results: DataFrame, exceptions: DataFrame) -> DataFrame:
    """A failing rule with an exception (ruleId, reason, approvedBy, trackingUrl) is excepted and counts as ok."""
    e = exceptions.groupBy(F.col("ruleId").alias("id")).agg(F.min(F.struct("reason", "approvedBy", "trackingUrl")).alias("exception"))
    rows = results.join(e, "id", "left")
    status = F.when(F.col("passed"), "pass").when(F.col("exception").isNotNull(), "excepted").otherwise("fail")
    return rows.withColumn("status", status).withColumn("ok", status != "fail").withColumn("exception", F.when(status == "excepted", F.col("exception")))


def summary(results: DataFrame) -> DataFrame:
    """(level, passed, failed, excepted, ok) for each level."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy("level").agg(n("pass").alias("passed"), n("fail").alias("failed"), n("excepted").alias("excepted"), F.bool_and("ok").alias("ok"))


def duplicate_exceptions(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("ruleId").count().where("count > 1").select("ruleId")


def violations(products: DataFrame, claims: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """(rule, key, detail): one row for each broken rule of the product contract.

    products (id, name, shortName, repo, promise, kind, accent, surfaces struct, navigation struct<next, order, showInBar>); claims
    (productId, source struct<type, url, repo>, verification, claims array<struct<id, value, conservativeFloor, evidence struct<type, repo>>>); properties
    (pos, id, name, barLabel, domain, url, repo, tagline, kind, accent, llms, stats), an older projection of products.
    """
    row = lambda df, rule, key, detail=None: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))
    c = F.col
    n = products.groupBy("id").count().where("count > 1")
    out = [row(n, "product-id-unique", c("id"))]
    out.append(row(products.where((c("surfaces.documentation") == "fumadocs") & c("surfaces.docs").isNull()), "docs-surface-required", c("id")))
    bar = products.where(c("navigation.showInBar"))
    out.append(row(bar.where(c("surfaces.home").isNull() | c("navigation.order").isNull()), "bar-needs-home-and-order", c("id")))
    out.append(row(bar.where(c("navigation.order").isNotNull()).groupBy(c("navigation.order").alias("o")).count().where("count > 1"), "bar-order-unique", c("o")))
    edges = products.select("id", F.explode("navigation.next").alias("to"))
    out.append(row(edges.where(c("id") == c("to")), "navigation-self", c("id")))
    out.append(row(edges.groupBy("id", "to").count().where("count > 1"), "navigation-duplicate", c("id"), c("to")))
    ids = products.select(c("id").alias("to")).distinct()
    out.append(row(edges.select("id", "to").distinct().join(ids, "to", "left_anti"), "navigation-unknown", c("id"), c("to")))
    out.append(row(claims.groupBy("productId").count().where("count > 1"), "claims-unique", c("productId")))
    pair = products.select(c("id"), c("repo"), c("surfaces.stats").alias("stats")).dropDuplicates(["id"]).join(claims, c("id") == c("productId"), "full_outer")
    out.append(row(pair.where(c("productId").isNull()), "claims-missing", c("id")))
    out.append(row(pair.where(c("id").isNull()), "claims-unknown", c("productId")))
    known = pair.where(c("id").isNotNull() & c("productId").isNotNull())
    kind = c("source.type")
    out.append(row(known.where((kind == "endpoint") & ~c("source.url").eqNullSafe(c("stats"))), "source-endpoint", c("id")))
    out.append(row(known.where((kind == "repository") & ~c("source.repo").eqNullSafe(c("repo"))), "source-repository", c("id")))
    out.append(row(known.where((kind == "declaration") & c("repo").isNotNull()), "source-declaration", c("id")))
    out.append(row(known.where((c("verification") == "declared") & (F.size("claims") > 0)), "declared-has-claims", c("id")))
    each = known.select("id", "repo", F.explode("claims").alias("claim"))
    out.append(row(each.groupBy("id", c("claim.id").alias("claim_id")).count().where("count > 1"), "claim-unique", c("id"), c("claim_id")))
    out.append(row(each.where(c("claim.conservativeFloor") > c("claim.value")), "claim-floor", c("id"), c("claim.id")))
    out.append(row(each.where((c("claim.evidence.type") == "repository-derivation") & ~c("claim.evidence.repo").eqNullSafe(c("repo"))), "claim-evidence", c("id"), c("claim.id")))
    if properties is not None:
        out.append(projection_violations(products, properties))
    return reduce(DataFrame.unionByName, out)


def projection_violations(products: DataFrame, properties: DataFrame) -> DataFrame:
    """Columns of the older projection that differ from their product, and properties without one."""
    c = F.col
    p = products.select(
        "id", F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in {
            "name": c("name"), "barLabel": c("shortName"), "domain": F.try_parse_url(c("surfaces.home"), F.lit("HOST")), "url": c("surfaces.home"), "repo": c("repo"), "tagline": c("promise"), "kind": c("kind"), "accent": c("accent"), "llms": c("surfaces.llms"), "stats": c("surfaces.stats"),
        }.items()]).alias("expected"),
    )
    fields = ("name", "barLabel", "domain", "url", "repo", "tagline", "kind", "accent", "llms", "stats")
    given = properties.select("id", F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[c(f).cast("string") for f in fields])).alias("given"))
    both = given.join(p, "id", "left")
    lost = both.where("expected is null").select(F.lit("projection-unknown").alias("rule"), c("id").alias("key"), F.lit(None).cast("string").alias("detail"))
    each = both.where("expected is not null").select("id", "given", F.explode("expected").alias("e")).where(~F.element_at("given", c("e.field")).eqNullSafe(c("e.value")))
    return lost.unionByName(each.select(F.lit("projection-differs").alias("rule"), c("id").alias("key"), c("e.field").alias("detail")))
