"""Named queries of ownership, lookups, hashes, published contracts, loaders and drafts, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark import tables
from waymark.config import Settings
from waymark.functions import paths, text
from waymark.operators import conformance, doctor, gates, handoff, memory, retrieve, sinks, validate
from waymark.plans import bindings as B
from waymark.plans import index
from waymark.plans import oracles as O
from waymark.plans import queries as Q
from waymark.sources import files, human, web
from waymark.sources.stores import store
from waymark.streaming import rebuild

#: Explicit owners: ids of documents, of declared packages and of digits alone, with and without each value.
OWNERS = """
SELECT CASE s_suppkey % 5 WHEN 0 THEN cast(s_suppkey AS string) WHEN 1 THEN concat('p', cast(s_suppkey * 8 AS string)) ELSE concat('d', cast(s_suppkey AS string)) END AS id,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('explicit/', cast(s_suppkey AS string)) END AS path, CASE s_suppkey % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN '' END AS purpose,
  CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'x,y' END AS checks, CASE WHEN s_suppkey % 7 = 0 THEN concat('own/', cast(s_suppkey AS string), '.md') END AS agent_doc, CASE s_suppkey % 5 WHEN 2 THEN '' WHEN 3 THEN concat('/h/', cast(s_suppkey AS string)) END AS human_doc, s_suppkey AS pos
FROM supplier
"""
HUMAN = """
SELECT concat(CASE page_id % 4 WHEN 0 THEN 'packages/' WHEN 1 THEN 'site/deep/' WHEN 2 THEN 'my-' ELSE '' END, 'd', cast(page_id AS string), CASE WHEN page_id % 6 = 1 THEN '/index' ELSE '' END) AS id, concat('/docs/', cast(page_id AS string)) AS url, page_id AS pos
FROM pages WHERE page_id IS NOT NULL
"""


#: Owners of a fixed number, whatever the data's size: a published index has at most 2,000.
FEW_OWNERS = """
SELECT concat('s-', cast(n_nationkey AS string)) AS id, concat('packages/s', cast(n_nationkey AS string)) AS path, n_name AS "group", CASE WHEN n_nationkey % 3 = 0 THEN 'core' END AS layer, concat('serves ', lower(n_name)) AS purpose,
  CASE WHEN n_nationkey % 4 <> 1 THEN concat('docs/d', cast(n_nationkey * 7 AS string), '.md') END AS agent_doc, CASE n_nationkey % 3 WHEN 0 THEN concat('/docs/s', cast(n_nationkey AS string)) WHEN 1 THEN concat('https://docs.example.com/', cast(n_nationkey AS string)) END AS human_doc, n_nationkey AS pos
FROM nation
"""


def _owners(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.bound(spark, d, OWNERS, "supplier").withColumnsRenamed({"agent_doc": "agentDoc", "human_doc": "humanDoc"})
    return tables.conform(rows.withColumn("checks", F.when(F.col("checks") == "", F.array().cast("array<string>")).otherwise(F.split("checks", ","))), tables.OWNERSHIP)


def ownership_build(spark: SparkSession, d: str) -> DataFrame:
    """Owners of every package: settings, seeds, discovery, guessed documents, human pages and default commands, by rank."""
    know = Q.parsed_docs(spark, d)
    seeds = tables.written(tables.conform(handoff.seeds(know), tables.SEED))
    own, found = _owners(spark, d), Q._discovered(spark, d)
    packages = tables.written(handoff.merge_packages(own, found, seeds))
    out = handoff.build_ownership(packages, own, seeds, know, Q.bound(spark, d, HUMAN, "pages"), Q.settings(), {"manager": "pnpm", "workspace": True})
    return out.select("id", "path", "purpose", F.array_join("checks", ",").alias("checks"), "agentDoc", "humanDoc")


def resolved_packages(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs of asked packages: stored, made anew from the owner, or none."""
    own, s = Q.ownership(spark, d), Q.settings()
    stored = handoff.handoffs(own.where("pos % 3 = 0"), s)
    ids = own.select("id").unionByName(own.select(F.concat("id", F.lit("x")).alias("id")))
    out = handoff.resolve(ids, stored, own, s)
    return out.select("id", "found", "startHere", F.array_join("readBeforeEditing", ",").alias("read_first"), F.array_join("editRoots", ",").alias("edit_roots"), F.col("bridge.humanDoc").alias("bridge"))


def change_routes(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs of changes, the last of an id."""
    p = tables.read(spark, d, "part")
    changes = p.select(F.concat(F.lit("c"), F.col("p_partkey") % 150).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("startHere"), F.lit(None).cast("array<string>").alias("relatedPackages"), F.col("p_partkey").alias("pos"))
    out = handoff.resolve_change(changes.select("id").distinct(), changes, Q.settings())
    return out.select(F.col("target.id").alias("id"), "startHere", F.array_join("readBeforeEditing", ",").alias("read_first"), F.array_join("editRoots", ",").alias("edit_roots"), F.array_join("notes", ",").alias("notes"))


def legacy_handoffs(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs of an older form get their version; the keys of a listing with it."""
    rows = handoff.listing(Q.ownership(spark, d), "pos").withColumn("schemaVersion", F.when(F.col("pos") % 2 == 0, 1))
    return handoff.normalized_handoff(rows).select("id", F.col("schemaVersion").cast("long").alias("schemaVersion"))


def documents_by_ref(spark: SparkSession, d: str) -> DataFrame:
    """The document of a path, else the first of an id."""
    know = Q.knowledge(spark, d)
    refs = ("docs/d5.md", "doc-8", "docs/none.md", "doc-700")
    out = [handoff.fetch_document(know, r).select(F.lit(r).alias("ref"), "id", "path") for r in refs]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def gate_run(spark: SparkSession, d: str) -> DataFrame:
    """All four gates with whether all passed."""
    s = Settings(agent_index="docs/d7.md", human=[{}], preset="strict", allowed_types=["guide", "draft"], style={"profile": "title-only"})
    docs = Q.agent_docs(spark, d)
    fresh = gates.freshness("a" * 64, "b" * 64, spark)
    out = gates.run([fresh, gates.human_links(handoff.handoffs(Q.ownership(spark, d), s), Q.pages(spark, d).where("pos % 3 <> 0")), gates.type_gate(docs, s), gates.style_gate(docs, s)])
    return out.select("id", "ok", "expected", "actual", "all_ok")


def index_payload_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of a published index of owners, handoffs, knowledge, intents and changes."""
    n = tables.read(spark, d, "nation")
    i = F.col("n_nationkey").cast("string")
    know = n.select(F.concat(F.lit("n"), i).alias("id"), F.lit("agent-doc").alias("type"), F.col("n_name").alias("title"), F.concat(F.lit("docs/"), i, F.lit(".md")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "é \"q\"").alias("description"), F.col("n_nationkey").cast("long").alias("pos"))
    rows = Q.bound(spark, d, FEW_OWNERS, "nation").withColumnsRenamed({"agent_doc": "agentDoc", "human_doc": "humanDoc"})
    own = tables.conform(rows.withColumn("checks", F.array(F.lit("npm test"))), tables.OWNERSHIP)
    intents = n.select(F.concat(F.lit("i"), i).alias("id"), F.col("n_name").alias("title"), F.array(i).alias("paths"), F.col("n_nationkey").cast("long").alias("pos"))
    changes = n.select(F.concat(F.lit("c"), (F.col("n_nationkey") % 9).cast("string")).alias("id"), F.col("n_name").alias("title"), i.alias("startHere"), F.col("n_nationkey").cast("long").alias("pos")).withColumn("relatedPackages", F.lit(None).cast("array<string>"))
    return sinks.payload(know, own, handoff.handoffs(own, Q.settings()), intents, changes).select("contentHash", F.length("json").cast("long").alias("chars"))


def index_rows_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of an index of any size, by groups of digests."""
    know = Q.knowledge(spark, d).select("id", "path", "pos")
    none = spark.createDataFrame([], "id string")
    return sinks.index_hash(know, none, none)


def diagnosed_indexes(spark: SparkSession, d: str) -> DataFrame:
    """What is said of a starter index and of a full one, and what to run next."""
    know, own, s = Q.knowledge(spark, d), Q.ownership(spark, d), Settings(agent_index="docs/d5.md")
    starter, some = know.where("id = 'doc-5'"), handoff.handoffs(own, s)
    part = lambda kind, df, column: df.select(F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), F.col(column).alias("said"))
    return (
        part("starter", sinks.diagnostics(starter, some.limit(0), s), "message").unionByName(part("full", sinks.diagnostics(know, some, s), "message"))
        .unionByName(part("next starter", sinks.next_commands(some.limit(0), s), "command")).unionByName(part("next full", sinks.next_commands(some, s), "command"))
    )


def health(spark: SparkSession, d: str) -> DataFrame:
    """Whether an index is healthy: with and without a gate that fails."""
    own = Q.ownership(spark, d)
    one = lambda ok: spark.createDataFrame([("okf-type", ok, "m", None, None)], tables.GATE_RESULT)
    case = lambda name, ok, fresh: doctor.healthy(doctor.issues(own, one(ok), "docs/d7.md", True, fresh), one(ok)).select(F.lit(name).alias("case"), "ok")
    return case("fresh", True, True).unionByName(case("stale", True, False)).unionByName(case("gate", False, True))


def unindexed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that knowledge lacks."""
    return doctor.unindexed(Q.knowledge(spark, d).where("pos % 3 = 0"), Q.agent_docs(spark, d).select(F.regexp_replace("path", r"\A.*/", "docs/").alias("path")), "docs/d7.md")


def conformance_report(spark: SparkSession, d: str) -> DataFrame:
    """The nine documentation rules over evidence in tables, with exceptions."""
    n = tables.read(spark, d, "nation").withColumn("k", F.col("n_nationkey"))
    name = F.concat(F.lower(F.translate("n_name", " ", "-")), F.lit(".md"))
    content = F.concat("n_name", F.lit(" see https://h/"), F.col("k").cast("string"))
    exist = n.select(name.alias("path"), F.length("n_name").cast("long").alias("size"), content.alias("content"))
    known = lambda df, read=True: conformance.evidence(df, exist, read)
    declared = n.select(F.concat(F.lit("x/../"), name).alias("path"), F.array("n_name").alias("contains"))
    links = known(n.where("k < 5").select(name.alias("path"), F.concat(F.lit("https://h/"), F.col("k").cast("string")).alias("url")))
    urls = conformance.canonical_urls(n.select(F.struct(F.concat(F.lit("https://h/"), F.col("k").cast("string"), F.lit("/")).alias("home"), *[F.lit(None).cast("string").alias(c) for c in ("docs", "llms", "stats")]).alias("surfaces")))
    starts = known(n.where("k < 3").select(name.alias("path"), "k")).select("k", F.col("ok").alias("doc_ok"), F.col("ok").alias("test_ok"), F.col("content").alias("test_content"), F.array(F.lit("see")).alias("contains"), F.when(F.col("k") == 1, "  ").otherwise("run").alias("command"))
    sources = known(conformance.raw_sources(n.select(F.when(F.col("k") % 2 == 0, F.concat(F.lit("./"), name)).otherwise("llms.txt").alias("path"), F.col("k").alias("pos")), "llms.txt"))
    one = lambda value: spark.createDataFrame([(value,)], "content string")
    exceptions = spark.createDataFrame([("tested-quickstarts", "r", "a", "u"), ("metadata", "r", "a", "u")], "ruleId string, reason string, approvedBy string, trackingUrl string")
    out = conformance.documentation_standard(
        Q.pages(spark, d), one("same"), one("same"), sources, handoff.handoffs(Q.ownership(spark, d), Q.settings()), known(spark.createDataFrame([("CONTRIBUTING.md",)], "path string")),
        known(declared), links, urls, starts, known(declared.select(F.concat(F.lit("no/"), "path").alias("path")), False), known(declared.limit(0)), exceptions,
    )
    return out.select("id", "level", "status", "ok", "message", F.col("exception.reason").alias("reason"))


def duplicate_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Rules that several exceptions name."""
    return conformance.duplicate_exceptions(tables.read(spark, d, "documents").where("doc_id is not null").select(F.concat(F.lit("r"), F.col("doc_id") % 400).alias("ruleId")))


def projection_check(spark: SparkSession, d: str) -> DataFrame:
    """Columns of an older projection that differ from their product."""
    n = tables.read(spark, d, "nation")
    k, home = F.col("n_nationkey"), F.concat(F.lit("https://n"), F.col("n_nationkey").cast("string"), F.lit(".example.com/a"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    products = n.select(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("shortName"), F.lit("r").alias("repo"), F.lit("p").alias("promise"), F.lit("k").alias("kind"), none("accent"), F.struct(home.alias("home"), none("llms"), none("stats")).alias("surfaces"))
    given = n.select(
        F.concat(F.lit("n"), (k + F.when(k == 3, 100).otherwise(0)).cast("string")).alias("id"), F.when(k % 4 == 1, "other").otherwise(F.col("n_name")).alias("name"), F.col("n_name").alias("barLabel"), F.concat(F.lit("n"), k.cast("string"), F.lit(".example.com")).alias("domain"), home.alias("url"), F.lit("r").alias("repo"),
        F.lit("p").alias("tagline"), F.when(k % 5 != 2, "k").alias("kind"), F.when(k % 6 == 0, "red").alias("accent"), none("llms"), none("stats"),
    )
    return conformance.projection_violations(products, given)


def resolver_checks(spark: SparkSession, d: str) -> DataFrame:
    """Resolved handoffs with what makes them unsafe."""
    s = tables.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    start = F.when(k % 5 == 0, "../up.md").when(k % 5 == 1, "C:\\x").when(k % 5 == 2, "").otherwise("docs/a.md")
    rows = s.select(k.alias("asked"), F.struct(F.when(k % 7 == 0, k + 1).otherwise(k).alias("id")).alias("target"), start.alias("startHere"), F.when(k % 3 == 0, F.array(F.lit("docs/b.md"))).otherwise(F.array(start)).alias("readBeforeEditing"), F.when(k % 4 == 0, F.array(F.lit("/abs"))).otherwise(F.array(F.lit("src"))).alias("editRoots"), F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))).alias("checks"))
    out = validate.resolver_post_conditions(rows, "asked")
    return out.select("asked", F.array_join(F.transform("issues", lambda x: F.concat(x["path"], F.lit(" "), x["message"])), "; ").alias("issues"))


def schema_issues(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge, owners, candidates, matches, intents and changes that break their schemas."""
    docs = tables.read(spark, d, "documents").where("doc_id is not null")
    k = F.col("doc_id")
    know = docs.select(F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("id"), F.lit("t").alias("type"), F.substring("text", 1, 300).alias("title"), F.lit("p").alias("path"), F.col("text").alias("description"))
    own = Q.ownership(spark, d).withColumn("checks", F.when(F.col("pos") % 4 == 0, F.array(F.lit(""))).otherwise(F.col("checks"))).withColumn("layer", F.when(F.col("pos") % 5 == 0, F.repeat(F.lit("x"), 33)))
    notes = Q.notes(spark, d).select(F.lit(1).alias("schemaVersion"), "id", F.lit("cursor").alias("source"), "fact", F.lit("project").alias("suggestedType"), (F.col("pos") % 5 * 0.3).alias("confidence"), F.when(F.col("pos") % 2 == 0, F.array().cast("array<string>")).alias("references"))
    kinds = ("knowledge", know, "id"), ("ownership", own, "id"), ("candidate", notes, "id")
    told = [validate.checked(df, kind).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.explode("issues").alias("i")) for kind, df, key in kinds]
    return told[0].unionByName(told[1]).unionByName(told[2]).groupBy("kind", F.col("i.path").alias("field")).agg(F.count("*").alias("n"))


def index_limits(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the index against the published limits."""
    return validate.index_limits(Q.knowledge(spark, d), Q.ownership(spark, d), 500, 2000)


def legacy_usages(spark: SparkSession, d: str) -> DataFrame:
    """Lines that use a package that is to be left, with their places."""
    docs = tables.read(spark, d, "documents").where("doc_id is not null")
    line = F.element_at(F.array(F.lit("import x from 'old-kit'"), F.lit("const y = require(\"old-kit\")"), F.lit("my-old-kits are fine"), F.lit("  \"old-kit\": \"1\",")), F.pmod("doc_id", F.lit(4)).cast("int") + 1)
    rows = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat("text", F.lit("\n"), line).alias("content"))
    return validate.forbidden_lines(rows, validate.usage_pattern("old-kit")).select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "text")


def digest_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose digest isn't the stated one."""
    docs = tables.read(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    stated = docs.select(F.when(F.col("path").endswith("7"), F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.when(F.col("path").endswith("3"), "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return validate.digest_mismatches(docs, stated)


def readme_rules(spark: SparkSession, d: str) -> DataFrame:
    """README rules of every document."""
    docs = tables.read(spark, d, "documents").where("doc_id is not null")
    k = F.col("doc_id")
    add = F.concat(F.repeat(F.lit("![i](https://x/i.png) "), (k % 4).cast("int")), F.when(k % 3 == 0, "![](https://img.shields.io/b)").otherwise(""), F.when(k % 5 == 0, "<img class='c' alt=\" \" src=\"u\">").otherwise(""))
    rows = docs.select(k.cast("string").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.when(k % 2 == 0, "## Install").otherwise(""), add).alias("content"))
    return validate.readme_audit(rows, ["## Install"], 2, 0, 1)


def unsynced_examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples of READMEs that differ from their fixtures."""
    n = tables.read(spark, d, "nation")
    k = F.col("n_nationkey")
    i, fixture = k.cast("string"), F.concat(F.lit("fix/"), k.cast("string"))
    body = F.concat(F.lit("run "), "n_name", F.lit("\nend"))
    readme = F.concat(F.lit("# x\n\n<!-- readme-example:e"), i, F.lit(" -->\n\n```sh\n"), F.when(k % 4 == 1, "old").otherwise(body), F.lit("\n```\n"))
    readmes = n.where("n_nationkey % 6 <> 5").select(i.alias("path"), readme.alias("content"))
    examples = n.select(i.alias("path"), F.concat(F.lit("e"), i).alias("id"), fixture.alias("fixture"))
    return validate.unsynced_examples(readmes, examples, n.select(fixture.alias("path"), F.concat(body, F.lit("\n")).alias("content")))


def sources_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of a listed set of files, the texts of all documents."""
    docs = tables.read(spark, d, "documents")
    return validate.sources_hash(docs.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content")))


def action_contract(spark: SparkSession, d: str) -> DataFrame:
    """Problems of a published action and of workflows."""
    n = tables.read(spark, d, "nation")
    k = F.col("n_nationkey")
    good = "name: x\ndescription: y\nbranding: z\nruns:\n  using: composite\n  default: '1.2.3'\n"
    own = F.when(k == 0, good).when(k == 1, good.replace("branding: z\n", "")).when(k == 2, good.replace("1.2.3", "1.2.4")).when(k == 3, good + "  run: |\n    echo ${{ inputs.x }}\n").when(k == 4, good + "  - uses: a/b@v2\n")
    rows = n.where("n_nationkey < 5").select(F.lit("action.yml").alias("path"), own.alias("content"))
    flows = n.where("n_nationkey >= 5").select(F.concat(F.lit(".github/workflows/"), k.cast("string"), F.lit(".yml")).alias("path"), F.concat(F.lit("- uses: a/b@"), F.when(k % 3 == 0, F.repeat(F.lit("a"), 40)).otherwise("v1"), F.lit(" # c\n")).alias("content"))
    return validate.action_contract(rows.unionByName(flows), "action.yml", "1.2.3")


def discovered_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages of workspace patterns over manifests."""
    p = tables.read(spark, d, "part")
    k = F.col("p_partkey")
    path = F.concat(F.element_at(F.array(F.lit("libs/"), F.lit("apps/"), F.lit("libs/deep/x"), F.lit("other/")), F.pmod(k, F.lit(4)).cast("int") + 1), F.lit("m"), k.cast("string"))
    js = F.when(k % 7 == 0, "broken").when(k % 5 == 0, "{}").otherwise(F.concat(F.lit('{"name": "'), F.when(k % 2 == 0, "@s/").otherwise(""), F.lit("n"), k.cast("string"), F.lit('"}')))
    rows = p.select(path.alias("path"), F.when(k % 11 == 0, "project.json").otherwise("package.json").alias("file"), js.alias("json"))
    return files.discover_packages(rows, ["./libs/*", "apps/*/ignored"]).select("id", "path", "name")


def portal_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a portal: public documents and packages' handoffs, with their distinct names."""
    docs = Q.agent_docs(spark, d).select(F.regexp_replace("path", r"\Adocs/for-agents/", "").alias("file"), "raw", "pos")
    entries = sinks.portal_entries(sinks.document_entries(docs, docs.where("pos % 2 = 0"), "https://o", "site"), sinks.package_entries(handoff.handoffs(Q.ownership(spark, d), Q.settings()), "https://o"))
    return entries.select("id", "kind", "title", F.array_join("aliases", "|").alias("aliases"), F.sha2("answer", 256).alias("answer"))


def described_documents(spark: SparkSession, d: str) -> DataFrame:
    """The description of every document: declared, else its first prose."""
    docs = tables.read(spark, d, "documents").where("doc_id is not null and text is not null")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ndescription: 'About "), "source", F.lit("'\n---\n"))).otherwise(F.lit(""))
    raw = F.concat(head, F.lit("# Title\n\n> quote\n\n```\ncode\n```\n\n"), F.regexp_replace("text", r"\s+", " "))
    return docs.select("doc_id", sinks.described(raw).alias("description"))


def federated_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of federated texts that lead to texts of the same origin."""
    n = tables.read(spark, d, "nation")
    i = F.col("n_nationkey").cast("string")
    raw = F.concat(F.lit("# "), "n_name", F.lit("\n[a](one-"), i, F.lit(".md): first\n[b](https://h"), (F.col("n_nationkey") % 2).cast("string"), F.lit(".example/two.txt?x=1)\n[c](https://h0.example/three.html)"))
    src = n.select(i.alias("source_id"), F.lit("https://h0.example/llms.txt").alias("url"), raw.alias("raw"), F.when(F.col("n_nationkey") % 3 == 0, "https://h0.example/raw/").alias("base"))
    return retrieve.federated_links(src).select("source_id", "title", "url", "description")


def federated_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sections of federated texts and of the texts that they link to, in order."""
    n = tables.read(spark, d, "nation")
    i = F.col("n_nationkey").cast("string")
    src = n.where("n_nationkey < 9").select(F.concat(F.lit("s"), i).alias("source_id"), F.concat(F.lit("https://h/"), i, F.lit("/llms.txt")).alias("url"), F.concat(F.lit("# Top "), i, F.lit("\n[a](https://h/t"), i, F.lit(".md)\n## Sub\n[b](https://h/none.md)")).alias("raw"))
    texts = n.select(F.concat(F.lit("https://h/t"), i, F.lit(".md")).alias("url"), F.concat(F.lit("plain "), "n_name", F.lit("\n## Part "), "n_name").alias("raw"))
    out = retrieve.federated_chunks(src, texts)
    place = F.row_number().over(Window.partitionBy("property").orderBy("at")).cast("long")
    return out.select("chunkKey", "path", "title", "summary", place.alias("place"))


def rag_documents(spark: SparkSession, d: str) -> DataFrame:
    """Contents of knowledge for retrieval: the file, else title and description."""
    know = Q.knowledge(spark, d)
    have = Q.agent_docs(spark, d).where("pos % 2 = 0").select(F.concat(F.lit("docs/d"), (F.col("pos") % 500).cast("string"), F.lit(".md")).alias("path"), F.col("pos").alias("p")).groupBy("path").agg(F.concat(F.lit("file "), F.min("p").cast("string")).alias("content"))
    return retrieve.rag_documents(know, have)


def memory_draft(spark: SparkSession, d: str) -> DataFrame:
    """The draft that proposes all notes, and whether it may be sent."""
    notes = Q.notes(spark, d)
    out = memory.draft(memory.classify(notes), memory.safety(notes))
    return out.select("ok", "title", F.sha2("body", 256).alias("body"), F.size(F.split("body", "\n")).cast("long").alias("lines"))


def first_notes(spark: SparkSession, d: str) -> DataFrame:
    """One candidate of each id, the surest."""
    rows = Q.notes(spark, d).select((F.col("pos") % 97).cast("string").alias("id"), F.concat(F.when(F.col("pos") % 3 == 0, ".cursor/rules/").otherwise(".agent-memory/"), F.col("id"), F.lit(".md")).alias("rawPath"), F.when(F.col("pos") % 3 == 0, 0.6).otherwise(0.7).alias("confidence"))
    return memory.first_candidates(rows)


def scaffold_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Starter documents of discovered packages, and which of them are new."""
    have = Q._discovered(spark, d).where("pos % 5 = 0").select(F.concat(F.lit("docs/for-agents/packages/"), "id", F.lit(".md")).alias("path"))
    return sinks.scaffold_drafts(Q._discovered(spark, d).groupBy("id").agg(F.min("path").alias("path")), have)


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    """Normalised paths, publication, origins and one-line summaries."""
    docs = tables.read(spark, d, "documents").where("doc_id is not null and text is not null")
    k, i = F.col("doc_id"), F.col("doc_id").cast("string")
    raw = F.concat(F.element_at(F.array(F.lit(".\\guide\\"), F.lit("landing/"), F.lit("x/DRAFT-"), F.lit("./")), F.pmod(k, F.lit(4)).cast("int") + 1), F.when(k % 5 == 0, "PLAN.md").otherwise(F.concat(i, F.lit(".md"))))
    a, b = F.concat(F.lit("https://h"), (k % 2).cast("string"), F.lit(".example")), F.concat(F.when(k % 3 == 0, "https://H0.example:443/").when(k % 3 == 1, "http://h0.example/").otherwise("local/"), i)
    return docs.select("doc_id", paths.to_posix(raw).alias("posix"), paths.is_public(raw, ["PLAN.md"], ["landing"], ["DRAFT"]).alias("public"), paths.same_origin(a, b).alias("same"), text.one_line(F.col("text")).alias("line"))


def meta_lists(spark: SparkSession, d: str) -> DataFrame:
    """Page lists of directories; broken ones are left out."""
    n = tables.read(spark, d, "nation")
    k = F.col("n_nationkey")
    rows = n.select(F.concat(F.when(k % 2 == 0, F.concat(F.lit("d"), k.cast("string"), F.lit("/"))).otherwise(""), F.when(k % 5 == 0, "other.json").otherwise("meta.json")).alias("path"), F.when(k % 3 == 0, "{broken").when(k % 7 == 1, '{"title": "x"}').otherwise(F.concat(F.lit('{"pages": ["p'), k.cast("string"), F.lit('", "..."]}'))).alias("raw"))
    return human.meta_pages(rows).select("dir", F.array_join("pages", ",").alias("pages"))


def human_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of human documents by id."""
    return human.url_map(human.union([Q.pages(spark, d)], "docs/for-agents"))


def relevant_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changed files that ask for a rebuild, with and without manifests."""
    e = tables.read(spark, d, "events").where("event_id is not null")
    k = F.col("event_id")
    name = F.element_at(F.array(F.lit("a.MD"), F.lit("b.mdx"), F.lit("x/package.json"), F.lit("nx.json"), F.lit("waymark.config.json"), F.lit("c.ts"), F.lit("meta.json"), F.lit("mypackage.json")), F.pmod(k, F.lit(8)).cast("int") + 1)
    rows = e.select(name.alias("path"), F.col("ts"))
    count = lambda df, kind: df.groupBy("path").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "path", "n")
    return count(rebuild.relevant(rows), "plain").unionByName(count(rebuild.relevant(rows, manifests=True), "manifests"))


def _tree(spark: SparkSession, d: str) -> str:
    """A project on disk, written by the tasks: documents, some in hidden folders and in skipped ones, notes and editor rules, some of each supplier."""
    root = f"{tables.shared_dir(spark)}/waymark-tree-{uuid.uuid4().hex}"
    k, name = F.col("s_suppkey"), F.col("s_name")
    number = k.cast("string")
    file = lambda *parts, text: F.struct(F.concat(*parts).alias("path"), text.alias("text"))
    titled = F.concat(F.lit("# "), name, F.lit("\n"))
    folder = F.when(k % 3 == 0, "_x/").when(k % 3 == 1, ".h/").otherwise("")
    note = F.when(k % 2 == 0, file(F.lit(".agent-memory/m"), number, F.lit(".md"), text=F.concat(F.lit("Fact of "), name, F.lit("\n")))).otherwise(file(F.lit(".cursor/rules/r"), number, F.lit(".mdc"), text=F.concat(F.lit("# Rule "), name, F.lit("\n"))))
    every = F.array(file(F.lit("docs/"), folder, F.lit("d"), number, F.lit(".md"), text=titled), file(F.lit("docs/node_modules/n"), number, F.lit(".md"), text=F.lit("no")), note)
    rows = tables.read(spark, d, "supplier").where("s_suppkey is not null and s_name is not null").select(F.inline(every))
    web.write_texts(rows, root).agg(F.sum("bytes")).first()
    return root


def _of_tree(spark: SparkSession, d: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What read gives of the tree, as a written table; the tree is removed then."""
    root = _tree(spark, d)
    try:
        return tables.written(read(root))
    finally:
        system, base = store(root)
        system.delete_dir(base)


def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    """Markdown files of a tree on disk, with sizes and digests."""
    return _of_tree(spark, d, lambda root: files.scan_markdown(spark, root, max_files=1 << 20, max_bytes=1 << 20, max_total=1 << 30).select("path", "length", F.sha2("raw", 256).alias("sha256")))


def scanned_notes(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the notes of a tree on disk."""
    return _of_tree(spark, d, lambda root: memory.ingest(files.scan_notes(spark, root)).select("id", "source", "rawPath", "fact", "confidence"))


def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """An index that was built of a tree, written, and read again; its hash is that of what was built."""

    def read(root: str) -> DataFrame:
        s = Settings(agent_root="docs", agent_index="docs/d2.md", human=[{}])
        docs = files.scan_markdown(spark, root).select("path", "raw")
        built = index.build(spark, docs, human.empty(spark), s)
        now = index.write(built, f"{root}/index")
        built.close()
        held = files.load_index(spark, f"{root}/index")
        return held["knowledge"].join(held["ownership"].select("id", F.col("path").alias("root")), "id", "left").select("id", "title", "path", "root", F.lit(held["meta"].first()["contentHash"] == now).alias("fresh"))

    return _of_tree(spark, d, read)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        ownership_build, resolved_packages, change_routes, legacy_handoffs, documents_by_ref, gate_run, index_payload_hash, index_rows_hash, diagnosed_indexes, health, unindexed_documents, conformance_report, duplicate_exceptions, projection_check, resolver_checks, schema_issues, index_limits, legacy_usages,
        digest_mismatches, readme_rules, unsynced_examples, sources_hash, action_contract, discovered_packages, portal_artifact, described_documents, federated_links, federated_chunks, rag_documents, memory_draft, first_notes, scaffold_drafts, path_functions, meta_lists, human_urls, relevant_changes, scanned_documents, scanned_notes, stored_index,
    ]
    return {f.__name__: f for f in own}


_OWN = f"own AS ({B.OWNERSHIP})"
_MISSING = f"SELECT DISTINCT url FROM ({O._LOCAL}) WHERE url NOT IN (SELECT url FROM page WHERE pos % 3 <> 0)"
_GUESS = """SELECT p.id, b.path, b.pos, CASE WHEN f.f_package = p.id THEN 1 WHEN b.id = p.id THEN 2 WHEN ends_with(b.path, '/packages/' || p.id || '.md') THEN 3 WHEN ends_with(b.path, '/' || p.id || '.md') THEN 7 WHEN contains(b.path, '/packages/' || p.id || '/') THEN 9 END AS rule
  FROM p, built b JOIN field f USING (pos) WHERE rule IS NOT NULL"""

SQL: dict[str, str] = {
    "ownership_build": rf"""WITH {O._SEEDS}, e AS ({OWNERS}), d AS (SELECT id, arg_min(path, pos) AS path, arg_max(name, pos) FILTER (name IS NOT NULL) AS name, max(CASE WHEN pos % 2 = 0 THEN 'make test' END) AS checks FROM ({O._DISCOVERED}) GROUP BY id),
s1 AS (SELECT id, arg_min(path, CASE WHEN origin = 'path' THEN 1000000000 ELSE 0 END + pos) AS path FROM seed GROUP BY id),
s AS (SELECT * FROM seed QUALIFY row_number() OVER (PARTITION BY id ORDER BY origin = 'path' DESC, pos DESC) = 1),
p AS (SELECT id, coalesce(nullif(e.path, ''), d.path, s1.path, e.path) AS path, d.name, d.checks FROM (SELECT id FROM e UNION SELECT id FROM d UNION SELECT id FROM s1) LEFT JOIN e USING (id) LEFT JOIN d USING (id) LEFT JOIN s1 USING (id)),
guess AS (SELECT id, path FROM ({_GUESS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rule, pos) = 1),
h AS ({HUMAN}), hit AS (SELECT p.id, h.url, h.pos, CASE WHEN h.id = p.id THEN 0 WHEN h.id = 'packages/' || p.id THEN 4 WHEN h.id = 'packages/' || p.id || '/index' THEN 6 WHEN ends_with(h.id, '/' || p.id) OR ends_with(h.id, '/' || p.id || '/index') OR ends_with(h.id, '-' || p.id) THEN 7 END AS way FROM p, h WHERE way IS NOT NULL),
m AS (SELECT id, url FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY way, pos) = 1),
r AS (SELECT p.id, coalesce(e.path, s.path, p.path) AS path, p.name, nullif(coalesce(e.purpose, s.purpose), '') AS purpose, e.checks AS e_checks, s.checks AS s_checks, p.checks AS p_checks, coalesce(e.agent_doc, s."agentDoc", guess.path, 'docs/d7.md') AS "agentDoc", coalesce(nullif(e.human_doc, ''), nullif(s."humanDoc", ''), m.url) AS "humanDoc"
  FROM p LEFT JOIN e USING (id) LEFT JOIN s USING (id) LEFT JOIN guess USING (id) LEFT JOIN m USING (id))
SELECT id, path, purpose, coalesce(e_checks, s_checks, p_checks, CASE WHEN coalesce(name, CASE WHEN path LIKE 'packages/%' OR path LIKE 'apps/%' THEN id END) IS NOT NULL THEN concat('pnpm --filter ', coalesce(name, id), ' test') ELSE 'pnpm test' END) AS checks, "agentDoc", "humanDoc" FROM r""",
    "resolved_packages": f"""WITH {_OWN} SELECT id, true AS found, CASE WHEN pos % 3 = 0 THEN coalesce(agent_doc, '') ELSE coalesce(agent_doc, 'docs/d7.md') END AS "startHere", concat_ws(',', agent_doc, 'AGENTS.md') AS read_first, path AS edit_roots, CASE WHEN human_doc LIKE 'http%' THEN 'external' WHEN human_doc IS NOT NULL THEN 'linked' ELSE 'missing' END AS bridge FROM own
UNION ALL SELECT concat(id, 'x'), false, NULL, NULL, NULL, NULL FROM own""",
    "change_routes": """SELECT concat('c', p_partkey % 150) AS id, p_brand AS "startHere", 'AGENTS.md,docs/d7.md' AS read_first, p_brand AS edit_roots, p_name AS notes FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 150 ORDER BY p_partkey DESC) = 1""",
    "legacy_handoffs": f"""WITH {_OWN} SELECT id, CAST(1 AS BIGINT) AS "schemaVersion" FROM own""",
    "documents_by_ref": f"""WITH know AS ({B.KNOWLEDGE}), r AS (SELECT unnest(['docs/d5.md', 'doc-8', 'docs/none.md', 'doc-700']) AS ref) SELECT ref, id, path FROM r JOIN know ON path = ref OR id = ref QUALIFY row_number() OVER (PARTITION BY ref ORDER BY path = ref DESC, pos) = 1""",
    "gate_run": rf"""WITH {_OWN}, {O._PAGES}, {O._DOCS}, s AS ({O._STYLE}), t AS (SELECT path, nullif(trim(regexp_extract(head, '(?m)^type:\s*[''"]?([^''"\n#]+)', 1)), '') AS type, regexp_matches(raw, '(?m)^#\s+\S+') AS titled FROM s),
c AS (SELECT (SELECT count(*) FROM ({_MISSING})) AS lost, (SELECT count(*) FROM t WHERE type IS NULL OR type NOT IN ('guide', 'draft')) AS untyped, (SELECT count(*) FROM t WHERE NOT titled) AS untitled),
g AS (SELECT 'index-freshness' AS id, false AS ok, repeat('b', 64) AS expected, repeat('a', 64) AS actual UNION ALL SELECT 'human-guide-links', lost = 0, CASE WHEN lost > 0 THEN 'all local humanDoc links resolve' END, CASE WHEN lost > 0 THEN concat(lost, ' missing') END FROM c
  UNION ALL SELECT 'okf-type', untyped = 0, CASE WHEN untyped > 0 THEN 'type: guide | draft' END, CASE WHEN untyped > 0 THEN concat(untyped, ' invalid') END FROM c UNION ALL SELECT 'docs-style', untitled = 0, CASE WHEN untitled > 0 THEN 'title-only: title' END, CASE WHEN untitled > 0 THEN concat(untitled, ' file(s) with style issues') END FROM c)
SELECT *, bool_and(ok) OVER () AS all_ok FROM g""",
    "index_payload_hash": rf"""WITH own AS ({FEW_OWNERS}), k AS (SELECT string_agg(concat('{{', CASE WHEN n_nationkey % 2 = 0 THEN '"description":"é \"q\"",' ELSE '' END, '"id":"n', n_nationkey, '","path":"docs/', n_nationkey, '.md","title":', to_json(n_name), ',"type":"agent-doc"}}'), ',' ORDER BY n_nationkey) AS j FROM nation),
h AS (SELECT string_agg(concat(to_json(id), ':{{"bridge":', CASE WHEN human_doc LIKE 'http%' THEN '{{"humanDoc":"external"}}' WHEN human_doc IS NOT NULL THEN '{{"humanDoc":"linked"}}' ELSE concat('{{"action":"waymark bootstrap agent-docs","bootstrap":"docs/for-agents/human/', id, '.md","humanDoc":"missing"}}') END, ',"checks":["npm test"],"editRoots":[', to_json(path), ']', CASE WHEN human_doc IS NOT NULL THEN concat(',"humanDoc":', to_json(human_doc)) ELSE '' END,
  ',"notes":[', to_json(purpose), CASE WHEN human_doc IS NULL THEN concat(',"Human guide missing for ', id, '. Run: waymark bootstrap agent-docs"') ELSE '' END, '],"readBeforeEditing":[', CASE WHEN agent_doc IS NOT NULL THEN concat(to_json(agent_doc), ',') ELSE '' END, '"AGENTS.md"],"schemaVersion":1,"source":"index.json","startHere":', to_json(coalesce(agent_doc, '')),
  ',"target":{{"group":', to_json("group"), ',"id":', to_json(id), CASE WHEN layer IS NOT NULL THEN concat(',"layer":', to_json(layer)) ELSE '' END, ',"path":', to_json(path), ',"type":"package"}},"type":"agent-handoff"}}'), ',' ORDER BY id) AS j FROM own),
o AS (SELECT string_agg(concat(to_json(id), ':{{', CASE WHEN agent_doc IS NOT NULL THEN concat('"agentDoc":', to_json(agent_doc), ',') ELSE '' END, '"checks":["npm test"],"group":', to_json("group"), CASE WHEN human_doc IS NOT NULL THEN concat(',"humanDoc":', to_json(human_doc)) ELSE '' END, ',"id":', to_json(id), CASE WHEN layer IS NOT NULL THEN concat(',"layer":', to_json(layer)) ELSE '' END, ',"path":', to_json(path), ',"purpose":', to_json(purpose), '}}'), ',' ORDER BY id) AS j, string_agg(to_json(id), ',' ORDER BY pos) AS p FROM own),
i AS (SELECT string_agg(concat('"i', n_nationkey, '":{{"id":"i', n_nationkey, '","paths":["', n_nationkey, '"],"title":', to_json(n_name), '}}'), ',' ORDER BY concat('i', n_nationkey)) AS j FROM nation),
c AS (SELECT string_agg(concat('"c', n_nationkey % 9, '":{{"id":"c', n_nationkey % 9, '","startHere":"', n_nationkey, '","title":', to_json(n_name), '}}'), ',' ORDER BY n_nationkey % 9) AS j FROM (SELECT * FROM nation QUALIFY row_number() OVER (PARTITION BY n_nationkey % 9 ORDER BY n_nationkey DESC) = 1)),
w AS (SELECT concat('{{"handoffs":{{', h.j, '}},"knowledge":[', k.j, '],"lookup":{{"changes":{{', c.j, '}},"intents":{{', i.j, '}},"ownership":{{', o.j, '}},"packages":[', o.p, ']}},"schemaVersion":1}}') AS json FROM k, h, o, i, c)
SELECT sha256(json) AS "contentHash", length(json) AS chars FROM w""",
    "index_rows_hash": f"""WITH know AS ({B.KNOWLEDGE}), r AS (SELECT sha256(concat('knowledge:{{"id":', to_json(id), ',"path":', to_json(path), '}}')) AS h FROM know),
a AS (SELECT left(h, 6) AS g, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1), b AS (SELECT g, sha256(h) AS h FROM a), c AS (SELECT left(g, 3) AS g, sha256(string_agg(h, '' ORDER BY g)) AS h FROM a GROUP BY 1)
SELECT sha256(concat('v1:', string_agg(h, '' ORDER BY g))) AS "contentHash" FROM c""",
    "diagnosed_indexes": """SELECT 'starter' AS kind, CAST(pos AS BIGINT) AS pos, said FROM (VALUES (0, 'Only the starter docs/d5.md was indexed.'), (1, 'Add agent docs under docs/for-agents/, then run waymark index again.'), (2, 'No ownership handoffs yet. Add routing.options.ownership, package frontmatter (package + editRoot), or a monorepo plugin.')) AS t(pos, said)
UNION ALL SELECT 'next starter', * FROM (VALUES (0, 'mkdir -p docs/for-agents/packages'), (1, 'edit docs/for-agents/packages/<module>.md  # frontmatter: package + editRoot'), (2, 'waymark index')) AS t(pos, said)
UNION ALL SELECT 'next full', 0, concat('waymark query package ', (SELECT min(concat('s-', s_suppkey)) FROM supplier), ' --agent') UNION ALL SELECT 'next full', * FROM (VALUES (1, 'waymark list packages --text'), (2, 'waymark mcp')) AS t(pos, said)""",
    "health": "SELECT * FROM (VALUES ('fresh', true), ('stale', false), ('gate', false)) AS t(\"case\", ok)",
    "unindexed_documents": f"""WITH know AS ({B.KNOWLEDGE}), {O._DOCS} SELECT path FROM (SELECT regexp_replace(path, '^.*/', 'docs/') AS path FROM docs) WHERE path <> 'docs/d7.md' AND path NOT IN (SELECT path FROM know WHERE pos % 3 = 0)""",
    "conformance_report": f"""WITH {_OWN}, {O._PAGES}, c AS (SELECT (SELECT count(*) FROM page) AS pages, (SELECT count(*) FROM own) AS total, (SELECT count(*) FROM own WHERE agent_doc <> '' AND human_doc IS NOT NULL) AS ready, (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS raw)
SELECT 'human-docs' AS id, 'required' AS level, 'pass' AS status, true AS ok, concat('Found ', pages, ' human document(s).') AS message, CAST(NULL AS VARCHAR) AS reason FROM c
UNION ALL SELECT 'llms-and-raw-source', 'required', 'pass', true, concat('Resolved llms.txt and ', raw, ' raw source(s).'), NULL FROM c
UNION ALL SELECT 'agent-handoffs', 'required', CASE WHEN ready = total THEN 'pass' ELSE 'fail' END, ready = total, CASE WHEN ready = total THEN concat(ready, ' handoff(s) are action-ready and human-linked.') ELSE concat(ready, '/', total, ' handoff(s) are action-ready and human-linked.') END, NULL FROM c
UNION ALL SELECT * FROM (VALUES ('contribution', 'required', 'fail', false, 'Contribution guidance is missing.', NULL), ('metadata', 'required', 'pass', true, 'metadata evidence is complete.', NULL), ('cross-links', 'required', 'pass', true, '5 required ecosystem link(s) resolve in source.', NULL),
  ('tested-quickstarts', 'required', 'excepted', true, 'Quickstart test evidence is incomplete.', 'r'), ('visual-explanations', 'recommended', 'fail', false, 'Visual explanation evidence is incomplete.', NULL), ('structured-diagrams', 'recommended', 'fail', false, 'structured-diagrams evidence is incomplete.', NULL)) AS t""",
    "duplicate_exceptions": """SELECT concat('r', doc_id % 400) AS "ruleId" FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id % 400 HAVING count(*) > 1""",
    "projection_check": """SELECT 'projection-unknown' AS rule, 'n103' AS key, CAST(NULL AS VARCHAR) AS detail UNION ALL SELECT 'projection-differs', concat('n', n_nationkey), f FROM (SELECT n_nationkey, unnest(list_filter([CASE WHEN n_nationkey % 4 = 1 THEN 'name' END, CASE WHEN n_nationkey % 5 = 2 THEN 'kind' END, CASE WHEN n_nationkey % 6 = 0 THEN 'accent' END], lambda x: x IS NOT NULL)) AS f FROM nation WHERE n_nationkey <> 3)""",
    "resolver_checks": """WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS asked, concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'target.id is another target' END, CASE WHEN k % 5 < 3 THEN 'startHere is missing or unsafe' END, CASE WHEN k % 5 < 3 AND k % 3 <> 0 THEN 'readBeforeEditing is missing or unsafe' END,
  CASE WHEN k % 3 = 0 THEN 'readBeforeEditing lacks the start' END, CASE WHEN k % 4 = 0 THEN 'editRoots is missing or unsafe' END, CASE WHEN k % 6 = 0 THEN 'checks is missing' END) AS issues FROM s""",
    "schema_issues": f"""WITH {_OWN}, notes AS ({B.NOTES}), i AS (SELECT 'knowledge' AS kind, unnest([CASE WHEN doc_id % 3 = 0 THEN 'id' END, CASE WHEN coalesce(length(substring(text, 1, 300)), 0) NOT BETWEEN 1 AND 256 THEN 'title' END, CASE WHEN length(text) > 2048 THEN 'description' END]) AS field FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'ownership', unnest([CASE WHEN pos % 4 = 0 THEN 'checks' END, CASE WHEN pos % 5 = 0 THEN 'layer' END]) FROM own UNION ALL SELECT 'candidate', unnest([CASE WHEN pos % 5 = 4 THEN 'confidence' END, CASE WHEN pos % 2 = 1 THEN 'references' END]) FROM notes)
SELECT kind, field, count(*) AS n FROM i WHERE field IS NOT NULL GROUP BY ALL""",
    "index_limits": f"""WITH {_OWN}, know AS ({B.KNOWLEDGE}) SELECT 'knowledge' AS "table", count(*) AS n, CAST(500 AS BIGINT) AS most, count(*) <= 500 AS ok FROM know UNION ALL SELECT 'packages', count(*), 2000, count(*) <= 2000 FROM own""",
    "legacy_usages": """SELECT cast(doc_id AS string) AS path, len(regexp_split_to_array(text, '\\r?\\n')) + 1 AS "line", CAST(CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 11 ELSE 3 END AS BIGINT) AS "column", CASE doc_id % 4 WHEN 0 THEN 'import x from ''old-kit''' WHEN 1 THEN 'const y = require("old-kit")' ELSE '  "old-kit": "1",' END AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND doc_id % 4 <> 2""",
    "digest_mismatches": """WITH d AS (SELECT cast(doc_id AS string) AS p, text FROM documents WHERE doc_id IS NOT NULL) SELECT CASE WHEN ends_with(p, '7') THEN concat(p, 'x') ELSE p END AS path, CASE WHEN ends_with(p, '3') THEN '0' ELSE sha256(text) END AS expected, CASE WHEN ends_with(p, '3') THEN sha256(text) END AS actual FROM d WHERE ends_with(p, '7') OR ends_with(p, '3')""",
    "readme_rules": r"""WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL), c AS (SELECT k, t, length(t) - length(replace(t, 'https://img.shields.io/', '')) > 0 AS shielded, k % 4 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + len(regexp_extract_all(t, '!\[([^\]]*)\]\(([^)]+)\)')) AS images FROM d)
SELECT cast(k AS string) AS path, 'marker:## Install' AS rule, k % 2 = 0 OR contains(t, '## Install') AS ok FROM c UNION ALL SELECT cast(k AS string), 'image-budget', images BETWEEN 1 AND 2 FROM c UNION ALL SELECT cast(k AS string), 'badge-budget', k % 3 <> 0 AND NOT shielded FROM c UNION ALL SELECT cast(k AS string), 'alt-text', k % 3 <> 0 AND k % 5 <> 0 FROM c""",
    "unsynced_examples": "SELECT cast(n_nationkey AS string) AS path, concat('e', n_nationkey) AS id FROM nation WHERE n_nationkey % 4 = 1 OR n_nationkey % 6 = 5",
    "sources_hash": r"""SELECT concat('sha256:', sha256(coalesce(string_agg(concat('src/', doc_id, chr(0), text, chr(0)), '' ORDER BY concat('src/', doc_id), text), ''))) AS "sourceHash" FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""",
    "action_contract": """SELECT 'action.yml' AS path, unnest(['branding: is missing', 'the default version differs', 'an input enters a shell step directly', 'a reference is mutable']) AS problem UNION ALL SELECT concat('.github/workflows/', n_nationkey, '.yml'), 'a reference is mutable' FROM nation WHERE n_nationkey >= 5 AND n_nationkey % 3 <> 0""",
    "discovered_packages": """WITH p AS (SELECT p_partkey AS k, concat(CASE p_partkey % 4 WHEN 0 THEN 'libs/' WHEN 1 THEN 'apps/' WHEN 2 THEN 'libs/deep/x' ELSE 'other/' END, 'm', p_partkey) AS path FROM part) SELECT CASE WHEN k % 5 = 0 THEN concat('m', k) ELSE concat('n', k) END AS id, path, CASE WHEN k % 5 <> 0 THEN concat(CASE WHEN k % 2 = 0 THEN '@s/' ELSE '' END, 'n', k) END AS name FROM p WHERE k % 7 <> 0 AND k % 11 <> 0 AND k % 4 < 2""",
    "portal_artifact": rf"""WITH {_OWN}, {O._DOCS}, x AS (SELECT regexp_replace(path, '^docs/for-agents/', '') AS file, raw FROM docs WHERE pos % 2 = 0), y AS (SELECT file, regexp_replace(file, '\.md$', '') AS slug, coalesce(nullif(trim(regexp_extract(raw, '(?m)^#\s+(.+)$', 1)), ''), regexp_replace(file, '\.md$', '')) AS title, regexp_replace(raw, '\A---\r?\n(?s:.*?)\r?\n---\r?\n', '') AS body FROM x),
b AS (SELECT file, k, trim(regexp_replace(t, '(?m)^#+\s+.*$', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM (SELECT file, unnest(regexp_split_to_array(body, '\n\s*\n')) AS t, generate_subscripts(regexp_split_to_array(body, '\n\s*\n'), 1) AS k FROM y)),
f AS (SELECT file, left(regexp_replace(arg_min(t, k), '\s+', ' ', 'g'), 240) AS said FROM b WHERE t <> '' AND NOT starts_with(t, '```') AND NOT starts_with(t, '>') GROUP BY file),
e AS (SELECT concat('doc:', regexp_replace(slug, '[^A-Za-z0-9._:-]+', ':', 'g')) AS id, 'document' AS kind, title, [slug, file, title, 'site ' || title] AS names, concat('## ', title, chr(10), chr(10), coalesce(said, 'Canonical documentation.'), chr(10), chr(10), '[Open the canonical guide](https://o/docs/', CASE WHEN slug = 'index' THEN '' ELSE slug || '/' END, ') · [Read raw Markdown](https://o/raw/', file, ')') AS answer FROM y LEFT JOIN f USING (file)
  UNION ALL SELECT concat('package:', id), 'package', concat(id, ' ownership handoff'), [id, 'who owns ' || id, id || ' handoff', purpose], concat('## ', id, ' handoff', chr(10), chr(10), purpose, '.', chr(10), chr(10), 'Start at [**', coalesce(agent_doc, ''), '**](https://o/raw/', regexp_replace(coalesce(agent_doc, ''), '^docs/', ''), '). Edit roots: **', path, '**. Checks: **npm test**.', chr(10), chr(10), 'This answer was generated from the repository''s own index.') FROM own),
n AS (SELECT id, kind, title, answer, list_transform(names, lambda x: lower(regexp_replace(trim(x), '\s+', ' ', 'g'))) AS keys, names FROM e)
SELECT id, kind, title, array_to_string(list_filter(names, lambda x, i: list_position(keys, keys[i]) = i), '|') AS aliases, sha256(answer) AS answer FROM n""",
    "described_documents": r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(concat('About ', source), 240) ELSE nullif(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 240), '') END AS description FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""",
    "federated_links": """SELECT cast(n_nationkey AS string) AS source_id, 'a' AS title, concat(CASE WHEN n_nationkey % 3 = 0 THEN 'https://h0.example/raw/' ELSE '' END, 'one-', n_nationkey, '.md') AS url, 'first' AS description FROM nation UNION ALL SELECT cast(n_nationkey AS string), 'b', 'https://h0.example/two.txt?x=1', NULL FROM nation WHERE n_nationkey % 2 = 0""",
    "federated_chunks": """WITH n AS (SELECT n_nationkey AS i, n_name FROM nation WHERE n_nationkey < 9) SELECT concat('s', i, ':federated:', CASE k WHEN 1 THEN concat('top-', i) WHEN 2 THEN 'sub' WHEN 3 THEN concat('t', i) ELSE concat('part-', regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g')) END) AS "chunkKey", CASE WHEN k < 3 THEN concat('https://h/', i, '/llms.txt') ELSE concat('https://h/t', i, '.md') END AS path,
  CASE k WHEN 1 THEN concat('Top ', i) WHEN 2 THEN 'Sub' WHEN 3 THEN concat('t', i) ELSE concat('Part ', n_name) END AS title, CASE k WHEN 1 THEN concat('# Top ', i, chr(10), '[a](https://h/t', i, '.md)') WHEN 2 THEN concat('## Sub', chr(10), '[b](https://h/none.md)') WHEN 3 THEN concat('plain ', n_name) ELSE concat('## Part ', n_name) END AS summary, CAST(k AS BIGINT) AS place FROM n, range(1, 5) AS r(k)""",
    "rag_documents": f"""WITH know AS ({B.KNOWLEDGE}), {O._DOCS}, f AS (SELECT concat('docs/d', pos % 500, '.md') AS path, concat('file ', min(pos)) AS content FROM docs WHERE pos % 2 = 0 GROUP BY 1) SELECT id, coalesce(content, concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(description, ''))) AS content, path AS source, type, title FROM know LEFT JOIN f USING (path)""",
    "memory_draft": f"""WITH c AS ({O._CLASSIFY}), {O._NOTES}, l AS (SELECT pos, concat('- ', c.id, ': ', route, ' | reason=', reason, CASE WHEN target <> '' THEN concat(' | target=', target) ELSE '' END, ' | fact=', fact) AS line FROM c JOIN notes USING (id)),
n AS (SELECT count(*) AS n FROM l), t AS (SELECT string_agg(line, chr(10) ORDER BY pos) AS lines FROM (SELECT * FROM l ORDER BY pos LIMIT 1000)), b AS (SELECT concat_ws(chr(10), '# Draft memory promotion', '', 'Safety scan: blocked. Redact findings before PR.', '', '## Candidates', '', concat(lines, CASE WHEN n > 1000 THEN concat(chr(10), '- and ', n - 1000, ' more') ELSE '' END), '', '## Policy', '', '- Draft only; never auto-merge.', '- Run the documentation gates before opening a PR.') AS body FROM n, t)
SELECT false AS ok, 'Draft memory promotion' AS title, sha256(body) AS body, CAST(len(string_split(body, chr(10))) AS BIGINT) AS lines FROM b""",
    "first_notes": f"""WITH notes AS ({B.NOTES}), r AS (SELECT cast(pos % 97 AS string) AS id, concat(CASE WHEN pos % 3 = 0 THEN '.cursor/rules/' ELSE '.agent-memory/' END, id, '.md') AS "rawPath", CASE WHEN pos % 3 = 0 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM notes) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, "rawPath") = 1""",
    "scaffold_drafts": f"""WITH d AS ({O._DISCOVERED}), h AS (SELECT DISTINCT id FROM d WHERE pos % 5 = 0) SELECT concat('docs/for-agents/packages/', id, '.md') AS path, concat('---', chr(10), 'type: package', chr(10), 'draft: true', chr(10), 'package: ', id, chr(10), 'editRoot: ', min(path), chr(10), '---', chr(10), chr(10), '# ', id, chr(10), chr(10), 'Draft generated by `waymark init --scaffold-workspaces`.', chr(10), chr(10), '## Ownership', chr(10), chr(10), '- Package: `', min(path), '`', chr(10), chr(10), '## Notes', chr(10), chr(10), '- TODO: describe responsibility, boundaries, and checks.', chr(10)) AS content, id NOT IN (SELECT id FROM h) AS created FROM d GROUP BY id""",
    "path_functions": r"""WITH d AS (SELECT doc_id, text, concat(CASE doc_id % 4 WHEN 0 THEN './guide/' WHEN 1 THEN 'landing/' WHEN 2 THEN 'x/DRAFT-' ELSE './' END, CASE WHEN doc_id % 5 = 0 THEN 'PLAN.md' ELSE concat(doc_id, '.md') END) AS posix FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, posix, NOT (doc_id % 4 = 1 OR doc_id % 4 = 2 OR posix = './PLAN.md') AS public, CASE doc_id % 3 WHEN 0 THEN doc_id % 2 = 0 WHEN 1 THEN false ELSE true END AS same, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 100) AS line FROM d""",
    "meta_lists": """SELECT CASE WHEN n_nationkey % 2 = 0 THEN concat('d', n_nationkey) ELSE '' END AS dir, concat('p', n_nationkey, ',...') AS pages FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 7 <> 1""",
    "human_urls": f"WITH {O._PAGES} SELECT id, url FROM page WHERE path NOT LIKE 'docs/for-agents/%' AND path NOT LIKE '%/for-agents/%' QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1",
    "scanned_documents": """SELECT concat('docs/', CASE s_suppkey % 3 WHEN 0 THEN '_x/' WHEN 1 THEN '.h/' ELSE '' END, 'd', s_suppkey, '.md') AS path, CAST(length(s_name) + 3 AS BIGINT) AS "length", sha256(concat('# ', s_name, chr(10))) AS sha256 FROM supplier
UNION ALL SELECT concat('.agent-memory/m', s_suppkey, '.md'), length(s_name) + 9, sha256(concat('Fact of ', s_name, chr(10))) FROM supplier WHERE s_suppkey % 2 = 0""",
    "scanned_notes": """SELECT concat('m', s_suppkey) AS id, 'agent-memory' AS source, concat('.agent-memory/m', s_suppkey, '.md') AS "rawPath", concat('Fact of ', s_name) AS fact, 0.7::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT concat('r', s_suppkey, '.mdc'), 'cursor', concat('.cursor/rules/r', s_suppkey, '.mdc'), concat('Rule ', s_name), 0.6 FROM supplier WHERE s_suppkey % 2 = 1""",
    "stored_index": """SELECT concat('d', s_suppkey) AS id, s_name AS title, concat('docs/', CASE s_suppkey % 3 WHEN 0 THEN '_x/' WHEN 1 THEN '.h/' ELSE '' END, 'd', s_suppkey, '.md') AS path, CAST(NULL AS VARCHAR) AS root, true AS fresh FROM supplier""",
    "relevant_changes": """WITH e AS (SELECT ['a.MD', 'b.mdx', 'x/package.json', 'nx.json', 'waymark.config.json', 'c.ts', 'meta.json', 'mypackage.json'][CAST(event_id % 8 AS INT) + 1] AS path FROM events WHERE event_id IS NOT NULL) SELECT 'plain' AS kind, path, count(*) AS n FROM e WHERE path IN ('a.MD', 'b.mdx', 'waymark.config.json', 'meta.json') GROUP BY path UNION ALL SELECT 'manifests', path, count(*) FROM e WHERE path NOT IN ('c.ts', 'mypackage.json') GROUP BY path""",
}


def oracles() -> dict[str, str]:
    return dict(SQL)
