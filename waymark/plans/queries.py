"""Named queries over the given tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import tables
from waymark.config import STYLE_PROFILES, Settings
from waymark.functions import markdown, paths, text
from waymark.operators import conformance, doctor, gates, handoff, memory, retrieve, search, sinks, vectors
from waymark.plans import bindings as B
from waymark.plans.oracles import SQL
from waymark.sources import human
from waymark.streaming import rebuild

Query = Callable[[SparkSession, str], DataFrame]


#: Tables whose rows cost much work each.
TEXTS = ("documents", "pages", "conversations")


def bound(spark: SparkSession, sf_dir: str, statement: str, *names: str) -> DataFrame:
    """A binding over the named tables of the data directory."""
    return spark.sql(_framed(statement, names), **{n: tables.spread(tables.read(spark, sf_dir, n)) if n in TEXTS else tables.read(spark, sf_dir, n) for n in names})


def _framed(statement: str, names: tuple[str, ...]) -> str:
    """Table names as parameters of frames, so that no view is registered."""
    statement = B.spark_sql(statement).replace("{", "{{").replace("}", "}}")
    for n in names:
        statement = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}} AS {n}", statement)
    return statement


def agent_docs(spark: SparkSession, d: str) -> DataFrame:
    return bound(spark, d, B.AGENT_DOCS, "documents")


def knowledge(spark: SparkSession, d: str) -> DataFrame:
    return tables.conform(bound(spark, d, B.KNOWLEDGE, "documents"), tables.KNOWLEDGE)


def ownership(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d, B.OWNERSHIP, "supplier", "nation").withColumnsRenamed({"agent_doc": "agentDoc", "human_doc": "humanDoc"})
    return tables.conform(rows.withColumn("checks", F.array(F.lit("npm test"))), tables.OWNERSHIP)


def terms(spark: SparkSession, d: str) -> DataFrame:
    return bound(spark, d, B.TERMS, "benchmark")


def notes(spark: SparkSession, d: str) -> DataFrame:
    return bound(spark, d, B.NOTES, "conversations")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return bound(spark, d, B.PAGES, "pages")


def settings() -> Settings:
    return Settings(agent_index="docs/d7.md", human=[{"plugin": "plain-markdown"}], out_file="index.json")


def knowledge_build(spark: SparkSession, d: str) -> DataFrame:
    """Id, title, description and search body of every agent document."""
    return handoff.build_knowledge(agent_docs(spark, d), settings()).select("id", "title", "path", "description", "body", "pos")


def frontmatter_fields(spark: SparkSession, d: str) -> DataFrame:
    """What the three frontmatter readers see."""
    docs = agent_docs(spark, d)
    fm, plain, raw = markdown.frontmatter(F.col("raw")), markdown.plain_frontmatter(F.col("raw")), F.col("raw")
    return docs.select("pos", markdown.fm_string(fm, "purpose").alias("purpose"), F.array_join(markdown.fm_list(fm, "checks"), ",").alias("checks"), markdown.plain_value(plain, "id").alias("plain_id"), markdown.header_field(raw, "type").alias("doc_type"), F.length(markdown.body(raw)).cast("long").alias("body_chars"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return search.search(knowledge(spark, d), ownership(spark, d), terms(spark, d))


def search_rank(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty entries of each term."""
    return _matches(spark, d).select(F.col("query_id").cast("long"), F.col("rank").cast("long"), "type", "id", "path", "summary", "score")


def agent_search_envelope(spark: SparkSession, d: str) -> DataFrame:
    """One row a term."""
    out = search.envelope(_matches(spark, d), terms(spark, d), ownership(spark, d))
    return out.select(F.col("query_id").cast("long"), "term", F.col("count").alias("n"), F.col("bestMatch.id").alias("best_id"), F.size("matches").cast("long").alias("n_matches"), F.array_join("nextCommands", "|").alias("next_commands"))


def ask_route(spark: SparkSession, d: str) -> DataFrame:
    """The preferred match of each term with its handoff."""
    out = search.ask(_matches(spark, d), handoff.handoffs(ownership(spark, d), settings()))
    return out.select(F.col("query_id").cast("long"), "type", "id", "score", "startHere", F.array_join("editRoots", ",").alias("edit_roots"))


def question_packages(spark: SparkSession, d: str) -> DataFrame:
    """The package that a question names."""
    return search.question_packages(terms(spark, d), ownership(spark, d)).select(F.col("query_id").cast("long"), "id")


def retriever_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first eight matches of each term as chunks."""
    out = retrieve.retrieve(_matches(spark, d), knowledge(spark, d), ownership(spark, d), "waymark")
    return out.select(F.col("query_id").cast("long"), F.col("rank").cast("long"), "chunkKey", "type", "id", "path", "title", "summary", "score")


def parsed_docs(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge of the agent documents, parsed once for all that reads it."""
    return tables.written(handoff.build_knowledge(agent_docs(spark, d), settings()).select("id", "path", "description", "frontmatter", "pos"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return handoff.seeds(parsed_docs(spark, d))


def ownership_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Owners that documents declare or that their paths suggest."""
    return _seeds(spark, d).select("id", "path", "purpose", F.array_join("checks", ",").alias("checks"), "agentDoc", "humanDoc", "origin", "pos")


def _discovered(spark: SparkSession, d: str) -> DataFrame:
    return bound(spark, d, DISCOVERED, "part").withColumn("checks", F.when(F.col("pos") % 2 == 0, F.array(F.lit("make test"))))


def _explicit(spark: SparkSession, d: str) -> DataFrame:
    return tables.conform(bound(spark, d, EXPLICIT, "supplier"), tables.OWNERSHIP)


DISCOVERED = """
SELECT concat('d', cast(p_partkey % 400 as string)) AS id, concat('packages/part', cast(p_partkey as string)) AS path, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name, p_partkey AS pos FROM part
"""
EXPLICIT = """
SELECT concat('d', cast(s_suppkey as string)) AS id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('explicit/', cast(s_suppkey as string)) END AS path, s_suppkey AS pos FROM supplier
"""


def packages_merge(spark: SparkSession, d: str) -> DataFrame:
    """Packages of explicit owners, discovery and seeds."""
    seeds = tables.conform(_seeds(spark, d), tables.SEED)
    out = handoff.merge_packages(_explicit(spark, d), _discovered(spark, d), seeds)
    return out.select("id", "path", "name", F.array_join("checks", ",").alias("checks"))


def handoff_build(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs of all owners, with their link state and notes."""
    h = handoff.handoffs(ownership(spark, d), settings())
    return h.select(F.col("target.id").alias("id"), F.col("target.path").alias("path"), F.col("target.layer").alias("layer"), "startHere", F.array_join("readBeforeEditing", ",").alias("read_first"), "humanDoc", F.col("bridge.humanDoc").alias("bridge"), F.col("bridge.bootstrap").alias("bootstrap"), F.array_join("notes", "|").alias("notes"))


def agent_doc_guess(spark: SparkSession, d: str) -> DataFrame:
    """The document that a package without one gets, by nine rules."""
    know = handoff.build_knowledge(agent_docs(spark, d), settings())
    return handoff.agent_doc_guess(_discovered(spark, d).select("id").distinct(), know)


def human_doc_match(spark: SparkSession, d: str) -> DataFrame:
    """The human document of each package by id, alias or suffix."""
    return handoff.human_doc_match(bound(spark, d, MATCH_PACKAGES, "part"), bound(spark, d, MATCH_HUMAN, "pages"))


MATCH_PACKAGES = "SELECT concat(CASE p_partkey % 5 WHEN 0 THEN 'os-' WHEN 1 THEN '@x/' ELSE '' END, 'h', cast(p_partkey as string), CASE WHEN p_partkey % 7 = 0 THEN '-pattern' ELSE '' END) AS id FROM part"
MATCH_HUMAN = "SELECT concat(CASE page_id % 4 WHEN 0 THEN 'packages/' WHEN 1 THEN 'site/deep/' WHEN 2 THEN 'my-' ELSE '' END, 'h', cast(page_id as string), CASE WHEN page_id % 6 = 1 THEN '/index' ELSE '' END) AS id, concat('/docs/', cast(page_id as string)) AS url, page_id AS pos FROM pages WHERE page_id IS NOT NULL"


def human_doc_union(spark: SparkSession, d: str) -> DataFrame:
    """Pages of two sources without agent documents, the first of an id."""
    p = pages(spark, d)
    out = human.union([p.where("pos % 2 = 0"), p.where("pos % 2 = 1")], "docs/for-agents")
    return out.select("id", "url", "path", F.col("source_pos").cast("long").alias("source_pos"))


def route_collision(spark: SparkSession, d: str) -> DataFrame:
    """One page of each route."""
    return human.resolve_collisions(pages(spark, d)).select("id", "url", "path")


def human_links_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether all local human links resolve."""
    return gates.human_links(handoff.handoffs(ownership(spark, d), settings()), pages(spark, d).where("pos % 3 <> 0"))


def human_links_missing(spark: SparkSession, d: str) -> DataFrame:
    return gates.missing_links(handoff.handoffs(ownership(spark, d), settings()), pages(spark, d).where("pos % 3 <> 0"))


def docs_style_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rules that each document fails."""
    return gates.style_defects(agent_docs(spark, d), STYLE_PROFILES["google-dev-docs"] + ["owner-source"]).select("path", F.array_join("missing", ",").alias("missing"))


def okf_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents without an allowed type."""
    return gates.type_defects(agent_docs(spark, d), ["guide", "package"])


def doctor_score(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, score and grade."""
    own, know, docs = ownership(spark, d), knowledge(spark, d), agent_docs(spark, d)
    ix = settings().index_doc
    results = gates.run([gates.human_links(handoff.handoffs(own, settings()), pages(spark, d)), spark.createDataFrame([("index-freshness", True, "Index is fresh", None, None)], tables.GATE_RESULT)])
    out = doctor.score(doctor.coverage(own, ix), doctor.document_coverage(know.where("pos % 3 = 0"), docs.select(F.regexp_replace("path", r"\A.*/", "docs/").alias("path")), ix), results, True, False)
    return out.select("total", "with_agent_doc", "with_human_doc", "docs", "indexed", "gates_passed", "gates", "score", "grade", "handoff_pct", "bridge_pct")


def doctor_issues(spark: SparkSession, d: str) -> DataFrame:
    """One row a defect."""
    own = ownership(spark, d)
    results = gates.human_links(handoff.handoffs(own, settings()), pages(spark, d).where("pos % 3 <> 0"))
    return doctor.issues(own, results, settings().index_doc, True, False).select(F.col("kind").cast("long").alias("kind"), "severity", "code", "message", "action")


def conformance_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rules by level and status, failing ones excepted where an exception stands."""
    rules = bound(spark, d, RULES, "labels")
    exceptions = bound(spark, d, EXCEPTIONS, "labels").withColumns({"reason": F.lit("r"), "approvedBy": F.lit("a"), "trackingUrl": F.lit("u")})
    return conformance.summary(conformance.apply_exceptions(rules, exceptions))


RULES = "SELECT concat('r', cast(doc_id as string)) AS id, CASE WHEN doc_id % 2 = 0 THEN 'required' ELSE 'recommended' END AS level, quality = 1 AS passed, 'm' AS message FROM labels"
EXCEPTIONS = "SELECT concat('r', cast(doc_id as string)) AS \"ruleId\" FROM labels WHERE doc_id % 3 = 0"


def memory_classify(spark: SparkSession, d: str) -> DataFrame:
    """Route, reason and target of every note."""
    return memory.classify(notes(spark, d)).select("id", "route", "reason", "target")


def memory_safety(spark: SparkSession, d: str) -> DataFrame:
    """Notes and documents that hold a secret or a private address."""
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("fact"))
    return memory.safety(notes(spark, d).select("id", "fact").unionByName(docs))


def memory_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Notes that the index already knows: a stated set of notes, those of conversations divisible by 50, against all entries."""
    asked = notes(spark, d).where("cast(split_part(id, '-', 1) as long) % 50 = 0")
    return memory.duplicates(asked, knowledge(spark, d), ownership(spark, d))


def memory_draft_lines(spark: SparkSession, d: str) -> DataFrame:
    """The draft's line of every note."""
    return memory.line(memory.classify(notes(spark, d)))


def llms_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of every agent document."""
    docs = agent_docs(spark, d)
    return docs.select("pos", F.explode(markdown.llms_links(F.col("raw"))).alias("l")).select("pos", "l.title", "l.url", "l.description")


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every agent document."""
    out = retrieve.chunk_markdown(agent_docs(spark, d).select(F.concat(F.lit("s"), F.col("pos") % 3).alias("source_id"), F.col("path").alias("url"), "raw"))
    return out.select("chunkKey", "path", "title", "summary", F.col("ordinal").cast("long").alias("ordinal"))


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Local and federated chunks of each term, the best eight."""
    local = retrieve.retrieve(_matches(spark, d), knowledge(spark, d), ownership(spark, d), "waymark")
    chunks = bound(spark, d, FEDERATED, "pages").withColumn("score", F.lit(0))
    return retrieve.hybrid_of(local, chunks, terms(spark, d)).select(F.col("query_id").cast("long"), F.col("rank").cast("long"), "chunkKey", "type", "path", "score")


FEDERATED = """
SELECT concat('web:federated:', cast(page_id % 90 as string)) AS "chunkKey", 'web' AS property, 'federated' AS type, cast(page_id % 90 as string) AS id, url AS path,
  concat('page ', cast(page_id as string)) AS title, html AS summary, page_id AS at FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL
"""


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of every document's canonical JSON, whole text included, keys given out of order."""
    docs = tables.read(spark, d, "documents")
    meta = F.struct("lang", F.array((F.col("doc_id") % 3).cast("string"), F.lit("é/\"")).alias("a"))
    return docs.select("doc_id", text.content_hash(F.to_json(F.struct("source", "text", F.col("doc_id").alias("id"), meta.alias("meta")))).alias("sha256"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose ids are divisible by 50."""
    e = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e, e.where("id % 50 = 0").withColumnRenamed("id", "query_id")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest vectors of each vector whose id is divisible by 50."""
    return vectors.exact_topk(*_vectors(spark, d)).select("query_id", F.col("rank").cast("long"), "id", F.round("similarity", 6).alias("similarity"))


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same by an inverted file: those found in the cells that each query is sent to, with no SQL; recall is measured against vector_topk."""
    corpus, asked = _vectors(spark, d)
    cells = vectors.fit(corpus)
    return vectors.search_index(vectors.build_index(corpus, cells), asked, cells).select("query_id", F.col("rank").cast("long"), "id", "similarity")


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of every document."""
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return retrieve.fixed_chunks(docs).select("id", F.col("ordinal").cast("long").alias("ordinal"), "chunk")


def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's events, an hour apart."""
    out = rebuild.debounce(tables.read(spark, d, "events").where("ts is not null and user_id is not null"), "user_id", "ts", "1 hour")
    return out.select("key", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


def link_graph_violations(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a product graph that are unknown, repeated or lead back."""
    products, claims = _contract(spark, d)
    return conformance.violations(products, claims)


def _contract(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = tables.read(spark, d, "nation")
    k = F.col("n_nationkey")
    key = lambda c: F.concat(F.lit("n"), c.cast("string"))
    home = F.when(k % 6 != 1, F.concat(F.lit("https://"), F.lower(F.translate("n_name", " ", "-")), F.lit(".example.com")))
    products = n.select(
        key(k).alias("id"), F.concat(F.lit("org/"), key(k)).alias("repo"),
        F.struct(home.alias("home"), F.when(k % 4 != 0, home).alias("docs"), F.lit(None).cast("string").alias("llms"), F.concat(F.lit("https://stats/"), key(k)).alias("stats"), F.when(k % 5 == 0, "fumadocs").otherwise("none").alias("documentation")).alias("surfaces"),
        F.struct(F.array(key(k * 2), key(F.col("n_regionkey").cast("int")), key(k + 1)).alias("next"), F.when(k % 7 != 3, (k % 20)).alias("order"), (k % 2 == 0).alias("showInBar")).alias("navigation"),
    )
    claim = F.struct(F.lit("c").alias("id"), (k * 1.0).alias("value"), F.when(k % 3 == 0, F.lit(10.0)).alias("conservativeFloor"), F.struct(F.lit("repository-derivation").alias("type"), F.concat(F.lit("org/n"), (k % 11).cast("string")).alias("repo")).alias("evidence"))
    claims = n.where(k != 4).select(
        key(F.when(k == 7, F.lit(77)).otherwise(k)).alias("productId"), F.struct(F.when(k % 2 == 0, "endpoint").otherwise("repository").alias("type"), F.when(k != 10, F.concat(F.lit("https://stats/"), key(k))).alias("url"), F.when(k != 9, F.concat(F.lit("org/"), key(k))).alias("repo")).alias("source"),
        F.when(k % 8 == 0, "declared").otherwise("measured").alias("verification"), F.when(k % 5 == 1, F.array(claim, claim)).otherwise(F.array(claim)).alias("claims"),
    )
    return products, claims


def llms_txt(spark: SparkSession, d: str) -> DataFrame:
    """The text index of the first 500 documents."""
    return sinks.llms_text(knowledge(spark, d), "demo")


def default_checks(spark: SparkSession, d: str) -> DataFrame:
    """Commands of every discovered package for each package manager."""
    rows = _discovered(spark, d).select("pos", "id", "path", "name")
    calls = [F.struct(F.lit(m).alias("manager"), F.array_join(handoff.default_checks(F.col("id"), F.col("path"), F.col("name"), m, True, True), ",").alias("checks")) for m in ("npm", "pnpm", "yarn", "bun")]
    return rows.select("pos", F.explode(F.array(*calls)).alias("c")).select("pos", "c.*")


def vitepress_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of pages with and without index files."""
    p = pages(spark, d)
    raw = p.select("path", F.lit("text").alias("raw"))
    return human.vitepress(raw, "docs", "/guide/").select("id", "url", "path")


def knowledge_urls(spark: SparkSession, d: str) -> DataFrame:
    """Published addresses of knowledge."""
    return knowledge(spark, d).select("pos", paths.knowledge_url(F.col("path"), "https://docs.example.com/base", "docs").alias("url"))


def registry() -> dict[str, Query]:
    own = [
        search_rank, knowledge_build, frontmatter_fields, agent_search_envelope, ask_route, question_packages, retriever_chunks, ownership_seeds, packages_merge, handoff_build, agent_doc_guess, human_doc_match, human_doc_union, route_collision, human_links_gate, human_links_missing, docs_style_gate, okf_gate,
        doctor_score, doctor_issues, conformance_summary, memory_classify, memory_safety, memory_duplicates, memory_draft_lines, llms_links, chunk_markdown, hybrid_retrieve, content_hash, vector_topk, vector_index_topk, fixed_chunks, debounce_sessions, link_graph_violations, llms_txt, default_checks, vitepress_routes, knowledge_urls,
    ]
    return {f.__name__: f for f in own}


def oracles() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in registry()}
