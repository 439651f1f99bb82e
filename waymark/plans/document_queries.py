"""Named queries over literals in code, strict schemas and sidebars of many sites, each with its DuckDB SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.literals import exported_literal
from waymark.operators import handoff, sinks, strict, validate
from waymark.plans import bindings as B
from waymark.plans import queries as Q
from waymark.plans import site_queries
from waymark.sources import human, web
from waymark.sources.stores import store
from waymark.streaming import requests
from waymark.tables import read, shared_dir, spread


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null"))


def _quoted(c: Column, quote: str) -> Column:
    """A JavaScript string of a text."""
    inner = F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit(quote), F.lit("\\" + quote)), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(quote), inner, F.lit(quote))


def _sources(docs: DataFrame) -> DataFrame:
    """(doc_id, code): scripts around whole texts, in all forms that export a literal, and some that don't."""
    k, key = F.col("doc_id"), F.col("doc_id").cast("string")
    tags = F.concat(F.lit("['a', \"b\", /* ] */ "), F.array_join(F.transform(F.sequence(F.lit(0), k % 4), lambda x: x.cast("string")), ", "), F.lit(",]"))
    body = F.concat(F.lit("{ id: "), key, F.lit(", 'source': "), _quoted(F.col("source"), '"'), F.lit(", // } not yet\n  text: "), _quoted(F.col("text"), "'"), F.lit(",\n tags: "), tags, F.lit(", deep: {on: true, off: false, none: null, 'a-b': -1.50, deeper: [[{x: [{}]}]]}, }"))
    code = (
        F.when(k % 7 == 0, F.concat(F.lit("// module.exports = {id: 0}\nmodule.exports = "), body, F.lit(";")))
        .when(k % 7 == 1, F.concat(F.lit("export default "), body))
        .when(k % 7 == 2, F.concat(F.lit("import {defineConfig} from 'x'\nexport default defineConfig( "), body, F.lit(" )")))
        .when(k % 7 == 3, F.concat(F.lit("const site: Site<{a: 1}>\n = "), body, F.lit(" as const;\nexport default site")))
        .when(k % 7 == 4, F.concat(F.lit("const s = 'module.exports = {'; const re = /export default {[/]/g;\nmodule.exports = cfg; var cfg = "), body))
        .when(k % 7 == 5, F.concat(F.lit("module.exports = { id: make("), key, F.lit(") }")))
        .otherwise(F.concat(F.lit("export default { text: 'no end "), key))
    )
    return docs.select("doc_id", code.alias("code"))


def literal_sources(spark: SparkSession, d: str) -> DataFrame:
    """What scripts around all documents export, with the error of those that can't be read."""
    read_ = _sources(_documents(spark, d)).select("doc_id", exported_literal(F.col("code")).alias("r"))
    of = lambda path, kind: F.try_variant_get("r.value", path, kind)
    text = of("$.text", "string")
    return read_.select(
        "doc_id", F.col("r.error").alias("error"), of("$.id", "bigint").alias("id"), of("$.source", "string").alias("source"), F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"),
        F.array_join(F.transform(of("$.tags", "array<variant>"), lambda x: x.cast("string")), ",").alias("tags"), of("$.deep['a-b']", "double").alias("number"), F.coalesce(F.schema_of_variant(of("$.deep", "variant")), F.lit("")).alias("deep"),
    )


def _json(c: Column) -> Column:
    """A JSON string of a text."""
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def _index_json(docs: DataFrame) -> DataFrame:
    k, key, text = F.col("doc_id"), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    digest = F.when(k % 5 == 0, F.concat(F.lit("X"), F.substring(F.sha2(text.cast("binary"), 256), 2, 63))).otherwise(F.sha2(text.cast("binary"), 256))
    owners = F.concat(F.lit('{"packages": ["p", '), F.when(k % 9 == 0, "3").otherwise('"q"'), F.lit('], "ownership": {"o'), key, F.lit('": {"id": "o", "path": "p", "checks": [], "purpose": '), _json(text), F.when(k % 4 == 1, ', "owner": "x"').otherwise(""), F.lit("}}}"))
    return docs.select("doc_id", F.concat(
        F.lit('{"schemaVersion": 1, "contentHash": "'), digest, F.lit('", "contentHashAlgo": "sha256-normalized-v1", "knowledge": [{"id": "doc", "type": "guide", "title": '), F.when(k % 4 == 0, '""').otherwise(_json(F.col("lang"))),
        F.lit(', "path": "p", "body": '), _json(text), F.lit("}, "), F.when(k % 7 == 0, '{"id": 1, "type": "guide", "path": "p", "tags": [true]}').otherwise('{"id": "two", "type": "guide", "title": "Two", "path": "p"}'),
        F.lit('], "lookup": '), owners, F.when(k % 6 == 0, F.concat(F.lit(', "extra": {"knowledge": 1}, "more'), key, F.lit('": null'))).otherwise(""), F.lit("}"),
    ).alias("json"))


def _search_json(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    match = F.concat(F.lit('{"type": "doc", "id": "a", "path": "p", "score": 0.5, "summary": '), _json(F.coalesce("text", F.lit(""))), F.when(k % 4 == 0, ', "refs": -1').otherwise(""), F.lit("}"))
    return docs.select("doc_id", F.concat(
        F.lit('{"type": "agent-search", "source": '), _json(F.col("source")), F.lit(', "term": '), _json(F.col("lang")), F.lit(', "count": '), F.col("n_chars").cast("string"), F.when(k % 5 == 1, ".5").otherwise(""),
        F.lit(', "bestMatch": '), F.when(k % 2 == 0, match).otherwise("null"), F.lit(', "matches": ['), F.when(k % 8 == 1, F.array_join(F.array_repeat(F.lit('{"type": "t", "id": "i", "path": "p"}'), 33), ",")).otherwise(""),
        F.lit('], "nextCommands": '), F.when(k % 7 == 3, '"run"').otherwise('["run"]'), F.when(k % 11 == 2, "").otherwise("}"),
    ).alias("json"))


def _config_json(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    human_ = F.when(k % 4 == 0, '{"plugin": "docusaurus", "options": {"any": [1, {}]}}').when(k % 4 == 1, '[{"plugin": "fumadocs"}, {"plugin": "odd"}]').when(k % 4 == 2, '{"options": {}}').otherwise("[]")
    return docs.select("doc_id", F.concat(
        F.lit('{"project": '), _json(F.coalesce("text", F.lit(""))), F.lit(', "human": '), human_, F.lit(', "preset": '), F.when(k % 5 == 2, '"odd"').otherwise('"strict"'), F.lit(', "require_type": '), F.when(k % 6 == 3, "1").otherwise("true"), F.lit("}"),
    ).alias("json"))


def document_issues(spark: SparkSession, d: str) -> DataFrame:
    """What breaks the schemas in indexes, search results and settings that hold whole texts."""
    docs = _documents(spark, d).where("lang is not null and source is not null and n_chars is not null")
    kinds = [("index", _index_json), ("search", _search_json), ("config", _config_json)]
    every = [strict.issues(made(docs.where(F.col("doc_id") % 3 == k)), schema, "doc_id").select(F.lit(schema).alias("schema"), F.col("id").alias("doc_id"), "path", "message") for k, (schema, made) in enumerate(kinds)]
    return every[0].unionByName(every[1]).unionByName(every[2])


def _sites(pages: DataFrame) -> DataFrame:
    """(site, raw): a sidebar for most sites, nested as deep as its page's number says, in JSON or in code."""
    k = F.col("pos")
    nested = F.concat(F.repeat(F.lit('{"type": "category", "label": "c", "items": ['), (k % 9).cast("int")), F.when(k % 2 == 0, F.concat(F.lit('"'), F.col("side"), F.lit('"'))).otherwise(F.concat(F.lit('{"type": "doc", "id": "'), F.col("side"), F.lit('"}'))), F.repeat(F.lit("]}"), (k % 9).cast("int")))
    linked = F.concat(F.lit('{"type": "category", "label": "l", "items": [], "link": {"type": "doc", "id": "'), F.col("side"), F.lit('"}}'))
    named = pages.where(k % 3 < 2).groupBy("site").agg(F.array_join(F.collect_list(F.when(k % 3 == 0, nested).otherwise(linked)), ", ").alias("listed"))
    auto = F.when(F.col("number") % 4 == 0, ', {"type": "autogenerated", "dirName": "guide/"}').when(F.col("number") % 4 == 1, ', {"type": "autogenerated", "dirName": 7}').otherwise("")
    body = F.concat(F.lit('{"docs": ['), F.coalesce("listed", F.lit('"none"')), auto, F.lit("]}"))
    sites = pages.select("site", "number").distinct().join(named, "site", "left").where("number % 7 <> 0")
    raw = F.when(F.col("number") % 7 == 3, F.concat(F.lit("// made\nmodule.exports = "), body)).when(F.col("number") % 7 == 4, "export default sidebar()").otherwise(body)
    return sites.select("site", raw.alias("raw"))


def sidebar_sites(spark: SparkSession, d: str) -> DataFrame:
    """Pages of many sites that their sidebars list or generate."""
    files = Q.bound(spark, d, site_queries.FILES, "pages").withColumn("number", F.floor(F.col("pos") / 25)).withColumn("site", F.concat(F.lit("s"), F.col("number").cast("string")))
    files = files.withColumn("side", F.regexp_replace(F.regexp_replace("path", r"(?:\A|/)index\.mdx?\z", ""), r"\.mdx?\z", ""))
    return human.docusaurus(files.select("site", "path", "raw"), "docs", "/docs", _sites(files)).select("site", "id", "url", "path")


def sidebar_errors(spark: SparkSession, d: str) -> DataFrame:
    """Sites whose sidebars can't be read."""
    files = Q.bound(spark, d, site_queries.FILES, "pages").select(F.floor(F.col("pos") / 25).alias("number"), "pos", F.col("path").alias("side")).withColumn("site", F.concat(F.lit("s"), F.col("number").cast("string")))
    return human.sidebar_entries(_sites(files))[1]


def rebuild_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a stream of each user's events, an hour apart and served at once, as far as the stream's own time goes."""
    events = read(spark, d, "events").select("user_id", "ts")
    changes = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream reads no single file
    at = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    requests.serve(requests.requests(changes, key="user_id", gap_ms=3_600_000), lambda batch: batch, f"{at}/out", f"{at}/state").awaitTermination()
    served = spark.read.schema(requests.REQUEST).parquet(f"{at}/out")
    return served.select("key", "number", "n", *[F.unix_micros(c).alias(f"{c}_us") for c in ("first", "last", "at")])


def portal_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Portal entries of all kinds with their citations: commands, other products, packages and public documents whose titles have compatibility forms."""
    key = lambda c: F.col(c).cast("string")
    parts = read(spark, d, "part").where("p_partkey is not null and p_name is not null and p_brand is not null and p_type is not null")
    docs = _documents(spark, d).where("lang is not null and text is not null")
    title = F.concat(F.lit("\ufb01ne  "), "lang", F.lit(" "), key("doc_id"))
    files = docs.select(F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("fine "), "lang", F.lit(" "), key("doc_id"))).otherwise(F.concat(F.lit("guide/d"), key("doc_id"))), F.lit(".md")).alias("file"), F.concat(F.lit("# "), title, F.lit("\n\n> quote\n\n"), F.md5(F.col("text").cast("binary"))).alias("raw"), "doc_id")
    commands = parts.where("p_partkey % 2 = 0").select(F.concat(F.lit("c"), key("p_partkey")).alias("id"), F.col("p_name").alias("label"), F.concat(F.lit("run "), "p_brand").alias("command"), F.col("p_type").alias("description"))
    products = parts.where("p_partkey % 2 = 1").select(F.concat(F.lit("p"), key("p_partkey")).alias("id"), F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("role"), F.col("p_type").alias("hook"), F.concat(F.lit("https://h/"), key("p_partkey")).alias("home"))
    every = sinks.portal_entries(
        sinks.document_entries(files, files.where("doc_id % 2 = 0"), "https://o", "site"), sinks.package_entries(handoff.handoffs(Q.ownership(spark, d), Q.settings()), "https://o"),
        sinks.command_entries(commands, "https://o", "site"), sinks.ecosystem_entries(products, "p7"),
    )
    return every.select("id", "kind", "title", F.array_join("aliases", "|").alias("aliases"), F.sha2("answer", 256).alias("answer"), F.array_join(F.transform("citations", lambda c: F.concat(c["id"], F.lit(" "), c["title"], F.lit(" "), c["href"])), "|").alias("citations"))


def portal_full_text(spark: SparkSession, d: str) -> DataFrame:
    """Where each document begins in the one text of all documents."""
    docs = _documents(spark, d).where("text is not null").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "a/").otherwise("b/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md")).alias("file"), F.col("text").alias("raw"))
    rows = sinks.full_text("# All of it\n", docs)
    return rows.select(F.coalesce("file", F.lit("")).alias("file"), "offset", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def package_uses(spark: SparkSession, d: str) -> DataFrame:
    """Uses of all legacy packages in code that holds whole texts, by kind of file and line."""
    k, key = F.col("doc_id"), F.col("doc_id").cast("string")
    names = read(spark, d, "part").where("p_partkey is not null").select(F.concat(F.lit("@old/p"), F.col("p_partkey").cast("string")).alias("name"))
    used = F.concat(F.lit("@old/p"), (k % 150).cast("string"))
    folder = F.when(k % 6 == 0, "src/").when(k % 6 == 1, "node_modules/a/").when(k % 6 == 2, ".github/").when(k % 6 == 3, "docs/.hidden/").otherwise("lib/")
    path = F.concat(folder, key, F.when(k % 5 == 0, ".tsx").when(k % 5 == 1, ".json").when(k % 5 == 2, ".md").otherwise(".mjs"))
    around = lambda before, after: F.concat(F.lit(before), used, F.lit(after))
    line = F.when(k % 7 == 0, around("  import x from '", "'")).when(k % 7 == 1, F.concat(around('"', '": "1", "'), used, F.lit('/sub"'))).when(k % 7 == 2, around("run ", "@1.2 now")).when(k % 7 == 3, around("x", "")).when(k % 7 == 4, around("", "-more")).otherwise(around("require( '", "' )"))
    text = F.regexp_replace("text", r"[\r\n]+", " ")
    docs = _documents(spark, d).where("text is not null").select(path.alias("path"), F.concat(text, F.lit("\r\n"), line, F.lit("\n"), text).alias("content"))
    lock = spark.createDataFrame([("pnpm-lock.yaml", "a\n/x@old/p12(y):\n  '@old/p3-more': 1"), ("sub/pnpm-lock.yaml", "'@old/p3'")], "path string, content string")
    return validate.package_usages(docs.unionByName(lock), names)


def action_rules(spark: SparkSession, d: str) -> DataFrame:
    """Actions, one a document, that rebuild the index instead of gating it or leave the version open."""
    k = F.col("doc_id")
    head = F.concat(F.lit("name: a\ndescription: "), F.to_json(F.array("source")), F.lit("\nbranding:\nruns:\n  using: composite\ndefault: '1.0.0'\n"))
    body = F.concat(head, F.when(k % 2 == 0, "run: waymark gate run\n").otherwise(""), F.when(k % 3 == 0, "run: waymark index\n").otherwise(""), F.when(k % 5 < 3, f"[[ $V =~ {validate.EXACT_VERSION}$ ]]\n").otherwise(""))
    docs = _documents(spark, d).where("source is not null").select(F.concat(F.lit("action.yml#"), k.cast("string")).alias("path"), body.alias("content"))
    return validate.action_contract(docs, F.col("path"), "1.0.0", "waymark gate run", "waymark index", validate.EXACT_VERSION)


#: Bytes of a text from which it is too large, in the query.
TEXT_BYTES = 8000


def fetched_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the files that the tasks write of all pages give when their addresses are fetched: most by path, some by a file address, some that aren't there, lie outside or are too large."""
    root = f"{shared_dir(spark)}/waymark-texts-{uuid.uuid4().hex}"
    k, number = F.col("page_id"), F.col("page_id").cast("string")
    path = F.concat(F.lit("p"), (k % 16).cast("string"), F.lit("/"), number, F.lit(".html"))
    pages = read(spark, d, "pages").where("page_id is not null")
    full = root if "://" in root or root.startswith("file:") else f"file://{root}"
    asked = pages.select("page_id", F.when(k % 5 == 4, F.concat(path, F.lit(".gone"))).when(k % 5 == 3, F.concat(F.lit("../"), path)).when(k % 5 == 2, F.concat(F.lit(full + "/"), path)).otherwise(path).alias("url"))
    system, base = store(root)
    system.create_dir(base)
    try:
        web.write_texts(pages.select(path.alias("path"), F.col("html").alias("text")), root).agg(F.sum("bytes")).first()
        got = web.read_texts(asked, base, timeout=60, max_bytes=TEXT_BYTES)
    finally:
        system.delete_dir(base)
    return asked.join(got, "url").select("page_id", "outcome", "bytes", F.md5("raw").alias("raw_md5"))


def readme_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """What the READMEs made of all documents break of what is declared for them: markers, budgets, visuals, commands, profiles, reviews."""
    docs = _documents(spark, d)
    k, key = F.col("doc_id"), F.col("doc_id").cast("string")
    of = lambda c, n: F.concat(F.lit(c), (k % n).cast("string"))
    shown = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.when(k % 2 == 0, "## Install\n").otherwise(""), F.when(k % 3 != 0, F.concat(F.lit("run "), key, F.lit("!\n"))).otherwise(""), F.repeat(F.lit("![i](https://x/i.png) "), (k % 4).cast("int")), F.when(k % 5 == 0, "![](https://img.shields.io/b)").otherwise(""))
    some = docs.select(F.explode(F.array(of("v/", 4), of("t/", 5))).alias("path")).distinct().withColumn("content", F.lit("x"))
    files_ = docs.select(F.concat(F.lit("r/"), key, F.lit(".md")).alias("path"), shown.alias("content")).unionByName(some)
    surfaces = docs.select(
        F.concat(F.lit("s"), key).alias("id"), F.concat(F.when(k % 11 == 0, "gone/").otherwise("r/"), key, F.lit(".md")).alias("path"), F.when(k % 7 == 0, "none").otherwise(of("p", 2)).alias("profileId"),
        F.array(F.struct(F.lit("install").alias("dimension"), F.lit("## Install").alias("marker"))).alias("dimensions"), F.array(F.struct(of("v/", 5).alias("src"), F.when(k % 4 == 0, "odd").otherwise("paired").alias("darkMode"))).alias("visuals"),
        F.array(F.struct(F.when(k % 9 == 0, "").otherwise("c").alias("id"), F.concat(F.lit("run "), key, F.lit("!")).alias("command"), of("t/", 6).alias("test"), F.lit("x").alias("testCommand"))).alias("commands"),
        F.when(k % 13 == 0, "soon").otherwise("2024-01-01").alias("reviewedOn"), F.when(k % 8 == 0, "2024-06-30").otherwise("2026-01-01").alias("reviewDueOn"),
    )
    profiles = spark.createDataFrame([("p0", 0, 2, 0), ("p1", 1, 3, 1)], "profileId string, min_images int, max_images int, max_badges int")
    return validate.surface_problems(surfaces, profiles, files_, "2025-01-01")


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (literal_sources, document_issues, sidebar_sites, sidebar_errors, rebuild_requests, portal_catalog, portal_full_text, package_uses, action_rules, fetched_texts, readme_surfaces)}


SQL: dict[str, str] = {
    "readme_surfaces": r"""WITH d AS (SELECT doc_id AS k, concat('s', doc_id) AS id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
m AS (SELECT DISTINCT concat('v/', k % 4) AS path FROM d UNION SELECT DISTINCT concat('t/', k % 5) FROM d),
here AS (SELECT *, k % 7 <> 0 AS known, k % 4 + len(list_filter(regexp_extract_all(t, '!\[[^\]]*\]\([^)]+\)'), lambda x: NOT contains(x, '(https://img.shields.io/'))) AS images, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + (length(t) - length(replace(t, 'https://img.shields.io/', ''))) // 24 AS badges FROM d WHERE k % 11 <> 0),
full_ AS (SELECT * FROM here WHERE known)
SELECT id, 'readme-missing' AS rule, concat('gone/', k, '.md') AS detail FROM d WHERE k % 11 = 0
UNION ALL SELECT id, 'marker', '## Install' FROM here WHERE k % 2 <> 0 AND NOT contains(t, '## Install')
UNION ALL SELECT id, 'profile', 'none' FROM here WHERE NOT known
UNION ALL SELECT id, 'alt-text', '' FROM full_ WHERE k % 5 = 0 OR regexp_matches(t, '!\[\s*\]\([^)]+\)')
UNION ALL SELECT id, 'image-budget', images::VARCHAR FROM full_ WHERE NOT (images BETWEEN k % 2 AND 2 + k % 2)
UNION ALL SELECT id, 'badge-budget', badges::VARCHAR FROM full_ WHERE badges > k % 2
UNION ALL SELECT id, 'dark-mode', concat('v/', k % 5) FROM full_ WHERE k % 4 = 0
UNION ALL SELECT id, 'command', concat('run ', k, '!') FROM full_ WHERE k % 3 = 0 AND NOT contains(t, concat('run ', k, '!'))
UNION ALL SELECT id, 'command-metadata', concat('run ', k, '!') FROM full_ WHERE k % 9 = 0
UNION ALL SELECT id, 'review-expired', CASE WHEN k % 8 = 0 THEN '2024-06-30' ELSE '2026-01-01' END FROM full_ WHERE k % 8 = 0 OR k % 13 = 0
UNION ALL SELECT id, 'visual-file', concat('v/', k % 5) FROM full_ WHERE concat('v/', k % 5) NOT IN (SELECT path FROM m)
UNION ALL SELECT id, 'command-test', concat('t/', k % 6) FROM full_ WHERE concat('t/', k % 6) NOT IN (SELECT path FROM m)""",
    "fetched_texts": f"""WITH p AS (SELECT page_id, html, octet_length(encode(html)) AS n FROM pages WHERE page_id IS NOT NULL),
o AS (SELECT *, CASE WHEN page_id % 5 = 4 THEN 'away' WHEN page_id % 5 = 3 THEN 'outside' WHEN html IS NULL THEN 'away' WHEN n = 0 THEN 'empty' WHEN n > {TEXT_BYTES} THEN 'too large' ELSE 'text' END AS outcome FROM p)
SELECT page_id, outcome, CASE WHEN outcome IN ('text', 'empty') THEN n END AS bytes, CASE WHEN outcome = 'text' THEN md5(html) END AS raw_md5 FROM o""",
    "literal_sources": """SELECT doc_id, CASE doc_id % 7 WHEN 5 THEN 'no literal: make' WHEN 6 THEN 'a string has no end' END AS error,
  CASE WHEN ok THEN doc_id END AS id, CASE WHEN ok THEN coalesce(source, '') END AS source, CASE WHEN ok THEN length(coalesce(text, '')) END AS n_chars, CASE WHEN ok THEN md5(coalesce(text, '')) END AS text_md5,
  CASE WHEN ok THEN concat('a,b', CASE doc_id % 4 WHEN 0 THEN ',0' WHEN 1 THEN ',0,1' WHEN 2 THEN ',0,1,2' ELSE ',0,1,2,3' END) END AS tags, CASE WHEN ok THEN -1.5::DOUBLE END AS number,
  CASE WHEN ok THEN 'OBJECT<`a-b`: DECIMAL(2,1), deeper: ARRAY<ARRAY<OBJECT<x: ARRAY<OBJECT<>>>>>, none: VOID, off: BOOLEAN, on: BOOLEAN>' ELSE '' END AS deep
FROM (SELECT *, doc_id % 7 < 5 AS ok FROM documents WHERE doc_id IS NOT NULL)""",
    "document_issues": """WITH d AS (SELECT doc_id, doc_id AS k, length(coalesce(text, '')) AS n FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL),
i AS (SELECT * FROM d WHERE k % 3 = 0), s AS (SELECT * FROM d WHERE k % 3 = 1), c AS (SELECT * FROM d WHERE k % 3 = 2), w AS (SELECT * FROM s WHERE k % 11 <> 2)
SELECT 'index' AS schema, doc_id, 'contentHash' AS path, 'has another form' AS message FROM i WHERE k % 5 = 0
UNION ALL SELECT 'index', doc_id, 'knowledge.0.title', 'characters must be 1 to 256' FROM i WHERE k % 4 = 0
UNION ALL SELECT 'index', doc_id, 'knowledge.0.body', 'characters must be at most 8000' FROM i WHERE n > 8000
UNION ALL SELECT 'index', doc_id, unnest(['knowledge.1.id', 'knowledge.1.tags.0', 'knowledge.1.title']), unnest(['must be a text', 'must be a text', 'is missing']) FROM i WHERE k % 7 = 0
UNION ALL SELECT 'index', doc_id, 'lookup.packages.1', 'must be a text' FROM i WHERE k % 9 = 0
UNION ALL SELECT 'index', doc_id, concat('lookup.ownership.o', k, '.purpose'), 'characters must be at most 1024' FROM i WHERE n > 1024
UNION ALL SELECT 'index', doc_id, concat('lookup.ownership.o', k), 'unknown keys: owner' FROM i WHERE k % 4 = 1
UNION ALL SELECT 'index', doc_id, '(root)', concat('unknown keys: extra, more', k) FROM i WHERE k % 6 = 0
UNION ALL SELECT 'search', doc_id, '(root)', 'is no JSON' FROM s WHERE k % 11 = 2
UNION ALL SELECT 'search', doc_id, 'count', 'must be a whole number' FROM w WHERE k % 5 = 1
UNION ALL SELECT 'search', doc_id, 'bestMatch.summary', 'characters must be at most 2048' FROM w WHERE k % 2 = 0 AND n > 2048
UNION ALL SELECT 'search', doc_id, 'bestMatch.refs', 'must be at least 0' FROM w WHERE k % 4 = 0
UNION ALL SELECT 'search', doc_id, 'matches', 'items must be at most 32' FROM w WHERE k % 8 = 1
UNION ALL SELECT 'search', doc_id, 'nextCommands', 'must be a list' FROM w WHERE k % 7 = 3
UNION ALL SELECT 'config', doc_id, 'project', 'characters must be 1 to 128' FROM c WHERE n = 0 OR n > 128
UNION ALL SELECT 'config', doc_id, 'human.1.plugin', 'must be one of plain-markdown, fumadocs, docusaurus, vitepress, starlight, nextra' FROM c WHERE k % 4 = 1
UNION ALL SELECT 'config', doc_id, 'human.plugin', 'is missing' FROM c WHERE k % 4 = 2
UNION ALL SELECT 'config', doc_id, 'preset', 'must be one of minimal, standard, strict, playbook' FROM c WHERE k % 5 = 2
UNION ALL SELECT 'config', doc_id, 'require_type', 'must be true or false' FROM c WHERE k % 6 = 3""",
    "sidebar_sites": rf"""WITH f AS ({site_queries.FILES}), s AS (SELECT *, pos // 25 AS number, {site_queries._ROUTE} AS side FROM f)
SELECT concat('s', number) AS site, CASE WHEN pos % 5 = 0 THEN concat('pkg', cast(pos AS string)) ELSE side END AS id, concat('/docs/', side) AS url, concat('docs/', path) AS path
FROM s WHERE number % 7 = 0 OR number % 7 <> 4 AND (pos % 3 < 2 OR number % 4 = 0 AND path LIKE 'guide/%')""",
    "rebuild_requests": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY k) AS number, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, epoch_us(max(ts)) + 3600000000 AS at_us
FROM s GROUP BY user_id, k HAVING epoch_us(max(ts)) + 3600000000 <= (SELECT epoch_ms(max(ts)) * 1000 FROM g)""",
    "portal_catalog": f"""WITH own AS ({B.OWNERSHIP}), part_ AS (SELECT * FROM part WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL AND p_brand IS NOT NULL AND p_type IS NOT NULL),
docs AS (SELECT doc_id AS k, lang, md5(text) AS said, CASE WHEN doc_id % 3 = 0 THEN concat('fine ', lang, ' ', doc_id) ELSE concat('guide/d', doc_id) END AS slug FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL AND text IS NOT NULL),
doc AS (SELECT *, concat('\ufb01ne  ', lang, ' ', k) AS title, concat('https://o/docs/', slug, '/') AS page, concat('doc:', regexp_replace(slug, '[^A-Za-z0-9._:-]+', ':', 'g')) AS id FROM docs)
SELECT id, 'document' AS kind, title, concat_ws('|', slug, concat(slug, '.md'), CASE WHEN k % 3 <> 0 THEN title END, concat('site ', title)) AS aliases,
  sha256(concat('## ', title, chr(10), chr(10), said, chr(10), chr(10), '[Open the canonical guide](', page, ') · [Read raw Markdown](https://o/raw/', slug, '.md)')) AS answer, concat(id, ' ', title, ' ', page) AS citations FROM doc
UNION ALL SELECT concat('command:c', p_partkey), 'command', p_name, concat_ws('|', 'c' || p_partkey, 'run ' || p_brand, p_name, 'how do i c' || p_partkey, 'site c' || p_partkey), sha256(concat('## ', p_name, chr(10), chr(10), '```bash', chr(10), 'run ', p_brand, chr(10), '```', chr(10), chr(10), p_type)), 'doc:spec:cli CLI reference https://o/docs/spec/cli/' FROM part_ WHERE p_partkey % 2 = 0
UNION ALL SELECT concat('ecosystem:p', p_partkey), 'document', upper(p_name), concat_ws('|', 'p' || p_partkey, upper(p_name), CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, p_type), sha256(concat('## ', upper(p_name), chr(10), chr(10), p_type, chr(10), chr(10), '[Continue to ', upper(p_name), '](https://h/', p_partkey, ')')), concat('ecosystem:p', p_partkey, ' ', upper(p_name), ' https://h/', p_partkey) FROM part_ WHERE p_partkey % 2 = 1 AND p_partkey <> 7
UNION ALL SELECT concat('package:', id), 'package', concat(id, ' ownership handoff'), concat_ws('|', id, 'who owns ' || id, id || ' handoff', purpose),
  sha256(concat('## ', id, ' handoff', chr(10), chr(10), purpose, '.', chr(10), chr(10), 'Start at [**', start, '**](https://o/raw/', place, '). Edit roots: **', path, '**. Checks: **npm test**.', chr(10), chr(10), 'This answer was generated from the repository''s own index.')),
  concat('human:', id, ' ', id, ' human guide ', CASE WHEN human_doc LIKE 'http%' THEN human_doc ELSE concat('https://o', coalesce(human_doc, '/docs/getting-started'), '/') END, '|doc:', regexp_replace(place, '[^A-Za-z0-9._:-]+', ':', 'g'), ' ', start, ' https://o/raw/', place)
FROM (SELECT *, coalesce(agent_doc, '') AS start, regexp_replace(coalesce(agent_doc, ''), '^docs/', '') AS place FROM own)""",
    "portal_full_text": """WITH t AS (SELECT '' AS file, concat('# All of it', chr(10)) AS text UNION ALL SELECT file, concat(chr(10), '---', chr(10), chr(10), '# Source: ', file, chr(10), chr(10), text) FROM (SELECT concat(CASE WHEN doc_id % 2 = 0 THEN 'a/' ELSE 'b/' END, lpad(doc_id::VARCHAR, 12, '0'), '.md') AS file, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))
SELECT file, (sum(length(text) + 1) OVER (ORDER BY file ROWS UNBOUNDED PRECEDING) - length(text) - 1)::BIGINT AS "offset", length(text) AS n_chars, md5(text) AS text_md5 FROM t""",
    "package_uses": """WITH d AS (SELECT doc_id AS k, concat('@old/p', doc_id % 150) AS used, chr(39) AS q, concat(CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 2 THEN '.github/' ELSE 'lib/' END, doc_id, CASE doc_id % 5 WHEN 0 THEN '.tsx' WHEN 1 THEN '.json' ELSE '.mjs' END) AS path
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND doc_id % 5 <> 2 AND doc_id % 6 NOT IN (1, 3) AND doc_id % 7 NOT IN (3, 4) AND doc_id % 150 IN (SELECT p_partkey FROM part))
SELECT path, 2 AS line, used AS name, CASE k % 7 WHEN 0 THEN concat('import x from ', q, used, q) WHEN 1 THEN concat('"', used, '": "1", "', used, '/sub"') WHEN 2 THEN concat('run ', used, '@1.2 now') ELSE concat('require( ', q, used, q, ' )') END AS text FROM d
UNION ALL SELECT 'pnpm-lock.yaml', line, concat('@old/p', p_partkey), text FROM part JOIN (VALUES (1, 2, '/x@old/p12(y):'), (12, 2, '/x@old/p12(y):'), (3, 3, concat(chr(39), '@old/p3-more', chr(39), ': 1'))) v(p, line, text) ON p = p_partkey""",
    "action_rules": """SELECT concat('action.yml#', doc_id) AS path, unnest(list_filter([CASE WHEN doc_id % 2 <> 0 OR doc_id % 3 = 0 THEN 'the committed index isn''t gated as it is' END, CASE WHEN doc_id % 5 >= 3 THEN 'the version isn''t held to an exact one' END], lambda x: x IS NOT NULL)) AS problem FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL""",
    "sidebar_errors": """SELECT DISTINCT concat('s', page_id // 25) AS site, 'sidebar isn''t declared with a value' AS error FROM pages WHERE page_id IS NOT NULL AND (page_id // 25) % 7 = 4""",
}


def oracles() -> dict[str, str]:
    return dict(SQL)
