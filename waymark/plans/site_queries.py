"""Named queries of the adapters, manifests, lookups, rules and reports, each with its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.operators import conformance, doctor, gates, handoff, memory, retrieve, sinks, validate
from waymark.plans import bindings as B
from waymark.plans import queries as Q
from waymark.sources import human

#: (path, raw, pos): files of a documentation site, some with frontmatter, groups, index files and hidden names.
FILES = """
SELECT concat(CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'guide/' WHEN 2 THEN '(main)/api/' WHEN 3 THEN 'api/v1/' WHEN 4 THEN '_parts/' ELSE 'for-agents/' END,
  CASE WHEN page_id % 10 = 3 THEN concat('dir', cast(page_id as string), '/index') WHEN page_id % 10 = 7 THEN concat('.p', cast(page_id as string)) ELSE concat('p', cast(page_id as string)) END, CASE WHEN page_id % 4 = 1 THEN '.mdx' ELSE '.md' END) AS path,
  CASE WHEN page_id % 5 = 0 THEN concat('---', chr(10), 'package: pkg', cast(page_id as string), chr(10), 'draft: ', CASE WHEN page_id % 3 = 0 THEN 'true' ELSE 'false' END, chr(10), '---', chr(10), 'x') ELSE 'x' END AS raw, page_id AS pos
FROM pages WHERE page_id IS NOT NULL
"""
_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.mdx?$', '')"
_ID = f"CASE WHEN pos % 5 = 0 THEN concat('pkg', cast(pos AS string)) ELSE {_STEM} END"
_ROUTE = r"regexp_replace(regexp_replace(path, '(^|/)index\.mdx?$', ''), '\.mdx?$', '')"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return Q.bound(spark, d, FILES, "pages").drop("pos")


def _page(df: DataFrame) -> DataFrame:
    return df.select("id", "url", "path")


def plain_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages chosen by globs."""
    return _page(human.plain_markdown(_files(spark, d), "docs", "/d", ["**/*.md"], ["api/**"]))


def fumadocs_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that every level's list allows."""
    meta = spark.createDataFrame([("", ["guide", "(main)", "./api"]), ("api", ["..."]), ("guide", ["p1", "p7", "p13", "./p19", "p25", "p31"])], "dir string, pages array<string>")
    return _page(human.fumadocs(_files(spark, d), meta, "content", "/docs"))


def docusaurus_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a sidebar names or generates."""
    side = [{"type": "autogenerated", "dirName": "api/v1/"}, "p6", {"type": "category", "items": ["p12", {"type": "doc", "id": "guide/p1"}]}]
    return _page(human.docusaurus(_files(spark, d), "docs", "/docs", side))


def starlight_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages without drafts and hidden parts."""
    return _page(human.starlight(_files(spark, d), "src", None))


def nextra_pages(spark: SparkSession, d: str) -> DataFrame:
    """One page of each route."""
    return _page(human.nextra(_files(spark, d), "content", "/n"))


def ranked_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects by their ranked manifests."""
    rows = Q.bound(spark, d, MANIFESTS, "part").withColumn("targets", F.split("targets", ","))
    return handoff.ranked_projects(rows, "npx nx run", True).select("id", "name", F.array_join("checks", ",").alias("checks"), "collides")


MANIFESTS = """
SELECT p_partkey % 3 = 0 AS project_json, concat('libs/l', cast(p_partkey % 200 as string)) AS path, concat(CASE WHEN p_partkey % 4 = 0 THEN '@s/' WHEN p_partkey % 50 = 1 THEN '-' ELSE '' END, 'l', cast(p_partkey % 200 as string)) AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'lint,build' WHEN 1 THEN 'test' ELSE 'build' END AS targets, p_partkey AS pos FROM part
"""


def exact_answers(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose alias is the question."""
    n = Q.tables.read(spark, d, "nation")
    entries = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.array("n_name", F.concat(F.lit("Where is "), F.lower("n_name"))).alias("aliases"))
    asked = n.select(F.col("n_nationkey").cast("long").alias("query_id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("  WHERE   is "), "n_name", F.lit(" "))).when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).otherwise("nothing").alias("term"))
    return retrieve.exact_answers(entries, asked)


def missing_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of pages without an agent document."""
    pages = human.union([Q.pages(spark, d)], "docs/for-agents")
    texts = pages.select("path", F.concat(F.lit("---\na: b\n---\n"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("# Head "), "id", F.lit("\n\n"))).otherwise(""), F.lit("Text of "), "id").alias("raw"))
    have = pages.where("pos % 2 = 0").select(F.concat(F.lit("docs/for-agents/human/"), "id", F.lit(".md")).alias("path"))
    return sinks.missing_drafts(pages, have, texts)


def doctor_badge(spark: SparkSession, d: str) -> DataFrame:
    """Badge of the coverage."""
    own = Q.ownership(spark, d)
    g = spark.createDataFrame([("index-freshness", True, "m", None, None)], Q.tables.GATE_RESULT)
    none = spark.createDataFrame([(0, 0)], "docs long, indexed long")
    return doctor.badge(doctor.score(doctor.coverage(own, "docs/d7.md"), none, g, True, True)).select("score", "grade", "packages", "markdown")


def next_actions(spark: SparkSession, d: str) -> DataFrame:
    """What to do next."""
    own = Q.ownership(spark, d)
    g = spark.createDataFrame([("okf-type", False, "bad", None, None)], Q.tables.GATE_RESULT)
    out = doctor.next_actions(doctor.issues(own, g, "docs/d7.md", True, False), own, "docs/d7.md")
    return out.select(F.col("n").cast("long").alias("n"), "action")


def memory_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of note files."""
    rows = Q.notes(spark, d).select(F.concat(F.when(F.col("pos") % 3 == 0, ".cursor/rules/").when(F.col("pos") % 3 == 1, ".agent-memory/").otherwise("docs/"), F.col("pos"), F.lit(".md")).alias("path"), F.concat(F.lit("# N\n\n"), F.translate("fact", "\n|-#`*", " ")).alias("raw"))
    return memory.ingest(rows).select("id", "source", "rawPath", "fact", "confidence")


def marker_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Declared evidence with missing markers."""
    n = Q.tables.read(spark, d, "nation")
    path = F.concat(F.when(F.col("n_nationkey") % 8 == 7, "../").otherwise(""), F.lower("n_name"), F.lit(".md"))
    declared = n.select(path.alias("path"), F.array(F.lit("A"), F.lit("Z")).alias("contains"))
    files = n.where("n_nationkey % 5 <> 4").select(path.alias("path"), F.when(F.col("n_nationkey") % 6 == 5, 0).otherwise(F.length("n_name")).cast("long").alias("size"), F.when(F.col("n_nationkey") % 7 != 6, F.col("n_name")).alias("content"))
    return conformance.marker_details(conformance.evidence(declared, files)).select("path", "detail")


def style_report(spark: SparkSession, d: str) -> DataFrame:
    """Result row of the style gate."""
    docs = Q.agent_docs(spark, d)
    return gates.style_gate(docs, Q.Settings(style={"profile": "playbook-okf-soft"})).select("ok", "message", "expected", "actual")


def intent_routes(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs of intents, the last of an id."""
    p = Q.tables.read(spark, d, "part")
    intents = p.select(F.concat(F.lit("i"), F.col("p_partkey") % 120).alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type")).alias("paths"), F.col("p_partkey").alias("pos"))
    out = handoff.resolve_intent(intents.select("id").distinct(), intents)
    return out.select(F.col("target.id").alias("id"), "startHere", F.array_join("readBeforeEditing", ",").alias("read_first"), F.array_join("notes", ",").alias("notes"))


def invalid_handoffs(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs with what is wrong with them."""
    own = Q.ownership(spark, d).withColumn("path", F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("path"))).withColumn("agentDoc", F.when(F.col("pos") % 7 != 0, F.col("agentDoc")))
    out = validate.handoffs(handoff.handoffs(own, Q.settings())).where(F.size("issues") > 0)
    return out.select(F.col("target.id").alias("id"), F.array_join(F.transform("issues", lambda x: x["path"]), ",").alias("paths"))


def rewritten_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of documents as site routes or repository addresses."""
    docs = Q.tables.read(spark, d, "documents").where("doc_id is not null")
    i = F.col("doc_id").cast("string")
    url = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("../x/d"), i, F.lit(".md#s"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("../../src/"), i, F.lit(".ts"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("#h"), i)).otherwise(F.concat(F.lit("../../../"), i, F.lit(".md")))
    return docs.select("doc_id", paths.rewrite_link(url, F.lit("docs/guides/a.md"), "https://git.example/r", "main", "/base").alias("url"))


def portal_products(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the product block."""
    products, _ = Q._contract(spark, d)
    rows = products.withColumns({"pos": F.substring("id", 2, 9).cast("long"), "name": F.upper("id"), "promise": F.when(F.col("id") < "n2", " Does it! ").otherwise("Does it"), "role": F.when(F.col("id") > "n3", "helper"), "maturity": F.lit(None).cast("string")})
    return sinks.ecosystem_block(rows, "Products", "n12").select("pos", "line")


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [plain_pages, fumadocs_pages, docusaurus_pages, starlight_pages, nextra_pages, ranked_projects, exact_answers, missing_drafts, doctor_badge, next_actions, memory_ingest, marker_evidence, style_report, intent_routes, invalid_handoffs, rewritten_links, portal_products]
    return {f.__name__: f for f in own}


_F = f"f AS ({FILES})"
_O = f"own AS ({B.OWNERSHIP})"
SQL: dict[str, str] = {
    "plain_pages": rf"""WITH {_F} SELECT {_ID} AS id, CASE WHEN {_ROUTE} = '' THEN '/d' ELSE concat('/d/', {_ROUTE}) END AS url, concat('docs/', path) AS path FROM f WHERE path LIKE '%.md' AND path NOT LIKE 'api/%'""",
    "fumadocs_pages": rf"""WITH {_F} SELECT {_ID} AS id, CASE WHEN r = '' THEN '/docs' ELSE concat('/docs/', r) END AS url, concat('content/', path) AS path FROM (SELECT *, regexp_replace(regexp_replace(replace(path, '(main)/', ''), '(^|/)index\.mdx?$', ''), '\.mdx?$', '') AS r FROM f)
WHERE NOT regexp_matches(path, '(^|/)\.[^/]*$') AND (path LIKE '(main)/%' OR path LIKE 'api/%' OR regexp_matches(path, '^guide/p(1|7|13|19|25|31)\.mdx?$'))""",
    "docusaurus_pages": rf"""WITH {_F}, s AS (SELECT *, {_ROUTE} AS side FROM f) SELECT CASE WHEN pos % 5 = 0 THEN concat('pkg', cast(pos AS string)) ELSE side END AS id, concat('/docs/', side) AS url, concat('docs/', path) AS path FROM s WHERE side LIKE 'api/v1/%' OR side IN ('p6', 'p12', 'guide/p1')""",
    "starlight_pages": rf"""WITH {_F} SELECT {_ID} AS id, replace(replace({_ROUTE}, '(', ''), ')', '') AS url, concat('src/', path) AS path FROM f WHERE NOT regexp_matches(path, '(^|/)[._]') AND NOT (pos % 5 = 0 AND pos % 3 = 0)""",
    "nextra_pages": rf"""WITH {_F}, s AS (SELECT *, {_ROUTE} AS r FROM f) SELECT CASE WHEN pos % 5 = 0 THEN concat('pkg', cast(pos AS string)) ELSE r END AS id, concat('/n/', r) AS url, concat('content/', path) AS path FROM s""",
    "ranked_projects": rf"""WITH m AS ({MANIFESTS}), v AS (SELECT *, regexp_replace(name, '^@s/', '') AS id FROM m WHERE name NOT LIKE '-%'),
g AS (SELECT id, arg_max(name, CASE WHEN project_json THEN 1000000000000 ELSE 0 END + pos) AS name, bool_or(targets LIKE '%test%') AS t, bool_or(targets LIKE '%lint%') AS l, count(DISTINCT path) > 1 AS collides FROM v GROUP BY id)
SELECT id, name, CASE WHEN t OR l THEN concat_ws(',', CASE WHEN t THEN concat('npx nx run ', name, ':test') END, CASE WHEN l THEN concat('npx nx run ', name, ':lint') END) END AS checks, collides FROM g""",
    "exact_answers": "SELECT CAST(n_nationkey AS BIGINT) AS query_id, concat('n', n_nationkey) AS id FROM nation WHERE n_nationkey % 3 <> 2",
    "missing_drafts": rf"""WITH page AS ({B.PAGES}) SELECT concat('docs/for-agents/human/', id, '.md') AS path, concat('---', chr(10), 'type: knowledge', chr(10), 'draft: true', chr(10), 'id: ', id, chr(10), 'humanDoc: ', url, chr(10), '---', chr(10), chr(10), '# ', CASE WHEN pos % 3 = 0 THEN concat('Head ', id) ELSE id END, chr(10), chr(10), 'Draft generated by `waymark bootstrap agent-docs` from existing human docs.', chr(10), chr(10), '## Source summary', chr(10), chr(10), 'Text of ', id, chr(10), chr(10), '## Review checklist', chr(10), chr(10), '- TODO: confirm ownership, edit roots, and checks.', chr(10), '- TODO: move this draft to the right agent-doc location if needed.', chr(10)) AS content FROM (SELECT * FROM page WHERE path NOT LIKE 'docs/for-agents/%' AND path NOT LIKE '%/for-agents/%' QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1) WHERE pos % 2 = 1""",
    "doctor_badge": f"""WITH {_O}, c AS (SELECT count(*) AS n, count(*) FILTER (agent_doc IS NOT NULL AND agent_doc <> 'docs/d7.md') AS a, count(human_doc) AS h FROM own),
s AS (SELECT n, CAST(floor(100 * a / n + 0.5) AS BIGINT) AS ap, CAST(floor(100 * h / n + 0.5) AS BIGINT) AS hp, CAST(45 + floor(a / n * 35 + 0.5) + floor(h / n * 20 + 0.5) AS BIGINT) AS score FROM c),
k AS (SELECT *, CASE WHEN ap >= 80 THEN '2ea44f' WHEN ap >= 50 THEN 'dbab09' ELSE 'cb2431' END AS ac, CASE WHEN hp >= 80 THEN '2ea44f' WHEN hp >= 50 THEN 'dbab09' ELSE 'cb2431' END AS hc, CASE WHEN score >= 80 THEN '2ea44f' WHEN score >= 50 THEN 'dbab09' ELSE 'cb2431' END AS sc FROM s)
SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, n AS packages,
concat('![handoff coverage](https://img.shields.io/badge/handoff_coverage-', ap, '%25-', ac, '?style=flat-square) ![human bridge](https://img.shields.io/badge/human_bridge-', hp, '%25-', hc, '?style=flat-square) ![docs score](https://img.shields.io/badge/docs_score-', score, '%2F100-', sc, '?style=flat-square)') AS markdown FROM k""",
    "next_actions": f"""WITH {_O}, i AS (SELECT 1 AS kind, CAST(0 AS BIGINT) AS pos, 'waymark index' AS action UNION ALL SELECT 2, pos, concat('waymark init --scaffold-workspaces  # or edit docs/for-agents/packages/', id, '.md') FROM own WHERE (agent_doc IS NULL OR agent_doc = 'docs/d7.md')
  UNION ALL SELECT 3, pos, 'waymark bootstrap agent-docs' FROM own WHERE human_doc IS NULL UNION ALL SELECT 4, 0, 'waymark gate run' UNION ALL SELECT 8, 0, (SELECT concat('waymark query package ', arg_min(id, pos), ' --agent') FROM own WHERE agent_doc IS NULL OR agent_doc = 'docs/d7.md')),
a AS (SELECT action, min((kind, pos)) AS spot FROM i GROUP BY action) SELECT row_number() OVER (ORDER BY spot) AS n, action FROM a QUALIFY n <= 6""",
    "memory_ingest": rf"""WITH notes AS ({B.NOTES}), r AS (SELECT pos, trim(regexp_replace(translate(fact, chr(10) || '|-#`*', ' '), '\s+', ' ', 'g')) AS t FROM notes WHERE pos % 3 < 2),
c AS (SELECT *, left(t, 400) AS s, greatest(CASE WHEN strpos(reverse(left(t, 400)), ' .') > 0 THEN 399 - strpos(reverse(left(t, 400)), ' .') ELSE -1 END, CASE WHEN strpos(reverse(left(t, 400)), ' !') > 0 THEN 399 - strpos(reverse(left(t, 400)), ' !') ELSE -1 END, CASE WHEN strpos(reverse(left(t, 400)), ' ?') > 0 THEN 399 - strpos(reverse(left(t, 400)), ' ?') ELSE -1 END) AS sentence,
  CASE WHEN strpos(reverse(left(t, 400)), ' ') > 0 THEN 400 - strpos(reverse(left(t, 400)), ' ') ELSE -1 END AS word FROM r)
SELECT cast(pos AS string) AS id, CASE WHEN pos % 3 = 0 THEN 'cursor' ELSE 'agent-memory' END AS source, concat(CASE WHEN pos % 3 = 0 THEN '.cursor/rules/' ELSE '.agent-memory/' END, cast(pos AS string), '.md') AS "rawPath",
  CASE WHEN t = '' THEN 'N' WHEN length(t) <= 400 THEN t WHEN sentence > 160 THEN trim(left(s, sentence + 1)) WHEN word > 0 THEN trim(left(s, word)) ELSE s END AS fact, CASE WHEN pos % 3 = 0 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM c""",
    "marker_evidence": """SELECT concat(CASE WHEN n_nationkey % 8 = 7 THEN '../' ELSE '' END, lower(n_name), '.md') AS path,
CASE WHEN n_nationkey % 8 = 7 THEN 'Path escapes the project root.' WHEN n_nationkey % 5 = 4 THEN 'File does not exist.' WHEN n_nationkey % 6 = 5 THEN 'File is empty.' WHEN n_nationkey % 7 = 6 THEN 'File is not readable text.'
WHEN n_name LIKE '%A%' AND n_name LIKE '%Z%' THEN 'Found marker(s): A, Z' ELSE concat('Missing marker(s): ', concat_ws(', ', CASE WHEN n_name NOT LIKE '%A%' THEN 'A' END, CASE WHEN n_name NOT LIKE '%Z%' THEN 'Z' END)) END AS detail FROM nation""",
    "style_report": rf"""WITH docs AS ({B.AGENT_DOCS}), m AS (SELECT path, concat_ws(', ', CASE WHEN NOT regexp_matches(raw, '(?m)^#\s+\S+') THEN 'title' END, CASE WHEN regexp_matches(raw, '(?i)\b(TODO|TBD|coming soon|eventually|placeholder)\b') THEN 'no-stale-wording' END) AS missing FROM docs),
x AS (SELECT path, concat(path, ' (', missing, ')') AS item FROM m WHERE missing <> ''), b AS (SELECT (SELECT count(*) FROM x) AS n, (SELECT string_agg(item, '; ' ORDER BY path) FROM (SELECT * FROM x ORDER BY path LIMIT 100)) || CASE WHEN (SELECT count(*) FROM x) > 100 THEN concat('; and ', (SELECT count(*) FROM x) - 100, ' more') ELSE '' END AS items)
SELECT n = 0 AS ok, CASE WHEN n = 0 THEN 'All agent docs pass playbook-okf-soft docs-style rules' ELSE concat('Docs style issues: ', items) END AS message, CASE WHEN n > 0 THEN 'playbook-okf-soft: title, no-stale-wording' END AS expected, CASE WHEN n > 0 THEN concat(n, ' file(s) with style issues') END AS actual FROM b""",
    "intent_routes": """WITH p AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 120 ORDER BY p_partkey DESC) = 1) SELECT concat('i', p_partkey % 120) AS id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS "startHere", CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat(p_brand, ',', p_type) END AS read_first, p_name AS notes FROM p""",
    "invalid_handoffs": f"""WITH {_O} SELECT id, concat_ws(',', CASE WHEN pos % 5 = 0 THEN 'target.path' END, CASE WHEN pos % 7 = 0 OR agent_doc IS NULL THEN 'startHere' END, CASE WHEN pos % 5 = 0 THEN 'editRoots' END) AS paths FROM own WHERE pos % 5 = 0 OR pos % 7 = 0 OR agent_doc IS NULL""",
    "rewritten_links": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('/base/docs/x/d', doc_id, '/#s') WHEN 1 THEN concat('https://git.example/r/blob/main/src/', doc_id, '.ts') WHEN 2 THEN concat('#h', doc_id) ELSE concat('../../../', doc_id, '.md') END AS url FROM documents WHERE doc_id IS NOT NULL""",
    "portal_products": """WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, concat('n', n_nationkey) AS id, concat('https://', lower(replace(n_name, ' ', '-')), '.example.com') AS link FROM nation WHERE n_nationkey % 6 <> 1)
SELECT pos, concat('- [', upper(id), '](', link, ')', CASE WHEN id = 'n12' THEN ' **(current)**' ELSE '' END, ' — Does it', CASE WHEN id < 'n2' THEN '!' ELSE '.' END, CASE WHEN id > 'n3' THEN ' Role: `helper`.' ELSE '' END) AS line FROM p""",
}


def oracles() -> dict[str, str]:
    return dict(SQL)
