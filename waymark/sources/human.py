"""Human documentation of several site generators as (id, url, path, pos).

raw: (path below the documentation's root, raw). Each adapter says which files are pages, what their ids are and at which
route they appear.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.functions.literals import MAX_DEPTH, exported_literal
from waymark.functions.markdown import non_empty, plain_frontmatter, plain_value, slug_from_path
from waymark.operators.handoff import with_position


def _fm(key: str) -> Column:
    return plain_value(F.col("fm"), key)


def _pages(raw: DataFrame, root: str, keep: Column, ident: Column, slug: Column, prefix: str | None, *more: str) -> DataFrame:
    rows = raw.where(F.col("path").rlike(r"\.mdx?\z")).withColumn("fm", plain_frontmatter(F.col("raw"))).where(keep)
    got = rows.select(*more, ident.alias("id"), paths.human_url(slug, prefix).alias("url"), F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"))
    return with_position(got, *more, "path")


def _own_id() -> Column:
    return F.coalesce(_fm("package"), _fm("module"), _fm("id"), slug_from_path(F.col("path")))


def plain_markdown(raw: DataFrame, root: str = "docs", url_prefix: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    return _pages(raw, root, paths.matches_globs(F.col("path"), include, exclude), _own_id(), paths.route_slug(F.col("path")), url_prefix)


def fumadocs(raw: DataFrame, meta: DataFrame, root: str = "content/docs", url_prefix: str | None = None, exclude_prefixes: list[str] | None = None) -> DataFrame:
    """meta (dir, pages array<string>): the allow-list of each directory, '' being the root. A page must be listed, with or without ./, at every
    level that has a list, unless the list is empty or holds '...'. Agent documents are never pages; (group) segments vanish from routes.
    """
    heads = {*(exclude_prefixes or []), "for-agents"}
    out = reduce(lambda c, h: c | (F.col("path") == h) | F.col("path").startswith(h + "/"), sorted(heads), F.lit(False))
    docs = raw.where(~out & ~paths.file_name(F.col("path")).startswith("."))
    parts = F.split("path", "/")
    steps = docs.select("path", F.posexplode(parts).alias("k", "part"), parts.alias("parts"))
    steps = steps.select("path", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("dir"), F.regexp_replace("part", r"\.mdx?\z", "").alias("key"))
    lists = meta.where((F.size("pages") > 0) & ~F.array_contains("pages", "..."))
    hidden = steps.join(lists, "dir").where(~F.array_contains("pages", F.col("key")) & ~F.array_contains("pages", F.concat(F.lit("./"), "key"))).select("path").distinct()
    return _pages(docs.join(hidden, "path", "left_anti"), root, F.lit(True), _own_id(), paths.route_slug(F.col("path"), True), url_prefix)


def meta_pages(files: DataFrame) -> DataFrame:
    """(path, raw) of meta.json files -> (dir, pages); broken ones are left out."""
    rows = files.where(paths.file_name(F.col("path")) == "meta.json")
    parsed = rows.select(F.regexp_replace("path", r"/?meta\.json\z", "").alias("dir"), F.from_json("raw", "struct<pages: array<string>>")["pages"].alias("pages"))
    return parsed.where("pages is not null")


#: Levels of a sidebar that are read, as many as a literal may have.
MOST_LEVELS = 2 + MAX_DEPTH
#: Every value of a sidebar that may hold or name documents: of objects the lists and the link, of lists everything.
_WALK = f"""
WITH RECURSIVE part(site, v) MAX RECURSION LEVEL {MOST_LEVELS} AS (
  SELECT site, v FROM {{sidebars}}
  UNION ALL
  SELECT p.site, e.value FROM part p, LATERAL variant_explode(p.v) e
  WHERE schema_of_variant(e.value) LIKE 'ARRAY%' OR e.key IS NULL AND schema_of_variant(e.value) RLIKE '^(OBJECT|STRING)' OR e.key = 'link' AND schema_of_variant(e.value) LIKE 'OBJECT%'
)
SELECT site, v, schema_of_variant(v) AS of FROM part
"""


def sidebar_entries(sidebars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, raw) of sidebar files, JSON or a script that exports a literal -> (site, kind, name) of what they name, each once; (site, error) of those that can't be read.

    kind doc names a document, folder a directory that is listed whole ('' for all). Sidebars are walked by a recursive query over all sites at once. Rows of a site that repeat add up.
    """
    spark = sidebars.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # sidebars are as many as there are sites; plans run later, so it stays
    as_json = F.try_parse_json(F.col("raw"))
    read = sidebars.select("site", as_json.alias("as_json"), F.when(as_json.isNull(), F.col("raw")).alias("source")).withColumn("literal", exported_literal(F.col("source")))
    read = read.select("site", F.coalesce("as_json", "literal.value").alias("v"), F.when(F.col("as_json").isNull(), F.coalesce("literal.error", F.when(F.col("source").isNull(), "no source"))).alias("error"))
    parts = spark.sql(_WALK, sidebars=read.where("v is not null").select("site", "v"))
    of = lambda key: F.when(F.col("of").startswith("OBJECT"), F.try_variant_get("v", f"$.{key}", "string"))
    is_text = lambda key: F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")) == "STRING"
    doc = F.when(F.col("of") == "STRING", F.col("v").cast("string")).when(of("type").isin("doc", "ref") & is_text("id"), of("id"))
    folder = F.when((of("type") == "autogenerated") & is_text("dirName"), F.when(of("dirName") == ".", "").otherwise(F.regexp_replace(of("dirName"), r"/\z", "")))
    named = parts.select("site", F.explode(F.array(F.struct(F.lit("doc").alias("kind"), doc.alias("name")), F.struct(F.lit("folder").alias("kind"), folder.alias("name")))).alias("e"))
    return named.select("site", "e.*").where("name is not null").distinct(), read.where("error is not null").select("site", "error")


def docusaurus(raw: DataFrame, root: str = "docs", url_prefix: str | None = None, sidebars=None) -> DataFrame:
    """Index and readme files, and files named as their directory, stand for the directory.

    sidebars: parsed JSON of one site, a table (site, raw) of sidebar files of sites that raw names in a column site, or null for all pages. Sites
    without a sidebar keep all pages, those whose sidebar can't be read none. A page offers its id and all its directories, which meet what
    the sidebars name by equality. With a table the result has the site.
    """
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    stem = F.regexp_replace(paths.file_name(F.col("path")), r"\.mdx?\z", "")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    file_slug = F.when(stem.rlike(r"(?i)\A(index|readme)\z") | F.coalesce(stem == parent, F.lit(False)), folder).otherwise(paths.route_slug(F.col("path")))
    slug = F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(_fm("slug"), r"\A\./", ""), r"\A/", ""), r"/\z", ""), file_slug)
    side = F.coalesce(F.concat_ws("/", non_empty(folder), _fm("id")), F.lit(""))
    side = F.when(_fm("id").isNotNull(), side).otherwise(paths.route_slug(F.col("path")))
    ident = F.coalesce(_fm("package"), _fm("module"), side)
    if sidebars is None:
        return _pages(raw, root, F.lit(True), ident, slug, url_prefix)
    if not isinstance(sidebars, DataFrame):
        one = raw.sparkSession.createDataFrame([("", json.dumps(sidebars))], "site string, raw string")
        return docusaurus(raw.withColumn("site", F.lit("")), root, url_prefix, one).drop("site")
    entries, _ = sidebar_entries(sidebars)
    ids = raw.where(F.col("path").rlike(r"\.mdx?\z")).withColumn("fm", plain_frontmatter(F.col("raw"))).select("site", "path", side.alias("side"))
    steps = F.split("side", "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(F.lit("folder").alias("kind"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("name")))
    offered = ids.select("site", "path", F.explode(F.array_append(heads, F.struct(F.lit("doc").alias("kind"), F.col("side").alias("name")))).alias("o")).select("site", "path", "o.*")
    listed = offered.join(entries, ["site", "kind", "name"], "left_semi").select("site", "path").distinct()
    free = raw.join(sidebars.select("site").distinct(), "site", "left_anti")
    return _pages(raw.join(listed, ["site", "path"], "left_semi").unionByName(free), root, F.lit(True), ident, slug, url_prefix, "site")


def vitepress(raw: DataFrame, root: str = "docs", url_prefix: str | None = None, clean_urls: bool = False, src_exclude: list[str] | None = None) -> DataFrame:
    globs = src_exclude or []
    if len(globs) > 64 or any(not g or len(g) > 256 or "\0" in g for g in globs):
        raise ValueError("at most 64 exclusion patterns of 1 to 256 characters")
    keep = ~F.exists(F.split("path", "/"), lambda s: s.startswith(".")) & paths.matches_globs(F.col("path"), None, globs)
    slug = paths.route_slug(F.col("path"))
    slug = slug if clean_urls else F.when(F.col("path").rlike(r"(?:\A|/)index\.mdx?\z"), slug).otherwise(F.concat(slug, F.lit(".html")))
    return _pages(raw, root, keep, _own_id(), slug, url_prefix)


def starlight(raw: DataFrame, root: str = "src/content/docs", url_prefix: str | None = None) -> DataFrame:
    keep = ~F.exists(F.split("path", "/"), lambda s: s.startswith(".") | s.startswith("_")) & ~F.coalesce(_fm("draft") == "true", F.lit(False))
    own = F.array_join(F.filter(F.transform(F.split(paths.route_slug(F.col("path")), "/"), paths.github_slug), lambda s: s != ""), "/")
    return _pages(raw, root, keep, _own_id(), F.coalesce(non_empty(F.regexp_replace(_fm("slug"), r"\A/+|/+\z", "")), own), url_prefix)


def nextra(raw: DataFrame, root: str = "content", url_prefix: str = "/") -> DataFrame:
    route = paths.route_slug(F.col("path"))
    ident = F.coalesce(_fm("package"), _fm("module"), _fm("id"), non_empty(route), F.lit("index"))
    return resolve_collisions(_pages(raw, root, F.lit(True), ident, route, url_prefix))


def resolve_collisions(pages: DataFrame) -> DataFrame:
    """One page of each route: the last index page, else the last page. The empty route is /."""
    rows = pages.withColumn("url", F.coalesce(non_empty(F.col("url")), F.lit("/"))).withColumn("index_page", F.col("path").rlike(r"(?i)(?:\A|[/\\])index\.mdx?\z"))
    return rows.groupBy("url").agg(F.max_by(F.struct("id", "path"), F.struct("index_page", "pos")).alias("r"), F.min("pos").alias("pos")).select("r.id", "url", "r.path", "pos")


def union(sources: list[DataFrame], agent_root: str) -> DataFrame:
    """All sources in order; agent documents are left out; the first page of an id stays."""
    root = agent_root.rstrip("/")
    both = reduce(DataFrame.unionByName, [s.withColumn("source_pos", F.lit(k)) for k, s in enumerate(sources)])
    agent = (F.col("path") == root) | F.col("path").startswith(root + "/") | F.col("path").contains("/for-agents/") | F.col("path").endswith("/for-agents")
    first = F.min_by(F.struct("url", "path", "source_pos", "pos"), F.struct("source_pos", "pos"))
    return both.where(~agent).groupBy("id").agg(first.alias("r")).select("id", "r.*")


def url_map(pages: DataFrame) -> DataFrame:
    """id -> url."""
    return pages.select("id", "url")


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"plain-markdown": plain_markdown, "fumadocs": fumadocs, "docusaurus": docusaurus, "vitepress": vitepress, "starlight": starlight, "nextra": nextra}


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, url string, path string, pos long")
