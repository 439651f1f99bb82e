"""Ownership from several sources of unequal rank, merged into one handoff row per package.

Positions (``pos``) carry the order of every source, so first-wins and last-wins rules never lean on row order.
Human documents are matched by equality of ids, aliases and suffixes of the id, all as hash joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark import tables
from waymark.config import Settings
from waymark.functions import markdown, paths
from waymark.functions.markdown import fm_list, fm_string, non_empty


def build_knowledge(raw: DataFrame, settings: Settings) -> DataFrame:
    """(path, raw[, pos]) agent documents -> knowledge columns, frontmatter and raw.

    path is relative to the project; globs apply below the agent root. pos is in the byte order of the path, unless given.
    """
    root = settings.agent_root.rstrip("/") + "/"
    below = F.substring("path", len(root) + 1, 1 << 30)
    docs = raw.where(F.col("path").startswith(root)).where(paths.matches_globs(below, settings.include, settings.exclude))
    docs = docs if "pos" in raw.columns else with_position(docs, "path")  # before the texts are parsed, as range bounds read rows once more
    fm = docs.withColumns({"frontmatter": markdown.frontmatter(F.col("raw")), "own_body": markdown.body(F.col("raw"))})
    text = F.col("own_body")
    ident = F.coalesce(fm_string(F.col("frontmatter"), "id"), fm_string(F.col("frontmatter"), "package"), markdown.slug_from_path(F.col("path")))
    return fm.withColumn("id", ident).select(
        "id", F.lit("agent-doc").alias("type"), F.coalesce(markdown.first_heading(F.col("raw"), text), F.col("id")).alias("title"), "path",
        F.coalesce(fm_string(F.col("frontmatter"), "purpose"), markdown.first_paragraph(F.col("raw"), 400, text)).alias("description"), markdown.search_body(F.col("raw"), 6000, text).alias("body"), "frontmatter", "raw", "pos",
    )


def with_position(df: DataFrame, *order: str | Column) -> DataFrame:
    """pos: a number that grows with the order of the rows, with gaps, without gathering them in one task: the rank's partition and row within it."""
    sized = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).sortWithinPartitions(*order)
    return sized.withColumn("pos", F.monotonically_increasing_id())


def collated(column: str = "id") -> Column:
    """The order of names for people: letters by the root collation, not by their bytes."""
    return F.expr(f"`{column}` collate UNICODE")


def seeds_from_frontmatter(knowledge: DataFrame) -> DataFrame:
    """Owners that documents declare: an id and an edit root, which packages and modules may leave to their id."""
    fm = lambda key: fm_string(F.col("frontmatter"), key)
    typed = fm("type")
    ident = F.coalesce(fm("package"), F.when(typed.isin("package", "module", "pattern"), F.coalesce(fm("id"), F.col("id"))))
    rows = knowledge.withColumn("seed_id", ident)
    where = F.coalesce(fm("editRoot"), fm("path"), F.when(typed.isin("package", "module"), F.concat(F.lit("packages/"), F.col("seed_id"))))
    return _seeds(rows.withColumn("seed_path", where), F.coalesce(fm("purpose"), F.col("description")), "frontmatter")


def seeds_from_path(knowledge: DataFrame) -> DataFrame:
    """Owners that paths suggest, unless package and edit root are declared; the first document of an id counts."""
    fm = lambda key: fm_string(F.col("frontmatter"), key)
    rel = F.col("path")
    part = lambda pattern: non_empty(F.regexp_extract(rel, pattern, 1))
    package = part(r"(?:\A|/)packages/([^/]+)\.(?:md|mdx)\z")
    folder = part(r"(?:\A|/)packages/([^/]+)/index\.(?:md|mdx)\z")
    entry = part(r"(?i)(?:\A|/)registry/([^/]+)/README\.(?:md|mdx)\z")
    pattern = part(r"(?:\A|/)pillars/[^/]+/([^/]+(?:-pattern)?)\.(?:md|mdx)\z")
    top = part(r"(?:\A|/)for-agents/([^/]+)\.(?:md|mdx)\z")
    found = (
        F.when(package != "index", F.struct(package.alias("id"), F.concat(F.lit("packages/"), package).alias("path"), F.lit(False).alias("pattern")))
        .when(folder.isNotNull(), F.struct(folder.alias("id"), F.concat(F.lit("packages/"), folder).alias("path"), F.lit(False).alias("pattern")))
        .when(entry.isNotNull(), F.struct(entry.alias("id"), F.concat(F.lit("registry/"), entry).alias("path"), F.lit(False).alias("pattern")))
        .when(pattern.isNotNull() & ~pattern.isin("index", "universal"), F.struct(pattern.alias("id"), rel.alias("path"), F.lit(True).alias("pattern")))
        .when(top.isNotNull() & ~top.isin("index", "INDEX"), F.struct(top.alias("id"), F.concat(F.lit("packages/"), top).alias("path"), F.lit(False).alias("pattern")))
    )
    open_rows = knowledge.where(fm("package").isNull() | fm("editRoot").isNull()).withColumn("found", found).where("found is not null")
    rows = open_rows.withColumn("seed_id", F.col("found.id")).withColumn("seed_path", F.col("found.path"))
    purpose = F.coalesce(fm("purpose"), F.col("description"), F.when(F.col("found.pattern"), F.concat(F.lit("Playbook pattern: "), F.col("found.id"))))
    return first_per(_seeds(rows, purpose, "path"), "id", "pos")


def seeds(knowledge: DataFrame) -> DataFrame:
    """Seeds of both kinds."""
    return seeds_from_frontmatter(knowledge).unionByName(seeds_from_path(knowledge))


def _seeds(rows: DataFrame, purpose: Column, origin: str) -> DataFrame:
    own = F.col("frontmatter")
    out = rows.where(F.col("seed_id").isNotNull() & F.col("seed_path").isNotNull())
    return out.select(F.col("seed_id").alias("id"), F.col("seed_path").alias("path"), non_empty(purpose).alias("purpose"), fm_list(own, "checks").alias("checks"), F.col("path").alias("agentDoc"), fm_string(own, "humanDoc").alias("humanDoc"), F.lit(origin).alias("origin"), "pos")


def first_per(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The row of the least pos of each key, by a combining aggregate."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), pos).alias("r")).select("r.*")


def last_per(df: DataFrame, key: str, *pos: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*pos)).alias("r")).select("r.*")


def explicit_owners(spark: SparkSession, settings: Settings) -> DataFrame:
    """The owners of the settings; names of digits alone come first, by number, as in an object of the web."""
    names = sorted(settings.ownership, key=lambda n: (0, int(n)) if n.isdigit() and str(int(n)) == n else (1, 0))
    rows = [{"id": n, "pos": k} | settings.ownership[n] for k, n in enumerate(names)]
    fields = spark.createDataFrame([], tables.OWNERSHIP).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields.fields) for r in rows], fields)


def merge_packages(explicit: DataFrame, discovered: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, path, name, checks): explicit owners, then what was discovered, then seeds.

    An explicit path stays unless empty; name and checks come from the discovery, the last of an id. Seeds give
    unknown ids and fill empty paths, the first of an id. An explicit path that is empty and that nothing fills is no path: null.
    """
    e = explicit.select("id", F.col("path").alias("e_path"))
    d = discovered.groupBy("id").agg(F.min_by("path", F.struct("pos")).alias("d_first"), F.max_by("name", F.when(F.col("name") != "", F.col("pos"))).alias("name"), F.max_by("checks", F.when(F.col("checks").isNotNull(), F.col("pos"))).alias("checks"), F.min_by(F.when(F.col("path") != "", F.col("path")), F.when(F.col("path") != "", F.col("pos"))).alias("d_path"))
    # in the order of the two kinds of seeds; an empty path never stands where a later seed has one
    s = seeds.withColumn("at", F.struct((F.col("origin") == "path").alias("late"), "pos")).groupBy("id").agg(F.min_by("path", F.when(F.col("path") != "", F.col("at"))).alias("s_path"))
    all_ids = e.join(d, "id", "full_outer").join(s, "id", "full_outer")
    return all_ids.select("id", F.coalesce(non_empty(F.col("e_path")), "d_path", "s_path", "d_first").alias("path"), "name", "checks")


def agent_doc_guess(packages: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(id, guess): the best document of each package by nine rules, the first of equal rank.

    Each rule is an equality between the package's id and something a document offers, so one hash join serves all.
    """
    path, stem = F.col("path"), markdown.slug_from_path(F.col("path"))
    offer = lambda rule, key, when=None: F.struct(F.lit(rule).alias("rule"), (F.when(when, key) if when is not None else key).alias("id"))
    ends = lambda ext: path.endswith(ext)
    folder = F.element_at(F.split(path, "/"), -2)
    in_packages = F.regexp_extract_all(path, F.lit(r"/packages/(?=([^/]+)/)"), F.lit(1))
    package = fm_string(F.col("frontmatter"), "package")
    tail = lambda ext: path.rlike(rf"/packages/[^/]+\.{ext}\z")
    offers = F.array(
        offer(1, package), offer(2, F.col("id")), offer(3, stem, tail("md")), offer(4, stem, tail("mdx")), offer(5, folder, path.rlike(r"/packages/[^/]+/index\.md\z")), offer(6, folder, path.rlike(r"/packages/[^/]+/index\.mdx\z")),
        offer(7, stem, path.contains("/") & ends(".md")), offer(8, stem, path.contains("/") & ends(".mdx")),
    )
    rows = knowledge.select("path", "pos", F.explode(F.concat(offers, F.transform(in_packages, lambda x: F.struct(F.lit(9).alias("rule"), x.alias("id"))))).alias("o")).where("o.id is not null")
    best = rows.groupBy(F.col("o.id").alias("id")).agg(F.min_by("path", F.struct("o.rule", "pos")).alias("guess"))
    return packages.select("id").join(best, "id")


def human_doc_match(packages: DataFrame, human: DataFrame) -> DataFrame:
    """(id, url): the human document of a package by its id, its aliases in order, then the first whose id ends with it.

    Suffixes are met by equality: each document offers its id and all that follows a slash or a hyphen in it. Both sides are
    dealt out by their keys: a plan takes exploded rows for far fewer than they are, and would gather them on the driver to broadcast them.
    """
    ident = F.col("id")
    aliases = F.array(
        ident, F.regexp_replace(ident, r"\A@[^/]+/", ""), F.regexp_replace(ident, r"\Aos-", ""), F.regexp_replace(ident, r"-pattern\z", ""),
        *[F.concat(F.lit(head), ident, F.lit(tail)) for head, tail in (("packages/", ""), ("reference/packages/", ""), ("packages/", "/index"))],
    )
    named = packages.select("id", F.posexplode(aliases).alias("way", "key"))
    by_alias = named.hint("merge").join(human.select(F.col("id").alias("key"), "url").where("url <> ''"), "key").groupBy("id").agg(F.min_by("url", "way").alias("alias_url"))
    key = F.col("id")
    tails = lambda c: F.regexp_extract_all(c, F.lit(r"(?<=[/-])(?=(.+)\z)"), F.lit(1))
    after_slash = lambda c: F.regexp_extract_all(c, F.lit(r"(?<=/)(?=(.+)\z)"), F.lit(1))
    offered = F.array_distinct(F.concat(F.array(key), tails(key), F.transform(F.filter(after_slash(key), lambda x: x.endswith("/index")), lambda x: F.regexp_replace(x, r"/index\z", ""))))
    by_tail = human.select("url", "pos", F.explode(offered).alias("id")).groupBy("id").agg(F.min_by("url", "pos").alias("tail_url"))
    out = packages.select("id").join(by_alias.hint("merge"), "id", "left").join(by_tail.hint("merge"), "id", "left")
    return out.select("id", F.coalesce("alias_url", "tail_url").alias("url")).where("url is not null")


def default_checks(ident: Column, path: Column, name: Column, manager: str = "npm", workspace: bool = False, strict: bool = False, scripts: frozenset[str] | set[str] = frozenset()) -> Column:
    """Test (and lint) commands for a package, by package manager; Markdown targets take a project script first."""
    target = F.coalesce(name, F.when(path.startswith("packages/") | path.startswith("apps/"), ident))
    fill = lambda *parts: F.array(*[F.format_string(p, target) if "%s" in p else F.lit(p) for p in parts[: 2 if strict else 1]])
    plain = {"pnpm": ("pnpm test", "pnpm run lint"), "yarn": ("yarn test", "yarn lint"), "bun": ("bun test", "bun run lint"), "npm": ("npm test", "npm run lint")}[manager]
    scoped = {"pnpm": ("pnpm --filter %s test", "pnpm --filter %s lint"), "yarn": ("yarn workspace %s test", "yarn workspace %s lint"), "npm": ("npm test -w %s", "npm run lint -w %s")}.get(manager)
    out = F.when(target.isNotNull(), fill(*scoped)).otherwise(fill(*plain)) if workspace and scoped else fill(*plain)
    own = next((c for s, c in (("check:okf-type", "pnpm run check:okf-type"), ("docs:bridge:gate", "pnpm run docs:bridge:gate"), ("test", "pnpm test" if manager == "pnpm" else "npm test")) if s in scripts), None)
    return F.when(path.rlike(r"\.mdx?\z") | path.contains("/pillars/"), F.array(F.lit(own))).otherwise(out) if own else out


def bridge(ident: Column, human_doc: Column, has_human: bool, tool: str = "waymark") -> Column:
    """Link state: external, linked, or missing with what to do; null if no human documents are configured."""
    state = lambda kind, action=None, bootstrap=None: F.struct(F.lit(kind).alias("humanDoc"), F.lit(action).cast("string").alias("action"), (bootstrap if bootstrap is not None else F.lit(None).cast("string")).alias("bootstrap"))
    missing = state("missing", f"{tool} bootstrap agent-docs", F.concat(F.lit("docs/for-agents/human/"), ident, F.lit(".md")))
    out = F.when(human_doc.rlike(r"\Ahttps?://"), state("external")).when(human_doc.isNotNull(), state("linked"))
    return out.otherwise(missing) if has_human else out


def build_ownership(packages: DataFrame, explicit: DataFrame, seeds: DataFrame, knowledge: DataFrame, human: DataFrame, settings: Settings, checks: dict | None = None) -> DataFrame:
    """Ownership rows. Here, unlike in the merge of packages, the last seed of an id counts, and path seeds follow those of frontmatter.

    Values are taken from the explicit owner, the seed, then what was found, an empty text being a value except for
    links.
    """
    e = explicit.select("id", *[F.col(c).alias(f"e_{c}") for c in ("path", "group", "layer", "purpose", "checks", "agentDoc", "humanDoc")])
    s = last_per(seeds.withColumn("late", F.col("origin") == "path"), "id", "late", "pos").select("id", *[F.col(c).alias(f"s_{c}") for c in ("path", "purpose", "checks", "agentDoc", "humanDoc")])
    joined = packages.join(e, "id", "left").join(s, "id", "left").join(agent_doc_guess(packages, knowledge), "id", "left").join(human_doc_match(packages, human), "id", "left")
    path = F.coalesce("e_path", "s_path", "path")
    rows = joined.withColumn("own_path", path)
    commands = F.coalesce("e_checks", "s_checks", "checks", default_checks(F.col("id"), F.col("own_path"), F.col("name"), strict=settings.strict, **(checks or {})))
    out = rows.select(
        "id", F.col("own_path").alias("path"), non_empty(F.col("e_group")).alias("group"), non_empty(F.col("e_layer")).alias("layer"), non_empty(F.coalesce("e_purpose", "s_purpose")).alias("purpose"), commands.alias("checks"),
        F.coalesce("e_agentDoc", "s_agentDoc", "guess", F.lit(settings.index_doc)).alias("agentDoc"), F.coalesce(non_empty(F.col("e_humanDoc")), non_empty(F.col("s_humanDoc")), "url").alias("humanDoc"), F.lit(None).cast("string").alias("readme"),
    )
    return with_position(out, collated())


def handoffs(ownership: DataFrame, settings: Settings) -> DataFrame:
    """The routing answer of each owner."""
    has_human = bool(settings.human)
    missing = F.format_string(f"Human guide missing for %s. Run: {settings.tool} bootstrap agent-docs", F.col("id"))
    notes = F.array_compact(F.array("purpose", F.when(F.col("humanDoc").isNull() & F.lit(has_human), missing)))
    return ownership.select(
        F.lit("agent-handoff").alias("type"), F.lit(1).alias("schemaVersion"), F.lit(settings.out_file).alias("source"), F.struct(F.lit("package").alias("type"), "id", "path", "group", "layer").alias("target"),
        F.coalesce("agentDoc", F.lit("")).alias("startHere"), F.array_distinct(F.array_compact(F.array(non_empty(F.col("agentDoc")), F.lit("AGENTS.md")))).alias("readBeforeEditing"), F.array("path").alias("editRoots"), "checks", "humanDoc",
        bridge(F.col("id"), F.col("humanDoc"), has_human, settings.tool).alias("bridge"), notes.alias("notes"),
    )


def resolve(ids: DataFrame, handoff: DataFrame, ownership: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """(id) -> handoff rows; an id without one gives a row of nulls with found false.

    With ownership, an owner whose handoff isn't stored gets it made anew; there the documents to read may repeat.
    """
    rows = ids.select("id").join(handoff.withColumn("id", F.col("target.id")), "id", "left")
    if ownership is not None:
        s = settings or Settings()
        made = handoffs(ownership.withColumn("agentDoc", F.coalesce("agentDoc", F.lit(s.agent_index))), s)
        read = F.array_compact(F.array(non_empty(F.col("o.agentDoc")), F.lit("AGENTS.md")))
        made = made.alias("h").join(ownership.alias("o"), F.col("h.target.id") == F.col("o.id")).select(*[(read if c == "readBeforeEditing" else F.col(f"h.{c}")).alias(c) for c in made.columns])
        names = [c for c in made.columns if c in handoff.columns]
        spare = made.select(F.col("target.id").alias("id"), F.struct(*names).alias("spare"))
        rows = rows.join(spare, "id", "left").select("id", *[(F.when(F.col("target").isNotNull(), F.col(c)).otherwise(F.col(f"spare.{c}")) if c in names else F.col(c)).alias(c) for c in handoff.columns])
    return rows.withColumn("found", F.col("target").isNotNull())


def resolve_intent(ids: DataFrame, intents: DataFrame, source: str = "index.json") -> DataFrame:
    """Handoffs of intents: the first path is the start; nothing to edit or to check. The last intent of an id counts."""
    i = last_per(intents, "id", "pos")
    return ids.select("id").join(i, "id").select(F.lit("agent-handoff").alias("type"), F.lit(1).alias("schemaVersion"), F.lit(source).alias("source"), F.struct(F.lit("intent").alias("type"), "id").alias("target"), F.coalesce(F.get("paths", F.lit(0)), F.lit("")).alias("startHere"), F.col("paths").alias("readBeforeEditing"), F.array().cast("array<string>").alias("editRoots"), F.array().cast("array<string>").alias("checks"), F.array("title").alias("notes"))


def resolve_change(ids: DataFrame, changes: DataFrame, settings: Settings) -> DataFrame:
    """Handoffs of changes: start and edit root are the change's; the agents' guide and the corpus index are read first."""
    c = last_per(changes, "id", "pos")
    return ids.select("id").join(c, "id").select(F.lit("agent-handoff").alias("type"), F.lit(1).alias("schemaVersion"), F.lit(settings.out_file).alias("source"), F.struct(F.lit("change").alias("type"), "id").alias("target"), "startHere", F.array(F.lit("AGENTS.md"), F.lit(settings.index_doc)).alias("readBeforeEditing"), F.array("startHere").alias("editRoots"), F.array().cast("array<string>").alias("checks"), F.array("title").alias("notes"))


def listing(df: DataFrame, *columns: str) -> DataFrame:
    """Keys, or keys with some columns, of a lookup table."""
    return df.select("id", *columns)


def fetch_document(knowledge: DataFrame, ref: str) -> DataFrame:
    """The document of a path, else the first of an id; at most one row."""
    hit = knowledge.where((F.col("path") == ref) | (F.col("id") == ref))
    return hit.orderBy(F.desc(F.col("path") == ref), "pos").limit(1)


def normalized_handoff(df: DataFrame) -> DataFrame:
    """Handoffs of an older form lack the version; it is 1."""
    return df.withColumn("schemaVersion", F.coalesce("schemaVersion", F.lit(1)) if "schemaVersion" in df.columns else F.lit(1))


def ranked_projects(manifests: DataFrame, prefix: str = "npx nx run", strict: bool = False) -> DataFrame:
    """(manifest, project_json boolean, path, name, targets array<string>, pos) -> discovered packages.

    A project file outranks a package file of the same id; targets are united; the checks are the test target
    and, if strict, the lint target. Names that are no package names are left out.
    """
    valid = manifests.where(F.col("name").rlike(r"\A(?:@[A-Za-z0-9._-]+/)?[A-Za-z0-9][A-Za-z0-9._-]*\z")).withColumn("id", paths.package_id(F.col("name")))
    got = valid.groupBy("id").agg(F.max_by("name", F.struct(F.col("project_json"), "pos")).alias("name"), F.min_by("path", "pos").alias("path"), F.count_distinct("path").alias("n_paths"), F.array_distinct(F.flatten(F.collect_list("targets"))).alias("targets"), F.min("pos").alias("pos"))
    run = lambda target, also=True: F.when(F.array_contains("targets", target) & F.lit(also), F.concat(F.lit(f"{prefix} "), F.col("name"), F.lit(f":{target}")))
    checks = F.array_compact(F.array(run("test"), run("lint", strict)))
    return got.select("id", "path", "name", F.when(F.size(checks) > 0, checks).alias("checks"), "pos", (F.col("n_paths") > 1).alias("collides"))


def checked_projects(projects: DataFrame) -> DataFrame:
    """Ranked projects by the collation of their ids; an id that stands for several paths is an error that names it."""
    bad = projects.where("collides").select("id").orderBy("id").limit(5).collect()
    if bad:
        raise ValueError(f"one id for several projects: {', '.join(r['id'] for r in bad)}")
    return with_position(projects.drop("pos", "collides"), collated())
