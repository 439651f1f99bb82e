"""Constraint checks: each row with the list of what is wrong with it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.digests import Sha256
from waymark.tables import drop_at, written


# Limits of the published schemas. A field is (kind, least, most, required); of lists the limits are the items', behind them the list's own.
SCHEMAS: dict[str, dict[str, tuple]] = {
    "knowledge": {"id": ("text", 1, 256, True), "type": ("text", 1, 128, True), "title": ("text", 1, 256, True), "path": ("text", 1, 512, True), "description": ("text", 0, 2048, False), "body": ("text", 0, 8000, False)},
    "ownership": {
        "id": ("text", 1, 256, True), "path": ("text", 1, 512, True), "group": ("text", 1, 128, False), "layer": ("text", 1, 32, False), "purpose": ("text", 0, 1024, False), "checks": ("list", 1, 256, True, 32),
        "agentDoc": ("text", 1, 512, False), "humanDoc": ("text", 1, 512, False), "readme": ("text", 1, 512, False),
    },
    "handoff": {
        "type": ("one of", ("agent-handoff",), None, True), "schemaVersion": ("one of", (1,), None, False), "source": ("text", 1, 512, True),
        "target.type": ("one of", ("package", "module", "app", "screen", "flow", "component", "intent", "change", "search"), None, True), "target.id": ("text", 1, 256, True), "target.path": ("text", 1, 512, False), "target.group": ("text", 1, 128, False), "target.layer": ("text", 1, 32, False),
        "startHere": ("text", 1, 512, True), "readBeforeEditing": ("list", 1, 512, True, 64), "editRoots": ("list", 1, 512, True, 32), "checks": ("list", 1, 256, True, 32), "humanDoc": ("text", 1, 512, False),
        "bridge.humanDoc": ("one of", ("linked", "missing", "external"), None, False), "bridge.action": ("text", 1, 256, False), "bridge.bootstrap": ("text", 1, 256, False), "notes": ("list", 1, 1024, True, 16),
    },
    "search": {"type": ("text", 1, 64, True), "id": ("text", 1, 256, True), "path": ("text", 1, 512, True), "summary": ("text", 0, 2048, False), "score": ("number", None, None, False)},
    "candidate": {
        "schemaVersion": ("one of", (1,), None, True), "id": ("text", 1, 1 << 30, True), "source": ("text", 1, 1 << 30, True), "rawPath": ("text", 1, 1 << 30, False), "fact": ("text", 1, 1 << 30, True), "suggestedType": ("text", 1, 1 << 30, True),
        "confidence": ("number", 0, 1, True), "references": ("list", 1, 1 << 30, True, 1 << 30),
    },
    "intent": {"id": ("text", 1, 128, True), "title": ("text", 1, 256, True), "paths": ("list", 1, 512, True, 32)},
    "change": {"id": ("text", 1, 128, True), "title": ("text", 1, 256, True), "startHere": ("text", 1, 512, True), "relatedPackages": ("list", 1, 256, False, 32)},
}


def _issue(path: str, ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))


def _issues(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def _field(name: str, rule: tuple) -> Column:
    kind, least, most, required, *size = rule
    c = F.col(".".join(f"`{p}`" for p in name.split(".")))
    if kind == "one of":
        ok, message = c.isin(*least), f"must be one of {', '.join(map(str, least))}"
    elif kind == "number":
        ok, message = (c.isNotNull(), "must be a number") if least is None else (c.between(least, most), f"must be from {least} to {most}")
    elif kind == "list":
        ok, message = (F.size(c) <= size[0]) & F.forall(c, lambda x: F.length(x).between(least, most)), f"must hold at most {size[0]} texts of {least} to {most} characters"
    else:
        ok, message = F.length(c).between(least, most), f"must have {least} to {most} characters"
    return _issue(name, ok if required else c.isNull() | ok, message)


def checked(df: DataFrame, schema: str) -> DataFrame:
    """df with issues array<struct<path, message>>: what breaks the named schema, in the order of its fields. Optional fields may be null; those that df lacks are not looked at."""
    held = set(df.columns)
    return df.withColumn("issues", _issues(*[_field(n, rule) for n, rule in SCHEMAS[schema].items() if n.split(".")[0] in held or rule[3]]))


def handoffs(df: DataFrame) -> DataFrame:
    """issues of handoff rows."""
    return checked(df, "handoff")


def json_schema(schema: str) -> dict:
    """The named schema as a JSON Schema document."""
    out: dict = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": schema, "type": "object", "additionalProperties": False, "properties": {}, "required": []}
    for name, (kind, least, most, required, *size) in SCHEMAS[schema].items():
        at, *inner = name.split(".")
        here = out
        if inner:
            here = out["properties"].setdefault(at, {"type": "object", "additionalProperties": False, "properties": {}, "required": []})
            at = inner[0]
        text = {"type": "string"} | ({"minLength": least} if kind in ("text", "list") and least else {}) | ({"maxLength": most} if kind in ("text", "list") and most < 1 << 30 else {})
        here["properties"][at] = {"enum": list(least)} if kind == "one of" else {"type": "number"} | ({"minimum": least, "maximum": most} if least is not None else {}) if kind == "number" else {"type": "array", "items": text} | ({"maxItems": size[0]} if size[0] < 1 << 30 else {}) if kind == "list" else text
        if required:
            here["required"].append(at)
            if inner and (outer := name.split(".")[0]) not in out["required"]:
                out["required"].append(outer)
    return out


def index_limits(knowledge_rows: DataFrame, packages: DataFrame, most_knowledge: int = 10_000, most_packages: int = 2_000) -> DataFrame:
    """(table, n, most, ok): sizes against optional limits of a published index; the engine itself has none."""
    k = knowledge_rows.agg(F.lit("knowledge").alias("table"), F.count("*").alias("n"), F.lit(most_knowledge).cast("long").alias("most"))
    p = packages.agg(F.lit("packages").alias("table"), F.count("*").alias("n"), F.lit(most_packages).cast("long").alias("most"))
    return k.unionByName(p).withColumn("ok", F.col("n") <= F.col("most"))


def resolver_post_conditions(df: DataFrame, asked: str | None = None) -> DataFrame:
    """df (handoffs, and the id that was asked for) with issues: another target, a start that is missing or unsafe, lists that are empty, hold blanks or unsafe paths, or lack the start.

    A safe path is relative, names no drive and has no .. part. asked is the column of the id, null for none.
    """
    safe = lambda c: (F.trim(c) != "") & ~c.rlike(r"\A(?:/|\\\\|[A-Za-z]:[\\/])") & ~F.array_contains(F.split(c, r"[\\/]+"), "..")
    full = lambda name: (F.size(name) > 0) & F.forall(name, lambda x: F.trim(x) != "")
    return df.withColumn("issues", _issues(
        _issue("target.id", F.col("target.id") == F.col(asked) if asked else F.lit(True), "is another target"), _issue("startHere", safe(F.col("startHere")), "is missing or unsafe"),
        _issue("readBeforeEditing", full("readBeforeEditing") & F.forall("readBeforeEditing", safe), "is missing or unsafe"), _issue("readBeforeEditing", F.array_contains("readBeforeEditing", F.col("startHere")), "lacks the start"),
        _issue("editRoots", full("editRoots") & F.forall("editRoots", safe), "is missing or unsafe"), _issue("checks", full("checks"), "is missing"),
    ))


def forbidden_lines(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line, column, text): lines of files that match, with 1-based places."""
    rows = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("k", "text")).where(F.col("text").rlike(pattern))
    return rows.select("path", (F.col("k") + 1).alias("line"), F.regexp_instr("text", F.lit(pattern)).alias("column"), "text")


def usage_pattern(package: str) -> str:
    """A line that uses a package of code: an import, a require, a dependency's key, or its name as a word of its own."""
    own = re.escape(package)
    ways = (rf"from\s+['\"]{own}['\"]", rf"(?:import|require)\s*\(\s*['\"]{own}['\"]\s*\)", rf"['\"]{own}['\"]\s*:", rf"(?:^|[\s\"']){own}(?:@|/|\"|'|\s|$)")
    return "|".join(f"(?:{w})" for w in ways)


# Files that hold code or declare packages, folders that are left out, the lockfile, and the form of an exact version.
CODE_FILE = r"\.(?:ts|tsx|js|jsx|mjs|cjs|json)\z"
LOCKFILE = "pnpm-lock.yaml"
LEFT_OUT = r"(?:\A|/)(?:\.git|\.next|node_modules|coverage|dist|out|playwright-report|test-results|\.lighthouseci|\.(?!github/)[^/]*)/"
EXACT_VERSION = r"^[0-9]+\.[0-9]+\.[0-9]+"


def package_usages(files: DataFrame, names: DataFrame, left_out: str = LEFT_OUT) -> DataFrame:
    """(path, line, name, text): lines of code that use one of names (name), for any number of names in one pass. files (path, content).

    A use is a word, between quotes and white space, that is the name or goes on with @ or / behind it: so each word offers itself and what stands before its signs,
    and these meet the names by equality. In the lockfile a name counts anywhere: there each run of signs that names are made of offers its parts of the names' lengths. A line
    counts once a name. Other files, and those in left-out or hidden folders, aren't looked at. text is trimmed, 200 characters at most. Null paths and contents are left out.
    """
    path = F.col("path")
    kept = files.where((path.rlike(CODE_FILE) | (path == LOCKFILE)) & ~path.rlike(left_out) & F.col("content").isNotNull())
    lines = kept.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("k", "text"))
    sizes = [r[0] for r in names.where(F.length("name") > 0).select(F.length("name").alias("n")).distinct().orderBy("n").limit(MOST_SIZES + 1).collect()]
    if len(sizes) > MOST_SIZES:
        raise ValueError(f"names of more than {MOST_SIZES} lengths")
    sign = lambda w, p: F.substring(w, p, F.lit(1))
    heads = lambda w: F.transform(F.filter(F.sequence(F.lit(2), F.length(w) + 1), lambda p: (p > F.length(w)) | sign(w, p).isin("@", "/")), lambda p: F.substring(w, F.lit(1), p - 1))
    none = F.array().cast("array<string>")
    at_size = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda p: F.substring(w, p, n))).otherwise(none)
    parts = lambda w: F.flatten(F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: at_size(w, n)))
    full = lambda pattern: F.filter(F.split("text", pattern), lambda w: w != "")
    offered = F.when(path == LOCKFILE, F.flatten(F.transform(full(r"[\s\"':,{}()\[\]]+"), parts))).otherwise(F.flatten(F.transform(full(r"[\s\"']+"), heads)))
    met = lines.select("path", "k", "text", F.explode(F.array_distinct(offered)).alias("name")).join(names.select("name").distinct(), "name")
    return met.select("path", (F.col("k") + 1).alias("line"), "name", F.substring(F.trim("text"), 1, 200).alias("text"))


#: Different lengths of names that are looked for in lockfiles; package names have 214 characters at most.
MOST_SIZES = 1024


def action_contract(files: DataFrame, action: str | Column, version: str, gate: str | None = None, rebuild: str | None = None, exact: str | None = None) -> DataFrame:
    """(path, problem): what breaks the rules of a published action. files (path, content): the action's own and the workflows'.

    Where given: gate is the command that the action must run, rebuild one that it must not, exact the pattern to which it must hold its version (EXACT_VERSION).
    """
    c = F.col("content")
    own, flow = F.col("path") == action, F.col("path").rlike(r"(?:\A|/)\.github/workflows/[^/]+\.ya?ml\z")
    steps = F.transform(F.regexp_extract_all(c, F.lit(r"run:\s*\|([\s\S]*?)(?=\n\s+- name:|\z)"), F.lit(1)), lambda x: x.rlike(r"\$\{\{\s*inputs\."))
    rules = [(own & ~c.contains(field), f"{field} is missing") for field in ("name:", "description:", "branding:", "runs:", "using: composite")] + [
        (own & ~c.contains(f"default: '{version}'"), "the default version differs"), (own & c.rlike(r"(?m)uses:\s+[^\n]+@(?:v|main|master)(?:\d+)?\s*$"), "a reference is mutable"), (own & F.exists(steps, lambda x: x), "an input enters a shell step directly"),
        (flow & c.rlike(r"(?m)uses:\s+(?!\./)[^\s]+@(?![0-9a-f]{40}(?:\s|$))[^\s#]+"), "a reference is mutable"),
    ]
    if gate or rebuild:
        stale = ~c.contains(gate or "")
        rules.append((own & (stale | c.contains(rebuild) if rebuild else stale), "the committed index isn't gated as it is"))
    if exact:
        rules.append((own & ~c.contains(exact), "the version isn't held to an exact one"))
    return files.select("path", F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(said)) for broken, said in rules]))).alias("problem"))


#: Bytes that one step of the chain over files reads, about.
STEP_BYTES = 128 << 20


def _chained(state: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files (path, content) in order -> the chain's state behind them, from the state before them."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Sha256(state)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for part in (path, content):
                    chain.update(part.as_buffer())
                    chain.update(b"\0")
        yield pa.RecordBatch.from_arrays([pa.array([chain.state()], pa.binary())], names=["state"])

    return fold


def sources_hash(files: DataFrame, step_bytes: int = STEP_BYTES) -> DataFrame:
    """One row (sourceHash) of a listed set of files (path, content binary): SHA-256 over their paths and bytes, each followed by a zero byte, in the order of the paths.

    Files with a null path or content don't count. The digest is one chain over all bytes, so its steps follow one another, but no task reads all: files are dealt out by ranges of about step_bytes,
    and a step takes up the chain's state behind the range before. Files of the same path and the same first characters, so many that they are more than a range, are one step.
    """
    spark, state = files.sparkSession, Sha256().state()
    rows = files.select(F.col("path").cast("binary").alias("path"), F.col("content").cast("binary").alias("content")).where("path is not null and content is not null")
    total = rows.agg(F.sum(F.octet_length("path").cast("long") + F.octet_length("content") + 2)).first()[0] or 0
    steps = -(-total // step_bytes)
    if steps > 1:
        dealt = rows.repartitionByRange(steps, "path", F.substring("content", 1, 64)).withColumn("step", F.spark_partition_id())
        at = written(dealt, "step").written_at
        parts = [spark.read.schema(rows.schema).parquet(f"{at}/step={k}") for k in sorted(r[0] for r in spark.read.parquet(at).select("step").distinct().collect())]
    else:
        at, parts = None, [rows] if steps else []
    for part in parts:
        one = part.coalesce(1) if at else part.repartition(1)
        (state,) = one.sortWithinPartitions("path", "content").mapInArrow(_chained(state), "state binary").first()
        state = bytes(state)
    if at:
        drop_at(spark, at)
    return spark.range(1).select(F.lit(f"sha256:{Sha256(state).hexdigest()}").alias("sourceHash"))


def unsynced_examples(readmes: DataFrame, examples: DataFrame, files: DataFrame) -> DataFrame:
    """(path, id) of examples (path, id, fixture) whose fenced text behind their mark in the README isn't the fixture's (path, content)."""
    mark = F.concat(F.lit("<!-- readme-example:"), "id", F.lit(" -->"))
    rows = examples.join(readmes.select("path", F.col("content").alias("readme")), "path", "left").join(files.select(F.col("path").alias("fixture"), F.col("content").alias("wanted")), "fixture", "left")
    start = F.instr("readme", mark)
    behind = F.when(start > 0, F.substring(F.col("readme"), start, F.lit(1 << 30)))
    fenced = F.regexp_extract(behind, r"\n```[^\n]*\n((?:(?!\n```)[\s\S])*)\n```", 1)
    good = (fenced != "") & (F.concat(fenced, F.lit("\n")) == F.col("wanted"))
    return rows.where(~F.coalesce(good, F.lit(False))).select("path", "id")


def digest_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, expected, actual) of files whose SHA-256 is not the expected one."""
    rows = expected.join(files.select("path", F.sha2("content", 256).alias("actual")), "path", "left")
    return rows.where(~F.col("sha256").eqNullSafe(F.col("actual"))).select("path", F.col("sha256").alias("expected"), "actual")


# How images and badges stand in Markdown.
IMAGES = ((r"!\[([^\]]*)\]\(([^)]+)\)", 1, 2), (r"""<img\s+[^>]*alt=["']([^"']*)["'][^>]*src=["']([^"']+)["'][^>]*>""", 1, 2))
BADGES = "https://img.shields.io/"


def images_of(c: Column) -> tuple[Column, Column, Column]:
    """Of a Markdown text the number of images that are no badges, the number of badge addresses, and whether an image has no alternative text."""
    of = lambda pattern, alt, src: F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(alt)).alias("alt"), F.regexp_extract_all(c, F.lit(pattern), F.lit(src)).alias("src"))
    images = F.concat(*[of(*x) for x in IMAGES])
    return F.size(F.filter(images, lambda x: ~x["src"].startswith(BADGES))), F.size(F.regexp_extract_all(c, F.lit(re.escape(BADGES)), F.lit(0))), F.exists(images, lambda x: F.trim(x["alt"]) == "")


def readme_audit(files: DataFrame, markers: list[str], max_images: int, max_badges: int, min_images: int = 0) -> DataFrame:
    """(path, rule, ok) for each README: required markers, budgets of content images and of badges, alternative texts."""
    c = F.col("content")
    content, badges, unnamed = images_of(c)
    rules = [(f"marker:{m}", c.contains(m)) for m in markers] + [("image-budget", content.between(min_images, max_images)), ("badge-budget", badges <= max_badges), ("alt-text", ~unnamed)]
    return files.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules])).alias("r")).select("path", "r.*")


SURFACE = """id string, path string, profileId string, dimensions array<struct<dimension: string, marker: string>>, visuals array<struct<src: string, darkMode: string>>,
commands array<struct<id: string, command: string, test: string, testCommand: string>>, reviewedOn string, reviewDueOn string"""


def surface_problems(surfaces: DataFrame, profiles: DataFrame, files: DataFrame, today: str | Column) -> DataFrame:
    """(id, rule, detail): what READMEs break of what is declared for them. surfaces as SURFACE, profiles (profileId, min_images, max_images, max_badges), files (path, content).

    A README that is away, or a profile that isn't known, ends a surface's checks. Files that are named (visuals, tests of commands) meet the files by equality. A review is due by the
    end of its day; one without a date of review counts as expired, one without a due date doesn't.
    """
    rows = surfaces.join(files.select("path", F.col("content").alias("readme")), "path", "left").join(profiles.withColumn("known", F.lit(True)), "profileId", "left")
    readme = F.col("readme")
    content, badges, unnamed = images_of(readme)
    lacks = lambda text: ~readme.contains(text)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    problem = lambda rule, detail=None: F.struct(F.lit(rule).alias("rule"), F.coalesce(detail, F.lit("")).alias("detail") if detail is not None else F.lit("").alias("detail"))
    if_ = lambda broken, *said: F.when(F.coalesce(broken, F.lit(False)), F.array(problem(*said))).otherwise(F.array().cast("array<struct<rule: string, detail: string>>"))
    each = lambda items, broken, rule, detail: F.coalesce(F.transform(F.filter(items, broken), lambda x: problem(rule, x[detail])), F.array().cast("array<struct<rule: string, detail: string>>"))
    markers = each("dimensions", lambda x: lacks(x["marker"]), "marker", "marker")
    rest = F.concat(
        if_(unnamed, "alt-text"), if_(~content.between(F.col("min_images"), F.col("max_images")), "image-budget", content.cast("string")), if_(badges > F.col("max_badges"), "badge-budget", badges.cast("string")),
        each("visuals", lambda x: ~F.coalesce(x["darkMode"], F.lit("")).isin("neutral", "paired"), "dark-mode", "src"), each("commands", lambda x: lacks(x["command"]), "command", "command"),
        each("commands", lambda x: empty(x["id"]) | empty(x["testCommand"]), "command-metadata", "command"),
        if_(F.try_to_timestamp("reviewedOn", F.lit("yyyy-MM-dd")).isNull() | (F.try_to_timestamp("reviewDueOn", F.lit("yyyy-MM-dd")).cast("date") < F.to_date(today if isinstance(today, Column) else F.lit(today))), "review-expired", F.col("reviewDueOn")),
    )
    found = F.when(readme.isNull(), if_(F.lit(True), "readme-missing", F.col("path"))).when(F.col("known").isNull(), F.concat(markers, if_(F.lit(True), "profile", F.col("profileId")))).otherwise(F.concat(markers, rest))
    own = rows.select("id", F.inline(found))
    named = F.concat(F.coalesce(F.transform("visuals", lambda x: problem("visual-file", x["src"])), F.array().cast("array<struct<rule: string, detail: string>>")), F.coalesce(F.transform("commands", lambda x: problem("command-test", x["test"])), F.array().cast("array<struct<rule: string, detail: string>>")))
    refs = rows.where(readme.isNotNull() & F.col("known").isNotNull()).select("id", F.inline(named))
    return own.unionByName(refs.join(files.select(F.col("path").alias("detail")), "detail", "left_anti").select("id", "rule", "detail"))


def expired(df: DataFrame, due: str = "reviewBy", today: Column | None = None) -> DataFrame:
    """Rows whose review date has passed, by today's date if none is given."""
    return df.where(F.to_date(due) < (F.current_date() if today is None else today))
