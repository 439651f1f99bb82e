"""What a built index is written as: tables, a text index, capabilities, and drafts of missing documents."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark import tables
from waymark.config import Settings
from waymark.functions import paths
from waymark.functions.markdown import first_heading, first_paragraph, non_empty, trimmed
from waymark.functions.text import canonical_json

TEXT_ENTRIES = 500


def index_hash(knowledge: DataFrame, ownership: DataFrame, handoff: DataFrame) -> DataFrame:
    """One row (contentHash): SHA-256 over the digests of all rows' canonical JSON, with the version in front; for indexes of any size.

    Positions, times and the project's name are no content. Rows are digested where they are; digests meet in groups by their first
    hexadecimal digits, six, then three, then none, so a task gathers as many as there are rows to 16 million, or 4096. A published
    index has the hash of its whole canonical text instead; see payload.
    """
    digest = lambda df, kind: df.select(F.sha2(F.concat(F.lit(kind + ":"), canonical_json(F.to_json(F.struct(*[c for c in df.columns if c in KEPT[kind]])))), 256).alias("h"), F.lit("").alias("g"))
    rows = digest(knowledge, "knowledge").unionByName(digest(ownership, "ownership")).unionByName(digest(handoff, "handoff")).withColumn("g", F.substring("h", 1, 6))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "")
    for digits in (6, 3):
        rows = rows.groupBy(F.substring("g", 1, digits).alias("k")).agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("k", "g")
    return rows.agg(F.sha2(F.concat(F.lit("v1:"), F.coalesce(joined, F.lit(""))), 256).alias("contentHash"))


#: Rows of a published index at most; so its text has a bounded size.
MOST_KNOWLEDGE, MOST_PACKAGES = 10_000, 2_000


def payload(knowledge: DataFrame, ownership: DataFrame, handoff: DataFrame, intents: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """One row (json, contentHash): the canonical JSON of a published index and its SHA-256.

    Keys are sorted at every level, nulls left out. knowledge and packages stand in the order of pos, the last of a repeated key counts elsewhere.
    An index over the published limits is an error.
    """
    for df, most in ((knowledge, MOST_KNOWLEDGE), (ownership, MOST_PACKAGES)):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} rows in a published index")
    text = lambda df, kind: F.to_json(F.struct(*[c for c in df.columns if c in KEPT[kind]]))
    listed = lambda df, value: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]), ",").alias("j"))
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)

    def keyed(df: DataFrame | None, key: str, value: Column | None) -> DataFrame:
        spark = knowledge.sparkSession
        if df is None:
            return spark.createDataFrame([("",)], "j string")
        pos = F.col("pos") if "pos" in df.columns else F.lit(0)
        last = df.select(F.col(key).alias("k"), value.alias("v"), pos.alias("p")).groupBy("k").agg(F.max_by("v", "p").alias("v"))
        return last.agg(F.array_join(F.array_sort(F.collect_list(F.concat(quoted(F.col("k")), F.lit(":"), "v"))), ",").alias("j"))

    parts = {
        "knowledge": listed(knowledge, text(knowledge, "knowledge")), "handoffs": keyed(handoff, "target.id", text(handoff, "handoff")), "packages": listed(ownership, quoted(F.col("id"))), "ownership": keyed(ownership, "id", text(ownership, "ownership")),
        "intents": keyed(intents, "id", F.to_json(F.struct("id", "title", "paths")) if intents is not None else None), "changes": keyed(changes, "id", F.to_json(F.struct("id", "title", "startHere", "relatedPackages")) if changes is not None else None),
    }
    one = None
    for name, df in parts.items():
        part = df.select(F.col("j").alias(name))
        one = part if one is None else one.crossJoin(part)  # one row each
    whole = F.concat(F.lit('{"schemaVersion":1,"knowledge":['), "knowledge", F.lit('],"handoffs":{'), "handoffs", F.lit('},"lookup":{"packages":['), "packages", F.lit('],"ownership":{'), "ownership", F.lit('},"intents":{'), "intents", F.lit('},"changes":{'), "changes", F.lit("}}}"))
    return one.select(canonical_json(whole).alias("json")).select("json", F.sha2("json", 256).alias("contentHash"))


def index_json(payload_row: DataFrame, project: str, generated_at: str, previous: str | None = None) -> str:
    """The text of a published index. Where a previous text has the same hash, its time stays, so that the bytes don't change."""
    row = payload_row.first()
    data = json.loads(row["json"])
    if previous:
        try:
            old = json.loads(previous)
            if old.get("contentHash") == row["contentHash"] and isinstance(old.get("generatedAt"), str):
                generated_at = old["generatedAt"]
        except (ValueError, AttributeError):
            pass
    out = {"schemaVersion": 1, "contentHash": row["contentHash"], "contentHashAlgo": "sha256-normalized-v1", "generatedAt": generated_at, "project": {"name": project, "root": "."}}
    return json.dumps(out | {k: data[k] for k in ("knowledge", "handoffs", "lookup")}, indent=2, ensure_ascii=False) + "\n"


KEPT = {
    "knowledge": {"id", "type", "title", "path", "description", "body"},
    "ownership": {"id", "path", "group", "layer", "purpose", "checks", "agentDoc", "humanDoc", "readme"},
    "handoff": {"type", "schemaVersion", "source", "target", "startHere", "readBeforeEditing", "editRoots", "checks", "humanDoc", "bridge", "notes"},
}


def llms_text(knowledge: DataFrame, project: str, preamble: str | None = None, url_prefix: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """One row (content): the preamble and the first 500 documents by position."""
    head = (preamble if preamble is not None else f"# {project}\n\n> Agent-readable documentation index.\n").strip()
    url = paths.knowledge_url(F.col("path"), url_prefix, path_prefix)
    item = F.concat(F.lit("- ["), "title", F.lit("]("), url, F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(""))
    top = knowledge.orderBy("pos").limit(TEXT_ENTRIES).select("pos", item.alias("item"))
    lines = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "\n").alias("lines"))
    return lines.select(F.concat(F.lit(head + "\n\n## Knowledge\n\n"), "lines", F.lit("\n")).alias("content"))


def capabilities(settings: Settings, project: str, content_hash: str, version: str = "1", llms_out: str | None = "llms.txt") -> str:
    """JSON text of what the index offers."""
    names = ["index", "query", "search", "agent-handoff", "gates", "mcp", *(["human-docs"] if settings.human else [])]
    artifacts = {"index": settings.out_file} | ({"llmsTxt": llms_out} if llms_out else {})
    return json.dumps({"schemaVersion": 1, "type": "capabilities", "version": version, "project": {"name": project, "root": "."}, "contentHash": content_hash, "artifacts": artifacts, "capabilities": names}, indent=2) + "\n"


def missing_drafts(human: DataFrame, existing: DataFrame, texts: DataFrame, folder: str = "docs/for-agents/human", tool: str = "waymark") -> DataFrame:
    """(path, content): a draft agent document for each human document that has none. existing (path); texts (path, raw) of the human documents."""
    rows = human.join(texts.select("path", "raw"), "path", "left").withColumn("target", F.concat(F.lit(folder + "/"), "id", F.lit(".md"))).join(existing.select(F.col("path").alias("target")), "target", "left_anti")
    plain = F.regexp_replace(F.coalesce("raw", F.lit("")), r"\A---\n[\s\S]*?\n---\n?", "")
    rows = rows.withColumn("own", plain).withColumns({"title": F.coalesce(first_heading(F.col("own"), F.col("own")), "id"), "said": first_paragraph(F.col("own"), 400, F.col("own"))})
    summary = F.when(F.col("said").isNotNull(), F.concat(F.lit("## Source summary\n\n"), "said", F.lit("\n\n"))).otherwise("")
    # The draft's text is output
    content = F.concat(
        F.lit("---\ntype: knowledge\ndraft: true\nid: "), "id", F.lit("\nhumanDoc: "), "url", F.lit("\n---\n\n# "), "title", F.lit(f"\n\nDraft generated by `{tool} bootstrap agent-docs` from existing human docs.\n\n"), summary,
        F.lit("## Review checklist\n\n- TODO: confirm ownership, edit roots, and checks.\n- TODO: move this draft to the right agent-doc location if needed.\n"),
    )
    return rows.select(F.col("target").alias("path"), content.alias("content"))


def scaffold_drafts(packages: DataFrame, existing: DataFrame, agent_root: str = "docs/for-agents", tool: str = "waymark") -> DataFrame:
    """(path, content, created): the starter document of each discovered package (id, path); created is false where the document (path) is there already."""
    rows = packages.select("id", F.col("path").alias("root"), F.concat(F.lit(f"{agent_root}/packages/"), "id", F.lit(".md")).alias("path")).join(existing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    # The document's text is output
    head = F.concat(F.lit("---\ntype: package\ndraft: true\npackage: "), "id", F.lit("\neditRoot: "), "root", F.lit("\n---\n\n# "), "id")
    content = F.concat(head, F.lit(f"\n\nDraft generated by `{tool} init --scaffold-workspaces`.\n\n## Ownership\n\n- Package: `"), "root", F.lit("`\n\n## Notes\n\n- TODO: describe responsibility, boundaries, and checks.\n"))
    return rows.select("path", content.alias("content"), F.col("there").isNull().alias("created"))


def ecosystem_block(products: DataFrame, heading: str, current: str | None = None, prefer: str = "home") -> DataFrame:
    """(pos, line) of products with an address: link, promise with a full stop, role, maturity and machine index. heading is for the caller to print."""
    home, docs = F.col("surfaces.home"), F.col("surfaces.docs")
    link = F.coalesce(docs, home) if prefer == "docs" else F.coalesce(home, docs)
    promise = F.trim("promise")
    parts = F.concat(
        F.lit("- ["), "name", F.lit("]("), link, F.lit(")"), F.when(F.col("id") == (current or ""), " **(current)**").otherwise(""), F.lit(" — "), F.when(promise.rlike(r"[.!?]\z"), promise).otherwise(F.concat(promise, F.lit("."))),
        F.coalesce(F.concat(F.lit(" Role: `"), "role", F.lit("`.")), F.lit("")), F.coalesce(F.concat(F.lit(" Maturity: "), "maturity", F.lit(".")), F.lit("")), F.coalesce(F.concat(F.lit(" Machine index: "), F.col("surfaces.llms")), F.lit("")),
    )
    return products.where(link.isNotNull()).select("pos", F.lit(heading).alias("heading"), parts.alias("line"))


#: Names of an entry at most.
ALIASES = 16


def entry_id(slug: Column) -> Column:
    """Identifier of a document's entry: all but letters, digits and ._:- as colons."""
    return F.concat(F.lit("doc:"), F.regexp_replace(slug, "[^A-Za-z0-9._:-]+", ":"))


def described(raw: Column) -> Column:
    """A document's declared description without quotes, else its first block that is no heading, fence or quote on one line; 240 characters at most. Null without one."""
    head = F.regexp_extract(raw, r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n", 1)
    declared = F.regexp_replace(trimmed(F.regexp_extract(head, r"(?m)^description:\s*(.+)$", 1)), r"""\A['"]|['"]\z""", "")
    blocks = F.transform(F.split(F.regexp_replace(raw, r"\A---\r?\n[\s\S]*?\r?\n---\r?\n", ""), r"\n\s*\n"), lambda x: trimmed(F.regexp_replace(x, r"(?m)^#+\s+.*$", "")))
    prose = F.get(F.filter(blocks, lambda x: (x != "") & ~x.startswith("```") & ~x.startswith(">")), F.lit(0))
    return F.coalesce(non_empty(F.substring(declared, 1, 240)), F.substring(F.regexp_replace(prose, r"\s+", " "), 1, 240))


def _cited(*each: tuple[Column, Column, Column]) -> Column:
    return F.array(*[F.struct(i.alias("id"), t.alias("title"), h.alias("href")) for i, t, h in each]).alias("citations")


def document_entries(documents: DataFrame, public: DataFrame, origin: str, site: str) -> DataFrame:
    """(id, kind, title, aliases, answer, citations) of the public documents: documents (file, raw), public (file)."""
    rows = documents.join(public.select("file"), "file", "left_semi").withColumn("slug", F.regexp_replace("file", r"\.md\z", ""))
    title = F.coalesce(non_empty(trimmed(F.regexp_extract("raw", r"(?m)^#\s+(.+)$", 1))), "slug")
    rows = rows.withColumns({"title": title, "said": F.coalesce(described(F.col("raw")), F.lit("Canonical documentation."))})
    page = F.when(F.col("slug") == "index", F.lit(f"{origin}/docs/")).otherwise(F.concat(F.lit(f"{origin}/docs/"), "slug", F.lit("/")))
    answer = F.concat(F.lit("## "), "title", F.lit("\n\n"), "said", F.lit("\n\n[Open the canonical guide]("), page, F.lit(f") · [Read raw Markdown]({origin}/raw/"), "file", F.lit(")"))
    names = F.array("slug", "file", "title", F.concat(F.lit(f"{site} "), "title"))
    own = entry_id(F.col("slug"))
    return rows.select(own.alias("id"), F.lit("document").alias("kind"), "title", names.alias("aliases"), answer.alias("answer"), _cited((own, F.col("title"), page)))


def package_entries(handoffs: DataFrame, origin: str) -> DataFrame:
    """Entries of the packages' handoffs: who owns what, where to start, what to edit and to check."""
    ident = F.col("target.id")
    purpose = F.coalesce(F.get("notes", F.lit(0)), F.concat(ident, F.lit(" ownership and checks")))
    place = F.regexp_replace("startHere", r"\Adocs/", "")
    raw = F.concat(F.lit(f"{origin}/raw/"), place)
    guide = F.when(F.col("humanDoc").rlike(r"\Ahttps?://"), F.col("humanDoc")).otherwise(F.concat(F.lit(origin), F.coalesce("humanDoc", F.lit("/docs/getting-started")), F.lit("/")))
    answer = F.concat(F.lit("## "), ident, F.lit(" handoff\n\n"), purpose, F.lit(".\n\nStart at [**"), "startHere", F.lit("**]("), raw, F.lit("). Edit roots: **"), F.array_join("editRoots", ", "), F.lit("**. Checks: **"), F.array_join("checks", "**, **"), F.lit("**.\n\nThis answer was generated from the repository's own index."))
    names = F.array(ident, F.concat(F.lit("who owns "), ident), F.concat(ident, F.lit(" handoff")), purpose)
    cited = _cited((F.concat(F.lit("human:"), ident), F.concat(ident, F.lit(" human guide")), guide), (entry_id(place), F.col("startHere"), raw))
    return handoffs.select(F.concat(F.lit("package:"), ident).alias("id"), F.lit("package").alias("kind"), F.concat(ident, F.lit(" ownership handoff")).alias("title"), names.alias("aliases"), answer.alias("answer"), cited)


def command_entries(commands: DataFrame, origin: str, site: str) -> DataFrame:
    """Entries of commands (id, label, command, description)."""
    ident = F.col("id")
    answer = F.concat(F.lit("## "), "label", F.lit("\n\n```bash\n"), "command", F.lit("\n```\n\n"), "description")
    names = F.array(ident, "command", "label", F.concat(F.lit("how do i "), ident), F.concat(F.lit(f"{site} "), ident))
    return commands.select(F.concat(F.lit("command:"), ident).alias("id"), F.lit("command").alias("kind"), F.col("label").alias("title"), names.alias("aliases"), answer.alias("answer"), _cited((F.lit("doc:spec:cli"), F.lit("CLI reference"), F.lit(f"{origin}/docs/spec/cli/"))))


def ecosystem_entries(products: DataFrame, current: str) -> DataFrame:
    """Entries of the other products (id, name, role, hook, home)."""
    own = F.concat(F.lit("ecosystem:"), "id")
    answer = F.concat(F.lit("## "), "name", F.lit("\n\n"), "hook", F.lit("\n\n[Continue to "), "name", F.lit("]("), "home", F.lit(")"))
    return products.where(F.col("id") != current).select(own.alias("id"), F.lit("document").alias("kind"), F.col("name").alias("title"), F.array("id", "name", "role", "hook").alias("aliases"), answer.alias("answer"), _cited((own, F.col("name"), F.col("home"))))


def portal_entries(*parts: DataFrame) -> DataFrame:
    """Union of portal entries; of aliases that are one in key form (compatibility form, trimmed, single spaces, lower case) the first stays, and ALIASES at most. Null ones go."""
    both = reduce(DataFrame.unionByName, parts).withColumn("aliases", F.array_compact("aliases"))
    keyed = F.transform(F.pandas_udf(_nfkc_each, "array<string>")("aliases"), lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " ")))
    first = F.filter("aliases", lambda x, k: F.array_position("alias_keys", F.get("alias_keys", k)) == k + 1)
    return both.withColumn("alias_keys", keyed).withColumn("aliases", F.slice(first, 1, ALIASES)).drop("alias_keys")


def _nfkc_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else [unicodedata.normalize("NFKC", x) for x in xs])


def full_text(head: str, documents: DataFrame) -> DataFrame:
    """(part, place, file, text, offset): the texts that make up one file, a head and each document (file, raw) under its name, in the files' order by collation.

    part and place order the rows; offset is where a row's text begins in the whole, in code points, a line break after each. The rows are a written
    table, dealt out by ranges; one number a part is all that is gathered.
    """
    spark = documents.sparkSession
    first = spark.createDataFrame([(None, head)], "file string, text string")
    body = documents.select("file", F.concat(F.lit("\n---\n\n# Source: "), "file", F.lit("\n\n"), "raw").alias("text"))
    name = F.expr("coalesce(file, '') collate UNICODE")
    dealt = first.unionByName(body).repartitionByRange(name, F.col("file")).sortWithinPartitions(name, F.col("file"))
    rows = tables.written(dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "file", "text"))
    size = F.length("text") + 1
    sums, starts, at = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum(size).alias("n")).collect()), [], 0
    for part, n in sums:
        starts.append((part, at))
        at += n
    begun = F.sum(size).over(Window.partitionBy("part").orderBy("place")) - size  # a part is what one task held
    return rows.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").select("part", "place", "file", "text", (F.col("start") + begun).alias("offset"))


def write_text(rows: DataFrame, path: str) -> None:
    """The texts of full_text as files of a folder, whose names' order is the text's; joined they are one file."""
    rows.select("part", "place", "text").repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("text").write.mode("overwrite").text(path)


def part_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file of a folder that write_text made."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return parts.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def diagnostics(knowledge: DataFrame, handoff: DataFrame, settings: Settings) -> DataFrame:
    """(pos, message): what is said of an index that holds its starter only, or no handoffs."""
    n = knowledge.agg(F.count("*").alias("docs"), F.max("path").alias("path")).crossJoin(handoff.agg(F.count("*").alias("handoffs")))  # one row
    starter = (F.col("docs") == 1) & (F.col("path") == settings.index_doc)
    # Messages are output
    found = F.concat(
        F.when(starter, F.array(F.lit(f"Only the starter {settings.index_doc} was indexed."), F.lit(f"Add agent docs under {settings.agent_root}/, then run {settings.tool} index again."))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("handoffs") == 0, F.array(F.lit("No ownership handoffs yet. Add routing.options.ownership, package frontmatter (package + editRoot), or a monorepo plugin."))).otherwise(F.array().cast("array<string>")),
    )
    return n.select(F.posexplode(found).alias("pos", "message"))


def next_commands(handoff: DataFrame, settings: Settings) -> DataFrame:
    """(pos, command): what to run after an index was built."""
    tool, root = settings.tool, settings.agent_root
    first = handoff.agg(F.min("target.id").alias("id"))
    some = F.array(F.format_string(f"{tool} query package %s --agent", "id"), F.lit(f"{tool} list packages --text"), F.lit(f"{tool} mcp"))
    none = F.array(F.lit(f"mkdir -p {root}/packages"), F.lit(f"edit {root}/packages/<module>.md  # frontmatter: package + editRoot"), F.lit(f"{tool} index"))
    return first.select(F.posexplode(F.when(F.col("id").isNotNull(), some).otherwise(none)).alias("pos", "command"))
