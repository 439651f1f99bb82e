"""Files of a project as tables."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import paths
from waymark.operators.handoff import collated, with_position
from waymark.sources import web
from waymark.sources.stores import store

SKIPPED = ("node_modules", ".git", "dist", "coverage", ".waymark")


class LimitError(ValueError):
    """A size limit is exceeded."""


def list_files(root: str, extensions: list[str], skip: tuple[str, ...] = SKIPPED) -> list[tuple[str, int]] | None:
    """(path below root, bytes) of files with one of the endings, hidden ones too, by path in byte order. Skipped directories aren't entered and links aren't followed.

    Null where the address can be read by Spark only.
    """
    place = store(root.rstrip("/") or "/")
    if place is None:
        return None
    system, base = place
    found, todo, ends = [], [base], tuple(extensions)
    local = isinstance(system, fs.LocalFileSystem)
    while todo:
        here = todo.pop()
        if local:
            with os.scandir(here) as entries:
                items = [(e.path, e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False).st_size) for e in entries if not e.is_symlink()]
        else:
            items = [(e.path, e.base_name, e.type == fs.FileType.Directory, e.size or 0) for e in system.get_file_info(fs.FileSelector(here))]
        for path, name, is_dir, size in items:
            if is_dir:
                todo += [path] if name not in skip else []
            elif ends and name.endswith(ends):
                found.append((path[len(base.rstrip("/")) + 1 :], size))
    return sorted(found, key=lambda x: x[0].encode())


def _reader(root: str):
    """(path, length) -> with content, a file a batch, read where the rows are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(root)
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([f.read()], pa.binary())], names=["path", "length", "content"])

    return read


def scan_files(spark: SparkSession, root: str, extensions: list[str], max_files: int | None = None, max_bytes: int | None = None, max_total: int | None = None, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path below root, length, content) of files with one of the endings, in skipped directories none.

    Names and sizes are listed on the driver, as Spark's readers do, but hidden files and directories count; limits are checked
    on them before any content is read. Contents are read by the tasks. Of a store that only Spark reads, Spark's own reader
    gives the files, without hidden ones.
    """
    root = root.rstrip("/") or "/"
    listed = list_files(root, extensions, skip)
    if listed is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        tail = root.split("://")[-1].partition("/")[2]
        rel = F.regexp_replace(F.regexp_replace("path", r"\A[^:]+:/*[^/]*/", ""), r"\A" + re.escape(tail) + "/", "")
        rows = files.select(rel.alias("path"), "length", "content")
        for name in skip:
            rows = rows.where(~F.concat(F.lit("/"), "path").contains(f"/{name}/"))
        rows = rows.where(F.col("path").rlike("(?:" + "|".join(re.escape(e) for e in extensions) + r")\z") if extensions else F.lit(False))
        n = rows.agg(F.count("*").alias("n"), F.max("length").alias("largest"), F.sum("length").alias("total")).first() if max_files or max_bytes or max_total else (0, 0, 0)
        sizes = tuple(x or 0 for x in n)
    else:
        sizes = (len(listed), max((n for _, n in listed), default=0), sum(n for _, n in listed))
        names = spark.createDataFrame(listed, "path string, length long")
        tasks = max(1, min(len(listed), 4 * spark.sparkContext.defaultParallelism))
        rows = names.repartition(tasks, "path").mapInArrow(_reader(root), "path string, length long, content binary")
    for value, most, what in zip(sizes, (max_files, max_bytes, max_total), ("files", "bytes in a file", "bytes in all"), strict=True):
        if most and value > most:
            raise LimitError(f"more than {most} {what}: {value}")
    return rows


def scan_markdown(spark: SparkSession, root: str, **limits) -> DataFrame:
    """(path, length, raw) of Markdown files below root."""
    return scan_files(spark, root, [".md", ".mdx"], **limits).select("path", "length", F.col("content").cast("string").alias("raw"))


def scan_notes(spark: SparkSession, root: str, **limits) -> DataFrame:
    """(path, raw) of memory notes and editor rules."""
    return scan_files(spark, root, [".md", ".mdc"], **limits).select("path", F.col("content").cast("string").alias("raw"))


def scan_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path of the directory, file, json) of package.json and project.json files."""
    rows = scan_files(spark, root, ["package.json", "project.json"]).withColumn("file", paths.file_name(F.col("path"))).where(F.col("file").isin("package.json", "project.json"))
    folder = F.coalesce(F.nullif(F.regexp_replace("path", r"/?[^/]+\z", ""), F.lit("")), F.lit("."))
    return rows.select(folder.alias("path"), "file", F.col("content").cast("string").alias("json"))


def workspace_patterns(text: str) -> list[str]:
    """The packages list of a workspace file."""
    out, inside = [], False
    for line in map(str.strip, text.split("\n")):
        if line == "packages:":
            inside = True
        elif inside and line.startswith("- "):
            out.append(line[2:].strip().strip("'\""))
        elif inside and line and not line.startswith("#"):
            inside = False
    return out


def discover_packages(manifests: DataFrame, patterns: list[str]) -> DataFrame:
    """Packages in the directories of workspace patterns; the id is the name without scope, else the directory's."""
    rows = manifests.where((F.col("file") == "package.json") & F.col("path").rlike(paths.workspace_regex(patterns)))
    name = F.get_json_object("json", "$.name")
    ok = rows.where(F.try_parse_json("json").isNotNull())
    got = ok.select(F.coalesce(paths.package_id(name), paths.file_name(F.col("path"))).alias("id"), "path", name.alias("name"), F.lit(None).cast("array<string>").alias("checks"))
    return with_position(got, collated())


def project_rows(manifests: DataFrame) -> DataFrame:
    """Rows for ranked_projects: project files, and package files with a project section; targets are their keys and the scripts'."""
    keys = lambda path: F.coalesce(F.json_object_keys(F.get_json_object("json", path)), F.array().cast("array<string>"))
    is_project = F.col("file") == "project.json"
    rows = manifests.where(F.try_parse_json("json").isNotNull() & (is_project | F.get_json_object("json", "$.nx").startswith("{")))
    own = F.when(is_project, F.coalesce(F.get_json_object("json", "$.root"), "path")).otherwise(F.col("path"))
    names = manifests.where(F.col("file") == "package.json").select(F.col("path").alias("own_path"), F.get_json_object("json", "$.name").alias("package_name"))
    targets = F.when(is_project, keys("$.targets")).otherwise(F.array_union(keys("$.nx.targets"), keys("$.scripts")))
    rows = rows.withColumn("own_path", own).where(~F.col("own_path").rlike(r"\A/|(?:\A|/)\.\.(?:/|\z)")).withColumn("targets", targets)
    rows = rows.join(names, "own_path", "left")
    name = F.coalesce(F.get_json_object("json", "$.name"), F.when(is_project, F.col("package_name")), paths.file_name(F.col("own_path")))
    got = rows.select(F.col("own_path").alias("path"), is_project.alias("project_json"), name.alias("name"), "targets", F.concat_ws("/", "path", "file").alias("manifest"))
    return with_position(got, "manifest")


def package_manager(root: str) -> str:
    """By lock file, then by the manifest, else npm."""
    has = lambda *names: any(os.path.exists(os.path.join(root, n)) for n in names)
    for manager, names in (("pnpm", ("pnpm-lock.yaml", "pnpm-workspace.yaml")), ("yarn", ("yarn.lock",)), ("bun", ("bun.lockb", "bun.lock")), ("npm", ("package-lock.json",))):
        if has(*names):
            return manager
    declared = str(_manifest(root).get("packageManager", "")).split("@")[0]
    return declared if declared in ("pnpm", "npm", "yarn", "bun") else "npm"


def _manifest(root: str) -> dict:
    try:
        with open(os.path.join(root, "package.json"), encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}


def is_workspace(root: str) -> bool:
    return any(os.path.exists(os.path.join(root, n)) for n in ("pnpm-workspace.yaml", "lerna.json")) or bool(_manifest(root).get("workspaces"))


def project_name(root: str, configured: str | None = None) -> str:
    return configured or str(_manifest(root).get("name") or os.path.basename(os.path.abspath(root)))


def fetch_text(address: str, root: str = ".", timeout: float = web.TIMEOUT) -> str | None:
    """The text of a web address or of a file below root; null for what is away, too slow or too large. web.fetch says which."""
    return web.fetch(address, root, timeout)[0]


def federated_sources(spark: SparkSession, sources: list[dict], fetch: Callable[[str], str | None] = fetch_text) -> DataFrame:
    """(source_id, url, raw, base) of the configured texts, fetched by the tasks. fetch gets an address and gives its text; what it can't get, or
    fails at, is left out. web.federated_sources fetches each once and gives the outcomes, too.
    """
    rows = [(s["id"], s["llmsTxt"], s.get("rawBaseUrl")) for s in sources if s.get("includeInRetriever") is not False and s.get("llmsTxt")]
    asked = spark.createDataFrame(rows, "source_id string, url string, base string")
    return asked.join(fetch_texts(asked, fetch), "url").select("source_id", "url", "raw", "base")


def _soft(fetch: Callable[[str], str | None], address: str) -> str | None:
    try:
        return fetch(address)
    except Exception:  # a source that is away is no error
        return None


def fetch_texts(links: DataFrame, fetch: Callable[[str], str | None] = fetch_text) -> DataFrame:
    """(url) -> (url, raw) of the distinct addresses that give a text, fetched by the tasks."""

    def got(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, _soft(fetch, u)) for u in batch.column(0).to_pylist()]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["url", "raw"])

    tasks = 4 * links.sparkSession.sparkContext.defaultParallelism
    return links.select("url").distinct().repartition(tasks, "url").mapInArrow(got, "url string, raw string")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that write_index wrote; a missing index is a FileNotFoundError that says what to do."""
    try:
        return {name: spark.read.parquet(f"{path}/{name}") for name in ("knowledge", "ownership", "handoff", "meta")}
    except AnalysisException as e:
        raise FileNotFoundError(f"no index at {path}; build it first") from e
