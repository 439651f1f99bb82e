"""Paths, routes and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.markdown import non_empty, slug_from_path


def to_posix(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression: ** crosses directories, dot files match, {a,b} is a choice."""
    pattern = pattern.replace("\\", "/").removeprefix("./")
    out, k, depth = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
            continue
        if pattern.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            inner = pattern[k + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return r"(?s)\A" + "".join(out) + ")" * depth + r"\z"


def matches_globs(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Exclusion beats inclusion; no inclusion is all."""
    any_of = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    include, exclude = [g for g in include or [] if g], [g for g in exclude or [] if g]
    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))


def workspace_regex(patterns: list[str]) -> str:
    """Directories of workspace globs: one level below what stands before the first *, which ends the glob."""
    parts = []
    for p in patterns:
        head, star, _ = p.removeprefix("./").partition("*")
        parts.append(re.escape(head.rstrip("/")) + ("/[^/]+" if star else ""))
    return r"\A(?:" + "|".join(parts) + r")\z"


def route_slug(path: Column, strip_groups: bool = False) -> Column:
    """Path as a route: without (group) segments on demand, a final index.md(x) or .md(x)."""
    if strip_groups:
        path = F.array_join(F.filter(F.split(path, "/"), lambda s: ~s.rlike(r"\A\(.+\)\z")), "/")
    return F.regexp_replace(F.regexp_replace(path, r"(?:\A|/)index\.mdx?\z", ""), r"\.mdx?\z", "")


def human_url(slug: Column, prefix: str | None) -> Column:
    if not prefix:
        return slug
    base = prefix.removesuffix("/")
    return F.when(slug != "", F.concat(F.lit(base + "/"), F.regexp_replace(slug, r"\A/", ""))).otherwise(F.lit(base))


def github_slug(part: Column) -> Column:
    """Heading anchor: lower case, letters, marks, digits, hyphens and underscores stay, spaces become hyphens."""
    return F.translate(F.regexp_replace(F.lower(part), r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\- ]", ""), " ", "-")


def knowledge_url(path: Column, url_prefix: str | None = None, path_prefix: str | None = None) -> Column:
    """Address of a knowledge page; spaces and the like are percent-encoded, slashes stay."""
    if not url_prefix:
        return path
    route = F.regexp_replace(to_posix(path), r"\.mdx?\z", "")
    if path_prefix:
        head = path_prefix.replace("\\", "/").removesuffix("/") + "/"
        route = F.when(route.startswith(head), F.substring(route, len(head) + 1, 1 << 30)).otherwise(route)
    route = F.regexp_replace(route, r"\A/+", "")
    coded = F.array_join(F.transform(F.split(route, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")
    return F.concat(F.lit(url_prefix if url_prefix.endswith("/") else url_prefix + "/"), coded)


def package_id(name: Column) -> Column:
    """A package's name without its scope."""
    return F.when(name.startswith("@"), file_name(name)).otherwise(name)


def same_origin(a: Column, b: Column) -> Column:
    """True unless both are web addresses of different scheme or host."""
    web = lambda c: c.rlike(r"\Ahttps?://")
    part = lambda c, n: F.try_parse_url(c, F.lit(n))
    port = lambda c: F.coalesce(F.regexp_extract(part(c, "AUTHORITY"), r":(\d+)\z", 1), F.lit(""))
    full = lambda c: F.concat_ws("|", part(c, "PROTOCOL"), F.lower(part(c, "HOST")), F.when((part(c, "PROTOCOL") == "https") & (port(c) == "443") | (part(c, "PROTOCOL") == "http") & (port(c) == "80"), "").otherwise(port(c)))
    return ~(web(a) & web(b)) | (full(a) == full(b))


def resolved(path: Column) -> Column:
    """A path without . and .. segments; null if it leaves its root."""
    step = lambda seen, part: F.when(part.isin("", "."), seen).when(part == "..", F.when(F.size(seen) > 0, F.slice(seen, F.lit(1), F.size(seen) - 1))).otherwise(F.concat(seen, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def rewrite_link(url: Column, source: Column, repo: str, branch: str, base: str = "", docs_root: str = "docs") -> Column:
    """A link of the document source (a path of the repository): a relative Markdown file below docs_root as a route of the site, another
    file of the repository as its address there; anchors, full addresses and paths that leave the repository stay.
    """
    path, suffix = F.regexp_extract(url, r"\A([^?#]+)", 1), F.regexp_extract(url, r"\A[^?#]+([?#].*)?\z", 1)
    folder = F.regexp_replace(source, r"[^/]*\z", "")
    target = resolved(F.concat(folder, F.coalesce(F.try_url_decode(path), path)))
    head = docs_root.strip("/") + "/"
    slug = F.regexp_replace(F.substring(target, len(head) + 1, 1 << 30), r"\.md\z", "")
    page = F.concat(F.lit(f"{base}/docs/"), slug, F.lit("/"), suffix)
    kind = F.when(path.endswith("/"), "tree").otherwise("blob")
    file = F.concat(F.lit(repo.rstrip("/") + "/"), kind, F.lit(f"/{branch}/"), target, suffix)
    stays = (url == "") | url.startswith("#") | url.startswith("/") | url.rlike(r"(?i)\A[a-z]+:") | target.isNull()
    return F.when(stays, url).when(target.startswith(head) & path.endswith(".md"), page).otherwise(file)


def is_public(path: Column, names: list[str], folders: list[str], marks: list[str]) -> Column:
    """Whether a document may be published: not one of names, not in folders, and no segment beginning with a mark."""
    p = F.regexp_replace(to_posix(path), r"\A\.?/", "")
    out = ~p.isin(names) if names else F.lit(True)
    for f in folders:
        out = out & ~p.startswith(f.rstrip("/") + "/")
    for m in marks:
        out = out & ~p.startswith(m) & ~p.contains("/" + m)
    return out


def doc_id(package: Column, module: Column, own: Column, path: Column) -> Column:
    return F.coalesce(package, module, own, non_empty(slug_from_path(path)))
