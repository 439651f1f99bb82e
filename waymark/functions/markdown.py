"""Markdown and frontmatter as Column expressions.

Three frontmatter readers exist on purpose; each is used where its rules apply:

* ``frontmatter`` for agent documents: byte order mark, CRLF, comments, booleans and inline lists.
* ``plain_frontmatter`` for human documents: LF only, text values only.
* ``header_field`` for gates: first match of one field, the value ending at a quote, a line end or ``#``.

A frontmatter column is array<struct<key, raw>>; of repeated keys the last counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts of the web know it, for use inside a character class.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_INLINE = SPACE.replace(r"\n", "")
_HEAD = r"(?s)\A---(?=\r?\n)(.*?)\r?\n---\r?\n(.*)\z"


#: The same characters as a text.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def non_empty(c: Column) -> Column:
    """Null for an empty text."""
    return F.when(c != "", c)


def collapsed(c: Column) -> Column:
    # single spaces stay untouched
    return trimmed(F.regexp_replace(c, rf"[{SPACE}]{{2,}}|[{SPACE.replace(' ', '')}]", " "))


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, r"""\A['"]|['"]\z""", "")


def _entries(lines: Column, pattern: str, value_trim: bool) -> Column:
    kept = F.filter(lines, lambda x: x.rlike(pattern))
    pair = lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), (trimmed if value_trim else lambda c: c)(F.regexp_extract(x, pattern, 2)).alias("raw"))
    return F.transform(kept, pair)


def _no_mark(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\A\uFEFF", "")


def frontmatter(raw: Column) -> Column:
    """Entries of the frontmatter of an agent document; empty without one."""
    block = F.when(raw.rlike(r"\A\uFEFF?---\r?\n"), F.substring(F.regexp_extract(_no_mark(raw), _HEAD, 1), 2, 1 << 30)).otherwise("")
    lines = F.filter(F.transform(F.split(block, r"\r?\n"), trimmed), lambda x: (x != "") & ~x.startswith("#"))
    return _entries(lines, rf"(?s)\A([A-Za-z0-9_-]+):[{SPACE}]*(.*)\z", True)


def body(raw: Column) -> Column:
    """What follows the frontmatter; the whole text without one."""
    return F.when(raw.rlike(r"\A\uFEFF?---\r?\n") & _no_mark(raw).rlike(_HEAD), F.regexp_extract(_no_mark(raw), _HEAD, 2)).otherwise(raw)


def _last(entries: Column, key: str) -> Column:
    own = F.filter(entries, lambda e: e["key"] == key)
    return F.try_element_at(own, F.lit(-1))["raw"]


def fm_string(entries: Column, key: str) -> Column:
    """A non-empty text value, else null; booleans and lists are no texts."""
    raw = _last(entries, key)
    return F.when(~raw.isin("true", "false") & ~(raw.startswith("[") & raw.endswith("]")), non_empty(_unquoted(raw)))


def fm_bool(entries: Column, key: str) -> Column:
    raw = _last(entries, key)
    return F.when(raw == "true", True).when(raw == "false", False)


def fm_list(entries: Column, key: str) -> Column:
    """An inline list without empty items, or a text as a list of one."""
    raw = _last(entries, key)
    items = F.filter(F.transform(F.split(F.substring(raw, 2, F.length(raw) - 2), ","), lambda x: _unquoted(trimmed(x))), lambda x: x != "")
    one = fm_string(entries, key)
    return F.when(raw.startswith("[") & raw.endswith("]"), items).when(one.isNotNull(), F.array(one))


def first_heading(raw: Column, own_body: Column | None = None) -> Column:
    """The first line of one # and text. own_body is body(raw), for callers that have it."""
    found = F.regexp_extract(body(raw) if own_body is None else own_body, rf"(?md)^[{_INLINE}]*#[{_INLINE}]+([^\n]*[^{SPACE}][^\n]*)$", 1)
    return non_empty(trimmed(found))


def _last_index(text: Column, part: str) -> Column:
    """0-based place of the last occurrence, -1 for none."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at > 0, F.length(text) - at - (len(part) - 1)).otherwise(F.lit(-1))


def first_paragraph(raw: Column, most: int = 400, own_body: Column | None = None) -> Column:
    """The first block of prose, cut at a sentence or a word if longer than most; null without one.

    Headings and rules are passed over even inside a block; tables and task lists end a block or are passed over
    before one; a code fence ends the search.
    """

    def step(state: Column, line: Column) -> Column:
        held, has = state["held"], state["held"] != ""
        to = lambda text, done: F.struct(text.alias("held"), done.alias("done"))
        longer = F.when(has, F.concat(held, F.lit(" "), line)).otherwise(line)
        return (
            F.when(state["done"], state)
            .when(line == "", to(held, has))
            .when(line.startswith("#") | line.startswith("---"), state)
            .when(line.startswith("```"), to(held, F.lit(True)))
            .when(line.startswith("|") | line.startswith("- [") | line.startswith("* ["), to(held, has))
            .otherwise(to(longer, F.length(longer) >= most))
        )

    start = F.struct(F.lit("").alias("held"), F.lit(False).alias("done"))
    lines = F.transform(F.split(body(raw) if own_body is None else own_body, "\n"), trimmed)

    def shortened(cut: Column) -> Column:
        ends = F.greatest(*[_last_index(cut, p) for p in (". ", "! ", "? ")])
        by_word = let(_last_index(cut, " "), lambda word: F.when(word > 0, F.substring(cut, F.lit(1), word)).otherwise(cut))
        return trimmed(let(ends, lambda sentence: F.when(sentence > most * 0.4, F.substring(cut, F.lit(1), sentence + 1)).otherwise(by_word)))

    whole = collapsed(F.aggregate(lines, start, step)["held"])
    return let(whole, lambda text: non_empty(F.when(F.length(text) <= most, text).otherwise(let(F.substring(text, 1, most), shortened))))


def search_body(raw: Column, most: int = 6000, own_body: Column | None = None) -> Column:
    """The body without code fences, images, links and marks, on one line."""
    text = body(raw) if own_body is None else own_body
    text = F.regexp_replace(text, r"```[\s\S]*?```", " ")
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]+\)", " ")
    text = F.regexp_replace(text, r"\[[^\]]*\]\([^)]+\)", " ")
    text = F.regexp_replace(text, rf"(?m)^#+[{SPACE}]+", "")
    text = F.regexp_replace(text, r"[|>*_`#]", " ")
    return let(F.substring(collapsed(text), 1, most), non_empty)


def plain_frontmatter(raw: Column) -> Column:
    """Entries of the frontmatter of a human document."""
    block = F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---", 1)
    return _entries(F.split(block, "\n"), rf"(?s)\A([A-Za-z0-9_-]+):[{SPACE}]*(.+?)[{SPACE}]*\z", False)


def plain_value(entries: Column, key: str) -> Column:
    """The value without outer quotes; null if the key is absent."""
    return _unquoted(_last(entries, key))


def header_field(raw: Column, field: str) -> Column:
    """A field of the header block as the gates read it; null if absent or blank."""
    block = F.regexp_extract(raw, r"\A---\n([\s\S]*?)\n---", 1)
    return non_empty(trimmed(F.regexp_extract(block, rf"""(?m)^{field}:[{SPACE}]*['"]?([^'"\n#]+)""", 1)))


def slug_from_path(path: Column) -> Column:
    """The last segment without .md or .mdx."""
    return F.element_at(F.split(F.regexp_replace(path, r"\.mdx?\z", ""), "/"), -1)


def llms_links(raw: Column) -> Column:
    """array<struct<title, url, description>>: Markdown links with what follows a colon, then bare URLs that no link has."""
    full = r"\[([^\]]+)\]\(([^)]+)\)(?::\s*([^\n]+))?"
    parts = F.arrays_zip(*[F.regexp_extract_all(raw, F.lit(full), F.lit(k)).alias(n) for k, n in ((1, "title"), (2, "url"), (3, "description"))])
    links = F.transform(parts, lambda p: F.struct(p["title"].alias("title"), p["url"].alias("url"), non_empty(trimmed(p["description"])).alias("description")))
    bare = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(r"(?i)(?:^|\s)(?:Raw|llms\.txt|Full bundle|ZIP bundle)?:?\s*(https?://\S+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[),.;]+\z", "")))
    new = F.filter(bare, lambda u: (u != "") & ~F.exists(links, lambda x: x["url"] == u))
    return F.concat(links, F.transform(new, lambda u: F.struct(slug_from_path(u).alias("title"), u.alias("url"), F.lit(None).cast("string").alias("description"))))


def sections(raw: Column) -> Column:
    """Parts of a document: at bundle marks if it has any, else before headings of one or two #."""
    bundle = raw.contains("\n==== ")
    plain = F.regexp_replace(raw, r"\A---\n[\s\S]*?\n---\n?", "")
    return F.when(bundle, F.filter(F.split(raw, r"\n====\s+"), lambda s: trimmed(s) != "")).otherwise(F.split(plain, r"\n(?=##?\s+)"))


def section_title(section: Column, source: Column) -> Column:
    ways = (r"(?m)^title:\s*(.+)$", r"(?m)^https?://\S+/([^/\s]+)$", r"(?m)^#+\s+(.+)$")
    return F.coalesce(*[non_empty(trimmed(F.regexp_extract(section, w, 1))) for w in ways], slug_from_path(source))


def slug(title: Column) -> Column:
    """Lower-case letters and digits, all else one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), r"\A-|-\z", "")
