"""Strict checks of whole JSON documents against schemas: types, limits, missing and unknown keys, by path.

A schema is compiled to a table of rules, one for each place of a document, so a broadcast join gives each value its rule. The walk takes one
step for each level that the schema has: a value that holds others is replaced by these, and its own issues go on with the first of them.
So a document of any size is read in one pass over rows, without a shuffle. Nothing below an unknown key is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import PRESETS, RESERVED, STYLE_PROFILES, STYLE_RULES

ISSUES = "array<struct<path: string, message: string>>"
ANY_KEY = "*"


@dataclass(frozen=True)
class Rule:
    """What a value must be. least and most bound a text's characters, a number, or the items of a list; key_least and key_most the keys of free entries."""

    kind: str
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()
    required: dict[str, Rule] = field(default_factory=dict)
    optional: dict[str, Rule] = field(default_factory=dict)
    item: Rule | None = None
    key_least: int | None = None
    key_most: int | None = None
    nullable: bool = False


def text(least: int | None, most: int | None, pattern: str | None = None, nullable: bool = False) -> Rule:
    return Rule("text", least, most, pattern, nullable=nullable)


def whole(least: int | None = None, most: int | None = None) -> Rule:
    return Rule("whole number", least, most)


def one_of(*values: str) -> Rule:
    return Rule("one of", values=values)


def items(item: Rule, most: int | None = None, least: int | None = None) -> Rule:
    return Rule("list", least, most, item=item)


def one_or_items(item: Rule, most: int) -> Rule:
    """A list, or one item without it."""
    return Rule("list or object", None, most, required=item.required, optional=item.optional, item=item)


def entries(key_least: int | None, key_most: int | None, item: Rule) -> Rule:
    """An object with free keys."""
    return Rule("entries", item=item, key_least=key_least, key_most=key_most)


def fields(required: dict[str, Rule], optional: dict[str, Rule] | None = None, nullable: bool = False) -> Rule:
    return Rule("object", required=required, optional=optional or {}, nullable=nullable)


FLAG, NUMBER, ANYTHING = Rule("flag"), Rule("number"), Rule("any")

# Limits, names and forms of the published documents.
URL = r"(?is)\A(?:(?:https?|wss?|ftp):/*[^\s/?#]+[^\s]*|(?!(?:https?|wss?|ftp):)[a-z][a-z0-9+.-]*:.*)\z"
INSTANT = r"\A\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?Z\z"
DIGEST = r"\A[a-f0-9]{64}\z"
DIGEST_NAME = "sha256-normalized-v1"
FIRST_VERSION = whole(1, 1)
_PATH, _NAME = text(1, 512), text(1, 256)
_CHECKS = items(text(1, 256), 32)
_TARGETS = ("package", "module", "app", "screen", "flow", "component", "intent", "change", "search")
_HANDOFF = fields(
    {
        "type": one_of("agent-handoff"), "source": _PATH, "target": fields({"type": one_of(*_TARGETS), "id": _NAME}, {"path": _PATH, "group": text(1, 128), "layer": text(1, 32)}),
        "startHere": _PATH, "readBeforeEditing": items(_PATH, 64), "editRoots": items(_PATH, 32), "checks": _CHECKS, "notes": items(text(1, 1024), 16),
    },
    {
        "schemaVersion": FIRST_VERSION, "humanDoc": text(1, 512, nullable=True), "playbookPatterns": items(text(None, None, URL), 16),
        "bridge": fields({"humanDoc": one_of("linked", "missing", "external")}, {"action": text(1, 256), "bootstrap": text(1, 256)}),
    },
)
_OWNER = {"group": text(1, 128), "layer": text(1, 32), "purpose": text(None, 1024), "agentDoc": _PATH, "humanDoc": _PATH}
_INTENT = fields({"id": text(1, 128), "title": text(1, 256), "paths": items(_PATH, 32)})
_CHANGE = fields({"id": text(1, 128), "title": text(1, 256), "startHere": _PATH}, {"relatedPackages": items(_NAME, 32)})
_MATCH = {"required": {"type": text(1, 64), "id": _NAME, "path": _PATH}, "optional": {"summary": text(None, 2048), "score": NUMBER, "refs": whole(0)}}
SCHEMAS: dict[str, Rule] = {
    "handoff": _HANDOFF,
    "search": fields(
        {"type": one_of("agent-search"), "source": _PATH, "term": _PATH, "count": whole(0), "bestMatch": fields(**_MATCH, nullable=True), "matches": items(fields(**_MATCH), 32), "nextCommands": items(_PATH, 16)},
        {"schemaVersion": FIRST_VERSION},
    ),
    "index": fields(
        {
            "schemaVersion": FIRST_VERSION, "contentHash": text(None, None, DIGEST), "contentHashAlgo": one_of(DIGEST_NAME),
            "knowledge": items(fields({"id": _NAME, "type": text(1, 128), "title": _NAME, "path": _PATH}, {"description": text(None, 2048), "body": text(None, 8000), "links": items(_PATH, 64), "tags": items(text(1, 64), 32)}), 10_000),
        },
        {
            "generatedAt": text(None, None, INSTANT), "project": fields({"name": text(1, 128)}, {"root": _PATH}),
            "properties": items(fields({"id": text(1, 64), "name": text(1, 128)}, {"url": text(None, None, URL), "llms": text(None, None, URL)}), 16),
            "capabilities": items(fields({"id": _NAME, "kind": text(1, 64)}, {"description": text(None, 512)}), 5000),
            "handoffs": entries(1, 256, _HANDOFF),
            "lookup": fields({"packages": items(_NAME, 2000)}, {"ownership": entries(1, 256, fields({"id": _NAME, "path": _PATH, "checks": _CHECKS}, _OWNER | {"readme": _PATH})), "intents": entries(1, 128, _INTENT), "changes": entries(1, 128, _CHANGE)}),
        },
    ),
    "config": fields(
        {},
        {
            "project": text(1, 128), "agent_root": _PATH, "agent_index": _PATH, "include": items(text(1, 256), 64), "exclude": items(text(1, 256), 64), "require_type": FLAG, "allowed_types": items(text(1, 128), 64),
            "human": one_or_items(fields({"plugin": one_of("plain-markdown", "fumadocs", "docusaurus", "vitepress", "starlight", "nextra")}, {"options": entries(None, None, ANYTHING)}), 16), "out_file": _PATH,
            "llms": fields({}, {"enabled": FLAG, "outFile": _PATH, "preamble": text(None, 4000), "urlPrefix": text(None, None, URL), "pathPrefix": _PATH}),
            "ownership": entries(1, 256, fields({"path": _PATH}, _OWNER | {"checks": _CHECKS})), "ownership_from_corpus": FLAG, "intents": items(_INTENT, 128), "changes": items(_CHANGE, 128),
            "preset": one_of(*PRESETS), "gates_include": items(one_of(*PRESETS["strict"], *sorted(RESERVED)), 16), "gates_exclude": items(one_of(*PRESETS["strict"], *sorted(RESERVED)), 16),
            "style": fields({"profile": one_of(*STYLE_PROFILES, "custom")}, {"required": items(one_of(*STYLE_RULES), 16)}), "tool": text(1, 64),
        },
    ),
    "candidate": fields(
        {"schemaVersion": FIRST_VERSION, "id": _NAME, "source": one_of("cursor", "claude", "codex", "copilot", "agent-memory", "manual"), "fact": text(1, 8000), "suggestedType": one_of("user", "feedback", "project", "reference", "unknown"), "confidence": Rule("number", 0, 1), "references": items(_PATH, 64)},
        {"rawPath": _PATH, "why": text(None, 4000), "howToApply": text(None, 4000)},
    ),
}

RULE = "parent int, key string, rule int, kind string, least double, most double, pattern string, options array<string>, required array<string>, known array<string>, key_least int, key_most int, nullable boolean"


def compiled(schema: Rule) -> tuple[list[tuple], int]:
    """(rows of RULE, levels): the rule of each place by its parent's number and key; the root's parent is -1. Rows are as many as the schema has places."""
    rows: list[tuple] = []

    def add(rule: Rule, parent: int, key: str) -> int:
        own, known = len(rows), [*rule.required, *rule.optional]
        rows.append((parent, key, own, rule.kind, *(None if b is None else float(b) for b in (rule.least, rule.most)), rule.pattern, list(rule.values), list(rule.required), known, rule.key_least, rule.key_most, rule.nullable))
        below = [add(r, own, k) for k, r in (rule.required | rule.optional).items()]
        return 1 + max([0, *below, *([add(rule.item, own, ANY_KEY)] if rule.item else [])])

    return rows, add(schema, -1, "")


def _found(ok: Column, path: Column, message: Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.array(F.struct(path.alias("path"), message.alias("message"))))


def _shown(path: Column) -> Column:
    return F.when(F.size(path) == 0, "(root)").otherwise(F.array_join(path, "."))


def _bounds(what: str) -> Column:
    """from .. to .., of the bounds that there are."""
    n = lambda c: F.format_string("%.0f", c)
    both = F.concat(n(F.col("least")), F.lit(" to "), n(F.col("most")))
    one = F.when(F.col("most").isNull(), F.concat(F.lit("at least "), n(F.col("least")))).otherwise(F.concat(F.lit("at most "), n(F.col("most"))))
    return F.concat(F.lit(f"{what} "), F.when(F.col("least").isNotNull() & F.col("most").isNotNull(), both).otherwise(one))


def _within(x: Column) -> Column:
    return (F.col("least").isNull() | (x >= F.col("least"))) & (F.col("most").isNull() | (x <= F.col("most")))


#: VARIANT's names of the types of JSON numbers.
NUMERIC = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _seen() -> list[Column]:
    """What the checks look at, of v and its type."""
    v, of = F.col("v"), F.col("of")
    as_ = lambda kind: F.try_variant_get(v, "$", kind)
    return [
        F.when(of == "STRING", as_("string")).alias("as_text"), F.when(of.isin(*NUMERIC), as_("double")).alias("as_number"),
        F.when((of == "OBJECT") & F.col("kind").isin("object", "list or object"), F.map_keys(as_("map<string,variant>"))).alias("keys"),
        F.when((of == "ARRAY") & F.col("kind").startswith("list"), F.size(as_("array<variant>"))).alias("n_items"),
    ]


def _issues() -> Column:
    """Issues of a row (path, what _read gives, rule's columns); none of a row without a rule."""
    kind, path, of, as_text, as_number, keys, size = map(F.col, ("kind", "path", "of", "as_text", "as_number", "keys", "n_items"))
    numeric = of.isin(*NUMERIC)
    here = _shown(path)
    unknown, missing = F.array_except(keys, F.col("known")), F.array_except(F.col("required"), keys)
    must = lambda what: _found(F.lit(False), here, F.lit(f"must be {what}"))
    none = F.array().cast(ISSUES)
    of_text = F.coalesce(F.when(of != "STRING", must("a text")), _found(_within(F.length(as_text)), here, _bounds("characters must be")), _found(F.col("pattern").isNull() | F.rlike(as_text, F.col("pattern")), here, F.lit("has another form")), none)
    of_number = F.coalesce(F.when(~numeric, must("a number")), F.when((kind == "whole number") & (as_number != F.floor(as_number)), must("a whole number")), _found(_within(as_number), here, _bounds("must be")), none)
    of_choice = F.coalesce(_found((of == "STRING") & F.array_contains(F.col("options"), as_text), here, F.concat(F.lit("must be one of "), F.array_join("options", ", "))), none)
    of_object = F.concat(
        F.coalesce(F.when(F.size(unknown) > 0, F.array(F.struct(here.alias("path"), F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(unknown), ", ")).alias("message")))), none),
        F.transform(missing, lambda k: F.struct(F.array_join(F.array_append(path, k), ".").alias("path"), F.lit("is missing").alias("message"))),
    )
    of_list = F.coalesce(_found(_within(size), here, _bounds("items must be")), none)
    own = (
        F.when(of == "OBJECT", F.when(kind.isin("object", "list or object"), of_object).when(kind.isin("entries", "any"), none).when(kind == "list", must("a list")))
        .when(of == "ARRAY", F.when(kind.isin("list", "list or object"), of_list).when(kind == "any", none).when(kind.isin("object", "entries"), must("an object")))
    )
    scalar = F.when(kind == "text", of_text).when(kind.isin("number", "whole number"), of_number).when(kind == "one of", of_choice).when(kind == "flag", F.coalesce(_found(of == "BOOLEAN", here, F.lit("must be true or false")), none))
    scalar = scalar.when(kind == "list", must("a list")).when(kind.isin("object", "entries"), must("an object")).when(kind == "list or object", must("a list or an object")).otherwise(none)
    key = F.element_at(F.when(F.size(path) > 0, path), -1)
    fits = F.col("key_bounds").isNull() | F.length(key).between(F.col("key_bounds")["key_least"], F.col("key_bounds")["key_most"])
    bad_key = F.coalesce(_found(fits, here, F.concat(F.lit("key must have "), F.col("key_bounds")["key_least"], F.lit(" to "), F.col("key_bounds")["key_most"], F.lit(" characters"))), none)
    return F.when(kind.isNull(), none).otherwise(F.concat(bad_key, F.when((of == "VOID") & F.col("nullable"), none).otherwise(F.coalesce(own, scalar))))


def issues(docs: DataFrame, schema: str | Rule, id_col: str = "id", json_col: str = "json") -> DataFrame:
    """(id, path, message) of all that breaks the schema in the JSON texts of docs; (root) is the path of the whole.

    Null and broken texts are no JSON. Lengths are code points. Rows that share an id each have their issues. A valid document gives no row.
    """
    spark = docs.sparkSession
    rows, levels = compiled(SCHEMAS[schema] if isinstance(schema, str) else schema)
    rules = F.broadcast(spark.createDataFrame(rows, RULE))  # as many rows as the schema has places
    parsed = docs.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col)).alias("v"))
    broken = F.when(F.col("v").isNull(), F.array(F.struct(F.lit("(root)").alias("path"), F.lit("is no JSON").alias("message")))).otherwise(F.array()).cast(ISSUES)
    nodes = parsed.select("id", F.array().cast("array<string>").alias("path"), "v", F.lit(-1).alias("parent"), F.lit("").alias("key"), F.lit(None).cast("struct<key_least: int, key_most: int>").alias("key_bounds"), broken.alias("issues"))
    of = F.regexp_extract(F.schema_of_variant("v"), r"\A\w+", 0).alias("of")
    below = F.when(F.col("key_most").isNotNull(), F.struct("key_least", "key_most")).alias("below")
    both = F.concat("issues", F.when(F.col("v").isNull(), F.array().cast(ISSUES)).otherwise(_issues())).alias("issues")
    holds = (F.col("of") == "OBJECT") & F.col("kind").isin("object", "entries", "list or object") | (F.col("of") == "ARRAY") & F.col("kind").startswith("list")
    opened = F.when(holds, F.col("v")).alias("opened")
    seen, kept = ["*", *_seen()], ["id", "path", "rule", below, both, "kind", opened]
    for level in range(levels):
        ruled = nodes.join(rules, ["parent", "key"], "left").select("*", of).select(*seen).select(*kept)
        if level == levels - 1:
            nodes = ruled
            break
        nodes = spark.sql(
            f"""SELECT id, CASE WHEN e.value IS NULL THEN path ELSE array_append(path, coalesce(e.key, cast(e.pos AS string))) END AS path, e.value AS v, rule AS parent,
                CASE WHEN kind = 'entries' OR e.key IS NULL THEN '{ANY_KEY}' ELSE e.key END AS key, CASE WHEN kind = 'entries' THEN below END AS key_bounds,
                CASE WHEN coalesce(e.pos, 0) = 0 THEN issues ELSE cast(array() AS {ISSUES}) END AS issues
              FROM {{ruled}} r, LATERAL variant_explode_outer(r.opened) e WHERE e.value IS NOT NULL OR size(issues) > 0""",
            ruled=ruled,
        )
    return nodes.select("id", F.explode("issues").alias("i")).select("id", "i.path", "i.message")


def parsed_handoffs(docs: DataFrame, id_col: str = "id", json_col: str = "json") -> DataFrame:
    """docs with ok, and with the version that older handoffs leave out: the JSON texts that keep the schema, schemaVersion put in where it is missing."""
    bad = issues(docs, "handoff", id_col, json_col).select(F.col("id").alias(id_col)).distinct()
    filled = F.when(F.try_variant_get(F.try_parse_json(F.col(json_col)), "$.schemaVersion", "int").isNull(), F.regexp_replace(json_col, r"\A\s*\{", '{"schemaVersion":1,')).otherwise(F.col(json_col))
    good = docs.join(bad.withColumn("bad", F.lit(True)), id_col, "left")
    return good.withColumn("ok", F.col("bad").isNull()).withColumn(json_col, F.when(F.col("ok"), filled).otherwise(F.col(json_col))).drop("bad")

