"""Literals in code against a recursive reader, strict schemas against a plain walk, sidebars against a recursive visit."""

import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from waymark import config
from waymark.functions import literals
from waymark.operators import search, sinks, strict
from waymark.sources import human

RNG = random.Random(11)


def value(depth):
    kind = RNG.randrange(9 if depth else 6)
    if kind == 0:
        return RNG.choice([True, False, None])
    if kind == 1:
        return RNG.choice([0, 7, -3, 1.25, -0.5, 12345678901234567890])
    if kind < 6:
        return "".join(RNG.choice("ab'\"`\\/*{}[],: \n\té日😀") for _ in range(RNG.randrange(0, 9)))
    if kind < 8:
        return {RNG.choice(["a", "b-c", "d.e", "'q", "k l", "é"]) + str(RNG.randrange(3)): value(depth - 1) for _ in range(RNG.randrange(4))}
    return [value(depth - 1) for _ in range(RNG.randrange(4))]


def blank():
    return RNG.choice(["", " ", "\n", "/* } , ' */" if RNG.random() < 0.9 else " ", "// ] \" \n", "\t"])


def code(v):
    """A literal as people write it, one value after another."""
    if isinstance(v, dict):
        body = [f"{blank()}{k if re.fullmatch('[A-Za-z0-9_.-]+', k) and RNG.random() < 0.5 else code(k)}{blank()}:{blank()}{code(x)}{blank()}" for k, x in v.items()]
        return "{" + ",".join(body) + RNG.choice(["", ","] if body else [""]) + blank() + "}"
    if isinstance(v, list):
        body = [blank() + code(x) + blank() for x in v]
        return "[" + ",".join(body) + RNG.choice(["", ","] if body else [""]) + blank() + "]"
    if isinstance(v, str):
        quote = RNG.choice("'\"")
        return quote + "".join("\\" + {"\n": "n", "\t": "t"}.get(c, c) if c in (quote, "\\", "\n", "\t") or RNG.random() < 0.05 and c in "é日/" else c for c in v) + quote
    return json.dumps(v)


def scripts(v):
    body = code(v)
    return RNG.choice([f"module.exports = {body};", f"// module.exports = {{x: 1}}\nexport default {body} as const", f"export default defineConfig ( {body} )", f"const re = /export default {{[/]/, s = `module.exports = {{`\nlet c: C<'a'>\n = {body}\nexport default c", f"var $a_1 = {body}; module.exports =\n $a_1"])


def test_literals_against_what_they_were_made_of(spark):
    values = [{f"k{k}": value(4)} for k in range(400)]
    rows = [(k, scripts(v)) for k, v in enumerate(values)]
    for (_, source), v in zip(rows, values, strict=True):
        assert literals.read(source) == json.loads(json.dumps(v), parse_int=lambda n: int(n) if abs(int(n)) < 1 << 53 else float(n))
    broken = ["", "module.exports = 5", "module.exports = f()", "export default {a: b}", "export default {a: `x`}", "export default {a", "export default {a:1 b:2}", "export default {,}", "export default [1]", "export default {a:[,]}", "export default {...x}", "x = 'abc", "export default {a:[1}", "export default {'': 1}", "export default {a: 1e5}", "export default defineConfig(x)", "export default x\nlet x: {a: 1}", "export default {a: " + "[" * 600 + "]" * 600 + "}"]
    frame = spark.createDataFrame([*rows, *[(1000 + k, s) for k, s in enumerate(broken)], (5000, None)], "id long, source string")
    got = {r["id"]: r for r in frame.select("id", literals.exported_literal(F.col("source")).alias("r")).select("id", F.col("r.error").alias("error"), F.to_json(F.struct("r.value")).alias("v"), F.col("r.value").isNull().alias("none")).collect()}
    for k, v in enumerate(values):
        assert got[k]["error"] is None and json.loads(got[k]["v"], parse_int=float)["value"] == json.loads(json.dumps(v), parse_int=float)
    assert all(got[1000 + k]["error"] and got[1000 + k]["none"] for k in range(len(broken))) and got[5000]["error"] is None and got[5000]["none"]


@pytest.mark.parametrize("source", ["const a:" * 100_000 + " export default a", "export default {a:" + "[" * 300_000, "'\\" * 200_001, "/*" * 200_000, "a=/[" * 100_000, "module.exports = {a: '" + "\\n" * 300_000 + "'}", "let a : b ; " * 60_000 + "export default a"])
def test_literals_are_read_in_linear_time(source):
    began = time.time()
    try:
        literals.read(source)
    except literals.NotLiteral:
        pass
    assert time.time() - began < 15


def test_settings_in_code(tmp_path):
    (tmp_path / "waymark.config.ts").write_text("import type {C} from 'x'\nconst c: C = {project: 'p', human: {plugin: 'nextra'}, // why\n}\nexport default c\n")
    settings, root = config.load(str(tmp_path))
    assert settings.project == "p" and settings.human == [{"plugin": "nextra"}] and root == str(tmp_path)
    (tmp_path / "waymark.config.ts").write_text("export default {project: name()}")
    with pytest.raises(ValueError, match="no literal"):
        config.load(str(tmp_path))


def plain_issues(v, rule, path=()):
    """(path, message) of a parsed document, by a visit from the root."""
    at, out = ".".join(path) or "(root)", []
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    inside = lambda n: (rule.least is None or n >= rule.least) and (rule.most is None or n <= rule.most)
    show = lambda: f"{int(rule.least)} to {int(rule.most)}" if rule.least is not None and rule.most is not None else f"at least {int(rule.least)}" if rule.most is None else f"at most {int(rule.most)}"
    if v is None and rule.nullable or rule.kind == "any":
        return out
    if rule.kind in ("object", "list or object") and isinstance(v, dict):
        known = rule.required | rule.optional
        if extra := sorted(set(v) - set(known)):
            out.append((at, f"unknown keys: {', '.join(extra)}"))
        out += [(".".join((*path, k)), "is missing") for k in rule.required if k not in v]
        for k in v.keys() & known.keys():
            out += plain_issues(v[k], known[k], (*path, k))
    elif rule.kind == "entries" and isinstance(v, dict):
        for k, x in v.items():
            if rule.key_most is not None and not rule.key_least <= len(k) <= rule.key_most:
                out.append((".".join((*path, k)), f"key must have {rule.key_least} to {rule.key_most} characters"))
            out += plain_issues(x, rule.item, (*path, k))
    elif rule.kind in ("list", "list or object") and isinstance(v, list):
        if not inside(len(v)):
            out.append((at, f"items must be {show()}"))
        for k, x in enumerate(v):
            out += plain_issues(x, rule.item, (*path, str(k)))
    elif rule.kind == "text" and isinstance(v, str):
        if not inside(len(v)):
            out.append((at, f"characters must be {show()}"))
        elif rule.pattern and not re.search(rule.pattern.replace(r"\z", r"\Z"), v):
            out.append((at, "has another form"))
    elif rule.kind in ("number", "whole number") and number:
        if rule.kind == "whole number" and v != int(v):
            out.append((at, "must be a whole number"))
        elif not inside(v):
            out.append((at, f"must be {show()}"))
    elif rule.kind == "one of":
        if v not in rule.values:
            out.append((at, f"must be one of {', '.join(rule.values)}"))
    elif rule.kind == "flag" and isinstance(v, bool):
        pass
    else:
        what = {"object": "an object", "entries": "an object", "list": "a list", "list or object": "a list or an object", "text": "a text", "number": "a number", "whole number": "a number", "flag": "true or false"}[rule.kind]
        out.append((at, f"must be {what}"))
    return out


def sample(rule, depth=0):
    """A random value that mostly keeps a rule."""
    if RNG.random() < 0.06:
        return RNG.choice([None, 3, -1, 2.5, "", "odd", "x" * 600, True, [], {}, [1], {"a": 1}])
    if rule.kind in ("object", "list or object") and (rule.kind == "object" or RNG.random() < 0.5):
        out = {k: sample(r, depth + 1) for k, r in rule.required.items() if RNG.random() > 0.04} | {k: sample(r, depth + 1) for k, r in rule.optional.items() if RNG.random() < 0.5}
        return out | ({RNG.choice(["extra", "é", "a b"]): 1} if RNG.random() < 0.08 else {})
    if rule.kind in ("list", "list or object"):
        return [sample(rule.item, depth + 1) for _ in range(RNG.choice([0, 1, 2, int(rule.most or 0) + 1 if (rule.most or 99) < 40 and depth < 2 else 1]))]
    if rule.kind == "entries":
        return {RNG.choice(["a", "b", "", "k" * 300]): sample(rule.item, depth + 1) for _ in range(2)}
    return {"text": RNG.choice(["https://a.example/x", "a" * 64, "2024-02-03T04:05:06Z", "é日"]), "whole number": RNG.choice([1, 2, 1.0]), "number": 0.5, "flag": True, "any": [1, {"a": None}], "one of": RNG.choice(rule.values or ("",))}[rule.kind]


@pytest.mark.parametrize("schema", sorted(strict.SCHEMAS))
def test_strict_schemas(spark, schema):
    rule = strict.SCHEMAS[schema]
    docs = [sample(rule) for _ in range(120)]
    frame = spark.createDataFrame([*[(k, json.dumps(v)) for k, v in enumerate(docs)], (900, None), (901, "{"), (902, "")], "id long, json string")
    got = sorted((r["id"], r["path"], r["message"]) for r in strict.issues(frame, schema).collect())
    want = [(k, *issue) for k, v in enumerate(docs) for issue in plain_issues(v, rule)] + [(k, "(root)", "is no JSON") for k in (900, 901, 902)]
    assert got == sorted(want) and len({m for _, _, m in want}) > 8


def test_older_handoffs_get_their_version(spark):
    good = {"type": "agent-handoff", "source": "s", "target": {"type": "package", "id": "x"}, "startHere": "a", "readBeforeEditing": ["a"], "editRoots": ["r"], "checks": [], "notes": [], "humanDoc": None}
    rows = [(1, json.dumps(good)), (2, json.dumps(good | {"schemaVersion": 1})), (3, json.dumps(good | {"type": "nope"})), (4, "x")]
    got = {r["id"]: r for r in strict.parsed_handoffs(spark.createDataFrame(rows, "id long, json string")).collect()}
    assert [got[k]["ok"] for k in (1, 2, 3, 4)] == [True, True, False, False] and json.loads(got[1]["json"]) == json.loads(got[2]["json"]) == good | {"schemaVersion": 1}


def visit(v, ids, folders):
    if isinstance(v, str):
        ids.add(v)
    elif isinstance(v, list):
        for x in v:
            visit(x, ids, folders)
    elif isinstance(v, dict):
        if v.get("type") in ("doc", "ref") and isinstance(v.get("id"), str):
            ids.add(v["id"])
        if v.get("type") == "autogenerated" and isinstance(v.get("dirName"), str):
            folders.add("" if v["dirName"] == "." else v["dirName"].removesuffix("/"))
        for k, x in v.items():
            if isinstance(x, list) or k == "link" and isinstance(x, dict):
                visit(x, ids, folders)


def test_sidebars_of_many_sites(spark):
    name = lambda: RNG.choice(["a", "b", "x/a", "x/b", "x/y/c", "x"])

    def item(depth):
        kind = RNG.randrange(7 if depth else 4)
        if kind == 0:
            return name()
        if kind == 1:
            return {"type": RNG.choice(["doc", "ref", "link"]), "id": RNG.choice([name(), 5]), "label": "a"}
        if kind == 2:
            return {"type": "autogenerated", "dirName": RNG.choice([".", "x", "x/", "x/y/", "z", 3, "q"])} if RNG.random() < 0.3 else "none"
        if kind == 3:
            return RNG.choice([None, True, 1, {"label": "b"}])
        return {"type": "category", "items": [item(depth - 1) for _ in range(RNG.randrange(3))], "link": RNG.choice([{"type": "doc", "id": name()}, "x", None]), "other": {"items": ["b"]}}

    sides = {f"s{k}": {"docs": [item(4) for _ in range(RNG.randrange(4))], "api": RNG.choice([name(), [name()], {"x": ["x/a"]}])} for k in range(40)}
    raw = [(s, json.dumps(v) if RNG.random() < 0.5 else f"module.exports = {json.dumps(v)}") for s, v in sides.items()] + [("bad", "export default f()"), ("null", None)]
    entries, errors = human.sidebar_entries(spark.createDataFrame(raw, "site string, raw string"))
    want = {}
    for s, v in sides.items():
        ids, folders = set(), set()
        for x in v.values():
            if isinstance(x, list):
                visit(x, ids, folders)
        want[s] = (ids, folders)
    assert sorted(map(tuple, entries.collect())) == sorted((s, kind, n) for s, both in want.items() for kind, names in zip(("doc", "folder"), both, strict=True) for n in names)
    assert {r["site"] for r in errors.collect()} == {"bad", "null"}
    pages = ["a.md", "b.mdx", "x/a.md", "x/b.md", "x/y/c.md", "x/index.md", "z.md", "x/y.png"]
    frame = spark.createDataFrame([(s, p, "") for s in [*sides, "bad", "free"] for p in pages], "site string, path string, raw string")
    kept = {(r["site"], r["path"]) for r in human.docusaurus(frame, "d", None, spark.createDataFrame(raw, "site string, raw string")).collect()}
    for s in [*sides, "bad", "free"]:
        for p in pages[:-1]:
            side = re.sub(r"(^|/)index$", "", p.rsplit(".", 1)[0])
            ids, folders = want.get(s, (set(), set()))
            listed = side in ids or any(not f or side == f or side.startswith(f + "/") for f in folders)
            assert ((s, f"d/{p}") in kept) == (s == "free" or listed), (s, p)


def test_a_deep_sidebar(spark):
    deep = '{"docs": ' + '[{"type": "category", "items": ' * 150 + '["a"]' + "}]" * 150 + "}"
    entries, errors = human.sidebar_entries(spark.createDataFrame([("s", deep)], "site string, raw string"))
    assert [tuple(r) for r in entries.collect()] == [("s", "doc", "a")] and errors.count() == 0


def test_full_text_is_one_file_in_parts(spark, tmp_path):
    files = [(f"{RNG.choice('abÄz')}/{RNG.choice(['b', 'B', 'é'])}{k}.md", RNG.choice(["", "x\ny", "日😀 text\n"]) * RNG.randrange(4)) for k in range(60)]
    rows = sinks.full_text("head\n", spark.createDataFrame(files, "file string, raw string"))
    got = sorted((r["part"], r["place"], r["file"], r["offset"], r["text"]) for r in rows.collect())
    names = [r["file"] for r in spark.createDataFrame(files, "file string, raw string").orderBy(F.expr("file collate UNICODE")).collect()]
    whole = "head\n" + "".join(f"\n\n---\n\n# Source: {f}\n\n{dict(files)[f]}" for f in names) + "\n"
    assert [f for _, _, f, _, _ in got] == [None, *names]
    assert all(whole[at : at + len(text)] == text for *_, at, text in got)
    sinks.write_text(rows, str(tmp_path / "full"))
    parts = sorted((tmp_path / "full").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == whole
    digests = {r["file"]: (r["bytes"], r["sha256"]) for r in sinks.part_digests(spark, str(tmp_path / "full")).collect()}
    assert digests == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in parts}
    assert sinks.full_text("only", spark.createDataFrame([], "file string, raw string")).collect()[0]["offset"] == 0


def test_names_of_an_entry_count_once_in_their_compatibility_form(spark):
    rows = [("a", ["ﬁne", "FINE", " fine ", None, "ｗｉｄｅ", "wide", *[f"n{k}" for k in range(20)]]), ("b", None), ("c", [])]
    entries = spark.createDataFrame(rows, "id string, aliases array<string>")
    got = {r["id"]: r["aliases"] for r in sinks.portal_entries(entries).collect()}
    assert got == {"a": ["ﬁne", "ｗｉｄｅ", *[f"n{k}" for k in range(14)]], "b": None, "c": []}


def test_tokens_are_found_alike_by_either_way(spark, monkeypatch):
    words = ["ab", "a", "b-c", "abab", "@x/y", "b_", "9", "ba9", "zz"]
    hays = ["".join(RNG.choice(["ab", "a", "b", "-", "_", " ", "@x/y", "9", "é", "."]) for _ in range(RNG.randrange(0, 40))) for _ in range(200)]
    entries = spark.createDataFrame(list(enumerate(hays)), "k long, hay string")
    for signs in (search.SIGNS, ""):
        tokens = spark.createDataFrame([(w,) for w in words if not set(w) & set("@/_-") or signs], "token string")
        both = [sorted(map(tuple, f(entries, ["k"], tokens, signs).collect())) for f in (search.held_tokens, search.vocabulary_tokens)]
        assert both[0] == both[1] and len(both[0]) > 100
    monkeypatch.setattr(search, "SEEN_CHARS", 100)
    assert sorted(map(tuple, search.held_tokens(entries, ["k"], tokens, "").collect())) == both[0]
    none = spark.createDataFrame([], "token string")
    assert search.held_tokens(entries, ["k"], none).count() == 0
