"""Column expressions on literal rows."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.functions import markdown as M
from waymark.functions import occurrences, paths, text


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "key", "expected"),
    [
        ("---\nid: a\n---\nx", "id", "a"), ("﻿---\r\nid: 'a b'\r\n---\r\nx", "id", "a b"), ("---\nid: true\n---\n", "id", None), ("---\nid:\n---\n", "id", None), ("---\n# id: c\nid: one\nid: two\n---\n", "id", "two"),
        ("---\nid: [a]\n---\n", "id", None), ("id: a", "id", None), ("---\nid: a", "id", None), ("---\nchecks:\n- x\n---\n", "checks", None),
    ],
)
def test_frontmatter_text(spark, raw, key, expected):
    assert one(spark, M.fm_string(M.frontmatter(F.col("r")), key), r=raw) == expected


def test_frontmatter_lists_and_flags(spark):
    raw = "---\na: [x, 'y', ,z]\nb: word\nc: false\n---\nrest"
    fm = M.frontmatter(F.col("r"))
    assert one(spark, M.fm_list(fm, "a"), r=raw) == ["x", "y", "z"]
    assert one(spark, M.fm_list(fm, "b"), r=raw) == ["word"]
    assert one(spark, M.fm_list(fm, "c"), r=raw) is None
    assert one(spark, M.fm_bool(fm, "c"), r=raw) is False
    assert one(spark, M.body(F.col("r")), r=raw) == "rest"


def test_the_readers_differ(spark):
    raw = "---\r\nid: a\r\n---\r\n"
    assert one(spark, M.fm_string(M.frontmatter(F.col("r")), "id"), r=raw) == "a"
    assert one(spark, M.plain_value(M.plain_frontmatter(F.col("r")), "id"), r=raw) is None
    assert one(spark, M.plain_value(M.plain_frontmatter(F.col("r")), "draft"), r="---\ndraft: true\n---\n") == "true"
    assert one(spark, M.header_field(F.col("r"), "type"), r="---\ntype: guide # note\n---\n") == "guide"


@pytest.mark.parametrize(("raw", "expected"), [("# A b \ntext", "A b"), ("text\n  #  C", "C"), ("## no\n#no", None), ("#\nnext", None), ("---\nx: 1\n---\n# In body", "In body"), ("", None)])
def test_first_heading(spark, raw, expected):
    assert one(spark, M.first_heading(F.col("r")), r=raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("# T\n\none\ntwo\n\nthree", "one two"), ("| a |\n- [ ] x\nprose", "prose"), ("```\ncode\n```\nlater", None), ("a\n# head\nb", "a b"), ("a\n| t |\nb", "a"), ("", None), ("  spaced   out  ", "spaced out"),
        ("First sentence is here. " + "word " * 10, "First sentence is here."), ("x" * 30 + " " + "y" * 30, "x" * 30), ("z" * 60, "z" * 40),
    ],
)
def test_first_paragraph(spark, raw, expected):
    assert one(spark, M.first_paragraph(F.col("r"), 40), r=raw) == expected


def test_search_body(spark):
    raw = "---\na: b\n---\n# T\n```\ncode\n```\n![i](u) [l](u) **bold** `c`|x"
    assert one(spark, M.search_body(F.col("r")), r=raw) == "T bold c x"


def test_links_and_sections(spark):
    raw = "[A](a.md): what it is\n[B](https://x/b.md)\nRaw: https://x/c.txt.\nhttps://x/b.md"
    got = one(spark, M.llms_links(F.col("r")), r=raw)
    assert [(x["title"], x["url"], x["description"]) for x in got] == [("A", "a.md", "what it is"), ("B", "https://x/b.md", None), ("c.txt", "https://x/c.txt", None)]
    assert one(spark, M.sections(F.col("r")), r="intro\n# A\nx\n### no\n## B\ny") == ["intro", "# A\nx\n### no", "## B\ny"]
    assert one(spark, M.sections(F.col("r")), r="a\n==== b\nc\n==== d") == ["a", "b\nc", "d"]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("**/*.md", ["a.md", "x/y/a.md", ".h/a.md"], ["a.mdx"]), ("docs/*.{md,mdx}", ["docs/a.md", "docs/b.mdx"], ["docs/x/a.md"]), ("a?c", ["abc"], ["a/c"]), ("x/**", ["x/y/z"], ["y/x"]), ("./[ab].md", ["a.md"], ["c.md"])],
)
def test_globs(spark, glob, yes, no):
    for path in yes + no:
        assert one(spark, paths.matches_globs(F.col("p"), [glob]), p=path) == (path in yes), path
        assert one(spark, paths.matches_globs(F.col("p"), None, [glob]), p=path) == (path not in yes)


def test_routes(spark):
    slug = lambda p, groups=False: one(spark, paths.route_slug(F.col("p"), groups), p=p)
    assert [slug("a/index.md"), slug("index.mdx"), slug("a/b.md"), slug("(g)/a/index.md", True)] == ["a", "", "a/b", "a"]
    assert one(spark, paths.human_url(F.col("s"), "/docs/"), s="a") == "/docs/a" and one(spark, paths.human_url(F.col("s"), "/docs/"), s="") == "/docs"
    assert one(spark, paths.github_slug(F.col("s")), s="Héllo, World_1!") == "héllo-world_1"
    assert one(spark, paths.same_origin(F.col("a"), F.col("b")), a="https://x.org/a", b="https://X.org:443/b") is True
    assert one(spark, paths.same_origin(F.col("a"), F.col("b")), a="https://x.org/a", b="http://x.org/b") is False
    assert one(spark, paths.same_origin(F.col("a"), F.col("b")), a="local.md", b="http://x.org/b") is True


def test_scores(spark):
    row = spark.createDataFrame([("core core", "os-core", "docs/core.md", "the core of os-core")], "term string, id string, path string, hay string").withColumn("w", text.tokens(F.col("term")))
    got = row.select(text.identity_boost(F.col("id"), F.col("path"), F.col("w"), F.col("term")).alias("b")).first()
    assert got["b"] == 280
    assert one(spark, text.wants_owner(F.col("t")), t="éedit") is True and one(spark, text.wants_owner(F.col("t")), t="credits") is False
    assert one(spark, text.content_hash(F.col("t")), t='{"b": 1, "a": [true, null]}') == one(spark, text.content_hash(F.col("t")), t='{"a":[true,null],"b":1}')


def test_rewritten_links(spark):
    link = lambda url, source="docs/guides/a.md": one(spark, paths.rewrite_link(F.col("u"), F.col("s"), "https://git.example/r", "main"), u=url, s=source)
    assert [link("b.md#x"), link("../c.md"), link("../../src/x.ts"), link("../../../up.md"), link("#x"), link("https://a/b.md"), link("../../pkg/")] == [
        "/docs/guides/b/#x", "/docs/c/", "https://git.example/r/blob/main/src/x.ts", "../../../up.md", "#x", "https://a/b.md", "https://git.example/r/tree/main/pkg",
    ]
    public = lambda p: one(spark, paths.is_public(F.col("p"), ["PLAN.md"], ["landing"], ["DRAFT"]), p=p)
    assert [public(p) for p in ("a.md", "./PLAN.md", "landing/x.md", "x/DRAFT-1.md")] == [True, False, False, False]


def test_tokens_are_found_in_all_texts_at_once(monkeypatch):
    rng = random.Random(5)
    for window, cells, signs in ((3, 5, "-/"), (17, 100, ""), (1 << 16, 4 << 20, "-/")):
        monkeypatch.setattr(occurrences, "CELLS", cells)
        for _ in range(20):
            kinds = "ab1" + signs
            tokens = sorted({"".join(rng.choices(kinds, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 40]))) for _ in range(12)})
            texts = ["", *["".join(rng.choices(kinds * 3 + " \u00e9\0\U0001d518", k=rng.randrange(40))) for _ in range(6)], "ab" * 100 + tokens[-1]]
            want = []
            for e, h in enumerate(texts):
                runs = re.findall(f"[a-z0-9{signs}]{{2,}}", h)
                for k, t in enumerate(tokens):
                    if any(t in r for r in runs):
                        want.append((e, k, any(re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", r) for r in runs)))
            got = occurrences.Finder(tokens, signs, window).find(pa.array(["ab", *texts])[1:])
            assert list(zip(*(c.tolist() for c in got), strict=True)) == want
    assert [len(c) for c in occurrences.Finder([], "").find(pa.array(["ab"]))] == [0, 0, 0]
