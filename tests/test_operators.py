"""Operators against literal folds and small frames."""

import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from waymark import config, tables
from waymark.operators import conformance, doctor, gates, handoff, memory, retrieve, search, sinks, validate
from waymark.plans import index
from waymark.plans.facade import Waymark
from waymark.sources import files, human
from waymark.streaming import rebuild


def knowledge(spark, rows):
    return spark.createDataFrame([(i, "agent-doc", t, p, d, b, k) for k, (i, t, p, d, b) in enumerate(rows)], tables.KNOWLEDGE)


def owners(spark, rows):
    return spark.createDataFrame([(i, p, None, None, purpose, ["t"], doc, None, None, k) for k, (i, p, purpose, doc) in enumerate(rows)], tables.OWNERSHIP)


def fold(rows, want):
    """Paths by the order-dependent rule: a later row takes a path if it scores more, or as much as an owner, or nearly as an owner that is wanted."""
    best, first = {}, {}
    for k, (kind, path, score, ident) in enumerate(rows):
        first.setdefault(path, k)
        if path not in best or score > best[path][1] or (score == best[path][1] and kind == "ownership" != best[path][0]) or (want and kind == "ownership" != best[path][0] and score >= best[path][1] - 20):
            best[path] = (kind, score, ident)
    return best, first


def plain_scores(know, own, term):
    """Every entry's score, one after another, by the rules as written."""
    low, out = term.lower(), []
    words = [t for t in re.split("[^a-z0-9@/_-]+", low) if len(t) >= 2]
    want = bool(re.search(r"(?i)\b(package|module|pkg|edit|change|where|owns?|ownership|handoff|start)\b", term))
    for kind, ident, path, hay in [("knowledge", i, p, f"{i} {t} {d or ''} {p} {b}") for i, t, p, d, b in know] + [("ownership", i, d or p, f"{i} {p} {u or ''}  {d or ''} ") for i, p, u, d in own]:
        hay, me = hay.lower(), ident.lower()
        base, score = re.sub(r"\.mdx?$", "", path.split("/")[-1].lower()), 0
        for t in words:
            if t in hay:
                score += len(t) * (2 if kind == "ownership" else 1) + len(t) * bool(re.search(f"(?:^|[^a-z0-9]){re.escape(t)}(?:[^a-z0-9]|$)", hay))
        score += 200 * (low.strip() in (me, base)) + 200 * (len(words) == 1 and words[0] in (me, base))
        for t in words:
            score += 120 if me == t else 40 if me.startswith(t + "-") or me.endswith("-" + t) else 30 if t in me and len(me) <= len(t) + 4 else 0
            score += 100 * (base == t)
        score += max(0, 40 - len(me)) if me in words else 0
        score += (40 if want else 15) if kind == "ownership" else 0
        if score > 0:
            out.append((kind, path, score, ident))
    return words, want, out


@pytest.mark.parametrize(("seed", "k", "block"), [(3, 100, 256), (4, 5, 4), (5, 1, 256), (6, 20, 3)])
def test_search_matches_the_fold(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = random.Random(seed)
    words = ["core", "auth", "edit", "os", "pkg-x", "data", "@x/core", "a_b", "co", "authority-core/x"]
    know = [(f"{rng.choice(words)}-{j}", " ".join(rng.choices(words, k=3)), f"docs/{rng.choice(words[:6])}{rng.randrange(6)}.md", rng.choice([None, "about core"]), " ".join(rng.choices(words, k=8))) for j in range(40)]
    own = [(f"{rng.choice(words[:6])}{j}", f"packages/{j}", rng.choice(words), rng.choice([None, f"docs/{rng.choice(words[:6])}{rng.randrange(6)}.md"])) for j in range(30)]
    terms = ["core auth", "edit core", "os", "!", "core core", "unheard", "where is nothing", know[0][0], own[3][0], "pkg-x @x/core", "b", "co-", "x/ty-core"]
    got = search.search(knowledge(spark, know), owners(spark, own), spark.createDataFrame(list(enumerate(terms)), "query_id int, term string"), k).collect()
    for q, term in enumerate(terms):
        tokens, want, rows = plain_scores(know, own, term)
        best, first = fold(rows, want) if tokens else ({}, {})
        order = sorted(best, key=lambda p: (-best[p][1], best[p][2].lower() not in tokens, best[p][0] != "ownership", [(c.isalnum(), c) for c in best[p][2]], first[p]))[:k]
        mine = [(r["path"], r["type"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert sorted(s for *_, s in mine) == sorted(best[p][1] for p in order), term
        assert k < 100 or {m[0]: m[1:] for m in mine} == {p: v[:2] for p, v in best.items()}, term
        assert all(best[p][:2] == (t, s) for p, t, s in mine), term


@pytest.mark.parametrize(("k", "cells"), [(1, 1), (3, 60), (20, 1 << 20)])
def test_entries_scored_where_they_are_read_give_what_all_pairs_give(spark, monkeypatch, k, cells):
    rng = random.Random(k)
    words = ["core", "auth", "edit", "os", "pkg-x", "data", "co", "x"]
    know = [(rng.choice(words) if j % 9 == 0 else f"{rng.choice(words)}-{j}", "t", f"docs/{rng.choice(words[:4])}{rng.randrange(40)}.md", None, " ".join(rng.choices(words, k=rng.randrange(6)))) for j in range(150)]
    own = [(f"{rng.choice(words)}{j // 2}", f"packages/{j}", rng.choice(words), rng.choice([None, f"docs/{rng.choice(words[:4])}{rng.randrange(40)}.md"])) for j in range(80)]
    terms = ["core auth", "edit core", "os", "core core", "where is data", know[0][0], own[3][0], "edit pkg-x", "docs", "the co x", "t"]
    asked = spark.createDataFrame(list(enumerate(terms)), "query_id int, term string")
    both = []
    for most in (search.MOST_NAMED, -1):
        for name, v in (("MOST_NAMED", most), ("PATH_CELLS", cells), ("BLOCK_CELLS", cells), ("QUERY_CELLS", cells)):
            monkeypatch.setattr(search, name, v)
        both.append(sorted(map(tuple, search.search(knowledge(spark, know).repartition(3), owners(spark, own), asked, k).collect()), key=str))
    assert both[0] == both[1] and len(both[0]) > 8 * min(k, 15)


def test_only_entries_that_may_be_best_are_shuffled(spark):
    rows = [(False, f"d{j}", f"p{j}", j, "some words here" + " wanted" * (j == 7)) for j in range(2000)]
    entries = spark.createDataFrame(rows, "owner boolean, id string, path string, pos long, hay string").coalesce(1)
    asked = search.prepared(spark.createDataFrame([(q, "some words wanted") for q in range(9)], "query_id int, term string"))
    assert [(r["query_id"], r["pos"]) for r in search._best_hits(entries, asked, search._stated(asked), 1).orderBy("query_id").collect()] == [(q, 7) for q in range(9)]


def test_queries_of_more_tokens_than_a_task_takes_go_there_in_groups(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{j}x" for j in range(300)]
    know = [(f"d-{j}", "t", f"docs/{j % 20}.md", None, " ".join(rng.choices(words, k=60))) for j in range(120)]
    own = [(f"s-{j}", f"packages/{j}", rng.choice(words), f"docs/{j}.md" if j % 3 else None) for j in range(60)]
    terms = [" ".join(rng.choices(words, k=8)) for _ in range(50)] + ["where is w1x", "s-7", "w2x " + "long" * 100, " ".join(words)]
    asked = spark.createDataFrame(list(enumerate(terms)), "query_id int, term string")
    found = lambda: sorted(map(tuple, search.search(knowledge(spark, know).repartition(3), owners(spark, own), asked, 2).collect()))
    want, large, hits = found(), [], search._hits
    monkeypatch.setattr(search, "_hits", lambda entries, some, gain: large.extend(r["query_id"] for r in some.collect()) or hits(entries, some, gain))
    monkeypatch.setattr(search, "MOST_TOKENS", 120)
    assert found() == want and len(want) > 100
    assert large == [len(terms) - 1]  # the one that holds more tokens than a task takes


def test_owners_below_what_knowledge_reaches_are_not_shuffled(spark, monkeypatch):
    rows = [(False, "d", "p", 0, "every wanted word of this uncommonly long explanatory paragraph stands here")] + [(True, f"s{j}", f"o{j}", j, "wanted") for j in range(500)]
    entries = spark.createDataFrame(rows, "owner boolean, id string, path string, pos long, hay string").repartition(4, "owner")
    asked = search.prepared(spark.createDataFrame([(q, "edit every wanted word of this uncommonly long explanatory paragraph that stands here") for q in range(9)], "query_id int, term string"))
    monkeypatch.setattr(search, "FEW_QUERIES", 8)
    assert search._best_hits(entries, asked, search._stated(asked), 1).where("not owner").count() == 9
    assert search._best_hits(entries, asked, search._stated(asked), 1).count() == 9


@pytest.mark.parametrize("k", [1, 3, 20])
def test_owners_that_know_what_knowledge_reaches_are_found_as_before(spark, monkeypatch, k):
    rng = random.Random(k)
    words = ["core", "auth", "edit", "os", "pkg-x", "data", "co", "x", "serves"]
    know = [(f"{rng.choice(words)}-{j}", "t", f"docs/{rng.randrange(30)}.md", None, " ".join(rng.choices(words, k=rng.randrange(6)))) for j in range(90)]
    own = [(f"{rng.choice(words)}{j // 2}", f"packages/{j}", rng.choice(words), rng.choice([None, f"docs/{rng.randrange(40)}.md"])) for j in range(80)]
    asked = spark.createDataFrame(list(enumerate(["core auth", "edit core", "os", "where is data", own[3][0], "edit pkg-x", "docs", "the co x", "nothing so", "serves"])), "query_id int, term string")
    both = []
    for few, common, some in ((1000, 512, 32), (0, 512, 32), (0, 2, 3)):
        for name, v in (("FEW_QUERIES", few), ("MOST_COMMON", common), ("COMMON", some)):
            monkeypatch.setattr(search, name, v)
        both.append(sorted(map(tuple, search.search(knowledge(spark, know).repartition(3), owners(spark, own), asked, k).collect()), key=str))
    assert both[0] == both[1] == both[2] and len(both[0]) >= 8


def test_owners_of_one_file_are_scored_by_as_many_tasks_as_there_are_cores(spark, tmp_path, monkeypatch):
    rows = [(f"s-{j}", f"packages/s{j}", "serves", f"docs/{j}.md" if j % 3 else None) for j in range(300)]
    owners(spark, rows).coalesce(1).write.parquet(str(tmp_path / "own"))
    seen, hits, asked = [], search._best_hits, spark.createDataFrame([(1, "where is s-7"), (2, "serves")], "query_id int, term string")
    monkeypatch.setattr(search, "_best_hits", lambda entries, *more: seen.append(entries) or hits(entries, *more))
    both = [sorted(map(tuple, search.search(knowledge(spark, []), own, asked).collect())) for own in (spark.read.parquet(str(tmp_path / "own")), owners(spark, rows))]
    assert both[0] == both[1] and len(both[0]) == 40
    assert seen[0].where("owner").select(F.spark_partition_id().alias("part")).distinct().count() == spark.sparkContext.defaultParallelism


def test_equal_entries_of_two_paths_stand_in_the_order_of_their_first_rows(spark):
    know = [("z", "only", "b.md", None, "hit"), ("same", "t", "a.md", None, "hit hit"), ("same", "t", "b.md", None, "hit hit")]
    got = search.search(knowledge(spark, know), owners(spark, []), spark.createDataFrame([(1, "hit same")], "query_id int, term string"), 2).collect()
    assert [r["path"] for r in sorted(got, key=lambda r: r["rank"])] == ["b.md", "a.md"]


def test_exact_id_beats_a_mention(spark):
    o = owners(spark, [("os-core", "packages/os-core", "contracts", None), ("decoy", "packages/decoy", "mentions os-core twice os-core", None)])
    got = search.search(knowledge(spark, []), o, spark.createDataFrame([(1, "os-core")], "query_id int, term string")).collect()
    assert [r["id"] for r in got] == ["os-core", "decoy"]


DOCS = [
    ("docs/for-agents/INDEX.md", "# Index\n\nStart here."),
    ("docs/for-agents/packages/auth.md", "---\nchecks: [a, b]\nhumanDoc: /h/auth\n---\n# Auth\n\nLogs people in."),
    ("docs/for-agents/x/billing.md", "---\npackage: billing\neditRoot: src/billing\npurpose: Bills\n---\n# Billing"),
    ("docs/for-agents/pillars/p/retry-pattern.md", "# Retry"),
    ("docs/for-agents/top.mdx", "Words only."),
    ("elsewhere/skip.md", "# No"),
]


def built(spark, **more):
    settings = config.parse({"ownership": {"auth": {"path": "", "purpose": "explicit"}, "10": {"path": "ten", "checks": []}}, "human": [{"plugin": "plain-markdown"}]} | more)
    pages = spark.createDataFrame([("packages/billing", "/docs/billing", "site/b.md", 0), ("retry", "/docs/retry", "site/r.md", 1)], tables.HUMAN_DOC)
    found = spark.createDataFrame([("auth", "packages/auth", "@x/auth", None, 0), ("top", "apps/top", None, None, 1)], tables.DISCOVERED)
    return settings, index.build(spark, spark.createDataFrame(DOCS, "path string, raw string"), pages, settings, found, {"manager": "pnpm", "workspace": True}), pages


def test_index_build(spark, tmp_path):
    settings, ix, pages = built(spark)
    h = {r["target"]["id"]: r for r in ix.handoff.collect()}
    assert set(h) == {"10", "auth", "billing", "retry-pattern", "top"}
    assert h["auth"]["target"]["path"] == "" and h["auth"]["checks"] == ["a", "b"] and h["auth"]["humanDoc"] == "/h/auth" and h["auth"]["notes"] == ["explicit"]
    assert h["10"]["checks"] == [] and h["10"]["startHere"] == settings.index_doc and h["10"]["bridge"]["humanDoc"] == "missing"
    assert h["billing"]["editRoots"] == ["src/billing"] and h["billing"]["humanDoc"] == "/docs/billing" and h["billing"]["checks"] == ["pnpm test"]
    assert h["retry-pattern"]["humanDoc"] == "/docs/retry" and h["retry-pattern"]["notes"][0] == "Playbook pattern: retry-pattern"
    assert h["top"]["target"]["path"] == "packages/top" and h["top"]["checks"] == ["pnpm --filter top test"]
    assert h["auth"]["readBeforeEditing"] == ["docs/for-agents/packages/auth.md", "AGENTS.md"]
    with pytest.raises(ValueError):  # an empty edit root
        index.write(ix, str(tmp_path / "ix"))
    ix = built(spark, ownership={"auth": {"path": "src/auth"}})[1]
    one = index.write(ix, str(tmp_path / "ix"))
    assert one == index.stored_hash(spark, str(tmp_path / "ix")) == built(spark, ownership={"auth": {"path": "src/auth"}})[1].hash()
    assert gates.freshness(one, one, spark).first()["ok"] and not gates.freshness(None, one, spark).first()["ok"]
    assert validate.handoffs(ix.handoff).where(F.size("issues") > 0).count() == 0
    other = built(spark, ownership={})[1]
    assert other.hash() != one


def test_last_seed_of_an_id_counts_in_ownership_and_the_first_in_packages(spark):
    seeds = spark.createDataFrame([("a", f"p{k}", f"purpose {k}", None, f"d{k}.md", None, origin, k) for k, origin in ((0, "frontmatter"), (1, "frontmatter"), (0, "path"))], tables.SEED)
    none = spark.createDataFrame([], tables.OWNERSHIP)
    packages = handoff.merge_packages(none, spark.createDataFrame([], tables.DISCOVERED), seeds)
    assert [tuple(r)[:2] for r in packages.collect()] == [("a", "p0")]
    know = handoff.build_knowledge(spark.createDataFrame([], "path string, raw string"), config.Settings())
    own = handoff.build_ownership(packages, none, seeds, know, human.empty(spark), config.Settings()).first()
    assert (own["path"], own["purpose"], own["agentDoc"]) == ("p0", "purpose 0", "d0.md")


def test_an_empty_path_that_nothing_fills_is_null(spark):
    own = spark.createDataFrame([("a", ""), ("b", ""), ("c", ""), ("d", "own")], "id string, path string")
    found = spark.createDataFrame([("b", "found", None, None, 0)], tables.DISCOVERED)
    seeds = spark.createDataFrame([("c", "seed", None, None, None, None, "path", 0), ("d", "seed", None, None, None, None, "path", 1)], tables.SEED)
    got = handoff.merge_packages(own, found, seeds)
    assert {r["id"]: r["path"] for r in got.collect()} == {"a": None, "b": "found", "c": "seed", "d": "own"}


def test_human_documents_meet_without_a_broadcast(spark):
    packages = spark.createDataFrame([("a",), ("@x/b",), ("c",), ("d-pattern",)], "id string")
    pages = spark.createDataFrame([("packages/a", "/a", 0), ("site/a", "/late", 1), ("b", "/b", 2), ("x/c/index", "/c", 3)], "id string, url string, pos long")
    got = handoff.human_doc_match(packages, pages)
    assert {tuple(r) for r in got.collect()} == {("a", "/a"), ("@x/b", "/b"), ("c", "/c")}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_lookups(spark):
    settings, ix, _ = built(spark)
    ids = spark.createDataFrame([("auth",), ("nope",)], "id string")
    assert {r["id"]: r["found"] for r in handoff.resolve(ids, ix.handoff).collect()} == {"auth": True, "nope": False}
    intents = spark.createDataFrame([("i", "old", ["x"], 0), ("i", "new", ["y", "z"], 1)], tables.INTENT)
    got = handoff.resolve_intent(spark.createDataFrame([("i",)], "id string"), intents).first()
    assert got["startHere"] == "y" and got["notes"] == ["new"]
    changes = spark.createDataFrame([("c", "t", "s.md", None, 0)], tables.CHANGE)
    assert handoff.resolve_change(spark.createDataFrame([("c",)], "id string"), changes, settings).first()["readBeforeEditing"] == ["AGENTS.md", settings.index_doc]
    assert handoff.fetch_document(ix.knowledge, "docs/for-agents/top.mdx").first()["id"] == "top"


def test_adapters(spark):
    raw = lambda *rows: spark.createDataFrame([(p, t) for p, t in rows], "path string, raw string")
    urls = lambda df: {r["path"]: (r["id"], r["url"]) for r in df.collect()}
    meta = spark.createDataFrame([("", ["index", "./guide"]), ("guide", ["..."])], "dir string, pages array<string>")
    got = urls(human.fumadocs(raw(("index.md", ""), ("guide/(g)/a.md", "---\npackage: pa\n---\n"), ("hidden.md", ""), ("for-agents/x.md", ""), (".dot.md", "")), meta, "c", "/docs"))
    assert got == {"c/index.md": ("index", "/docs"), "c/guide/(g)/a.md": ("pa", "/docs/guide/a")}
    side = {"docs": ["intro", {"type": "category", "items": [{"type": "autogenerated", "dirName": "api"}], "link": {"type": "doc", "id": "cat"}}]}
    got = urls(human.docusaurus(raw(("intro.md", ""), ("api/x/x.md", ""), ("cat.md", "---\nslug: /c/\n---\n"), ("no.md", "")), "d", "/d", side))
    assert got == {"d/intro.md": ("intro", "/d/intro"), "d/api/x/x.md": ("api/x/x", "/d/api/x"), "d/cat.md": ("cat", "/d/c")}
    got = urls(human.vitepress(raw(("a.md", ""), ("b/index.md", ""), (".vitepress/c.md", ""), ("drafts/d.md", "")), "v", "/", False, ["drafts/**"]))
    assert got == {"v/a.md": ("a", "/a.html"), "v/b/index.md": ("index", "/b")}
    got = urls(human.starlight(raw(("Big Guide/A b.md", ""), ("_x.md", ""), ("d.md", "---\ndraft: true\n---\n"), ("s.md", "---\nslug: /t/\n---\n")), "s"))
    assert got == {"s/Big Guide/A b.md": ("A b", "big-guide/a-b"), "s/s.md": ("s", "t")}
    got = urls(human.nextra(raw(("a.md", ""), ("a/index.md", ""), ("index.md", "")), "n"))
    assert got == {"n/a/index.md": ("a", "/a"), "n/index.md": ("index", "/")} or got == {"n/a/index.md": ("a", "/a"), "n/index.md": ("index", "")}
    assert urls(human.plain_markdown(raw(("x.md", ""), ("y/z.md", "")), "docs", None, ["*.md"])) == {"docs/x.md": ("x", "x")}
    with pytest.raises(ValueError):
        human.vitepress(raw(), src_exclude=["x"] * 65)


def test_projects(spark):
    rows = spark.createDataFrame([(False, "libs/a", "@x/a", ["build", "test"], 0), (True, "libs/a", "a", ["lint"], 1), (False, "libs/b", "b", [], 2), (True, "libs/c", "b", [], 3), (True, "bad", "-no", [], 4)], "project_json boolean, path string, name string, targets array<string>, pos long")
    got = {r["id"]: r for r in handoff.ranked_projects(rows, strict=True).collect()}
    assert set(got) == {"a", "b"} and got["a"]["name"] == "a" and got["a"]["checks"] == ["npx nx run a:test", "npx nx run a:lint"] and got["b"]["collides"] and got["b"]["checks"] is None


def test_gates_and_settings(spark):
    docs = spark.createDataFrame([("i.md", ""), ("a.md", "---\ntype: guide\nowner: x\npurpose: y\n---\n# T"), ("b.md", "---\ntype: odd\n---\n# T\nTODO")], "path string, raw string")
    s = config.parse({"preset": "strict", "agent_index": "i.md", "allowed_types": ["guide"]})
    assert config.gate_ids(s) == ["index-freshness", "human-guide-links", "okf-type", "docs-style"]
    t, style = gates.type_gate(docs, s).first(), gates.style_gate(docs, s).first()
    assert (t["ok"], t["message"]) == (False, "Missing or invalid OKF type frontmatter: b.md") and style["message"] == "Docs style issues: b.md (purpose, owner-source, no-stale-wording)"
    assert gates.type_gate(docs, config.Settings()).first()["ok"]
    with pytest.warns(UserWarning):
        assert config.gate_ids(config.parse({"gates_include": ["link-rot", "docs-style"], "gates_exclude": ["index-freshness"]})) == ["docs-style"]
    with pytest.raises(ValueError):
        config.parse({"unknown": 1})


def test_doctor(spark):
    own = owners(spark, [("a", "p", None, "d.md"), ("b", "p", None, "i.md")]).withColumn("humanDoc", F.when(F.col("id") == "a", "/h"))
    g = spark.createDataFrame([("index-freshness", True, "m", None, None), ("okf-type", False, "bad", None, None)], tables.GATE_RESULT)
    none = spark.createDataFrame([(0, 0)], "docs long, indexed long")
    r = doctor.score(doctor.coverage(own, "i.md"), none, g, True, True).first()
    assert (r["score"], r["grade"], r["handoff_pct"]) == (15 + 15 + 18 + 10 + 5, "C", 50)
    found = doctor.issues(own, g, "i.md", True, True)
    assert [x["code"] for x in found.orderBy("kind", "pos").collect()] == ["missing-agent-doc", "missing-human-doc", "gate-okf-type"]
    acts = [x["action"] for x in doctor.next_actions(found, own, "i.md").orderBy("n").collect()]
    assert acts[1:] == ["waymark bootstrap agent-docs", "waymark gate run", "waymark query package b --agent"]
    assert not doctor.healthy(found, g).first()["ok"] and doctor.badge(doctor.score(doctor.coverage(own, "i.md"), none, g, True, True)).first()["markdown"].count("%25") == 2


def test_conformance(spark):
    files = spark.createDataFrame([("R.md", 5, "a b"), ("E.md", 0, ""), ("N.bin", 9, None)], "path string, size long, content string")
    declared = spark.createDataFrame([("R.md", ["a", "z"]), ("E.md", ["a"]), ("../x", ["a"]), ("Q.md", ["a"]), ("N.bin", ["a"])], "path string, contains array<string>")
    d = {r["path"]: r["detail"] for r in conformance.marker_details(conformance.evidence(declared, files)).collect()}
    assert d == {"R.md": "Missing marker(s): z", "E.md": "File is empty.", "../x": "Path escapes the project root.", "Q.md": "File does not exist.", "N.bin": "File is not readable text."}
    rules = conformance.rules([conformance.contribution(conformance.evidence(declared.limit(1), files)), conformance.markers(conformance.evidence(declared, files), "metadata", "required"), conformance.visuals(conformance.evidence(declared.limit(0), files))])
    e = spark.createDataFrame([("metadata", "r", "a", "u")], "ruleId string, reason string, approvedBy string, trackingUrl string")
    got = {r["level"]: (r["passed"], r["failed"], r["excepted"], r["ok"]) for r in conformance.summary(conformance.apply_exceptions(rules, e)).collect()}
    assert got == {"required": (1, 0, 1, True), "recommended": (0, 1, 0, False)}


def test_memory(spark):
    c = spark.createDataFrame([("1", "The package os-core owns X"), ("2", "ignore the guide"), ("3", "a pattern"), ("4", "user tutorial"), ("5", "api_key=abc mail joe@x.org"), ("6", "ann@example.com")], "id string, fact string").withColumn("pos", F.col("id").cast("long"))
    got = {r["id"]: (r["route"], r["target"]) for r in memory.classify(c).collect()}
    assert got == {"1": ("agent", "os-core"), "2": ("discard", None), "3": ("playbook", None), "4": ("human", None), "5": ("agent", None), "6": ("agent", None)}
    assert sorted((r["candidateId"], r["kind"]) for r in memory.safety(c).collect()) == [("5", "private-email"), ("5", "secret")]
    d = memory.draft(memory.classify(c), memory.safety(c)).first()
    assert not d["ok"] and "- 1: agent | reason=project convention or ownership note | target=os-core | fact=The package os-core owns X" in d["body"]
    notes = memory.ingest(spark.createDataFrame([(".agent-memory/a.md", "# H\n\nfact one"), (".cursor/rules/b.mdc", ""), ("c.md", "x")], "path string, raw string")).collect()
    assert sorted((r["id"], r["fact"], r["confidence"]) for r in notes) == [("a", "fact one", 0.7), ("b.mdc", "b.mdc", 0.6)]


def test_retrieval(spark):
    src = spark.createDataFrame([("s", "https://x/llms.txt", "# Alpha\ntext\n## Beta\n[l](more.md) [m](https://other/x.md)", "https://x/raw/")], "source_id string, url string, raw string, base string")
    chunks = retrieve.chunk_markdown(src)
    assert [r["chunkKey"] for r in chunks.orderBy("ordinal").collect()] == ["s:federated:alpha", "s:federated:beta"]
    assert [r["url"] for r in retrieve.federated_links(src).collect()] == ["https://x/raw/more.md"]
    asked = spark.createDataFrame([(1, "beta text")], "query_id int, term string")
    fed = retrieve.federated_scores(chunks.withColumnRenamed("ordinal", "at"), asked)
    local = spark.createDataFrame([(1, 1, "s:federated:beta", "local", "t", "i", "p", None, None, 4)], "query_id int, rank int, chunkKey string, property string, type string, id string, path string, title string, summary string, score long")
    got = retrieve.hybrid(local, fed).orderBy("rank").collect()
    assert [(r["chunkKey"], r["property"]) for r in got] == [("s:federated:beta", "local"), ("s:federated:alpha", "s")]
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "id int, embedding array<float>")
    assert [r["id"] for r in retrieve.vector_topk(v, v.where("id = 3").withColumnRenamed("id", "query_id"), 2).orderBy("rank").collect()] == [3, 4]
    e = spark.createDataFrame([("e", ["Ｈello  World", "hi"])], "id string, aliases array<string>")
    assert retrieve.exact_answers(e, spark.createDataFrame([(1, " hello world ")], "query_id int, term string")).first()["id"] == "e"


@pytest.mark.parametrize("kept", [1, 40, 1 << 20])
def test_hybrid_of_chunks_is_hybrid_of_their_scores(spark, monkeypatch, kept):
    rng = random.Random(9)
    rows = [(f"k{j % 13}", "w", "federated", str(j), f"u/{j}", f"page {j}", " ".join(rng.choices(["alpha", "beta", "gammas", "x"], k=rng.randrange(4))), j) for j in range(90)]
    chunks = spark.createDataFrame(rows, "chunkKey string, property string, type string, id string, path string, title string, summary string, at long")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "!"), (4, "page alpha alpha"), (5, "unheard")], "query_id int, term string")
    local = spark.createDataFrame([(1, 1, "k3", "local", "t", "i", "p", None, None, 9), (2, 1, "mine", "local", "t", "i", "p", "t", "s", 5), (3, 1, "k1", "local", "t", "i", "p", None, None, 1)], "query_id int, rank int, chunkKey string, property string, type string, id string, path string, title string, summary string, score long")
    want = sorted(map(tuple, retrieve.hybrid(local, retrieve.federated_scores(chunks, asked)).collect()), key=str)
    monkeypatch.setattr(retrieve, "KEPT", kept)
    got = retrieve.hybrid_of(local, chunks.repartition(3), asked)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 20
    assert "summary" not in retrieve.best_federated(chunks, asked).columns  # texts are not dealt out with every query


def test_sinks(spark):
    k = knowledge(spark, [("a", "A", "docs/a b.md", "desc", ""), ("b", "B", "docs/b.md", None, "")])
    text = sinks.llms_text(k, "demo", None, "https://x/base", "docs").first()["content"]
    assert text.endswith("## Knowledge\n\n- [A](https://x/base/a%20b): desc\n- [B](https://x/base/b)\n")
    pages = spark.createDataFrame([("p", "/p", "d/p.md", 0), ("q", "/q", "d/q.md", 1)], tables.HUMAN_DOC)
    made = sinks.missing_drafts(pages, spark.createDataFrame([("docs/for-agents/human/q.md",)], "path string"), spark.createDataFrame([("d/p.md", "---\nx: 1\n---\nbody")], "path string, raw string"))
    assert [r["path"] for r in made.collect()] == ["docs/for-agents/human/p.md"] and "# p\n\nDraft generated" in made.first()["content"] and "## Source summary\n\nbody\n" in made.first()["content"]


def test_debounce_as_a_stream_equals_the_batch(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:00.{ms:03d}") for ms in (0, 100, 300, 900)] + [("b", "2024-01-01 00:00:01.000"), ("a", "2024-01-01 01:00:00.000")]
    frame = lambda rows: spark.createDataFrame(rows, "root string, at string").select("root", F.to_timestamp("at").alias("ts"))
    events, source, seen = frame(rows), str(tmp_path / "in"), []
    events.coalesce(1).write.parquet(source)
    changes = lambda: spark.readStream.schema(events.schema).parquet(source)
    told = lambda df: sorted((r["key"], str(r["start"]), r["n"]) for r in df)
    assert rebuild.open_sessions(spark, str(tmp_path / "ck")).count() == 0
    rebuild.run(changes(), lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"))
    batch = rebuild.debounce(events, "root").collect()
    assert told(seen) == told(batch) and {(r["key"], r["n"]) for r in batch} == {("a", 3), ("a", 1), ("b", 1)}
    # later changes: what was flushed isn't sent again, and the new last session is
    more = frame([("b", "2024-01-01 03:00:00.000"), ("c", "2024-01-01 03:00:00.100")])
    more.coalesce(1).write.mode("append").parquet(source)
    rebuild.run(changes(), lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"))
    assert told(seen) == told(rebuild.debounce(events.unionByName(more), "root").collect())
    assert rebuild.flush(spark, lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck")) == 0


def test_flush_by_a_time(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:09")], "root string, at string").select("root", F.to_timestamp("at").alias("ts"))
    events.coalesce(1).write.parquet(source)
    rebuild.start(spark.readStream.schema(events.schema).parquet(source), lambda df, _: seen.extend(df.collect()), str(tmp_path / "ck"), late="1 hour").awaitTermination()
    keep = lambda df, _: seen.extend(df.collect())
    assert not seen and rebuild.flush(spark, keep, str(tmp_path / "ck"), "2024-01-01 00:00:05") == 1 and [r["key"] for r in seen] == ["a"]
    assert rebuild.flush(spark, keep, str(tmp_path / "ck")) == 1 and [r["key"] for r in seen] == ["a", "b"]


def test_hidden_files_are_scanned_and_links_are_not(spark, tmp_path):
    for name in (".agent-memory/a.md", ".cursor/rules/b.mdc", "docs/_x/d.md", "docs/c.md", "docs/.hidden.md", "node_modules/n.md", "docs/coverage/n.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    (tmp_path / "docs/link.md").symlink_to(tmp_path / "docs/c.md")
    (tmp_path / "docs/loop").symlink_to(tmp_path, target_is_directory=True)
    assert sorted(r["path"] for r in files.scan_markdown(spark, str(tmp_path)).collect()) == [".agent-memory/a.md", "docs/.hidden.md", "docs/_x/d.md", "docs/c.md"]
    assert sorted((r["source"], r["fact"]) for r in memory.ingest(files.scan_notes(spark, f"file://{tmp_path}")).collect()) == [("agent-memory", ".agent-memory/a.md"), ("cursor", ".cursor/rules/b.mdc")]
    assert files.scan_files(spark, str(tmp_path), []).count() == 0
    with pytest.raises(files.LimitError):
        files.scan_markdown(spark, str(tmp_path), max_files=3)


def test_settings_from_disk(tmp_path, monkeypatch):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "waymark.config.json").write_text('{"project": "p", "human": {"plugin": "nextra", "options": {"root": "a"}}}')
    settings, root = config.load(str(tmp_path / "a/b"))
    assert settings.project == "p" and root == str(tmp_path) and len(settings.human) == 1
    assert rebuild.watch_roots(settings, root) == [str(tmp_path / "a"), str(tmp_path)]
    assert config.contained(root, "a/b") == str(tmp_path / "a/b") and config.contained(root, "../x") is None
    (tmp_path / "out").symlink_to("/")
    assert config.contained(root, "out/etc") is None
    (tmp_path / "waymark.config.json").write_text("[]")
    with pytest.raises(ValueError):
        config.load(root)
    assert files.project_name(root) == tmp_path.name and files.project_name(root, "own") == "own"
    (tmp_path / "package.json").write_text('{"name": "@x/p", "packageManager": "yarn@4", "workspaces": ["a"]}')
    assert files.project_name(root) == "@x/p" and files.package_manager(root) == "yarn" and files.is_workspace(root)
    (tmp_path / "bun.lock").write_text("")
    assert files.package_manager(root) == "bun"


def test_federation_from_files(spark, tmp_path):
    (tmp_path / "llms.txt").write_text("# Top\n[a](more.md)\n[gone](none.md)")
    (tmp_path / "more.md").write_text("text\n## Part")
    fetch = lambda address: files.fetch_text(address, str(tmp_path))
    sources = files.federated_sources(spark, [{"id": "s", "llmsTxt": "llms.txt"}, {"id": "away", "llmsTxt": "http://127.0.0.1:9/none"}], lambda a: files.fetch_text(a, str(tmp_path), 0.5))
    texts = files.fetch_texts(retrieve.federated_links(sources), fetch)
    assert [(r["title"], r["path"]) for r in retrieve.federated_chunks(sources, texts).orderBy("at").collect()] == [("Top", "llms.txt"), ("more", "more.md"), ("Part", "more.md")]


def test_published_index(spark):
    settings, ix, _ = built(spark, ownership={"auth": {"path": "src/auth"}}, intents=[{"id": "i", "title": "t", "paths": ["p"]}], changes=[{"id": "c", "title": "t", "startHere": "s"}])
    text = index.export(ix, settings, "demo", "2024-01-01T00:00:00.000Z")
    data = json.loads(text)
    payload = {k: data[k] for k in ("schemaVersion", "knowledge", "handoffs", "lookup")}
    assert data["contentHash"] == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert list(data) == ["schemaVersion", "contentHash", "contentHashAlgo", "generatedAt", "project", "knowledge", "handoffs", "lookup"]
    assert data["lookup"]["packages"] == sorted(data["handoffs"]) and data["handoffs"]["billing"]["editRoots"] == ["src/billing"] and data["lookup"]["changes"]["c"]["startHere"] == "s"
    assert index.export(ix, settings, "demo", "2025-01-01T00:00:00.000Z", text) == text != index.export(ix, settings, "demo", "2025-01-01T00:00:00.000Z", "broken")


def test_names_are_in_the_order_of_people(spark):
    names = ["b", "A", "a", "B", "é", "z", "10"]
    packages = spark.createDataFrame([(n, "p", None, None) for n in names], "id string, path string, name string, checks array<string>")
    none, know = spark.createDataFrame([], tables.OWNERSHIP), handoff.build_knowledge(spark.createDataFrame([], "path string, raw string"), config.Settings())
    own = handoff.build_ownership(packages, none, spark.createDataFrame([], tables.SEED), know, human.empty(spark), config.Settings())
    assert [r["id"] for r in own.orderBy("pos").collect()] == ["10", "a", "A", "b", "B", "é", "z"]
    rows = spark.createDataFrame([("x", "x", "x", None, 0, True), ("y", "y", "y", None, 1, False)], "id string, path string, name string, checks array<string>, pos long, collides boolean")
    with pytest.raises(ValueError):
        handoff.checked_projects(rows)
    assert handoff.checked_projects(rows.where("not collides")).count() == 1


def test_messages_and_drafts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(gates, "LISTED", 2)
    monkeypatch.setattr(memory, "DRAFT_LINES", 2)
    docs = spark.createDataFrame([(f"{k}.md", "") for k in range(5)], "path string, raw string")
    got = gates.type_gate(docs, config.parse({"require_type": True})).first()
    assert (got["message"], got["actual"]) == ("Missing or invalid OKF type frontmatter: 0.md, 1.md, and 3 more", "5 invalid")
    notes = memory.classify(spark.createDataFrame([(str(k), f"fact {k}", k) for k in range(5)], "id string, fact string, pos long"))
    body = memory.draft(notes, memory.safety(notes)).first()["body"]
    assert "- 1: agent" in body and "- 2: agent" not in body and "- and 3 more" in body


def test_written_tables(spark):
    rows = spark.createDataFrame([(1, ["a"], None), (None, [], "x")], "k long, v array<string>, group string")
    got = tables.written(rows)
    assert got.schema == rows.schema and sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    none = tables.written(rows.limit(0))
    assert none.schema == rows.schema and none.count() == 0
    folder = tables.shared_dir(spark)
    assert got.written_at.startswith(folder) and os.path.isdir(got.written_at)
    tables.drop(got, none)
    assert not os.path.exists(got.written_at) and not os.path.exists(none.written_at)


def test_schemas():
    doc = validate.json_schema("handoff")
    assert doc["required"] == ["type", "source", "target", "startHere", "readBeforeEditing", "editRoots", "checks", "notes"]
    assert doc["properties"]["target"]["required"] == ["type", "id"] and doc["properties"]["checks"] == {"type": "array", "items": {"type": "string", "minLength": 1, "maxLength": 256}, "maxItems": 32}
    assert validate.json_schema("candidate")["properties"]["confidence"] == {"type": "number", "minimum": 0, "maximum": 1}


def test_facade(spark, tmp_path):
    settings, ix, pages = built(spark, ownership={"auth": {"path": "src/auth"}})
    now = index.write(ix, str(tmp_path / "ix"))
    w = Waymark(spark, str(tmp_path / "ix"), settings)
    assert w.handoff_resolve("auth").first()["editRoots"] == ["src/auth"] and w.search("auth").first()["id"] == "auth"
    assert w.document("billing").first()["title"] == "Billing" and w.retrieve("billing", 1).first()["chunkKey"] == "local:ownership:billing"
    assert w.gate_status(spark.createDataFrame(DOCS, "path string, raw string"), pages, now).first()["all_ok"]
    assert [r["id"] for r in w.listing("packages").collect()] == [r["id"] for r in ix.ownership.orderBy("pos").collect()] and json.loads(w.capabilities("demo"))["contentHash"] == now
    (tmp_path / ".agent-memory").mkdir()
    (tmp_path / ".agent-memory/n.md").write_text("The package auth owns this")
    assert w.memory_draft(w.memory_ingest(str(tmp_path)).withColumn("pos", F.lit(1))).first()["ok"]
    for call in (lambda: w.handoff_resolve("nope"), lambda: w.document("nope")):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError):
        w.search("x", 1000)
    with pytest.raises(FileNotFoundError):
        Waymark(spark, str(tmp_path / "none"), settings)


def test_files(spark, tmp_path):
    for name, body in {"docs/a.md": "# A", "docs/node_modules/x.md": "no", "p/one/package.json": '{"name": "@s/one"}', "p/two/package.json": "broken", "p/three/project.json": '{"targets": {"test": {}}}', "pnpm-lock.yaml": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    root = str(tmp_path)
    assert [tuple(r) for r in files.scan_markdown(spark, root).collect()] == [("docs/a.md", 3, "# A")]
    with pytest.raises(files.LimitError):
        files.scan_markdown(spark, root, max_bytes=2)
    manifests = files.scan_manifests(spark, root)
    assert [tuple(r)[:3] for r in files.discover_packages(manifests, ["p/*"]).collect()] == [("one", "p/one", "@s/one")]
    assert [(r["id"], r["checks"]) for r in handoff.ranked_projects(files.project_rows(manifests)).collect()] == [("three", ["npx nx run three:test"])]
    assert files.package_manager(root) == "pnpm" and files.workspace_patterns("packages:\n  - 'a/*'\n  - b\nother: x\n- no") == ["a/*", "b"]
    src = files.federated_sources(spark, [{"id": "s", "llmsTxt": "u", "rawBaseUrl": "b"}, {"id": "t", "llmsTxt": "bad"}, {"id": "o", "llmsTxt": "u", "includeInRetriever": False}], lambda u: {"u": "text"}[u])
    assert [tuple(r) for r in src.collect()] == [("s", "u", "text", "b")]
