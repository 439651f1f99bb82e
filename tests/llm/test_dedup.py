"""Line dedup and SimHash classes against brute force."""

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.llm import line_dedup, simhash

SCHEMA = "doc_id long, text string, fingerprint string, component_id string, row int, line string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], SCHEMA)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def brute_lines(rows, min_chars=line_dedup.MIN_CHARS, near_chars=line_dedup.NEAR_CHARS, edits=line_dedup.EDITS):
    seen, out = [], {}
    placed = sorted({(i is None, i or 0, t or "") for i, t in rows})
    for none, i, t in placed:
        kept = []
        for line in t.split("\n"):
            own = line_dedup.canonical(line)
            if len(own) < min_chars:
                kept.append(line)
                continue
            if not any(own == s or (edits and min(len(own), len(s)) >= near_chars and abs(len(own) - len(s)) < 2 and distance(own, s) <= 1) for s in seen):
                kept.append(line)
            seen.append(own)
        out[None if none else i, t] = "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(10, 60))).strip() + "end" for _ in range(25)]

    def edit(s):
        k = rng.randrange(len(s))
        return rng.choice([s, s[:k] + s[k + 1 :], s[:k] + "q" + s[k:], s[:k] + "Q" + s[k + 1 :], s.upper(), s.replace(" ", "  ")])

    rows = [(i, "\n".join(edit(edit(rng.choice(base))) if rng.random() < 0.8 else "short" for _ in range(6))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, base[0]), (3, rows[3][1])]
    expected = brute_lines(rows)
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None:
            assert r["doc_id"] == 100
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in got if r["text"] is not None)
    assert texts == sorted((i if i is not None else -1, expected[i, t]) for i, t in rows if t is not None)


def test_one_edit_matches_the_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(2))
        assert line_dedup.within_one(a, b) == (distance(a, b) <= 1), (a, b)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(docs(spark, [(1, None), (None, "")])).count() == 2
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_a_very_long_line(spark):
    long = "word " * 40_000
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(docs(spark, [(1, long), (2, long + "x"), (3, "y" + long[1:])])).collect()}
    assert got == {1: 1, 2: 1, 3: 0}  # 2 adds a blank and a letter, 3 has another letter


@pytest.mark.parametrize(("min_chars", "near_chars", "edits"), [(1, 16, 1), (1, 64, 1), (1, 16, 0), (4, 16, 1), (64, 64, 1)])
def test_bounds_are_parameters(spark, min_chars, near_chars, edits):
    rows = [(1, "abc\nOne line of letters"), (2, "abc\none  line of letters\nABC\nown"), (3, "One line of lettersx\nother"), (4, "new line without a peer\nabd")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows), "doc_id", "text", min_chars, near_chars, edits).collect()}
    assert got == {i: text for (i, _), text in brute_lines(rows, min_chars, near_chars, edits).items()}


def test_clashing_names(spark):
    names = ["doc_id", "text", "own", "an_id", "A_ROW", "of_it", "own_text", "row_hash", "is_repeated", "a.b", "_deduped2"]
    rows = [(1, "The same line stands here"), (2, "The same line stands here"), (None, "The same line stands here"), (3, None)]
    frame = spark.createDataFrame([(i, t, *["v"] * 9) for i, t in rows], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    done = line_dedup.with_lines_deduped(frame)
    assert done.columns == [*names, "_deduped"] and {r["doc_id"]: r["_deduped"]["n_kept"] for r in done.collect()} == {1: 1, 2: 0, None: 0, 3: 1}
    kept = simhash.one_of_each(frame)
    assert kept.columns == names and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_written_tables_are_dropped(spark, tmp_path):
    from waymark.llm import common

    since = common.mark()
    kept = common.materialize(spark.range(3).toDF("x"))
    gone = common.materialize(spark.range(3).toDF("x"))
    common.drop_since(spark, since, kept)
    assert kept.count() == 3 and os.path.isdir(kept.written_at) and not os.path.exists(gone.written_at)
    common.drop(kept)
    assert not os.path.exists(kept.written_at)
    assert common.folder_for("hdfs://x/y/", "spark://z") == "hdfs://x/y" and common.folder_for(None, "local[2]").startswith("/tmp/")
    for master in ("spark://z", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            common.folder_for(None, master)


@pytest.mark.parametrize("share", [1 / 512, 0.2, 2.0])
def test_hot_keys_join_like_others(spark, monkeypatch, share):
    from waymark.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.createDataFrame([(k, k % 7 if k % 3 else 0) for k in range(100)], "x long, k long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3").withColumns({"v": F.col("k") * 2, "w": F.col("n")})
    got = sorted(tuple(r) for r in common.join_hot(rows, table, "k", "n", 100).select("x", "k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in rows.join(table, "k").select("x", "k", "v", "w").collect())


def plain_fingerprint(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "One Two three", "a b c d e É é ÀB", "x y z\x0bw \x1c q", "repeat me " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                a_root, b_root = find(i), find(j)
                root[max(a_root, b_root)] = min(a_root, b_root)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("cell_max", [1, 4, 64])
def test_links_keep_all_components(spark, cell_max):
    """Also where cells are so crowded that no pairs are made in them."""
    rng = random.Random(cell_max)
    fps = {0}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(12):
            fps.add(at)
            for _ in range(rng.choice([1, 2, 2, 3])):
                at ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), cell_max, 5)
    from waymark.llm.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    roots = components(fps)
    classes = {}
    for x, r in zip(signed, roots, strict=True):
        classes.setdefault(r, set()).add(x)
    mine = {}
    for x in signed:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_simhash_classes(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(5, text), (3, text), (9, text.upper()), (1, "other words stand here"), (2, None), (4, ""), (7, "  "), (None, text), (1, "other words stand here"), (8, "x" * 200_000)]
    got = simhash.simhash_classes(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by == {5: 3, 3: 3, 9: 3, None: 3, 1: 1, 2: 2, 4: 2, 7: 2, 8: 8}
    kept = simhash.one_of_each(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id", "row", "line"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 8]
    shared = [(1, "alpha beta gamma delta"), (1, "quite another text of words"), (2, "a third text that shares nothing"), (1, "alpha beta gamma delta")]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs(spark, shared)).collect()) == sorted(set(shared))
    assert simhash.simhash_classes(docs(spark, [])).count() == 0
