"""Fill-in-middle, spelling variants and vector search against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from waymark.llm import fill_middle, multi_index, spelling
from waymark.llm.fill_middle import Sentinels

RNG = random.Random(5)
SCHEMA = "doc_id long, text string, n long, output string, form string, fim string"


def plain_fim(doc_id, text):
    """(n, form, prefix, middle, output), by slices."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_text(n):
    return "".join(RNG.choice(list("ab é日😀\n\t<PSM>́\u0000") + ["<P", "S>"]) for _ in range(n))


def test_fill_middle(spark):
    texts = [None, "", "a", "<P>", "x<M>y", "<", "<S", "日" * 3, *[odd_text(RNG.randrange(0, 60)) for _ in range(300)], *["word " * RNG.randrange(1, 9000) for _ in range(20)], "é" * 300_000]
    rows = [(k, t, 7, "o", "f", "m") for k, t in enumerate(texts)] + [(None, "null id here", 7, "o", "f", "m"), (2, "a", 7, "o", "f", "m")]
    out = fill_middle.transform(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "n", "output", "form", "fim", "n_", "form_", "prefix_chars", "middle_chars", "output_"]
    got = out.withColumn("back", fill_middle.restored(out["output_"], out["form_"])).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_"], r["form_"], r["prefix_chars"], r["middle_chars"], r["output_"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and (r["n"], r["fim"]) == (7, "m")
    assert {r["form_"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def depth_bound(rope):
    """Whether each node's parts differ in depth by one at most, and its counts are theirs."""
    if not isinstance(rope, fill_middle.Node):
        return True
    a, b = rope.left, rope.right
    return abs(a.depth - b.depth) <= 1 and rope.units == a.units + b.units and rope.points == a.points + b.points and depth_bound(a) and depth_bound(b)


@pytest.mark.parametrize("pattern", [None, r"\w+\s*", r"a", r"(?=b)|x"])
def test_ropes(pattern):
    unit = pattern and re.compile(pattern)
    for _ in range(200):
        text = odd_text(RNG.randrange(0, 300))
        rope = fill_middle.rope_of(text, unit, RNG.randrange(1, 9))
        units = [u for leaf in fill_middle.leaves(rope) for u in (leaf.text if leaf.ends is None else [leaf.text[a:b] for a, b in zip((0, *leaf.ends), leaf.ends, strict=False)])]
        assert "".join(units) == text == fill_middle.text_of(rope) and len(units) == rope.units and depth_bound(rope)
        for _ in range(5):
            k, p = RNG.randrange(len(units) + 1), RNG.randrange(len(text) + 1)
            left, right = fill_middle.split(rope, k)
            assert fill_middle.text_of(left) == "".join(units[:k]) and fill_middle.text_of(right) == "".join(units[k:])
            assert left.units == k and right.units == len(units) - k and depth_bound(left) and depth_bound(right)
            a, b = fill_middle.split(rope, p, "points")
            assert fill_middle.text_of(a) == text[:p] and fill_middle.text_of(b) == text[p:]
            assert depth_bound(both := fill_middle.join(right, left)) and fill_middle.text_of(both) == "".join(units[k:] + units[:k])
        for form in (fill_middle.PSM, fill_middle.SPM):
            if any(m in text for m in Sentinels().each):
                continue
            a, b = sorted((RNG.randrange(len(units) + 1), RNG.randrange(len(units) + 1)))
            out, prefix, middle = fill_middle.rearrange(rope, a, b, form, Sentinels())
            assert (prefix, middle) == (len("".join(units[:a])), len("".join(units[a:b])))
            assert fill_middle.restore(fill_middle.text_of(out), form, Sentinels()) == text


def test_sentinels():
    for bad in (("", "b", "c"), ("a", "a", "c"), ("ab", "bc", "d"), ("aba", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError):
            Sentinels(*bad)
    with pytest.raises(ValueError):
        fill_middle.restore("<S>a<P>b<M>c", fill_middle.PSM, Sentinels())


def one_edit(a, b):
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, least, ratio):
    words = {w: n for w, n in counts.items() if n >= least}
    out = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        form = min(near, default=(0, None))
        out[w] = [n, len(near), form[1] if -form[0] >= ratio * n else None]
    for w, row in out.items():
        at = w
        while out[at][2]:
            at = out[at][2]
        row.append(at)
    return out


def check_variants(got, counts, least, ratio):
    want = plain_variants(counts, least, ratio)
    assert {r["word"]: [r["n"], r["n_near"], r["form"], r["root"]] for r in got} == want and len(got) == len(want)
    assert all(r["form_n"] == (want[r["form"]][0] if r["form"] else None) for r in got)
    return want


def test_spelling_of_texts(spark):
    stems = ["banana", "Bananna", "ananas", "ÉTUDES", "études", "straße", "strasse", "letter", "lettter", "aaaaaa", "aaaaaaa", "x×÷yzzz"]
    texts = [None, "", "12 !", "short words only", *[" ".join(RNG.choices(stems, [60, 2, 40, 1, 30, 3, 20, 40, 1, 30, 1, 1])[0] + RNG.choices(["", "s", "z"], [30, 3, 1])[0] for _ in range(RNG.randrange(1, 60))) + "日" for _ in range(150)]]
    rows = [(k, t, 1, "o", "f", "m") for k, t in enumerate(texts)] + [(None, "banana banana", 1, "o", "f", "m"), (9, texts[9], 1, "o", "f", "m")]
    counts = Counter()
    for k, t, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    made = spelling.word_counts(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("output", "word"), drop_every=199)
    assert {r["word"]: r["n"] for r in made.collect()} == counts
    want = check_variants(spelling.spelling_variants(made).collect(), counts, 5, 5)
    assert any(r[2] for r in want.values())
    empty = spelling.word_counts(spark.createDataFrame([], SCHEMA))
    assert spelling.spelling_variants(empty).count() == 0


def test_spelling_of_counts(spark):
    words = ["", "a", "b", "ab", "aab", "aaab", "😀a", "😀b", "日本", "日木", *{"".join(RNG.choice("abé") for _ in range(RNG.randrange(1, 7))) for _ in range(150)}]
    counts = {w: RNG.choice([1, 2, 3, 6, 7, 20, 60, 61, 400]) for w in words}
    frame = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [("a", 4, "x"), (None, 9, "x")], "word string, n long, root string")
    counts["a"] += 4
    del counts[""]
    want = check_variants(spelling.spelling_variants(frame, 2, 3).collect(), counts, 2, 3)
    assert max(sum(w != r[3] for w, r in want.items()), 0) > 20
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame, 2, 1)


def test_spelling_of_long_words(spark):
    long = "".join(RNG.choice("abcd") for _ in range(30_000))
    frame = spark.createDataFrame([(long, 50), (long[:777] + "x" + long[777:], 5), (long[:-1], 6), ("b" + long[1:] if long[0] != "b" else "a" + long[1:], 7)], "word string, n long")
    began = time.time()
    got = {len(r["word"]): r for r in spelling.spelling_variants(frame).collect() if r["word"] != long}
    assert {r["form"] for r in got.values()} == {long} and {r["n_near"] for r in got.values()} == {1} and time.time() - began < 60


def test_pieces_and_hashes(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    outside = re.compile(r"[^a-z]")
    for _ in range(200):
        text = "".join(RNG.choice("abc ,") for _ in range(RNG.randrange(0, 80)))
        pieces = list(spelling._pieces(text, outside))
        assert "".join(pieces) == text and [w for p in pieces for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)
    alphabet = np.array([ord(c) for c in "abc"], np.uint64)
    for word in ("a", "abba", "aab", "cccc"):
        made = [int(k) for keys, *_ in spelling.offers(word, alphabet) for k in keys.view(np.int64)]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + d :] for i in range(len(word) + 1) for c in "abc" for d in (0, 1) if i + d <= len(word)}
        want = {w for w in want if w and w != word}
        assert sorted(made) == sorted(map(spelling.hash_of, want))


VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def plain_nearest(rows, k):
    """{query: [(id, distance)]} of all valid rows by brute force."""
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    common = Counter(len(v) for _, v in rows)
    dims = min(common, key=lambda d: (-common[d], d))
    rows = [(i, v) for i, v in rows if len(v) == dims]
    return {i: sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != i)[:k] for i, v in rows}


def near_rows(spark, rows, k=10, **options):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)
    got, dims = multi_index.prepared(frame)
    book = multi_index.fit(got, dims, k)
    out = {}
    for r in multi_index.search(multi_index.build_index(got, book), got, book, k, **options).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: [(s, v) for n, s, v in sorted(found)] for q, found in out.items()}, book


def test_neighbours_of_odd_rows(spark):
    rows = [(k, [float(RNG.randrange(-3, 4)) for _ in range(5)]) for k in range(300)]
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [1.0, None, 1.0, 1.0, 1.0]), (404, [float("nan")] * 5), (405, [float("inf")] * 5), (406, [1.0] * 4), (None, [1.0] * 5)]
    rows += [(500 + k, [1.0, 2.0, 1.0, 0.0, 1.0]) for k in range(40)]
    want = plain_nearest(rows, 10)
    got, book = near_rows(spark, rows, radius=5)
    assert got == want
    some, _ = near_rows(spark, rows, radius=0)  # too small a ball is widened
    assert some.keys() == want.keys() and all(len(v) == 10 for v in some.values())
    few, _ = near_rows(spark, rows[:4])
    assert few == plain_nearest(rows[:4], 10) and all(len(v) == 3 for v in few.values())
    assert near_rows(spark, rows[:1])[0] == {} == near_rows(spark, [])[0] == near_rows(spark, [(1, None), (2, [0.0])])[0]


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_neighbours_recall(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(multi_index, "BROADCAST_BYTES", broadcast_bytes)
    monkeypatch.setattr(multi_index, "SEGMENT_BYTES", 200 * 8 * 32)
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", 150 * 8 * 32)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32)) + 2 * rng.normal(size=(12, 32))[rng.integers(0, 12, 1500)]
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())]
    want = plain_nearest(rows, 10)
    got, book = near_rows(spark, rows)
    assert book.radius < 32 and got.keys() == want.keys()
    assert np.mean([len({j for _, j in got[q]} & {j for _, j in want[q]}) / 10 for q in want]) >= 0.9
    exact, _ = near_rows(spark, rows, radius=32)
    assert exact == want


def test_probing_finds_every_code_of_the_ball():
    rng = np.random.default_rng(4)
    for bits, n in ((64, 3000), (64, 50), (13, 500), (1, 5), (40, 1)):
        codes = rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 1 << 64, n, dtype=np.uint64)
        codes[: n // 3] = codes[0]
        tables = multi_index.Tables(codes, bits)
        for r in range(0, bits + 1, max(1, bits // 9)):
            code = codes[rng.integers(n)] ^ np.uint64(1)
            assert tables.within(code, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= r).tolist()
