"""Language ID, toxicity and quality: exact parts against brute force, models by held-out accuracy."""

import random

import corpus_pipeline
import numpy as np
import pytest

from waymark.llm import language_id, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, held_out string, predicted int"


def longest_phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) + 1 and text[at : at + n] in sample:
            n += 1
        count += 1
        at += max(1, n - 1)
    return count


def test_phrases_match_brute_force():
    rng = random.Random(2)
    samples = {k: "".join(rng.choice(c) for _ in range(300)) for k, c in (("x", "abc "), ("y", "acde"))}
    model = language_id.LanguageModel(samples)
    texts = ["".join(rng.choice("abcdefg !") for _ in range(rng.randrange(0, 200))) for _ in range(30)] + ["a" * 5, "é", ""]
    codes = [language_id.symbols(t, model.table) for t in texts]
    got = model.phrases(codes)
    for k, c in enumerate(codes):
        for j, lang in enumerate(model.langs):
            sample = bytes(language_id.symbols(samples[lang], model.table).tolist())
            assert got[k, j] == longest_phrases(bytes(c.tolist()), sample)


@pytest.mark.parametrize("dense", [0, 1 << 30])
def test_every_letter_counts_in_wide_alphabets(monkeypatch, dense):
    monkeypatch.setattr(language_id, "DENSE_BYTES", dense)
    rng = random.Random(5)
    letters = [chr(0x4E00 + k) for k in range(400)]
    samples = {k: "".join(rng.choice(own) for _ in range(2000)) for k, own in (("x", letters[:250]), ("y", letters[150:]))}
    model = language_id.LanguageModel(samples)
    assert model.width == 402 and model.dense == (dense > 0)
    texts = ["".join(rng.choice([*letters, " ", "q"]) for _ in range(rng.randrange(1, 300))) for _ in range(20)] + [samples["y"][5:300], ""]
    codes = [language_id.symbols(t, model.table) for t in texts]
    got, plain = model.phrases(codes), lambda c: "".join(map(chr, c.tolist()))
    for k, c in enumerate(codes):
        for j, lang in enumerate(model.langs):
            assert got[k, j] == longest_phrases(plain(c), plain(language_id.symbols(samples[lang], model.table)))


def test_every_sampled_document_is_learned_from(spark):
    docs = spark.createDataFrame([(k, chr(0x4E00 + k) * 5000, "zz", 0.5, "x", 3) for k in range(150)], SCHEMA)
    learned = docs.where(~language_id.held_out()).count()
    assert learned > 100 and language_id.fit(docs).width == learned + 2
    assert language_id.level([5, 100, 100], 105) == 50 and language_id.level([1, 2], 9) == 2 and language_id.level([], 9) == 0


@pytest.mark.parametrize(("n", "floor"), [(0, 1.0), (1, 1.0), (4, 0.3), (40, 0.03)])
def test_language_floor_follows_the_number_of_languages(n, floor):
    assert corpus_pipeline.score_floor(n) == pytest.approx(floor)


@pytest.mark.parametrize(("dense", "abreast"), [(0, 2), (1 << 30, 2), (1 << 30, 24), (0, 1)])
def test_long_texts_are_parsed_whole(monkeypatch, dense, abreast):
    """Long and short texts in one batch, side by side and alone."""
    monkeypatch.setattr(language_id, "DENSE_BYTES", dense)
    monkeypatch.setattr(language_id, "ABREAST", abreast)
    rng = random.Random(abreast)
    samples = {"x": "".join(rng.choice("abc ") for _ in range(500)), "y": "".join(rng.choice("bcd ") for _ in range(700))}
    model = language_id.LanguageModel(samples)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (5000, 1, 3000, 1025, 1024, 1023, 40, 2)] + ["", samples["x"] * 3]
    codes = [language_id.symbols(t, model.table) for t in texts]
    got = model.phrases(codes)
    for k, c in enumerate(codes):
        for j, lang in enumerate(model.langs):
            assert got[k, j] == longest_phrases(bytes(c.tolist()), bytes(language_id.symbols(samples[lang], model.table).tolist()))


def test_two_scripts_and_many_languages(spark, monkeypatch):
    """Every language is learned, and languages with alphabets of their own are told apart by single letters."""
    monkeypatch.setattr(language_id, "TOTAL_CHARS", 40_000)
    rng, rows = random.Random(7), []
    for lang in range(80):
        letters = [chr(0x4E00 + 40 * lang + k) for k in range(40)]
        rows += [(100 * lang + k, "".join(rng.choice(letters) for _ in range(80)), f"l{lang}") for k in range(15)]
    docs = spark.createDataFrame([(i, t, lang, 0.5, "x", 3) for i, t, lang in rows], SCHEMA)
    model = language_id.fit(docs)
    assert len(model.langs) == 80
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in language_id.identify(docs, model).collect() if r["held_out"]]
    assert len(held) > 150 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    monkeypatch.setattr(language_id, "MAX_LANGS", 79)
    with pytest.raises(ValueError):
        language_id.fit(docs)


def words(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


STEMS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["eau", "oi", "que", "ent"]}


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, STEMS[lang], 40), lang) for k, lang in enumerate(rng.choice(list(STEMS)) for _ in range(150))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !! ", "bb"), (None, rows[0][1], None), (0, *rows[0][1:]), (903, words(rng, STEMS["bb"], 20_000), "bb")]
    docs = spark.createDataFrame([(i, t, lang, 0.5, "x", 3) for i, t, lang in rows], SCHEMA)
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == language_id.UNKNOWN and by[k]["score"] == 0 for k in (900, 901, 902))
    held = [(r, lang) for (i, _, lang), r in ((x, by[x[0]]) for x in rows if x[0] is not None and x[0] < 900) if r["held_out"]]
    assert len(held) > 10 and all(r["lang_pred"] == lang for r, lang in held)
    assert by[903]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got)
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert language_id.identify(docs, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0


def maximal_segments(w):
    """By the recursive definition: the best segment, then left and right of it."""
    if not len(w):
        return []
    best, at = 0, None
    for a in range(len(w)):
        for b in range(a + 1, len(w) + 1):
            s = sum(w[a:b])
            if s > best + 1e-12 or (at and abs(s - best) <= 1e-12 and (b - a) < at[1] - at[0]):
                best, at = s, (a, b)
    if at is None:
        return []
    a, b = at
    return maximal_segments(w[:a]) + [(a, b)] + [(x + b, y + b) for x, y in maximal_segments(w[b:])]


@pytest.mark.parametrize("seed", range(20))
def test_segments_match_the_definition(seed):
    rng = random.Random(seed)
    w = [rng.uniform(-1, 1) for _ in range(25)]
    assert sorted((a, b) for a, b, _ in toxicity.segments(np.array(w))) == sorted(maximal_segments(w))


def test_weights_law_and_calibration_match_plain_versions():
    rng = random.Random(12)
    draw = lambda n: [[rng.choice(["good", "gooder", "word", "vile", "vilest", "odd"][: 3 if n % 2 else 6]) for _ in range(12)] for _ in range(20)]
    toxic, clean = draw(2), draw(1)
    got = toxicity.weigh(toxic, clean)
    parts = lambda w: {w} | {w[:n] + "*" for n in (4, 5) if len(w) > n}
    seen = lambda docs, x: sum(any(x in parts(w) for w in d) for d in docs)
    every = {x for d in toxic + clean for w in d for x in parts(w)}
    na, nb = (sum(seen(docs, x) for x in every) for docs in (toxic, clean))
    expected = {}
    for x in every:
        a, b = seen(toxic, x), seen(clean, x)
        ya, yb = a + 0.05 * (a + b), b + 0.05 * (a + b)
        total = 0.05 * (na + nb)
        if a >= toxicity.MIN_TOXIC_DOCS:
            s = np.log(ya / (na + total - ya)) - np.log(yb / (nb + total - yb)) - toxicity.SHRINK * (1 / ya + 1 / yb) ** 0.5 - toxicity.DRIFT
            if s > 0:
                expected[x] = s
    assert got == pytest.approx(expected) and any(x.startswith("vil") for x in got)
    mixed = clean + [["vile", "word", "vilest", "good"]] * 60
    scale, location = toxicity.law(got, mixed)
    scores = toxicity.TokenScores(got)
    every = [scores[w] for d in mixed for w in d]
    assert sum(np.exp(scale * s) for s in every) / len(every) == pytest.approx(1, abs=1e-4)
    tops = [scale * max([s for *_, s in toxicity.segments(scores.of(d))], default=0) - np.log(len(d)) for d in mixed]
    assert location == pytest.approx(np.quantile(tops, 0.95) + np.log(-np.log(0.95)))
    x = np.array([rng.uniform(0, 3) for _ in range(40)] + [rng.uniform(2, 6) for _ in range(40)])
    y = np.array([0] * 40 + [1] * 40)
    wrong = lambda cut: ((x > cut) != y).sum()
    assert wrong(toxicity.calibrate(x, y)[1]) == min(wrong(c) for c in [*x, *(x - 1e-9), -1])


def test_fit_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_CHARS", 3000)
    docs = spark.createDataFrame([(k, f"w{k} " + ("vile " if k % 2 else "good ") * 200, "x", 0.5, "x", 3) for k in range(30)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int"))
    assert "vile" in model.weights and model.score("vile " * 5) > 0.5 > model.score("good " * 5)


def test_toxicity(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(300):
        text = words(rng, STEMS["aa"], 60).split()
        bad = k % 5 == 0
        if bad:
            text[20:24] = rng.sample(["vilea", "vilebo", "grubo", "grubik"], 4)
        rows.append((k, " ".join(text)))
        marks.append((k, int(bad)))
    rows += [(900, None), (901, ""), (None, "vilea grubo"), (902, words(rng, STEMS["aa"], 30_000)), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x", 0.5, "x", 3) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by, truth = {r["doc_id"]: r for r in got}, dict(marks)
    held = [k for k in truth if by[k]["held_out"]]
    assert len(held) > 30 and all(by[k]["predicted"] == truth[k] for k in held)
    assert by[900]["predicted"] == by[901]["predicted"] == by[902]["predicted"] == 0
    spans = {r["doc_id"]: r["passages"] for r in toxicity.toxic_passages(docs, model).collect()}
    text = dict(rows)[5]
    assert any("vile" in text[p["start"] : p["end"]] or "grub" in text[p["start"] : p["end"]] for p in spans[5]) and spans[900] == []
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.toxicity(docs, none).where("predicted = 1").count() == 0


def plain_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    inside = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)]


def test_counts_match_brute_force():
    rng = random.Random(6)
    texts = [None, "", "\n \x1c é x\n", "a b c d e f g h " * 3, "x " * 30]
    for _ in range(40):
        some = [rng.choice(["a", "b", "é#", "<c>", "d\n", "d\n", "\x0b"]) for _ in range(rng.randrange(1, 60))]
        texts.append(" ".join(some * rng.choice([1, 1, 2])))
    for t in texts:
        assert quality.statistics(t)[0] == plain_counts(t), t


def test_forest_tells_outliers():
    rng = np.random.default_rng(1)
    forest = quality.IsolationForest(rng.normal(size=(1000, 4)))
    assert forest.anomaly(np.full((1, 4), 6.0))[0] > forest.anomaly(rng.normal(size=(50, 4))).max()


def test_forest_matches_plain_path_lengths():
    rng = np.random.default_rng(3)
    sample, rows = rng.normal(size=(300, 3)).round(1), rng.normal(size=(20, 3)).round(1) * 2
    forest = quality.IsolationForest(sample)

    def harmonic_depth(n):
        return 0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(rng, own, depth):
        """The same draws in the same order, as nested tuples."""
        todo, tree = [(own, depth, path := [])], {}
        while todo:
            own, depth, path = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            columns = np.nonzero(high > low)[0]
            if depth == quality.DEPTH or len(own) < 2 or not len(columns):
                tree[tuple(path)] = depth + harmonic_depth(len(own))
                continue
            c = int(rng.choice(columns))
            at = rng.uniform(low[c], high[c])
            tree[tuple(path)] = (c, at)
            left = own[:, c] < at
            todo += [(own[left], depth + 1, [*path, 0]), (own[~left], depth + 1, [*path, 1])]
        return tree

    def length(tree, row):
        path = ()
        while isinstance(tree[path], tuple):
            c, at = tree[path]
            path += (int(row[c] >= at),)
        return tree[path]

    rng = np.random.default_rng(7)
    trees = [grow(rng, sample[rng.choice(300, quality.DRAWN, replace=False)], 0) for _ in range(quality.TREES)]
    expected = [2 ** (-np.mean([length(t, r) for t in trees]) / harmonic_depth(quality.DRAWN)) for r in rows]
    assert forest.anomaly(rows) == pytest.approx(expected)


def test_quality(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for k in range(240):
        text, bad = words(rng, STEMS["aa"] + STEMS["bb"] + STEMS["cc"], 60), k % 6 == 0
        rows.append((k, text.upper().replace(" ", "!! ") if bad else text.capitalize() + "."))
        marks.append((k, int(not bad)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "a b c d e f g h i j " * 5000), (None, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "x", 0.5, "x", 3) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.quality(docs, quality.fit(docs, labels)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[900]["base_failed"] and by[902]["base_failed"] and by[903]["base_failed"] and not by[903]["kept"]
    right = sum(by[k]["kept"] == bool(q) for k, q in marks)
    assert right >= 0.95 * len(marks)
    assert quality.quality(docs, quality.fit(docs.limit(0), labels.limit(0))).where("kept").count() > 200
    assert quality.quality(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_every_labelled_row_sets_the_threshold(spark, monkeypatch):
    assert not hasattr(quality, "FIT_DOCS")
    counted, cut = [], quality._threshold
    monkeypatch.setattr(quality, "_threshold", lambda good, bad: counted.append((good.sum(), bad.sum())) or cut(good, bad))
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('word ', id, ' and then so many more words that are not the same as any of the other ones, so that rules pass')  as text")
    quality.fit(docs, docs.selectExpr("doc_id", "if(doc_id % 10 = 0, 0, 1) as quality"))
    assert 8000 * 0.45 < counted[0][0] < 9000 * 0.55 and 300 < counted[0][1] < 600  # half of all, not of a part


def test_threshold_cuts_between_the_labels():
    good, bad = np.zeros(quality.GRID + 1), np.zeros(quality.GRID + 1)
    good[8000], good[8200], bad[9000] = 99, 1, 50
    assert 8200 / quality.GRID < quality._threshold(good, bad) < 9000 / quality.GRID
