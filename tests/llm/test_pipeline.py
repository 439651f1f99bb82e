"""Each stage on its own input, and the whole."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    stems = ["ka", "lo", "mi", "tu", "re", "pa"]
    words = lambda n: [rng.choice(stems) + rng.choice(stems) + rng.choice(stems) for _ in range(n)]
    rows, marks = [], []
    for k in range(150):
        text = words(60)
        if k % 5 == 0:
            text[20:24] = ["vilea", "vilebo", "grubo", "grubik"]
        rows.append((k, " ".join(text) + "\nThe same closing line in all of them."))
        marks.append((k, int(k % 5 == 0)))
    return rows, marks


def test_pipeline(spark, tmp_path):
    rows, marks = corpus(random.Random(1))
    copy = rows[1][1].split("\n")[0]
    rows += [(200, None), (201, ""), (202, "12 34"), (203, copy), (204, copy + " too much added at the end of it"), (1, rows[1][1])]
    spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, at = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        at[name] = docs.collect()
        if name != "packing":
            assert docs.columns == SCHEMA.replace(",", "").split()[::2]
    ids = {name: {r["doc_id"] for r in got} for name, got in at.items()}
    toxic = {k for k, y in marks if y}
    assert not ids["toxicity"] & toxic and {k for k, y in marks if not y} <= ids["toxicity"]
    assert ids["toxicity"] - ids["language_id"] == {200, 201, 202}
    assert ids["language_id"] - ids["line_dedup"] == {203}
    assert sum("closing" in r["text"] for r in at["line_dedup"]) == sum(r["doc_id"] == 1 for r in at["line_dedup"])
    assert all(r["n_chars"] == len(r["text"]) for r in at["line_dedup"])
    assert ids["simhash_near_dedup"] <= ids["line_dedup"] and len(at["simhash_near_dedup"]) == len(ids["simhash_near_dedup"])
    assert ids["packing"] == ids["simhash_near_dedup"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, at["packing"]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
