"""What READMEs break of what is declared for them, with nulls and repeats; review dates."""

import hashlib

from pyspark.sql import functions as F

from waymark.operators import validate


def problems(spark, surfaces, files, profiles=(("p", 0, 1, 0),)):
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = validate.surface_problems(of(surfaces, validate.SURFACE), of(list(profiles), "profileId string, min_images int, max_images int, max_badges int"), of(files, "path string, content string"), "2025-01-01")
    return sorted((r["id"], r["rule"], r["detail"]) for r in got.collect())


def test_surfaces(spark):
    fine = ("a", "R", "p", [("d", "Install")], [("v", "paired")], [("c", "run it", "t", "x")], "2024-01-01", "2025-01-01")
    files = [("R", "Install\nrun it ![i](u)"), ("v", ""), ("t", None)]
    assert problems(spark, [fine], files) == []  # due today is no fault yet
    assert problems(spark, [fine, fine], files[:1]) == [("a", "command-test", "t")] * 2 + [("a", "visual-file", "v")] * 2
    assert problems(spark, [("a", "R", "p", None, None, None, None, None)], files) == [("a", "review-expired", "")]
    assert problems(spark, [("a", "R", "p", [], [], [], "2024-01-01", None), ("b", "R", "p", [], [], [], "2024-01-01", "2024-12-31")], files) == [("b", "review-expired", "2024-12-31")]
    assert problems(spark, [("a", None, "p", *fine[3:]), ("b", "R", None, *fine[3:])], files) == [("a", "readme-missing", ""), ("b", "profile", "")]
    assert problems(spark, [("a", "R", "p", [("d", "no")], [("v", None)], [("", "no", "t", None)], "x", "y")], [("R", "![ ](a) ![b](https://img.shields.io/b) ![c](d)"), *files[1:]]) == [
        ("a", "alt-text", ""), ("a", "badge-budget", "1"), ("a", "command", "no"), ("a", "command-metadata", "no"), ("a", "dark-mode", "v"), ("a", "image-budget", "2"), ("a", "marker", "no"), ("a", "review-expired", "y"),
    ]
    assert problems(spark, [], files) == []


def test_expired(spark):
    rows = spark.createDataFrame([("2020-01-01",), ("2020-01-02",), (None,)], "reviewBy string")
    assert [r[0] for r in validate.expired(rows, today=F.lit("2020-01-02").cast("date")).collect()] == ["2020-01-01"]
    assert validate.expired(rows).count() == 2


def test_sources_hash(spark):
    rows = [("b", b"two"), ("a\u00e9", b""), ("a", b"\0x"), ("a", b"\0x"), (None, b"n"), ("c", None)]
    of = lambda r: validate.sources_hash(spark.createDataFrame(r, "path string, content binary").repartition(3)).collect()
    want = b"".join(p.encode() + b"\0" + c + b"\0" for p, c in sorted((p.encode().decode(), c) for p, c in rows[:4]))
    assert [r[0] for r in of(rows)] == [f"sha256:{hashlib.sha256(want).hexdigest()}"]
    assert [r[0] for r in of([])] == [f"sha256:{hashlib.sha256().hexdigest()}"]


def test_sources_hash_is_carried_from_range_to_range(spark, monkeypatch):
    rows = [(f"p{k % 90:03}", bytes([k % 7]) * (k % 130)) for k in range(300)]
    files = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    steps, fold = [], validate._chained
    monkeypatch.setattr(validate, "_chained", lambda state: steps.append(state) or fold(state))
    want = hashlib.sha256(b"".join(p.encode() + b"\0" + c + b"\0" for p, c in sorted(rows))).hexdigest()
    assert validate.sources_hash(files, step_bytes=7000).first()[0] == f"sha256:{want}"
    assert 1 < len(steps) == len(set(steps))
