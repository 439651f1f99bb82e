"""Nearest vectors against a plain version, and the inverted file's recall."""

import random

import numpy as np
import pytest

from waymark.operators import vectors
from waymark.plans import queries


def plain(corpus, asked, k):
    """Every pair, one by one."""
    out = []

    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    for q, x in asked:
        near = []
        for i, y in corpus:
            s = 0.0
            if usable(x) and usable(y) and len(x) == len(y) and any(x) and any(y):
                s = sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)
            near.append((-round(s, 9), i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    base = [[float(rng.randint(-3, 3)) for _ in range(5)] for _ in range(40)]
    corpus = [(i, base[i % 40] if i % 3 else base[7]) for i in range(150)]  # a third of all are copies of one
    corpus += [(150, None), (151, [0.0] * 5), (152, [1.0, 2.0]), (153, []), (154, [1.0, None, 1.0, 1.0, 1.0]), (155, [float("nan")] * 5), (156, [1e200] * 5), (157, [1e-200] * 5)]
    return corpus


@pytest.mark.parametrize("small", [True, False])
def test_exact(spark, data, monkeypatch, small):
    if not small:  # many blocks that meet by a shuffle
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(vectors, "LANES", 3)
    df = spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)
    asked = df.where("id % 10 = 0 or id > 149").withColumnRenamed("id", "query_id")
    want = plain([(i, v if i < 156 else [1.0] * 5) for i, v in data], [(i, v if i < 156 else [1.0] * 5) for i, v in data if i % 10 == 0 or i > 149], 6)
    assert rows(vectors.exact_topk(df, asked)) == want
    cells = vectors.fit(df, 5)
    assert len(cells.centres) == 5 and 1 <= cells.probes <= 5
    all_probed = vectors.search_index(vectors.build_index(df, cells), asked.where("query_id < 150"), cells, probes=5)
    held = {(q, i): s for q, _, i, s in rows(vectors.exact_topk(df, asked, 200))}
    got = rows(all_probed)
    assert [(q, n, i) for q, n, i, _ in got] == [(q, n, i) for q, n, i, _ in want if q < 150] and all(held[q, i] == s for q, _, i, s in got)


def test_blocks_hold_every_row_once(spark, data, monkeypatch):
    monkeypatch.setattr(vectors, "PENDING", 300)
    df = spark.createDataFrame(data, "id long, embedding array<double>").selectExpr("id % 7 as cell", "cast(id as string) as id", "embedding")
    blocks = vectors.pack(df.select("cell", "id", vectors.usable(df["embedding"]).alias("vector")), (400, 4)).collect()
    assert sorted(i for b in blocks for i in b["ids"]) == sorted(str(i) for i, _ in data)
    assert all(len(b["vectors"]) == 8 * b["dims"] * len(b["ids"]) and len(b["ids"]) <= 4 and {int(i) % 7 for i in b["ids"]} == {b["cell"]} for b in blocks)


def test_tables_without_rows_or_vectors(spark):
    none = spark.createDataFrame([], "id string, embedding array<float>")
    odd = spark.createDataFrame([("a", None), ("b", [0.0])], none.schema)
    for corpus in (none, odd):
        cells = vectors.fit(corpus)
        found = vectors.search_index(vectors.build_index(corpus, cells), odd.withColumnRenamed("id", "query_id"), cells)
        want = [(q, n, i, 0.0) for q in "ab" for n, i in ((1, "a"), (2, "b"))] if corpus is odd else []
        assert rows(found) == want and rows(vectors.exact_topk(corpus, odd.withColumnRenamed("id", "query_id"))) == want


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    want = {(r["query_id"], r["id"]) for r in queries.vector_topk(spark, d).collect()}
    got = {(r["query_id"], r["id"]) for r in queries.vector_index_topk(spark, d).collect()}
    assert len(want & got) >= 0.9 * len(want)
