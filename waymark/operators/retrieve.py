"""Chunks: local search hits, federated text sections, and both together; answers by alias."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from waymark.functions import markdown, paths, text
from waymark.functions.markdown import non_empty
from waymark.functions.occurrences import Finder
from waymark.operators.handoff import with_position
from waymark.operators.search import MOST_SIZE, bound_batches, held_tokens, release_memory, token_counts
from waymark.operators.vectors import exact_topk as vector_topk  # noqa: F401
from waymark.tables import small_side, written

K = 8
#: Numbers that a task holds of queries and chunk keys, and of queries and tokens.
KEPT = 4 << 20


def chunk_key(prop: Column, kind: Column, ident: Column) -> Column:
    return F.concat_ws(":", prop, kind, ident)


def retrieve(matches: DataFrame, knowledge: DataFrame, ownership: DataFrame, prop: str = "local", k: int = K) -> DataFrame:
    """The first k matches of each query as chunks, with type and title of the knowledge row and the owner's purpose as a spare summary."""
    know = knowledge.select("id", "path", F.col("type").alias("k_type"), F.col("title").alias("k_title"), "pos").groupBy("id", "path").agg(F.min_by(F.struct("k_type", "k_title"), "pos").alias("k"))
    own = ownership.select("id", F.col("purpose").alias("o_purpose"))
    rows = matches.where(F.col("rank") <= k).join(know, ["id", "path"], "left").join(own, "id", "left")
    kind = F.when(F.col("type") == "ownership", "ownership").otherwise(F.coalesce("k.k_type", "type"))
    return rows.select("query_id", "rank", chunk_key(F.lit(prop), kind, F.col("id")).alias("chunkKey"), F.lit(prop).alias("property"), kind.alias("type"), "id", "path", non_empty(F.col("k.k_title")).alias("title"), non_empty(F.coalesce("summary", "o_purpose")).alias("summary"), "score")


def chunk_markdown(sources: DataFrame, *more: str) -> DataFrame:
    """(source_id, url, raw, more columns) -> one chunk for each section, in order (ordinal), with the columns asked for."""
    parts = sources.select("source_id", "url", *more, F.posexplode(markdown.sections(F.col("raw"))).alias("ordinal", "section"))
    titled = parts.withColumn("title", markdown.section_title(F.col("section"), F.col("url")))
    ident = F.coalesce(non_empty(markdown.slug(F.col("title"))), F.col("ordinal").cast("string"))
    rows = titled.withColumn("id", ident)
    return rows.select(chunk_key(F.col("source_id"), F.lit("federated"), F.col("id")).alias("chunkKey"), F.col("source_id").alias("property"), F.lit("federated").alias("type"), "id", F.col("url").alias("path"), "title", F.substring(markdown.trimmed(F.col("section")), 1, 500).alias("summary"), F.lit(0).cast("long").alias("score"), "ordinal", *more)


def federated_links(sources: DataFrame) -> DataFrame:
    """(source_id, url, raw[, base]) -> (source_id, pos, title, url, description): links to texts of the same origin; relative ones are set on base."""
    base = F.col("base") if "base" in sources.columns else F.lit(None).cast("string")
    rows = sources.select("source_id", F.col("url").alias("from_url"), base.alias("base"), F.posexplode(markdown.llms_links(F.col("raw"))).alias("pos", "link"))
    full = F.when(~F.col("link.url").rlike(r"\Ahttps?://") & F.col("base").isNotNull(), F.concat(F.regexp_replace("base", r"/\z", ""), F.lit("/"), F.regexp_replace("link.url", r"\A/", ""))).otherwise(F.col("link.url"))
    out = rows.withColumn("url", full).where(F.col("url").rlike(r"\.(md|txt)(?:\z|\?)") & paths.same_origin(F.col("from_url"), F.col("url")))
    return out.select("source_id", "pos", F.col("link.title").alias("title"), "url", F.col("link.description").alias("description"))


def federated_chunks(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """Chunks of the sources (source_id, url, raw[, base]) and of the texts (url, raw) that their links lead to, with their order at.

    A source's own sections come first, then those of its links in the order of the links; links without a text are left out.
    """
    own = sources.select("source_id", "url", "raw", F.lit(-1).alias("link"))
    led = federated_links(sources).select("source_id", "url", F.col("pos").alias("link")).join(texts.select("url", "raw"), "url").select("source_id", "url", "raw", "link")
    rows = chunk_markdown(own.unionByName(led), "link")
    return with_position(rows, "property", "link", "ordinal").withColumnRenamed("pos", "at").drop("link", "ordinal")


def rag_documents(knowledge: DataFrame, files: DataFrame) -> DataFrame:
    """(id, content, source, type, title): each entry's file (path, content), or where that is away its title and description."""
    spare = F.concat_ws("\n\n", non_empty(F.col("title")), non_empty(F.col("description")))
    rows = knowledge.join(files.select("path", "content"), "path", "left")
    return rows.select("id", F.coalesce("content", spare).alias("content"), F.col("path").alias("source"), "type", "title")


def federated_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks that hold a token of the query in title, summary or path, with the tokens' summed lengths. Chunks are told apart by chunkKey, path and at.

    Tokens meet the chunks' vocabulary by equality, as in search.
    """
    asked = queries.select("query_id", text.tokens(F.col("term"), "").alias("words"))
    terms = small_side(token_counts(asked))
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), "path"))
    key = ["chunkKey", "path", "at"]
    found = held_tokens(chunks.select(*key, hay.alias("hay")), key, terms.select("token").distinct(), "")
    sums = found.join(terms, "token").groupBy("query_id", *key).agg(F.sum(F.col("n") * F.length("token")).cast("long").alias("score"))
    return chunks.drop("score").join(sums, key)


def _reduced(tokens: list[str], named: list[list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks (chunkKey, at, hay) -> (q, chunkKey, score, at, first) of what a task reads: of each query and key the best score with its first row, and the first row with any token. named: each query's tokens and their gains."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, gains = Finder(tokens, ""), np.zeros((len(tokens), len(named)), np.int64)
        for q, some in enumerate(named):
            for t, gain in some:
                gains[t, q] = gain
        kept: dict[str, np.ndarray] = {}  # of a key: score, at, first by query
        most = max(1, KEPT // max(1, 3 * len(named)))

        def sent() -> Iterator[pa.RecordBatch]:
            for key, got in kept.items():
                q = np.flatnonzero(got[0])
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([key] * len(q), pa.string()), *[pa.array(c[q]) for c in got]], names=["q", "chunkKey", "score", "at", "first"])
            kept.clear()

        for batch in batches:
            text, token, _ = finder.find(batch.column("hay"))
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            for e, (key, at) in enumerate(zip(batch.column("chunkKey").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                if ends[e] == ends[e + 1]:
                    continue
                scores = gains[token[ends[e] : ends[e + 1]]].sum(axis=0)
                got = kept.get(key)
                if got is None:
                    if len(kept) == most:
                        yield from sent()
                    got = kept[key] = np.zeros((3, len(named)), np.int64)
                hit, new = scores > 0, got[0] == 0
                got[2] = np.where(hit & (new | (at < got[2])), at, got[2])
                better = hit & ((scores > got[0]) | (scores == got[0]) & (at < got[1]))
                got[0][better], got[1][better] = scores[better], at
        yield from sent()
        release_memory()

    return reduced


def best_federated(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunkKey, score, at, first): of each query and key the best score with its first row's place, and the place of the first row that holds a token.

    Stated queries go to every task, counted, which takes the best of its keys as it reads the chunks; more queries meet them by shuffles. Texts stay where they are. at tells chunks apart.
    """
    asked = queries.select("query_id", text.tokens(F.col("term"), "").alias("words"))
    size = asked.agg(F.count("*"), F.sum(F.size("words")), F.max(F.array_max(F.transform("words", lambda t: F.length(t))))).first()
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), "path"))
    if (size[1] or 0) * size[0] > KEPT or (size[2] or 0) > MOST_SIZE:
        scores = federated_scores(chunks, queries).select("query_id", "chunkKey", "score", F.col("at").cast("long").alias("at"))
        return scores.groupBy("query_id", "chunkKey").agg(F.max("score").alias("score"), F.max_by("at", F.struct("score", -F.col("at"))).alias("at"), F.min("at").alias("first"))
    rows = asked.where(F.size("words") > 0).collect()
    if not rows:
        return asked.select("query_id", F.lit("").alias("chunkKey"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("first")).limit(0)
    tokens = sorted({t for r in rows for t in r["words"]})
    bit = {t: k for k, t in enumerate(tokens)}
    named = [[(bit[t], n * len(t)) for t, n in Counter(r["words"]).items()] for r in rows]
    bound_batches(chunks.sparkSession)
    got = chunks.where("chunkKey is not null").select("chunkKey", F.col("at").cast("long").alias("at"), hay.alias("hay")).mapInArrow(_reduced(tokens, named), "q int, chunkKey string, score long, at long, first long")
    got = got.groupBy("q", "chunkKey").agg(F.max("score").alias("score"), F.max_by("at", F.struct("score", -F.col("at"))).alias("at"), F.min("first").alias("first"))
    ids = chunks.sparkSession.createDataFrame([(q, r["query_id"]) for q, r in enumerate(rows)], StructType([StructField("q", IntegerType()), StructField("query_id", asked.schema["query_id"].dataType)]))
    return got.join(F.broadcast(ids), "q").select("query_id", "chunkKey", "score", "at", "first")


def hybrid(local: DataFrame, federated: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, chunk columns): the best of local and federated chunks; of equal keys the higher score, then the earlier row, local before federated."""
    b = federated.select("query_id", "chunkKey", "score", F.col("at").cast("long").alias("at"), F.struct("property", "type", "id", "path", "title", "summary").alias("said"))
    best = _places(local).unionByName(b.select("query_id", "chunkKey", "score", "at", F.lit(1).alias("side"), F.col("at").alias("first"), "said"))
    return _best(best, k).select("query_id", "rank", "chunkKey", "said.*", "score")


def hybrid_of(local: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """What hybrid gives for the chunks' scores, whose texts are read for the best k of a query alone. at tells chunks apart."""
    b = best_federated(chunks, queries)
    none = F.lit(None).cast("struct<property: string, type: string, id: string, path: string, title: string, summary: string>")
    best = written(_best(_places(local).unionByName(b.select("query_id", "chunkKey", "score", "at", F.lit(1).alias("side"), "first", none.alias("said"))), k))
    far = small_side(best.where("side = 1").drop("said")).join(chunks.select(F.col("at").cast("long").alias("at"), F.struct("property", "type", "id", "path", "title", "summary").alias("said")), "at")
    return best.where("side = 0").unionByName(far.select(best.columns)).select("query_id", "rank", "chunkKey", "said.*", "score")


def _places(local: DataFrame) -> DataFrame:
    said = F.struct("property", "type", "id", "path", "title", "summary").alias("said")
    return local.select("query_id", "chunkKey", "score", F.col("rank").cast("long").alias("at"), F.lit(0).alias("side"), F.col("rank").cast("long").alias("first"), said)


def _best(both: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunkKey, score, at, side, said) of rows (query_id, chunkKey, score, at, side, first, said): a key stands where it came first."""
    best = both.groupBy("query_id", "chunkKey").agg(F.max_by(F.struct("score", "at", "side", "said"), F.struct("score", -F.col("side"), -F.col("at"))).alias("c"), F.min(F.struct("side", "first")).alias("place"))
    w = Window.partitionBy("query_id").orderBy(F.desc("c.score"), "place")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunkKey", "c.*")


def fixed_chunks(docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """(id, content) -> (id, ordinal, chunk): windows of size characters that overlap."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("content") - overlap - 1), F.lit(step))
    return docs.where(F.length("content") > 0).select("id", F.posexplode(F.transform(starts, lambda s: F.substring(F.col("content"), s + 1, F.lit(size)))).alias("ordinal", "chunk"))


def alias_key(c: Column) -> Column:
    """Compatibility form, trimmed, single spaces, lower case."""
    nfkc = F.pandas_udf(_nfkc, "string")
    return F.lower(F.regexp_replace(F.trim(nfkc(c)), r"\s+", " "))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def exact_answers(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, id): entries one of whose aliases is the question, in the same key form; an entry counts once, 16 aliases at most."""
    a = entries.select("id", F.explode(F.slice("aliases", 1, 16)).alias("alias")).select("id", alias_key(F.col("alias")).alias("key")).distinct()
    return questions.select("query_id", alias_key(F.col("term")).alias("key")).join(a, "key").select("query_id", "id")
