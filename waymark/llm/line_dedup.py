"""Line dedup: equal and nearly equal lines keep their earliest occurrence.

Lines are compared by their canonical text (lower case, white space as one space). Two lines are near if one
edit of a character at most parts them and the shorter has near_chars characters. Near lines are found by deletion neighbourhoods: a line emits the hash of itself
and of each text with one character deleted. A text equal to another's deletion is a near pair; so are two deletions at
the same place (a substitution). Each candidate is checked by its edit distance.

A line takes part in the neighbourhood join only if it can have a near line at all: one edit leaves the first or
the last half of the shorter line intact, so hashes of halves that occur once rule their lines out, exactly.

In each bucket lines are linked to the bucket's earliest line only, which is enough to know whether
a line has an earlier near line; no bucket makes all pairs. Buckets hold distinct lines that differ at one place, so their
size is bounded by the letters in use, not by how often a line occurs: copies are combined before.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from waymark.llm.common import bound_batches, drop, fresh, materialize, named, read_table, release_memory, small

#: Canonical characters from which equal lines are sought (blank lines always stay), and from which near ones are.
MIN_CHARS = 1
NEAR_CHARS = 16
#: Edits that may part near lines: 0 or 1.
EDITS = 1
#: Rows of one Arrow batch of variants.
VARIANT_ROWS = 1 << 16

_gaps = re.compile("[\t\x0b\f\r ]+").sub
BASE = 0x5DEECE66D1CE4E5B | 1
_INVERSE = pow(BASE, -1, 1 << 64)


def canonical(line: str) -> str:
    return _gaps(" ", line.lower()).strip(" ")


def halves(line: str) -> list[int]:
    """Hashes of the first and the last half, of the line as the shorter and as the longer one of a pair."""
    n, out = len(line), []
    for short in (n, n - 1):
        half = short // 2
        out.append(xxhash.xxh3_64_intdigest(f"{short} a {line[:half]}".encode("utf-8", "surrogatepass")) - (1 << 63))
        out.append(xxhash.xxh3_64_intdigest(f"{short} z {line[n - (short - half):]}".encode("utf-8", "surrogatepass")) - (1 << 63))
    return out


def neighbourhood(line: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Hashes of the line, of the distinct texts with one character less, and of each deletion with its place."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    powers = np.full(n, BASE, np.uint64)
    powers[:1] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)))
    less = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
    places = np.arange(1, n + 1, dtype=np.uint64)
    return int(_mix(sums[-1:], n, 0).view(np.int64)[0]), np.unique(_mix(less, n - 1, 0)).view(np.int64), _mix(less, n, places).view(np.int64)


def _mix(h: np.ndarray, length: int, place) -> np.ndarray:
    x = h ^ np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64)) ^ (np.asarray(place, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def within_one(a: str, b: str) -> bool:
    """Whether one edit at most parts the texts, in linear time."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = len(os.path.commonprefix((a, b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


LINES = StructType([StructField("id", LongType()), StructField("row", LongType()), StructField("line_no", IntegerType()), StructField("h1", LongType()), StructField("h2", LongType()), StructField("keys", ArrayType(LongType()))])
TEXTS = StructType([*LINES.fields[:5], StructField("line", StringType())])
VARIANTS = StructType([*LINES.fields[:5], StructField("kind", IntegerType()), StructField("key", LongType())])


def _split(min_chars: int, near_chars: int):
    """(id, row, text) -> LINES; keys only of lines that may have near ones."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])
        for batch in batches:
            rows = []
            for doc_id, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    own = canonical(line)
                    if len(own) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(own.encode("utf-8", "surrogatepass"))
                        rows.append((doc_id, row, k, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), halves(own) if len(own) >= near_chars else []))
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096], strict=True), schema.types, strict=True)], schema=schema)
        release_memory()

    return lines


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, text, wanted array<struct(line_no, h1, h2)>) -> TEXTS of the wanted lines."""
    for batch in batches:
        rows = []
        for doc_id, row, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            lines = (text or "").split("\n")
            rows += [(doc_id, row, w["line_no"], w["h1"], w["h2"], canonical(lines[w["line_no"]])) for w in wanted]
        if rows:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=TEXTS.names)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TEXTS -> VARIANTS, kind 0 the line, 1 a deletion, 2 a deletion with its place."""
    for batch in batches:
        for *place, line in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            own, less, placed = neighbourhood(line)
            keys = np.concatenate(([own], less, placed))
            kinds = np.repeat(np.array([0, 1, 2], np.int32), [1, len(less), len(placed)])
            for at in range(0, len(keys), VARIANT_ROWS):
                part = keys[at : at + VARIANT_ROWS]
                same = [pa.array([v] * len(part), t) for v, t in zip(place, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(kinds[at : at + VARIANT_ROWS]), pa.array(part)], names=VARIANTS.names)
    release_memory()


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(named(id_col).cast("long").alias("id"), F.xxhash64(named(id_col).cast("long"), named(text_col)).alias("row"), named(text_col).alias("text"))


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("last"), "id", "row", "line_no")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """(id, row, kept array<int>): of the lines of at least min_chars canonical characters, the numbers of those that stay. Rows without such lines are absent.

    Nulls, ties and repeated rows: see with_lines_deduped.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    base = _base(docs, id_col, text_col)
    lines = base.mapInArrow(_split(max(1, min_chars), near_chars if edits else 1 << 62), LINES)
    firsts = materialize(lines.groupBy("h1", "h2").agg(F.min(_place()).alias("at"), F.first("keys").alias("keys")))
    stay = firsts
    if edits:
        keyed = firsts.select("h1", "h2", F.explode("keys").alias("key"))
        shared = materialize(keyed.groupBy("key").count().where("count > 1").select("key"))
        suspects = materialize(keyed.join(small(shared), ["key"], "left_semi").select("h1", "h2").distinct())
        near = near_dropped(base, firsts, suspects)
        drop(shared, suspects)
        stay = firsts.join(small(near), ["h1", "h2"], "left_anti")
    return stay.groupBy(F.col("at.id").alias("id"), F.col("at.row").alias("row")).agg(F.collect_list("at.line_no").alias("kept"))


def near_dropped(base: DataFrame, firsts: DataFrame, suspects: DataFrame) -> DataFrame:
    """(h1, h2), a written table: the suspect lines with an earlier near line, each once.

    Only the documents that hold a suspect line first are read again, for the line's text. Empty tables give an empty one.
    """
    at = firsts.join(small(suspects), ["h1", "h2"], "left_semi").select("at.id", "at.row", F.struct("at.line_no", "h1", "h2").alias("w"))
    wanted = materialize(at.groupBy("id", "row").agg(F.collect_list("w").alias("wanted")))  # as long as a document's lines
    own = small(wanted.select(F.col("id").alias("own_id"), F.col("row").alias("own_row"), "wanted"))
    texts = base.join(own, (F.col("row") == F.col("own_row")) & F.col("id").eqNullSafe(F.col("own_id"))).select("id", "row", "text", "wanted")
    lines = materialize(texts.mapInArrow(_wanted, TEXTS).groupBy("h1", "h2").agg(F.min(_place()).alias("at"), F.first("line").alias("line")))
    keys = materialize(lines.select("at.id", "at.row", "at.line_no", "h1", "h2", "line").mapInArrow(_neighbours, VARIANTS))
    live = materialize(keys.groupBy("key").count().where("count > 1").select("key"))
    one = F.struct(_place().alias("at"), "h1", "h2")
    met = materialize(keys.join(small(live), ["key"], "left_semi").select("kind", "key", one.alias("b")))
    whole, deleted, placed = (met.where(F.col("kind") == k).select("key", "b") for k in range(3))
    hubs = placed.groupBy("key").agg(F.min("b").alias("a"))
    pairs = whole.withColumnRenamed("b", "a").join(deleted, "key").unionByName(hubs.join(placed, "key")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a.at < b.at").distinct()
    text = lines.select("h1", "h2", "line")
    told = pairs.select(F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2"), F.col("b.h1").alias("g1"), F.col("b.h2").alias("g2")).join(text, ["h1", "h2"])
    told = told.join(text.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other")), ["g1", "g2"])
    is_near = F.pandas_udf(lambda a, b: pd.Series([within_one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool), "boolean")
    near = materialize(told.where(is_near("line", "other")).select(F.col("g1").alias("h1"), F.col("g2").alias("h2")).distinct())
    drop(wanted, lines, keys, live, met)
    return near


KEPT = StructType([StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_kept", LongType()), StructField("n_long_kept", LongType())])


def with_lines_deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "_deduped", min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """docs with a struct column out: (text, n_lines, n_kept, n_long_kept).

    A line is dropped if an earlier line of the corpus, in the order of id, then row hash, then line
    number, is equal or near to it, whether or not that one stays. Lines under min_chars canonical characters and blank ones stay.
    Rows equal in id and text count as one document and get the same result; null ids come last. A null text stays null and has
    one empty line. Extra columns of any name but out stay.
    """
    bound_batches(docs.sparkSession)
    least = max(1, min_chars)

    def keep(texts: pd.Series, kept: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, kept, strict=True):
            lines, stay = (text or "").split("\n"), set() if own is None else set(own)
            left = [x for k, x in enumerate(lines) if k in stay or len(canonical(x)) < least]
            rows.append((None if text is None else "\n".join(left), len(lines), len(left), len(stay)))
        return pd.DataFrame(rows, columns=KEPT.names)

    names = [c for c in docs.columns if c != out]
    own, an_id, a_row, of_it = fresh(docs.columns, "own", "an_id", "a_row", "of_it")
    kept = kept_lines(docs, id_col, text_col, min_chars, near_chars, edits).select(F.col("id").alias(an_id), F.col("row").alias(a_row), F.col("kept").alias(of_it))
    marked = docs.select("*", F.xxhash64(named(id_col).cast("long"), named(text_col)).alias(own))
    joined = marked.join(kept, (F.col(own) == F.col(a_row)) & named(id_col).cast("long").eqNullSafe(F.col(an_id)), "left")
    return joined.select(*map(named, names), F.pandas_udf(keep, KEPT)(named(text_col), F.col(of_it)).alias(out))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """(doc_id, n_lines, n_kept, text) of every row; see with_lines_deduped."""
    done = with_lines_deduped(docs.select(named(id_col), named(text_col)), id_col, text_col, "_deduped", min_chars, near_chars, edits)
    return done.select(named(id_col).alias("doc_id"), "_deduped.n_lines", "_deduped.n_kept", "_deduped.text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that repeat no earlier line."""
    return dedup_lines(read_table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, k AS line_no, x AS raw, trim(regexp_replace(lower(x), '[\\t\\x0b\\f\\r ]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)
), f AS (
  SELECT line, min((doc_id, line_no)) AS place, length(line) AS n,
         substr(line, 1, length(line) // 2) AS p0, substr(line, 1, (length(line) - 1) // 2) AS p1,
         substr(line, length(line) // 2 + 1) AS s0, substr(line, (length(line) - 1) // 2 + 2) AS s1
  FROM l WHERE length(line) >= {MIN_CHARS} GROUP BY line
), near AS (
  SELECT b.line FROM f a JOIN f b ON a.n = b.n AND a.p0 = b.p0 WHERE a.n >= {NEAR_CHARS} AND a.place < b.place AND levenshtein(a.line, b.line) <= 1
  UNION SELECT b.line FROM f a JOIN f b ON a.n = b.n AND a.s0 = b.s0 WHERE a.n >= {NEAR_CHARS} AND a.place < b.place AND levenshtein(a.line, b.line) <= 1
  UNION SELECT CASE WHEN a.place < b.place THEN b.line ELSE a.line END FROM f a JOIN f b ON b.n = a.n + 1 AND a.p0 = b.p1 WHERE a.n >= {NEAR_CHARS} AND levenshtein(a.line, b.line) <= 1
  UNION SELECT CASE WHEN a.place < b.place THEN b.line ELSE a.line END FROM f a JOIN f b ON b.n = a.n + 1 AND a.s0 = b.s1 WHERE a.n >= {NEAR_CHARS} AND levenshtein(a.line, b.line) <= 1
), kept AS (
  SELECT l.doc_id, l.line_no, l.raw FROM l LEFT JOIN f USING (line)
  WHERE length(l.line) < {MIN_CHARS} OR (f.place = (l.doc_id, l.line_no) AND l.line NOT IN (SELECT line FROM near))
)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(k.n_kept, 0) AS n_kept,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_kept, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY doc_id) k USING (doc_id)
"""
