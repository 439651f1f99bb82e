"""Document fingerprints: an exact digest of the canonical text.

Canonical: Unicode NFKC, full case folding, NFKC again, runs of white space as one space and none at the ends.
Digest: 128-bit XXH3 of its UTF-8. Equal digests are never taken as equal texts unread: wherever two
texts are told equal, their canonical bytes are compared.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from waymark.llm.common import BROADCAST_ROWS, bound_batches, join_hot, materialize, named, read_table, release_memory, small


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def likeness(a: tuple[bytes, str], b: tuple[bytes, str]) -> float:
    """1 for equal digests of equal bytes, else 0: an exact digest knows no degrees."""
    return 1.0 if a[1] == b[1] and a[0] == b[0] else 0.0


def edited(text: str, following: str) -> str:
    """The last third replaced by as many code points, or all, of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def printed(text: str | None) -> tuple[bytes, str]:
    canon = canonical(text)
    return canon, digest(canon)


RESULT = StructType(
    [StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())]
)
WALKED = StructType([StructField("doc_id", LongType()), *RESULT.fields, StructField("part", IntegerType()), StructField("edge", IntegerType()), StructField("edge_text", StringType())])


def compare(text: str, own: tuple[bytes, str], following: str, other: tuple[bytes, str]) -> tuple:
    """The values of RESULT for a text and the one that follows it."""
    changed = edited(text, following)
    to = printed(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own[1], to[1], likeness(own, to), likeness(own, other)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition of (doc_id, text): a row's result needs the next row only.

    edge: 1 is the first row's text, for the last row of the partition before; 2 is the last row, still
    without a result.
    """
    part, last = TaskContext.get().partitionId(), None
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("edge_text", pa.string())])
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            own = printed(text)
            if last is None:
                rows.append((None, *[None] * 6, part, 1, text))
            else:
                rows.append((last[0], *compare(last[1], last[2], text, own), part, 0, None))
            last = doc_id, text, own
        if rows:
            yield out(rows)
    if last is not None:
        yield out([(last[0], *[None] * 6, part, 2, last[1])])
    release_memory()


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Rows follow each other by descending id, ties by a hash of the text, null ids last; after the last comes the first. A
    null text is empty. A single row follows itself. Other columns are ignored.

    The rows are range-partitioned, so the texts are shuffled once and each row meets the next one in a walk through its
    partition. Only the first and the last row of each partition are joined afterwards.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    parts = max(1, rows.rdd.getNumPartitions())
    walked = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_walk, WALKED))
    found = sorted(r[0] for r in walked.where("edge = 1").select("part").collect())  # one number a partition
    if not found:
        return walked.select("doc_id", *RESULT.names)
    after = spark.createDataFrame(list(zip(found, found[1:] + found[:1], strict=True)), "part int, next_part int")
    ends = walked.where("edge = 2").select("doc_id", "part", F.col("edge_text").alias("text")).join(after, "part")
    starts = walked.where("edge = 1").select(F.col("part").alias("next_part"), F.col("edge_text").alias("following"))

    def joined(texts: pd.Series, following: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(a, printed(a), b, printed(b)) for a, b in zip(texts, following, strict=True)], columns=RESULT.names)

    ended = ends.join(starts, "next_part").select("doc_id", F.pandas_udf(joined, RESULT)("text", "following").alias("r")).select("doc_id", "r.*")
    return walked.where("edge = 0").select("doc_id", *RESULT.names).unionByName(ended)


KIND = StructType([StructField("digest", StringType()), StructField("canon", StringType())])


def _both(texts: pd.Series) -> pd.DataFrame:
    found = [printed(t) for t in texts]
    return pd.DataFrame({"digest": [d for _, d in found], "canon": [c.decode("utf-8", "replace") for c, _ in found]}, columns=KIND.names)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, fingerprint, ...), each with class_id and class_rows: the smallest id of the rows of equal canonical text, and their number.

    Rows are grouped by digest. In buckets of two or more the canonical bytes are compared: only their texts are shuffled, and copies are combined before
    that, so a bucket of any size is a few texts a task. Equal digests of different bytes fall apart: all but the first of these bytes get the digest with a
    number behind it. A null text is empty. A null id is a class_id only where the class has no other. Other columns are ignored.

    prints: rows (doc_id, fingerprint, ...) of docs with their plain digests, where a caller has them; their other columns stay.
    """
    bound_batches(docs.sparkSession)
    both = F.pandas_udf(_both, KIND)
    kinds = docs.select(named(id_col).alias("doc_id"), both(named(text_col)).alias("p"))
    each = materialize(kinds.select("doc_id", F.col("p.digest").alias("fingerprint"))) if prints is None else prints
    groups = materialize(each.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows")))
    shared = groups.where("class_rows > 1")
    texts = kinds.select(F.col("p.digest").alias("fingerprint"), F.col("p.canon").alias("canon"))
    clashing = materialize(texts.join(small(shared.select("fingerprint")), "fingerprint", "left_semi").groupBy("fingerprint").agg(F.collect_set("canon").alias("canons")).where("size(canons) > 1"))
    if not clashing.isEmpty():
        return _parted(each, kinds, groups, clashing)
    if shared.count() <= BROADCAST_ROWS:  # a text of its own is its own class
        out = each.join(F.broadcast(shared), "fingerprint", "left")
        return out.select(*each.columns, F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"))
    return join_hot(each, groups.withColumn("size", F.col("class_rows")), "fingerprint", "size", each.count()).select(*each.columns, "class_id", "class_rows")


def _parted(each: DataFrame, kinds: DataFrame, groups: DataFrame, clashing: DataFrame) -> DataFrame:
    """exact_classes where digests clash: their few buckets go by digest and bytes. Rows of prints in them are told by their id."""
    own = kinds.select("doc_id", F.col("p.digest").alias("fingerprint"), F.col("p.canon").alias("canon")).join(small(clashing.select("fingerprint")), "fingerprint", "left_semi")
    byte_groups = own.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    k = F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon"))
    names = byte_groups.withColumn("k", k).withColumn("own_name", F.when(F.col("k") > 1, F.concat_ws("-", "fingerprint", "k")).otherwise(F.col("fingerprint")))
    rows = own.join(names, ["fingerprint", "canon"]).groupBy("fingerprint", "doc_id").agg(F.min(F.struct("own_name", "class_id", "class_rows")).alias("n"))
    told = each.alias("e").join(rows.alias("r"), (F.col("e.fingerprint") == F.col("r.fingerprint")) & F.col("e.doc_id").eqNullSafe(F.col("r.doc_id")))
    split = told.select(*[(F.col("r.n.own_name") if c == "fingerprint" else F.col(f"e.{c}")).alias(c) for c in each.columns], F.col("r.n.class_id").alias("class_id"), F.col("r.n.class_rows").alias("class_rows"))
    whole = each.join(small(clashing.select("fingerprint")), "fingerprint", "left_anti").select(*each.columns).join(groups, "fingerprint").select(*each.columns, "class_id", "class_rows")
    return whole.unionByName(split)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the class of the documents of its canonical text."""
    docs = read_table(spark, sf_dir, "documents")
    return exact_classes(docs, prints=with_following(docs))
