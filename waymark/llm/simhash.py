"""SimHash near-duplicate classes by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits and mapped to its vector of bit counts, each 0 to 2.
The Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so
a range join on a grid over the vectors, with radius 2, finds all candidates; they are then verified
on the fingerprints. The vectors are kept in unary (0 = 00, 1 = 01, 2 = 11 in each segment), where the
Manhattan distance is the bit count of an XOR.

Grid cells: the segments form ``blocks`` blocks. A distance of 2 touches two blocks at most, so two near
vectors agree in all blocks but two: a cell is a choice of the two that may differ and the coordinates of
the others. Pairs are formed only in cells of at most ``cell_max`` fingerprints. The members of larger
cells are linked exactly without pairs: fingerprints at distance 2 or less have a common word at distance
1 or less from both, so each emits its 65 such words, and a word has 65 members at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from waymark.llm.common import drop, fresh, join_hot, materialize, named, read_table, release_memory, small
from waymark.llm.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 2
CELL_MAX = 64
#: Number of blocks from which fewer than so many distinct fingerprints are expected to be alone in a cell.
BLOCKS = ((1 << 26, 5), (1 << 32, 8), (1 << 63, 12))
#: Shingles hashed at once: bounds the memory that a very long text takes.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles of a text; 0 for null or no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(SHINGLE, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, CHUNK):
        slices = map(joined.__getitem__, map(slice, starts[at : at + CHUNK], ends[at : at + CHUNK]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), "<u8", min(CHUNK, n - at))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints of batches, as signed longs."""
    for texts in batches:
        yield pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))
    release_memory()


def embed(fp: Column) -> Column:
    """Bit counts of the 2-bit segments, in unary."""
    low = F.lit(0x5555555555555555)
    right = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(right.bitwiseAND(fp).bitwiseAND(low), 1).bitwiseOR(right.bitwiseOR(fp).bitwiseAND(low))


def cell_masks(blocks: int) -> list[int]:
    """Bit masks, as signed longs, of the blocks that agree, one for each choice of two that may differ."""
    edges = [round(32 * b / blocks) for b in range(blocks + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(m for k, m in enumerate(masks) if k not in away) for away in combinations(range(blocks), RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def near_links(fps: DataFrame, cell_max: int = CELL_MAX, blocks: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) whose components are those of distance <= 2.

    Of the members of a large cell only links that keep the components are returned, not all pairs. Fingerprints must not be null; a
    repeated one counts once more in its cells. An empty table gives no links.
    """
    total = fps.count()
    if blocks is None:
        blocks = next(b for most, b in BLOCKS if total <= most)
    masks = F.array(*[F.lit(m) for m in cell_masks(blocks)])
    cells = (
        fps.select("fp", embed(F.col("fp")).alias("e"))
        .select("fp", "e", F.posexplode(F.transform(masks, lambda m: F.col("e").bitwiseAND(m))).alias("way", "at"))
        .select("fp", "e", F.xxhash64("way", "at").alias("cell"))
    )
    counts = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    live = materialize(join_hot(cells, counts.withColumn("size", F.col("n")), "cell", "size", total))
    drop(counts)
    small = live.where(F.col("n") <= cell_max)
    a, b = small.select("cell", F.col("fp").alias("u"), F.col("e").alias("eu")), small.select("cell", F.col("fp").alias("v"), F.col("e").alias("ev"))
    pairs = (
        a.join(b, "cell")
        .where("u < v")
        .where(F.bit_count(F.col("eu").bitwiseXOR(F.col("ev"))) <= RADIUS)  # lower bound
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
        .select("u", "v")
    )
    flips = F.array(F.lit(0), *[F.lit(m - (1 << 64) if m >> 63 else m) for m in (1 << k for k in range(64))])
    words = live.where(F.col("n") > cell_max).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    hubs = words.groupBy("word").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("vs")).where(F.size("vs") > 1)  # 65 at most
    return pairs.unionByName(hubs.select("u", F.explode("vs").alias("v")).where("u <> v")).distinct()


def _first() -> Column:
    """Order of rows: id, nulls last, then the hashes of the text and of the rest."""
    return F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "row_hash")


def _hashes(docs: DataFrame, text_col: str) -> tuple[Column, Column]:
    """Hashes of the text and of all other columns that can be hashed."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return F.xxhash64(named(text_col)), F.xxhash64(*[named(c) for c, kind in kinds.items() if c != text_col and "map<" not in kind and "variant" not in kind])


def _classes(each: DataFrame, cell_max: int) -> DataFrame:
    """Of rows (id, fp, text_hash, row_hash): (fp, n, component_id, first) of each fingerprint, first being the first row of the class. A written table."""
    fps = materialize(each.groupBy("fp").agg(F.min("id").alias("first_id"), F.min(_first()).alias("own_first"), F.count("*").alias("n")))
    roots = connected_components(near_links(fps.select("fp"), cell_max))
    linked = roots.join(fps, F.col("node") == F.col("fp"))
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("own_first").alias("first"))
    changed = roots.join(firsts, "root").select(F.col("node").alias("fp"), "component_id", "first")
    classes = fps.join(changed, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("first", "own_first").alias("first"))
    return materialize(classes)


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, text_hash, row_hash) of every row, a written table."""
    text_hash, row_hash = _hashes(docs, text_col)
    fp = F.pandas_udf(fingerprints, LongType())(named(text_col))
    return materialize(docs.select(named(id_col).alias("id"), fp.alias("fp"), text_hash.alias("text_hash"), row_hash.alias("row_hash")))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_max: int = CELL_MAX) -> DataFrame:
    """One row per row of docs: (id, fp long, component_id).

    component_id is the smallest id reachable over links of fingerprints that differ in two bits at
    most. A null or empty text has fingerprint 0 and is linked like any other. A repeated id keeps its
    rows. A null id is never a component_id unless its class has no other id. Other columns are ignored.
    """
    each = _prints(docs.select(named(id_col), named(text_col)), id_col, text_col)
    return with_class(each.select("id", "fp"), _classes(each, cell_max)).select(F.col("id").alias(id_col), "fp", "component_id")


def with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, fp) rows, each with the component_id of its fp in classes (fp, n, component_id), n being the number of rows that have the fp.

    Hot fingerprints go by broadcast, the rest by a shuffle. Rows of a null or unknown fp would go; fingerprints are never null.
    """
    return join_hot(rows, classes.select("fp", "component_id", "n"), "fp", "n", rows.count())


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of docs: that of the smallest id; of several with it, the one of the least text hash, then row hash.

    Rows that share an id but not the text are told apart. Rows with a null id come last in their class. Of
    rows that are equal in all columns one stays. Extra columns of any name stay.
    """
    each = _prints(docs, id_col, text_col)
    key = ["id", "text_hash", "row_hash"]
    chosen = _classes(each, CELL_MAX).select(*[F.col(f"first.{k}").alias(k) for k in key]).distinct()
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash")) & (F.col(f"{a}.row_hash") == F.col(f"{b}.row_hash"))
    repeated = each.groupBy(*key).count().where("count > 1").drop("count")
    chosen = materialize(chosen.alias("a").join(repeated.withColumn("is_repeated", F.lit(True)).alias("b"), same("a", "b"), "left").select(*[F.col(f"a.{k}") for k in key], F.coalesce("is_repeated", F.lit(False)).alias("is_repeated")))
    an_id, text_hash, row_hash, flag, own_text, own_row = fresh(docs.columns, "an_id", "text_hash", "row_hash", "is_repeated", "own_text", "own_row")
    of_text, of_row = _hashes(docs, text_col)
    few = small(chosen).toDF(an_id, text_hash, row_hash, flag)
    kept = docs.select("*", of_text.alias(own_text), of_row.alias(own_row)).join(few, named(id_col).eqNullSafe(F.col(an_id)) & (F.col(own_text) == F.col(text_hash)) & (F.col(own_row) == F.col(row_hash)))
    out = kept.where(~F.col(flag))
    if not chosen.where("is_repeated").isEmpty():
        out = out.unionByName(kept.where(F.col(flag)).dropDuplicates([id_col, own_text, own_row]))
    return out.select(*map(named, docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    out = simhash_classes(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
