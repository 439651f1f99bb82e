"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A rotation is learned on a bounded sample so that the signs of the rotated, centred vectors lose least (iterative
quantisation); these signs are a vector's code. The index is a table of segments, each some thousand vectors with
their codes. A search hands each segment the query set in blocks. A segment cuts its codes into
substrings of about as many bits as tell its rows apart and indexes each. Two codes within radius r agree, in one of m substrings,
to within floor(r / m) bits, and all but the first r mod m + 1 need one bit less; so probing those keys retrieves every code
of the ball. What is retrieved is checked on the whole code, and the ball is ranked by the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import bound_batches, materialize, named, read_table, release_memory

#: Rows that the rotation and the radius are learned on, those of the least hashes, and rows of them that serve as queries.
SAMPLE = 16_384
SAMPLE_QUERIES = 512
ROUNDS = 40
BITS = 64
#: Share of the sample's neighbours that the radius must hold. The whole table's are nearer, so its share is larger.
TARGET = 0.95
#: Bytes of the vectors of a segment, and of a block of queries, in double precision.
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 1 << 19
#: Bytes of query blocks up to which they are broadcast; beyond, blocks and segments meet by a shuffle over this many lanes.
BROADCAST_BYTES = 64 << 20
LANES = 64
K = 10


@dataclass(frozen=True)
class Codebook:
    """What is learned: centre (d), rotation (d x bits), radius in bits."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def dims(self) -> int:
        return len(self.mean)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Unsigned 64-bit codes of the rows of a matrix."""
        signs = (vectors - self.mean) @ self.rotation > 0
        return (signs.astype(np.uint64) << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _matrix(vectors: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, empty or zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, vector) of the rows that take part, and their number of components: the commonest, the smaller of two.

    Rows with a null id, an invalid vector or another number of components take no part.
    """
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = sizes["d"] if sizes else 0
    return rows.where(F.size("vector") == dims), dims


def fit(rows: DataFrame, dims: int, k: int = K, target: float = TARGET) -> Codebook:
    """Learn the rotation and the least radius that holds the target share of the sample's k nearest neighbours. No rows give radius 0."""
    got = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).select("vector").toArrow()
    if not got.num_rows:
        return Codebook(np.zeros(dims), np.zeros((dims, 0)), 0)
    x = np.unique(_matrix(got.column(0), dims), axis=0)  # copies would make any radius look good
    x = x[np.random.default_rng(0).permutation(len(x))]
    mean = x.mean(axis=0)
    bits = min(BITS, dims)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2] if len(x) >= dims else np.eye(dims)
    flat = (x - mean) @ axes[:bits].T
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    book = Codebook(mean, axes[:bits].T @ turn, bits)
    codes, found = book.codes(x), []
    for q in range(min(SAMPLE_QUERIES, len(x))):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)] if len(x) > 1 else []
        found += np.bitwise_count(codes[near] ^ codes[q]).tolist()
    radius = int(np.quantile(found, target, method="higher")) if found else bits
    return Codebook(mean, book.rotation, radius)


SEGMENT = "segment long, n long, ids binary, vectors binary, codes binary"


def _packing(book: Codebook, most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, vector) -> segments of rows as they come."""
    size = max(1, most_bytes // (8 * max(1, book.dims)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), book.dims)))
            n += batch.num_rows
            while n >= size:
                ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                yield one(made, ids[:size], x[:size])
                held, n, made = [(ids[size:], x[size:])], n - size, made + 1
        if n:
            yield one(made, *(np.concatenate(c) for c in zip(*held, strict=True)))
        release_memory()

    def one(segment: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        blobs = [pa.array([a.tobytes()], pa.binary()) for a in (ids.astype(np.int64), x, book.codes(x))]
        return pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([len(ids)]), *blobs], names=["segment", "n", "ids", "vectors", "codes"])

    return packed


def build_index(rows: DataFrame, book: Codebook) -> DataFrame:
    """A written table of segments. Every row lies in exactly one, rows that repeat too; rows aren't moved, so no key is hot."""
    return materialize(rows.mapInArrow(_packing(book, SEGMENT_BYTES), SEGMENT))


@cache
def _masks(width: int, radius: int) -> np.ndarray:
    """All keys of that many bits with at most radius ones."""
    return np.array([sum(1 << b for b in of) for k in range(radius + 1) for of in combinations(range(width), k)], np.int64)


def _n_masks(width: int, radius: int) -> int:
    total = term = 1
    for k in range(min(width, radius)):
        term = term * (width - k) // (k + 1)
        total += term
    return total


class Tables:
    """The substring indexes of one segment's codes."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.codes, self.bits = codes, bits
        width = max(1, min(16, (max(2, len(codes)) - 1).bit_length()))
        edges = np.linspace(0, bits, max(1, -(-bits // width)) + 1).round().astype(int)
        self.parts = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            keys = self.keys(codes, a, b)
            order = np.argsort(keys, kind="stable")
            present, starts = np.unique(keys[order], return_index=True)
            self.parts.append((a, b, order, present, np.append(starts, len(keys))))

    @staticmethod
    def keys(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Places of all codes within the radius, ascending."""
        if not self.parts or radius >= self.bits:
            return np.arange(len(self.codes))
        m, hit = len(self.parts), np.zeros(len(self.codes), bool)
        for s, (a, b, order, present, ends) in enumerate(self.parts):
            least = radius // m - (s > radius % m)
            if least < 0:
                continue
            own = int(self.keys(np.array([code]), a, b)[0])
            if _n_masks(b - a, least) < len(present):  # probe each key, else each that exists
                probes = _masks(b - a, least) ^ own
                at = np.searchsorted(present, probes)
                met = at[(at < len(present)) & (present[np.minimum(at, len(present) - 1)] == probes)]
            else:
                met = np.flatnonzero(np.bitwise_count(present ^ own) <= least)
            firsts, sizes = ends[met], ends[met + 1] - ends[met]
            steps = np.arange(sizes.sum()) + np.repeat(firsts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            hit[order[steps]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


def nearest(query: np.ndarray, query_id: int, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of the places, smaller ids first among equals; rows with the query's id are its own."""
    places = places[ids[places] != query_id]
    d = np.sqrt(((vectors[places] - query) ** 2).sum(axis=1))
    if len(d) > k:
        few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        places, d = places[few], d[few]
    order = np.lexsort((ids[places], d))[:k]
    return ids[places[order]], d[order]


FOUND = "query_id long, vec_id long, score double"


def _searching(book: Codebook, k: int, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(n, ids, vectors, codes, q_ids, q_vectors, q_codes) -> each query's k nearest of the segment's ball."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, last, tables = book.rotation.shape[1], None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids, codes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["codes"], np.uint64)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                if row["segment"] != last:  # a segment's blocks come one after another
                    last, tables = row["segment"], Tables(codes, bits)
                out: list[tuple[np.ndarray, ...]] = []
                q_vectors = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, book.dims)
                for q, x, code in zip(np.frombuffer(row["q_ids"], np.int64).tolist(), q_vectors, np.frombuffer(row["q_codes"], np.uint64), strict=True):
                    own, r = int((ids == q).sum()), radius
                    places = tables.within(code, r)
                    while len(places) < min(len(ids), k + own) and r < bits:  # a segment gives k, or all that it has
                        r += 2
                        places = tables.within(code, r)
                    near, d = nearest(x, q, ids, vectors, places, k)
                    out.append((np.full(len(near), q), near, d))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])
        release_memory()

    return searched


def search(index: DataFrame, queries: DataFrame, book: Codebook, k: int = K, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of (id, vector), a prepared query set, its k nearest of the index that lie within the radius in codes.

    Where a segment holds fewer than k within the radius, it is raised there, so at least min(k, others) come back. Nearest first, ties to the smaller id. A
    query never meets rows of its own id. Of queries that share an id the one with the least vector counts. Rows of the index that repeat come up
    each. Blocks of queries are broadcast up to BROADCAST_BYTES, counted; beyond, each is sent to every lane, and a lane's segments meet them by a shuffle.
    Ranks are limited inside each task before the shuffle.
    """
    bound_batches(index.sparkSession)
    each = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = materialize(each.mapInArrow(_packing(book, BLOCK_BYTES), SEGMENT)).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "codes")])
    size = blocks.agg(F.sum(F.length("q_vectors") + F.length("q_codes"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        pairs = index.withColumn("lane", F.lit(0)).join(F.broadcast(blocks.withColumn("lane", F.lit(0))), "lane")
    else:
        lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))
        pairs = index.withColumn("lane", F.pmod(F.xxhash64("segment"), F.lit(LANES)).cast("int")).join(blocks.select("*", lanes.alias("lane")), "lane")
    found = pairs.drop("lane").mapInArrow(_searching(book, k, book.radius if radius is None else radius), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each vector whose id is divisible by 100."""
    rows, dims = prepared(read_table(spark, sf_dir, "embeddings"))
    book = fit(rows, dims)
    return search(build_index(rows, book), rows.where(F.col("id") % 100 == 0), book)
