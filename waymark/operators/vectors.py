"""Nearest vectors by cosine: exactly, as matrix products of blocks, and by an inverted file of cells.

Rows are packed into blocks where they are. A block of the corpus meets blocks of the query set by equality of a cell: for the exact
search one cell holds all, for the inverted file a query is sent to the cells whose centres are nearest to it. A pair
of blocks is one matrix product, of which each query's best k leave the task. What the product only tells to rounding is worked out again row by row,
so equal vectors are equally near wherever they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from waymark.tables import written

K = 6
#: Bytes and rows of a block of the corpus and of the query set, and bytes of unfinished blocks in a task.
CORPUS_BLOCK, QUERY_BLOCK, PENDING = (1 << 20, 4096), (1 << 18, 1024), 64 << 20
#: Bytes of queries up to which their blocks are broadcast, and lanes by which larger sets meet the corpus in a shuffle.
BROADCAST_BYTES, LANES = 32 << 20, 64
#: Rows that cells and probes are learned on, those of the least hashes; rows of them that serve as queries; the share of their neighbours that the probes must hold.
SAMPLE, SAMPLE_QUERIES, TARGET = 16_384, 512, 0.95
#: Rounding of a similarity by the order of its sum.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """The vector in double precision; empty if null or with a null or non-finite component, which makes it similar to none."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, vector.cast("array<double>")).otherwise(F.array().cast("array<double>"))


def _block_type(ident: StructField) -> StructType:
    return StructType([StructField("cell", LongType()), StructField("block", LongType()), StructField("dims", IntegerType()), StructField("ids", ArrayType(ident.dataType)), StructField("vectors", BinaryType())])


def _packing(size: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, id, vector) -> blocks of rows that share the cell and the number of components."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list, list]] = {}  # ids, matrices, rows
        pending, made = 0, TaskContext.get().partitionId() << 32

        def full(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal pending, made
            ids, parts, rows = held.pop(key)
            pending, made = pending - sum(p.nbytes + 64 for p in parts), made + 1
            all_ids = pa.concat_arrays(ids)
            values = [pa.array([key[0]], pa.int64()), pa.array([made], pa.int64()), pa.array([key[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, sum(rows)], pa.int32()), all_ids), pa.array([np.concatenate(parts).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=["cell", "block", "dims", "ids", "vectors"])

        for batch in batches:
            cells, ids, vectors = (batch.column(k) for k in range(3))
            starts = vectors.offsets.to_numpy()
            flat, cells, dims = vectors.values.to_numpy(zero_copy_only=False), cells.to_numpy(), np.diff(starts)
            keys, which = np.unique(np.stack([cells, dims.astype(np.int64)], 1), axis=0, return_inverse=True)
            for g, (cell, d) in enumerate(keys.tolist()):
                most = max(1, min(size[1], size[0] // (8 * max(1, d))))
                every = np.flatnonzero(which.reshape(-1) == g)
                for at in np.split(every, range(most, len(every), most)):
                    got = held.setdefault((cell, d), ([], [], []))
                    if sum(got[2]) + len(at) > most:
                        yield full((cell, d))
                        got = held.setdefault((cell, d), ([], [], []))
                    part = flat[starts[at][:, None] + np.arange(d)]
                    got[0].append(ids.take(pa.array(at)))
                    got[1].append(part)
                    got[2].append(len(at))
                    pending += part.nbytes + 64
                    while pending > PENDING:
                        yield full(next(iter(held)))  # of sorted rows the first cell gets no more
        for key in list(held):
            yield full(key)

    return packed


def pack(rows: DataFrame, size: tuple[int, int] = CORPUS_BLOCK) -> DataFrame:
    """(cell, id, vector) -> (cell, block, dims, ids, vectors), without a shuffle."""
    return rows.select(F.col("cell").cast("long").alias("cell"), "id", "vector").mapInArrow(_packing(size), _block_type(rows.schema["id"]))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their largest component, so that no square overflows."""
    most = np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.where(most > 0, most, 1)


def nearest(corpus: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query the places and similarities of the corpus rows that are among its best k, all of a tie."""
    corpus, queries = _unit(corpus), _unit(queries)
    c_norm, q_norm = (np.sqrt((x * x).sum(axis=1)) for x in (corpus, queries))
    c_over, q_over = (np.divide(1.0, x, out=np.zeros_like(x), where=x > 0) for x in (c_norm, q_norm))
    near = (queries @ corpus.T) * c_over * q_over[:, None]
    least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
    found = []
    for j, row in enumerate(near):
        at = np.flatnonzero(row >= least[j] - SLACK)
        found.append((at, (corpus[at] * queries[j]).sum(axis=1) * c_over[at] * q_over[j]))
    return found


def _matching(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(dims, ids, vectors, q_dims, q_ids, q_vectors) -> (query_id, id, similarity): of each pair of blocks each query's best k."""

    def one(c: dict[str, pa.Array], row: int) -> pa.RecordBatch | None:
        size, q_size = c["dims"][row].as_py(), c["q_dims"][row].as_py()
        ids, q_ids = c["ids"][row].values, c["q_ids"][row].values
        matrix = lambda name, n: np.frombuffer(c[name][row].as_buffer(), np.float64).reshape(n, -1)
        if size == q_size and size:
            found = nearest(matrix("vectors", len(ids)), matrix("q_vectors", len(q_ids)), k)
        else:  # nothing to compare: all are as near
            found = [(np.arange(len(ids)), np.zeros(len(ids)))] * len(q_ids)
        places, scores, asked = [], [], []
        for j, (at, s) in enumerate(found):
            names = ids.take(pa.array(at)).to_pylist()
            best = sorted(range(len(at)), key=lambda i: (-s[i], names[i] is not None, names[i]))[:k]  # noqa: B023
            places += at[best].tolist()
            scores += s[best].tolist()
            asked += [j] * len(best)
        return pa.RecordBatch.from_arrays([q_ids.take(pa.array(asked, pa.int64())), ids.take(pa.array(places, pa.int64())), pa.array(scores, pa.float64())], names=["query_id", "id", "similarity"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for row in range(batch.num_rows):
                yield one(columns, row)

    return matched


def match(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Blocks of the corpus and of queries that share a cell -> (query_id, rank, id, similarity), the best k of each query."""
    types = [("query_id", asked.schema["ids"].dataType.elementType), ("id", index.schema["ids"].dataType.elementType)]
    out = ", ".join(f"{n} {t.simpleString()}" for n, t in types) + ", similarity double"
    names = ("dims", "ids", "vectors")
    pairs = index.select("cell", *names).join(asked.select("cell", *[F.col(n).alias(f"q_{n}") for n in names]), "cell")
    found = pairs.drop("cell").mapInArrow(_matching(k), out)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _sized(queries: DataFrame, probes: int = 1) -> bool:
    """Whether the queries' vectors, as often as they are sent, are few enough to be broadcast."""
    n = queries.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    return n * probes <= BROADCAST_BYTES


def exact_topk(corpus: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, similarity): nearest vectors by cosine, exact. corpus (id, embedding), queries (query_id, embedding), query_id unique, as the stated set.

    Ties go to the smaller id. Zero vectors, those that aren't usable and those of another number of components have similarity 0. Blocks of
    queries are broadcast up to BROADCAST_BYTES, counted; beyond, each is sent to every lane and meets the lane's blocks by a shuffle.
    """
    rows = corpus.select(F.lit(0).alias("cell"), "id", usable(F.col("embedding")).alias("vector"))
    asked = queries.select(F.lit(0).alias("cell"), F.col("query_id").alias("id"), usable(F.col("embedding")).alias("vector"))
    index, blocks = pack(rows), pack(asked, QUERY_BLOCK)
    if _sized(asked):
        return match(index, F.broadcast(blocks), k)
    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))).alias("cell")
    return match(index.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(LANES))), blocks.drop("cell").select("*", lanes), k)


@dataclass(frozen=True)
class Cells:
    """Centres of unit length, and how many of them a query is sent to."""

    centres: np.ndarray
    probes: int

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first; zero vectors lie in the first."""
        near = x @ self.centres.T
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def fit(corpus: DataFrame, n_cells: int | None = None, k: int = K, target: float = TARGET) -> Cells:
    """Cells by k-means for cosine on at most SAMPLE usable rows, and the least number of probes that holds the target share of the sample's k nearest.

    n_cells: the root of the sample's rows if none is given. Vectors have the commonest number of components, the smaller of two. An empty table gives one cell of none.
    """
    rows = corpus.select("id", usable(F.col("embedding")).alias("vector")).where(F.exists("vector", lambda x: x != 0))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return Cells(np.zeros((1, 0)), 1)
    got = rows.where(F.size("vector") == dims["d"]).orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    x = np.unique(_normed(got.flatten().to_numpy().reshape(-1, dims["d"])), axis=0)  # copies would make any probe look good
    n = min(len(x), n_cells or max(1, round(len(x) ** 0.5)))
    if n < 2:
        return Cells(x[:1], 1)
    unit = pa.table({"v": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dims["d"], pa.int32()), pa.array(x.reshape(-1)))})
    model = KMeans(k=n, distanceMeasure="cosine", seed=0, maxIter=20, featuresCol="v").fit(corpus.sparkSession.createDataFrame(unit).select(array_to_vector("v").alias("v")))
    cells = Cells(_normed(np.array(model.clusterCenters())), n)
    own, needed = cells.ranked(x, 1)[:, 0], []
    for q in np.random.default_rng(0).permutation(len(x))[:SAMPLE_QUERIES]:
        near = x @ x[q]
        near[q] = -np.inf
        place = np.argsort(cells.ranked(x[q : q + 1], len(cells.centres))[0])
        needed += (place[own[np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]]] + 1).tolist()
    return Cells(cells.centres, int(np.quantile(needed, target, method="higher")))


def _normed(x: np.ndarray) -> np.ndarray:
    x = _unit(x)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _celled(cells: Cells, n: int) -> Column:
    """The n nearest cells of a vector of as many components as the centres have; others lie in cell 0."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        d = cells.centres.shape[1]
        for vectors in batches:
            starts = vectors.offsets.to_numpy()
            fit_ = np.flatnonzero(np.diff(starts) == d) if d else np.zeros(0, int)
            out = np.zeros((len(vectors), n), np.int64)
            if len(fit_):
                flat = vectors.values.to_numpy(zero_copy_only=False)
                out[fit_] = cells.ranked(_normed(flat[starts[fit_][:, None] + np.arange(d)]), n)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * n, pa.int32()), pa.array(out.reshape(-1), pa.int64()))

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(found, "array<long>")


def build_index(corpus: DataFrame, cells: Cells) -> DataFrame:
    """A written table of blocks, each of one cell. Every row lies in exactly one; rows are sorted where they are, so no cell is hot."""
    rows = corpus.select("id", usable(F.col("embedding")).alias("vector")).withColumn("cell", F.get(_celled(cells, 1)(F.col("vector")), F.lit(0)))
    return written(pack(rows.sortWithinPartitions("cell")))


def search_index(index: DataFrame, queries: DataFrame, cells: Cells, k: int = K, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): the nearest vectors by cosine among those of the cells that a query is sent to; fewer than k where these hold fewer.

    With as many probes as there are cells the result is exact_topk's. A hot cell is many blocks, which a broadcast or adaptive execution deals out.
    """
    n = max(1, min(cells.probes if probes is None else probes, len(cells.centres)))
    asked = queries.select(F.col("query_id").alias("id"), usable(F.col("embedding")).alias("vector"))
    sent = asked.withColumn("cell", F.explode(F.array_distinct(_celled(cells, n)(F.col("vector")))) if n > 1 else F.get(_celled(cells, 1)(F.col("vector")), F.lit(0)))
    blocks = pack(sent.sortWithinPartitions("cell"), QUERY_BLOCK)
    return match(index, F.broadcast(blocks) if _sized(asked, n) else blocks, k)
