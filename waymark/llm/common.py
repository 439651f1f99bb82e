"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch handed to Python, so that a batch of very long texts stays small.
BATCH_ROWS = 256
BATCH_BYTES = 2 << 20
#: Rows of a counted side up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than this share of the rows; so there are fewer than 1 / share hot keys.
HOT_SHARE = 1 / 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark so that any store works."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of the Arrow batches of this session; smaller bounds stay. Plans are run later, so the bounds remain set."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def release_memory() -> None:
    """Give freed memory back to the system at a task's end, as Python workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def named(column: str) -> Column:
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no column has, in any case."""
    held, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the cluster names none, a local one serves a local master; else it is an error."""
    return folder_for(spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master)


def folder_for(folder: str | None, master: str) -> str:
    if folder:
        return folder.rstrip("/")
    if master == "local" or master.startswith("local["):
        return f"/tmp/waymark-checkpoints-{os.getuid()}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


#: Paths of written tables, by the frames that read them; and in the order they were written.
_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again.

    Written files outlive a lost executor. An empty frame keeps its schema. The table stays until it is dropped, by drop() or drop_since().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.written_at)


def mark() -> int:
    """The present, for drop_since."""
    return len(_written)


def drop_since(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete all tables that were written since the mark, but for those to keep."""
    kept = {df.written_at for df in keep}
    for path in [p for p in _written[since:] if p not in kept]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has few enough rows, counted, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose column size says how many rows the key has; size goes.

    Keys with more than HOT_SHARE of the total rows are, by definition, few: they go by broadcast, so that no task gets all rows
    of one; the rest goes by a shuffle.
    """
    bound = max(1.0, total * HOT_SHARE)
    more = [c for c in table.columns if c not in (key, size)]
    hot = table.where(F.col(size) > bound).select(key, F.struct(*more, F.lit(True).alias("is_hot")).alias("hot_row"))
    cold = table.where(F.col(size) <= bound).drop(size)
    marked = rows.join(F.broadcast(hot), key, "left")
    held = marked.where("hot_row is not null").select(*rows.columns, *[F.col(f"hot_row.{c}").alias(c) for c in more])
    return held.unionByName(marked.where("hot_row is null").select(*rows.columns).join(cold, key).select(*rows.columns, *more))
