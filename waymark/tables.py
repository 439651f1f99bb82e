"""Schemas of the engine's tables, and the readers of a data directory."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWLEDGE = "id string, type string, title string, path string, description string, body string, pos long"
OWNERSHIP = "id string, path string, group string, layer string, purpose string, checks array<string>, agentDoc string, humanDoc string, readme string, pos long"
SEED = "id string, path string, purpose string, checks array<string>, agentDoc string, humanDoc string, origin string, pos long"
DISCOVERED = "id string, path string, name string, checks array<string>, pos long"
INTENT = "id string, title string, paths array<string>, pos long"
CHANGE = "id string, title string, startHere string, relatedPackages array<string>, pos long"
HUMAN_DOC = "id string, url string, path string, pos long"
CHUNK = "chunkKey string, property string, type string, id string, path string, title string, summary string, score long"
CANDIDATE = "schemaVersion int, id string, source string, rawPath string, fact string, why string, howToApply string, suggestedType string, confidence double, references array<string>"
GATE_RESULT = "id string, ok boolean, message string, expected string, actual string"
RULE_RESULT = "id string, level string, passed boolean, message string"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """A scan of fewer files than the cluster has cores, dealt out by a column, the first if none is named; larger scans as they are, without a shuffle.

    Files count, not partitions: the splits of a file of few row groups are empty but for some.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, by or df.columns[0])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for all executors in spark.checkpoint.dir; without it only a local master is served."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder:
        return folder.rstrip("/")
    if master == "local" or master.startswith("local["):
        return f"/tmp/waymark-tables-{os.getuid()}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def written(df: DataFrame, *folders: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: what is built on them neither repeats the work nor carries its plan. folders: columns whose values have a folder each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(folders) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete written tables that are read no more."""
    for df in frames:
        drop_at(df.sparkSession, df.written_at)


def drop_at(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in its order; those that are missing as nulls."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


#: Rows and characters up to which a counted side is broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 32 << 20


def small_side(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if its rows and their characters, counted, are few enough, else as it is."""
    n = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("rows"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("chars")).first()
    return F.broadcast(df) if n["rows"] <= BROADCAST_ROWS and (n["chars"] or 0) <= BROADCAST_CHARS else df
