"""Debounced rebuilds: changes of a key that follow each other within a gap count as one.

In event time: a session window closes when no change of its key has come for the gap. As a stream, sessions are emitted when the watermark
passes them; every micro-batch of closed sessions triggers one full rebuild, and batches never overlap, so no change is lost to a running build.
The watermark only moves with later changes, so what is still open when all changes are read is sent by flush, from the stream's own
state, and not again when the stream closes it unchanged.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP = "350 milliseconds"


def relevant(changes: DataFrame, config_name: str = "waymark.config.json", manifests: bool = False) -> DataFrame:
    """Changes (path, ts) of documents, of the settings, and on demand of project manifests."""
    path = F.col("path")
    keep = path.rlike(r"(?i)\.mdx?\z") | path.endswith(config_name) | path.endswith("meta.json")
    return changes.where(keep | path.rlike(r"(?:\A|/)(?:package|project|nx)\.json\z") if manifests else keep)


def watch_roots(settings, root: str) -> list[str]:
    """Existing directories to watch: the agent root, those of human sources, and that of the settings."""
    wanted = [settings.agent_root, *(h.get("options", {}).get(k) for h in settings.human for k in ("contentDir", "docsDir", "root", "srcDir")), "."]
    full = [os.path.normpath(os.path.join(root, p)) for p in wanted if p]
    return list(dict.fromkeys(p for p in full if os.path.isdir(p)))


def debounce(events: DataFrame, key: str, ts: str = "ts", gap: str = GAP) -> DataFrame:
    """(key, start, end, n) of each session; for batches and streams alike. end is the last event plus the gap."""
    w = F.session_window(F.col(ts), gap)
    return events.groupBy(F.col(key).alias("key"), w.alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _flushed(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that flush sent: a table beside the checkpoint."""
    try:
        return spark.read.schema(SESSION).parquet(f"{checkpoint.rstrip('/')}-flushed")
    except AnalysisException:
        return spark.createDataFrame([], SESSION)


def start(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, key: str = "root", ts: str = "ts", gap: str = GAP, late: str = "0 seconds", available_now: bool = True) -> StreamingQuery:
    """Run rebuild once for each micro-batch that closed sessions. Offsets and sessions are kept in checkpoint, a shared folder; see flush for the last ones."""
    closed = debounce(changes.withWatermark(ts, late), key, ts, gap)

    def once(batch: DataFrame, epoch: int) -> None:
        fresh = batch.join(_flushed(batch.sparkSession, checkpoint), SESSION_COLUMNS, "left_anti")
        if not fresh.isEmpty():
            rebuild(fresh, epoch)

    writer = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(once)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


SESSION = "key string, start timestamp, end timestamp, n long"
SESSION_COLUMNS = ["key", "start", "end", "n"]


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, start, end, n) of the sessions that the stream holds open, as of its last micro-batch; none before the first."""
    try:
        state = spark.read.format("statestore").load(checkpoint)
    except Exception as e:
        if "STDS" in str(e) or isinstance(e, AnalysisException):  # no state yet
            return spark.createDataFrame([], SESSION)
        raise
    name = next(f.name for f in state.schema["value"].dataType.fields if f.name not in ("session_window", "count"))
    v = lambda field: F.col(f"value.`{field}`")
    return state.select(v(name).cast("string").alias("key"), F.col("value.session_window.start").alias("start"), F.col("value.session_window.end").alias("end"), v("count").alias("n"))


def flush(spark: SparkSession, rebuild: Callable[[DataFrame, int], None], checkpoint: str, now: str | None = None) -> int:
    """Run rebuild once for the open sessions that ended by now (a timestamp; all without one), and give their number. For a query that has ended, or between its micro-batches.

    A session that grows by later changes is sent again, as those are changes of their own.
    """
    due = open_sessions(spark, checkpoint).join(_flushed(spark, checkpoint), SESSION_COLUMNS, "left_anti")
    if now is not None:
        due = due.where(F.col("end") <= F.lit(now).cast("timestamp"))
    due = spark.createDataFrame(due.collect(), SESSION)  # a session a key at most
    n = due.count()
    if n:
        rebuild(due, -1)
        due.coalesce(1).write.mode("append").parquet(f"{checkpoint.rstrip('/')}-flushed")
    return n


def run(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, **options) -> None:
    """Read all changes that there are, and leave none without its rebuild."""
    start(changes, rebuild, checkpoint, **options).awaitTermination()
    flush(changes.sparkSession, rebuild, checkpoint)
