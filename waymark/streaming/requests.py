"""Rebuild requests with at most one rebuild of a key in flight: what changes meanwhile asks for one more, however often.

A stateful operator keeps, for each key, the changes that may still belong together as intervals, and whether a rebuild runs. An interval closes when no change has come for
the gap. If no rebuild runs, a request goes out; else the closed intervals are held, and one request for all of them goes out when the running one is done. In
event time the result doesn't depend on how changes come, if none is late; in processing time each change counts as of its arrival, and a timer closes
the interval, so the last change needs no later one to be served.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CHANGE, DONE = "change", "done"
EVENT_TIME, PROCESSING_TIME = "EventTime", "ProcessingTime"
REQUEST = "key string, number long, n long, first timestamp, last timestamp, at timestamp"
_RAW = "key string, number long, n long, first long, last long, at long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Interval = tuple[int, int, int]  # first, last, number of changes


def merged(open_: list[Interval], times: np.ndarray, gap: int) -> list[Interval]:
    """Intervals, ascending, with further changes: those at most the gap apart are one, as in session windows."""
    return [tuple(r) for r in _merged(np.array(open_, np.int64).reshape(-1, 3), times, gap).tolist()]


def _merged(open_: np.ndarray, times: np.ndarray, gap: int) -> np.ndarray:
    """What merged gives, of rows and as rows."""
    rows = np.concatenate([open_, np.stack([times, times, np.ones(len(times), np.int64)], axis=1)])
    if not len(rows):
        return rows
    rows = rows[np.argsort(rows[:, 0])]
    last = np.maximum.accumulate(rows[:, 1])
    begins = np.flatnonzero(np.concatenate([[True], rows[1:, 0] - last[:-1] > gap]))
    return np.stack([rows[begins, 0], np.maximum.reduceat(rows[:, 1], begins), np.add.reduceat(rows[:, 2], begins)], axis=1)


class Requests(StatefulProcessor):
    """Times are microseconds. in_flight: whether a request runs until it is told to be done; else it is done at once.

    A key's state is one value: each value, row of a list and timer costs a message to the store, and each row of a list its own conversion, so what is open and told is kept
    packed, as 64-bit numbers, and the one timer that is set with it.
    """

    def __init__(self, gap: int, mode: str, in_flight: bool) -> None:
        self.gap, self.mode, self.in_flight = gap, mode, in_flight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.phase = handle.getValueState("phase", "number long, running boolean, n long, first long, last long, open binary, told binary, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        phase, open_, told, timer = self._state()
        now = self._now(timerValues)
        for batch in rows:
            at = batch["ts"].to_numpy() if self.mode == EVENT_TIME else np.full(len(batch), now, np.int64)
            if self.in_flight:
                done = (batch["kind"] == DONE).to_numpy()
                told = np.concatenate([told, np.stack([at[done], batch["number"].to_numpy()[done].astype(np.int64)], axis=1)])
                at = at[~done]
            open_ = _merged(open_, at, self.gap)
        yield from self._advance(key, phase, open_, told, timer, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        phase, open_, told, timer = self._state()
        fired = expiredTimerInfo.getExpiryTimeInMs()  # it goes by itself
        yield from self._advance(key, phase, open_, told, None if timer == fired else timer, self._now(timerValues))

    def close(self) -> None:
        pass

    def _state(self) -> tuple[list, np.ndarray, np.ndarray, int | None]:
        """Number, whether it runs and what is held; open intervals; (time, number) of what is told; the timer that is set."""
        *phase, open_, told, timer = self.phase.get() or (0, False, 0, 0, 0, b"", b"", None)
        return phase, np.frombuffer(open_, np.int64).reshape(-1, 3), np.frombuffer(told, np.int64).reshape(-1, 2), timer

    def _now(self, timers) -> int:
        return 1000 * (timers.getCurrentWatermarkInMs() if self.mode == EVENT_TIME else timers.getCurrentProcessingTimeInMs())

    def _advance(self, key, phase: list, open_: np.ndarray, told: np.ndarray, timer: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Take all steps up to now in order of time, a close before what is told at the same time; keep the rest, and set a timer for its first step."""
        number, running, *held = phase
        closed, heard = open_[:, 1] + self.gap <= now, told[:, 0] <= now
        steps = [(i[1] + self.gap, 0, i) for i in open_[closed].tolist()] + [(ts, 1, n) for ts, n in told[heard].tolist()]
        out = []
        for at, is_told, what in sorted(steps):
            if is_told:
                running = running and what != number  # what an older rebuild says again changes nothing
            elif held[0]:
                held = [held[0] + what[2], min(held[1], what[0]), max(held[2], what[1])]
            else:
                held = [what[2], what[0], what[1]]
            if held[0] and not running:
                number += 1
                out.append((number, *held, at))
                running, held = self.in_flight, [0, 0, 0]
        open_, told = open_[~closed], told[~heard]
        rest = [int(t.min()) for t in (open_[:, 1] + self.gap, told[:, 0]) if len(t)]
        first = -(-min(rest) // 1000) if rest else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        self.phase.update((number, running, *held, open_.tobytes(), told.tobytes(), first))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out)} | dict(zip(("number", "n", "first", "last", "at"), np.array(out, np.int64).T, strict=True)))


def requests(changes: DataFrame, done: DataFrame | None = None, key: str = "root", ts: str = "ts", gap_ms: int = 350, late: str = "0 seconds", mode: str = EVENT_TIME) -> DataFrame:
    """Requests (key, number, n, first, last, at) of a stream of changes; done (key, number, ts) tells which have been served, without it each counts as served at once.

    number counts a key's requests from 1, n the changes that one answers for. Changes with a null key or time ask for nothing. In event time, changes later than late go. The
    session keeps its state in RocksDB from here on, as such operators need.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = changes.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("time"))
    if done is not None:
        rows = rows.select("*", F.lit(CHANGE).alias("kind"), F.lit(0).cast("long").alias("number"))
        rows = rows.unionByName(done.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("time"), F.lit(DONE).alias("kind"), F.col("number").cast("long").alias("number")))
    rows = rows.where("key is not null and time is not null").withColumn("ts", F.unix_micros("time"))
    rows = rows.withWatermark("time", late) if mode == EVENT_TIME else rows
    got = rows.groupBy("key").transformWithStateInPandas(Requests(1000 * gap_ms, mode, done is not None), _RAW, "Append", mode)
    micros = lambda c: F.timestamp_micros(F.col(c)).alias(c)
    return got.select("key", "number", "n", micros("first"), micros("last"), micros("at"))


def _committed(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def serve(asked: DataFrame, rebuild: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rebuild for each micro-batch of requests, and write what rebuild gives for them to a folder of out named by the batch.

    What is sent and the mark that it was are one thing, the commit of that folder: after a crash a batch whose folder is whole isn't rebuilt again, and one
    that isn't whole is written anew. So of no request there are two results, and none is lost. Both folders are shared ones.
    """

    def once(batch: DataFrame, epoch: int) -> None:
        to = f"{out.rstrip('/')}/epoch={epoch}"
        batch = batch.persist()
        if batch.count() and not _committed(batch.sparkSession, to):  # all of the batch is read in any case, as the state commits with it
            rebuild(batch).write.mode("overwrite").parquet(to)
        batch.unpersist()

    writer = asked.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(once)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
