"""Rebuild requests: against batches, against a plain simulation, after crashes, and in processing time."""

import random
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.streaming import rebuild, requests

SECOND = 1_000_000
CHANGES = "root string, ts timestamp"


def plain_requests(changes, done, gap, until):
    """(key, number, n, first, last, at) of (key, time) changes and (key, number, time) told, up to a time, one step after another."""
    out = []
    for key in sorted({k for k, _ in changes}):
        times = sorted(t for k, t in changes if k == key)
        sessions = []
        for t in times:
            if sessions and t - sessions[-1][-1] <= gap:
                sessions[-1].append(t)
            else:
                sessions.append([t])
        steps = sorted([(s[-1] + gap, 0, s) for s in sessions] + [(t, 1, n) for k, n, t in done if k == key], key=lambda s: s[:2])
        number, running, held = 0, False, []
        for at, told, what in steps:
            if at > until:
                break
            if told:
                running = running and what != number
            else:
                held += what
            if held and not running:
                number += 1
                out.append((key, number, len(held), min(held), max(held), at))
                running, held = bool(done), []
    return out


def frame(spark, rows, names):
    kinds = {"key": "string", "root": "string", "number": "long", "ts": "long"}
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names)).withColumn("ts", F.timestamp_micros("ts"))


def parts(spark, path, rows, names, files):
    """Rows as files that a stream reads one after another."""
    for k in range(files):
        frame(spark, rows[k::files], names).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(rows):
    micros = lambda t: round(t.timestamp() * SECOND)
    return sorted((r["key"], r["number"], r["n"], micros(r["first"]), micros(r["last"]), micros(r["at"])) for r in rows)


def changes_of(rng, n, span):
    return [(rng.choice("abc"), 1_700_000_000 * SECOND + rng.randrange(span) * 100_000) for _ in range(n)]


def test_requests_that_are_served_at_once_are_sessions(spark, tmp_path):
    rows = changes_of(random.Random(1), 120, 3000)
    stream = parts(spark, str(tmp_path / "in"), rows, ["root", "ts"], 3)
    requests.serve(requests.requests(stream, gap_ms=2000, late="10 minutes"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    until = max(t for _, t in rows) - 600 * SECOND
    assert not (tmp_path / "out").exists() or all(r["at"].timestamp() * SECOND <= until for r in spark.read.parquet(str(tmp_path / "out")).collect())
    late = [("z", max(t for _, t in rows) + 3600 * SECOND)]
    frame(spark, late, ["root", "ts"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    requests.serve(requests.requests(stream, gap_ms=2000, late="10 minutes"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = collected(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(plain_requests(rows, [], 2 * SECOND, 1 << 62))
    batch = rebuild.debounce(frame(spark, rows, ["root", "ts"]), "root", gap="2 seconds").collect()
    assert sorted((r["key"], round(r["start"].timestamp() * SECOND), r["n"]) for r in batch) == sorted((k, f, n) for k, _, n, f, _, _ in got)


def test_changes_during_a_rebuild_ask_for_one_more(spark, tmp_path):
    rng = random.Random(2)
    rows = changes_of(rng, 90, 2000)
    done, start = [], 1_700_000_000 * SECOND
    for key in "abc":  # rebuilds of some seconds, told for each number; some are told twice
        at = start
        for n in range(1, 40):
            at += rng.randrange(40, 200) * 100_000
            done += [(key, n, at)] * rng.choice([1, 1, 2])
    end = ("z", start + 9999 * SECOND)
    changes = parts(spark, str(tmp_path / "in"), [*rows, end], ["root", "ts"], 2)
    told = parts(spark, str(tmp_path / "done"), done, ["key", "number", "ts"], 2)
    requests.serve(requests.requests(changes, told, gap_ms=1000, late="4 hours"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    far = [("z", start + 99_999 * SECOND)]
    frame(spark, far, ["root", "ts"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame(spark, [("z", 99, far[0][1])], ["key", "number", "ts"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "done"))
    requests.serve(requests.requests(changes, told, gap_ms=1000, late="4 hours"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = [r for r in plain_requests([*rows, end], done, SECOND, 1 << 62)]
    assert collected(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)
    assert any(n > 1 for _, _, n, *_ in want) and sum(n for k, _, n, *_ in want if k != "z") <= len(rows)


def test_a_crash_sends_nothing_twice(spark, tmp_path):
    rows = [*[("a", k * 10 * SECOND) for k in range(1, 6)], ("z", 9000 * SECOND)]
    stream = parts(spark, str(tmp_path / "in"), rows, ["root", "ts"], 1)
    out, calls = str(tmp_path / "out"), []

    def serve(rebuild_):
        requests.serve(requests.requests(stream, gap_ms=1000), rebuild_, out, str(tmp_path / "ck")).awaitTermination()

    def before(batch):
        calls.append("before")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        serve(before)

    def sent(batch, epoch):  # the folder is whole, the stream's own mark is missing
        calls.append("sent")
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        raise RuntimeError("lost after")

    asked = requests.requests(stream, gap_ms=1000)
    with pytest.raises(Exception, match="lost after"):
        asked.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(sent).trigger(availableNow=True).start().awaitTermination()

    def again(batch):
        calls.append("again")
        return batch

    serve(again)
    got = spark.read.parquet(out).collect()
    assert calls == ["before", "sent"] and collected(got) == plain_requests(rows[:-1], [], SECOND, 1 << 62)


def test_processing_time_serves_the_last_change(spark, tmp_path):
    source, done, out = str(tmp_path / "in"), str(tmp_path / "done"), str(tmp_path / "out")
    schema = {"in": frame(spark, [], ["root", "ts"]).schema, "done": frame(spark, [], ["key", "number", "ts"]).schema}
    for p in (source, done):
        (tmp_path / p.rsplit("/", 1)[1]).mkdir()
    read = lambda p, s: spark.readStream.schema(s).parquet(p)
    put = lambda rows: frame(spark, rows, ["root", "ts"]).coalesce(1).write.mode("append").parquet(source)
    put([("a", 5), ("a", 6), (None, 7)])
    asked = requests.requests(read(source, schema["in"]), read(done, schema["done"]), gap_ms=500, mode=requests.PROCESSING_TIME)
    query = requests.serve(asked, lambda b: b, out, str(tmp_path / "ck"), available_now=False)

    def wait(n):
        end = time.time() + 90
        while time.time() < end:
            if list((tmp_path / "out").glob("*/_SUCCESS")) and spark.read.parquet(out).count() >= n:
                return [(r["number"], r["n"]) for r in spark.read.parquet(out).orderBy("number").collect()]
            time.sleep(0.3)
        raise AssertionError("no request")

    try:
        assert wait(1) == [(1, 2)]
        put([("a", 8)])  # while the rebuild runs, twice
        time.sleep(4)
        put([("a", 9)])
        time.sleep(4)
        assert wait(1) == [(1, 2)]
        frame(spark, [("a", 1, 10)], ["key", "number", "ts"]).coalesce(1).write.mode("append").parquet(done)
        assert wait(2) == [(1, 2), (2, 2)]
    finally:
        query.stop()


def test_intervals_merge_in_any_order():
    rng = random.Random(3)
    for _ in range(100):
        times = [rng.randrange(0, 300) for _ in range(rng.randrange(1, 40))]
        whole, rest, some = requests.merged([], np.array(times), 10), list(times), []
        while rest:
            k = rng.randrange(1, len(rest) + 1)
            some, rest = requests.merged(some, np.array(rest[:k]), 10), rest[k:]
        assert some == whole and sum(n for *_, n in whole) == len(times)


class Store:
    """State and timers of one key, with the number of messages that they cost."""

    def __init__(self):
        self.value, self.timers, self.sent = None, set(), 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.sent += 1
        return self.value

    def update(self, value):
        self.sent, self.value = self.sent + 1, value

    def registerTimer(self, ms):  # noqa: N802
        self.sent += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.sent += 1
        self.timers.remove(ms)


def test_a_key_costs_few_messages_however_many_changes():
    times = sorted(t for _, t in changes_of(random.Random(4), 400, 3000))
    store, requests_, now, got = Store(), requests.Requests(2 * SECOND, requests.EVENT_TIME, False), 0, []
    requests_.init(store)

    def taken(frames):
        before = store.sent
        for f in frames:
            got.extend(f[["key", "number", "n", "first", "last", "at"]].itertuples(index=False, name=None))
        assert store.sent - before <= 4 and len(store.timers) <= 1

    values = SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    for k in range(0, len(times), 100):
        taken(requests_.handleInputRows(("a",), iter([pd.DataFrame({"ts": times[k : k + 50]}), pd.DataFrame({"ts": times[k + 50 : k + 100]})]), values))
        now = times[k + 99] // 1000
    while store.timers:
        fired = min(store.timers)
        now = max(now, fired)
        store.timers.clear()  # Spark takes it away afterwards
        taken(requests_.handleExpiredTimer(("a",), values, SimpleNamespace(getExpiryTimeInMs=lambda at=fired: at)))
    assert got == plain_requests([("a", t) for t in times], [], 2 * SECOND, 1 << 62)
