"""Headline queries, timed: one cold run, then BENCH_RUNS (3) warm ones, of which the median counts. Prints one JSON line.

So that the whole stays short, a query whose cold run takes SLOW seconds or more is run warm once. The cold times are in the line, too.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waymark.plans import queries  # noqa: E402

HEADLINE = ("search_rank", "handoff_build", "doctor_score", "memory_safety", "hybrid_retrieve", "vector_topk", "content_hash", "knowledge_build", "debounce_sessions")


#: Seconds of a cold run from which one warm run is enough.
SLOW = 10


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "1m").config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, took, cold = queries.registry(), {}, {}
    for name in HEADLINE:
        times = []
        while len(times) < 2 or times[0] < SLOW and len(times) < 1 + runs:
            began = time.time()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        cold[name], took[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
