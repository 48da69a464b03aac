"""Times the headline queries, and a few of them as hand-written SQL beside; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from ringfold.plans import tpch
from ringfold.sources.bench import run_to_end

RUNS = 3
#: Queries whose SQL text Spark takes too: what they cost without this library, on the same machine.
YARDSTICK = ("q1", "q3", "q4", "q6", "q18")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def median(query) -> float:
    """Of RUNS runs, planning included, after one that compiles code and lists files, as in the baseline."""
    run_to_end(query())
    times = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run_to_end(query())
        times.append(time.perf_counter() - began)
    return round(statistics.median(times), 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in tpch.QUERIES.items():
        seconds[name] = median(lambda query=query: query(spark, sf_dir))
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    yardstick = {name: median(lambda name=name: spark.sql(tpch.SQL[name].replace("timestamp '", "timestamp_ntz '"))) for name in YARDSTICK}
    print(json.dumps({"metric": "sum of medians, 22 queries and 2 variants", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sql_yardstick": yardstick, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
