"""Times headline queries on BENCH_SF_DIR with local[BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "bench_calculation", "bench_selection", "groupby2", "describe", "join_by_column_inner_join", "asof_join_backward", "top_n", "simple_roll", "cumulative", "fill_linear", "crosstab", "resample_monthly", "quantile", "rsi",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from larkspur.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
