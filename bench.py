"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once unmeasured (class loading, code generation), then the median of
three runs is taken. Results go to the ``noop`` sink, so nothing but the query is timed.
Tables are laid out in one part per core first, as tables of any size are; that is not timed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from webstrata.session import shared_folder
from workloads.check import TABLES
from workloads.queries import QUERIES

HEADLINE = [
    "page_signals", "paragraphs", "links", "main_content", "data_table_filter", "table_cells_long",
    "attempt_select", "analysis_parse", "strategy_flags", "page_result", "captured_result",
    "corpus_rollup", "report_tables", "latest_per_url",
]
RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    data = shared_folder(spark, "bench")
    for table in TABLES:
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(int(cpus)).write.parquet(f"{data}/{table}.parquet")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
