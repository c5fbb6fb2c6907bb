"""Compare registered queries with their DuckDB equivalents: python -m workloads.check [sf_dir] [names]."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workloads.oracles import ORACLES
from workloads.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _key(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def compare(spark: SparkSession, sf: str, name: str) -> str:
    """``ok`` or what differs, for one query."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = QUERIES[name](spark, sf)
    mine = result.toArrow()
    theirs = con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(mine.column_names)
    if columns != sorted(theirs.column_names):
        return f"columns {columns} != {sorted(theirs.column_names)}"
    kinds = [(c, str(mine.schema.field(c).type), str(theirs.schema.field(c).type)) for c in columns]
    same = lambda a, b: a == b or a.split("[")[0] == b.split("[")[0] == "timestamp" or "string" in a and "string" in b
    if odd := [k for k in kinds if not same(k[1], k[2])]:
        return f"types {odd}"

    def rows(t):
        data = [t.column(c).to_pylist() for c in columns]
        return sorted(tuple(map(_key, r)) for r in zip(*data))

    a, b = rows(mine), rows(theirs)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), (None, None))
        cell = [(c, x[:90], y[:90]) for c, x, y in zip(columns, *diff) if x != y] if diff[0] else ""
        return f"rows {len(a)} / {len(b)}; first difference {cell} at {diff[0] and diff[0][:3]}"[:900]
    return f"ok {len(a)} rows"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    for name in names:
        start = time.time()
        try:
            verdict = compare(spark, sf, name) if name in ORACLES else "no oracle"
        except Exception as error:  # report and go on
            verdict = "ERROR " + str(error)[:600].replace("\n", " ")
        print(f"{name:22s} {time.time() - start:6.2f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
