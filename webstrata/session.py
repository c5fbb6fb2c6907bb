"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "webstrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with settings that suit wide text rows; every one can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Page rows are wide and uneven: small input splits keep tasks short.
        "spark.sql.files.maxPartitionBytes": "64m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor must reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(spark: SparkSession) -> int:
    """Partitions for rows whose work is large for their bytes.

    Given as a number, so that adaptive execution, which goes by bytes, does not merge them.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back, cutting its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
