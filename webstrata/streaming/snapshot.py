"""The newest result per URL as a snapshot that batches keep up to date, and roll-ups that follow it.

Results lie in hash buckets by URL. A batch writes only the buckets it touches, in a folder of its own,
and then a manifest, one small file, that names the folder of every bucket: it appears at once or not
at all and is what readers follow, so they see whole batches only. A batch starts from the newest
manifest before its own number, so doing it again gives the same files. A snapshot belongs to one
stream checkpoint, which numbers its batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from webstrata.operators.corpus import COUNTS
from webstrata.operators.results import latest_per_url

_MANIFEST = "bucket int, path string"
#: Stands for the empty folder that gives an empty snapshot its schema.
_NONE = -1


@dataclass(frozen=True)
class Snapshot:
    """A snapshot below the folder ``out``; ``order`` tells the rows of one URL in one batch apart."""

    spark: SparkSession
    out: str
    order: Sequence[str]
    buckets: int = 64
    key: str = "url"

    def create(self, schema: T.StructType) -> None:
        """An empty snapshot; one that is there already stays."""
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.out}/empty")
        self._point(-1, {_NONE: f"{self.out}/empty"}, "ignore")

    def _point(self, version: int, folders: dict[int, str], mode: str = "overwrite") -> None:
        rows = self.spark.createDataFrame(sorted(folders.items()), _MANIFEST).coalesce(1)
        rows.write.mode(mode).parquet(f"{self.out}/manifest/version={version}")

    def folders(self, before: int | None = None) -> dict[int, str]:
        """Folder of every bucket, by the newest manifest (of a batch before ``before``)."""
        known = self.spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{self.out}/manifest")
        if before is not None:
            known = known.where(F.col("version") < before)
        newest = known.agg(F.max("version")).first()[0]
        return {r["bucket"]: r["path"] for r in known.where(F.col("version") == newest).collect()}  # a row per bucket

    def _rows(self, folders: dict[int, str], buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = [p for b, p in sorted(folders.items()) if buckets is None or b in buckets or b == _NONE]
        return self.spark.read.schema(self.spark.read.parquet(folders[_NONE]).schema).parquet(*wanted)

    def read(self) -> DataFrame:
        """The newest result of every URL."""
        return self._rows(self.folders())

    def apply(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Make the rows of a batch the newest of their URLs; gives the rows that went and those that came."""
        old, folder = self.folders(batch_id), f"{self.out}/data/batch={batch_id}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        latest_per_url(batch, list(self.order), self.key).write.mode("overwrite").parquet(f"{folder}/came")
        came = self.spark.read.schema(batch.schema).parquet(f"{folder}/came")
        touched = {r[0] for r in came.select(bucket).distinct().collect()}  # at most the number of buckets
        there = self._rows(old, touched)
        urls = came.select(self.key)
        gone = there.join(urls, self.key, "left_semi").select(*came.columns)
        if touched:
            stay = there.join(urls, self.key, "left_anti").select(*came.columns)
            merged = stay.unionByName(came).withColumn("bucket", bucket).repartition(len(touched), "bucket")
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/buckets")
        self._point(batch_id, old | {b: f"{folder}/buckets/bucket={b}" for b in touched})
        return gone, came


def keep_snapshot(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    snapshot: Snapshot,
    checkpoint: str,
    follow: Callable[[DataFrame, DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Apply the transformed rows of every micro-batch to a snapshot.

    ``follow(gone, came, batch_id)`` may update what is derived from it; it must give the same when a
    batch is done again.
    """
    snapshot.create(transform(stream.sparkSession.createDataFrame([], stream.schema)).schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        gone, came = snapshot.apply(transform(batch), batch_id)
        if follow:
            follow(gone, came, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class KeptRollup:
    """Sums of page counts per full key of dimensions, kept by signed changes: minus what went, plus what came."""

    spark: SparkSession
    out: str
    dims: Sequence[str]
    counts: Sequence[str] = tuple(COUNTS)

    def _sums(self, rows: DataFrame, sign: int) -> DataFrame:
        signed = [(F.coalesce(F.col(c), F.lit(0)) * sign).cast("bigint").alias(c) for c in self.counts]
        there = [(F.col(c).isNotNull().cast("bigint") * sign).alias(f"{c}__n") for c in self.counts]
        return rows.select(*self.dims, F.lit(sign).cast("bigint").alias("pages"), *signed, *there)

    def _added(self, rows: DataFrame) -> DataFrame:
        measures = ["pages", *self.counts, *[f"{c}__n" for c in self.counts]]
        return rows.groupBy(*self.dims).agg(*[F.sum(m).alias(m) for m in measures])

    def update(self, gone: DataFrame, came: DataFrame, batch_id: int) -> None:
        """Add a batch's changes to the sums of the batches before it; both frames hold the dimensions and counts."""
        change = self._added(self._sums(gone, -1).unionByName(self._sums(came, 1)))
        if batch_id > 0:
            change = self._added(self._stored(batch_id).unionByName(change))
        change.where("pages <> 0").coalesce(max(1, self.spark.sparkContext.defaultParallelism)).write.mode("overwrite").parquet(f"{self.out}/version={batch_id}")

    def _stored(self, before: int | None = None) -> DataFrame:
        known = self.spark.read.parquet(self.out)
        if before is not None:
            known = known.where(F.col("version") < before)
        newest = known.agg(F.max("version").alias("newest"))
        return known.join(F.broadcast(newest), F.col("version") == F.col("newest")).drop("version", "newest")  # one row

    def read(self) -> DataFrame:
        """The columns of :func:`webstrata.operators.corpus.corpus_rollup`."""
        return self._stored().rollup(*self.dims).agg(
            F.grouping_id().cast("bigint").alias("level"),
            F.sum("pages").alias("pages"),
            *[F.when(F.sum(f"{c}__n") > 0, F.sum(c)).alias(f"{c}_sum") for c in self.counts],
            *[F.round(F.sum(c) / F.nullif(F.sum(f"{c}__n"), F.lit(0)), 6).alias(f"{c}_mean") for c in self.counts],
        )
