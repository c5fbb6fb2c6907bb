"""Incremental ingest of page files and suppression of repeated submissions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from webstrata.operators.results import latest_per_url


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file stream over a table, be it one file or a folder of parts.

    The path is given as a pattern that only it matches: a plain path would have to be a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def ingest(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Append the transformed rows of every micro-batch to ``out/batch_id=N``.

    Each batch overwrites its own folder, so a replay after a lost driver leaves no duplicates,
    and no batch ever rewrites older results. An empty batch -1 gives the folder its schema before
    anything arrives.
    """
    nothing = stream.sparkSession.createDataFrame([], stream.schema)
    transform(nothing).write.mode("overwrite").parquet(f"{out}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_results(spark: SparkSession, out: str, order: list[str]) -> DataFrame:
    """Newest result per URL over all batches: the latest batch, and within it by ``order``."""
    return latest_per_url(spark.read.parquet(out), ["batch_id", *order])


def compact(spark: SparkSession, out: str, target: str, order: list[str]) -> None:
    """Write the newest results to a new folder that can replace ``out``."""
    latest_results(spark, out, order).write.mode("overwrite").partitionBy("batch_id").parquet(target)


#: Where a row without a time stands: ahead of all others.
NO_TIME = -(2**63)


class FirstOfHorizon(StatefulProcessor):
    """Per key, keeps a row and suppresses those less than ``horizon`` after the last kept one, in event time.

    Rows wait until the watermark has passed them, so the outcome does not depend on the order of
    arrival. One timer per key wakes the earliest of them; it then decides all rows that the watermark
    has passed, and a last one forgets the key when its horizon is over. A row that a kept one
    covers already does not wait.

    Rows come with their time in microseconds as column ``at`` and leave so. A call is mostly the
    time of its messages to the state store, so the timer's time is state too and no timers are listed.
    """

    def __init__(self, columns: list[str], at: str, horizon_us: int):
        self.columns, self.at, self.horizon = [c for c in columns if c != at], at, horizon_us

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at bigint")
        self.waiting = handle.getListState("waiting", "at bigint, row string")
        self.woken = handle.getValueState("woken", "ms bigint")

    def _wake(self, at: int) -> None:
        ms = -(-at // 1000)  # timers are in milliseconds
        self.handle.registerTimer(ms)
        self.woken.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = []
        for row in rows:
            at = row[self.at]
            came.append((NO_TIME if at is None else at, json.dumps([row[c] for c in self.columns])))
        if key[0] is None:  # rows without a key only move the watermark
            return iter(())
        last = self.kept.get()
        if last is not None:
            came = [r for r in came if not last[0] <= r[0] < last[0] + self.horizon]
        if came:
            self.waiting.appendList(came)
            first, woken = min(at for at, _ in came), self.woken.get()
            if woken is None or -(-first // 1000) < woken[0]:
                if woken is not None:
                    self.handle.deleteTimer(woken[0])
                self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((at, row) for at, row in self.waiting.get())
        before = self.kept.get()
        last = before = before[0] if before is not None else None
        out, later = [], []
        for at, row in rows:
            if at > passed:
                if last is None or at >= last + self.horizon:
                    later.append((at, row))
            elif last is None or at >= last + self.horizon:
                out.append(Row(**dict(zip(self.columns, json.loads(row))), **{self.at: None if at == NO_TIME else at}))
                last = at
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        open_ = last is not None and passed < last + self.horizon
        if not open_:
            if before is not None:
                self.kept.clear()
        elif last != before:
            self.kept.update((last,))
        if later or open_:
            self._wake(later[0][0] if later else last + self.horizon)
        else:
            self.woken.clear()
        return iter(out)

    def close(self) -> None:
        pass


_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 6 * 10**7, "hour": 36 * 10**8, "day": 864 * 10**8}


def _microseconds(span: str) -> int:
    number, unit = span.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def suppress_repeats(
    submissions: DataFrame, horizon: str = "1 day", key: str = "url", at: str = "fetched_at", delay: str = "1 hour"
) -> DataFrame:
    """Drop submissions of a URL less than ``horizon`` after its last kept one (stream state per URL).

    Decisions are made in event time, as soon as the watermark, ``delay`` behind the newest row, has
    passed a row; rows that come later than that are dropped and counted (:func:`late_rows`). Rows
    without a key are never kept; they serve to move the watermark on. ``at`` is a timestamp and
    other columns are texts or numbers. State lives as long as a horizon is open.
    """
    spark = submissions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # The time crosses to Python as a number; the column itself stays in the input for the watermark.
    us = f"{at}_us"
    columns = [c for c in submissions.columns if c != at]
    kinds = {f.name: f.dataType.simpleString() for f in submissions.schema.fields}
    kept = (
        submissions.withWatermark(at, delay)
        .withColumn(us, F.unix_micros(F.col(at).cast("timestamp")))
        .groupBy(key)
        .transformWithState(
            FirstOfHorizon([*columns, us], us, _microseconds(horizon)),
            ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], f"`{us}` bigint"]), "Append", "EventTime",
        )
    )
    return kept.select(*[F.timestamp_micros(us).cast(kinds[at]).alias(at) if c == at else F.col(f"`{c}`") for c in submissions.columns])


@contextmanager
def state_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Streams that start inside keep their state in ``n`` partitions, for good; one or two per core are enough."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark so far in the kept progress reports."""
    return sum(
        op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]
    )
