"""Exact de-duplication through an extendible-hash index on shared files.

The index maps a 64-bit key of the normalised text to the row that stays. Its directory grows by
doubling: a bucket holding more than ``capacity`` entries splits on the next bit of the key, and
the directory doubles when a bucket needs more bits than the directory has. Every bucket is a set
of Parquet files below the shared folder, written by the one task that owns its key range.

Texts of one key are compared byte by byte: the aggregate that makes the entries groups on
``(key, text)``, with partial aggregation before the shuffle, so a text that fills a third of the
table travels once per task. Different texts of one key stand in the same entry as a chain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import id_text, one_of_each, spaced, without
from webstrata.session import shared_folder, written

#: Finest prefix, in bits, by which buckets may split; bounds the directory to 2 ** FINEST slots.
FINEST = 14


@dataclass(frozen=True)
class Directory:
    """``slots[top depth bits of a key]`` is the number of a bucket; ``local`` its own depth."""

    depth: int
    slots: list[int]
    local: list[int]


def grow_directory(cells: dict[int, int], capacity: int, finest: int = FINEST) -> Directory:
    """Split overfull buckets until each fits or its key range has one cell.

    ``cells`` counts the entries by the top ``finest`` bits of their keys. What still exceeds the
    capacity at the finest prefix stays in one bucket with overflow pages (more rows in its files).
    """
    depth, slots = 0, [0]
    buckets = {0: (0, 0)}  # number -> (prefix, own depth)
    todo = [0]
    below: list[Counter] = [Counter() for _ in range(finest + 1)]
    for cell, n in cells.items():
        for bits in range(finest + 1):
            below[bits][cell >> (finest - bits)] += n
    while todo:
        number = todo.pop()
        prefix, own = buckets[number]
        if own == finest or below[own][prefix] <= capacity:
            continue
        if own == depth:  # the directory doubles: every slot points twice at its bucket
            slots = [b for b in slots for _ in range(2)]
            depth += 1
        other = len(buckets)
        buckets[number], buckets[other] = (prefix * 2, own + 1), (prefix * 2 + 1, own + 1)
        span = 1 << (depth - own - 1)
        first = (prefix * 2 + 1) * span
        slots[first : first + span] = [other] * span
        todo += [number, other]
    return Directory(depth, slots, [buckets[b][1] for b in range(len(buckets))])


def _top_bits(key: Column, bits: int) -> Column:
    """The top bits of a signed 64-bit key as a number from 0."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(
    docs: DataFrame, folder: str, capacity: int = 200_000, key: Callable[[Column], Column] = text_key
) -> Directory:
    """Write the index of ``docs`` (doc_id, text) below ``folder`` and return its directory.

    Index rows: ``bucket, key, chain`` with ``chain`` an array of ``(text_sha256, keep_id,
    group_size)``, one element per different text of the key, ordered by digest.
    """
    spark = docs.sparkSession
    norm = spaced(F.col("text"))
    entries = (
        docs.select("doc_id", norm.alias("norm"))
        .withColumn("key", key(F.col("norm")))
        .groupBy("key", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    staged = f"{folder}/entries"
    entries.write.parquet(staged)
    entries = spark.read.parquet(staged)
    cells = entries.groupBy(_top_bits(F.col("key"), FINEST).alias("cell")).count().collect()  # at most 2 ** FINEST rows
    directory = grow_directory({r["cell"]: r["count"] for r in cells}, capacity)
    owners = spark.createDataFrame(list(enumerate(directory.slots)), "slot int, bucket int")
    (
        entries.withColumn("slot", _top_bits(F.col("key"), directory.depth))
        .join(F.broadcast(owners), "slot")  # at most 2 ** FINEST rows
        .groupBy("bucket", "key")
        .agg(F.array_sort(F.collect_list(F.struct("text_sha256", "keep_id", "group_size"))).alias("chain"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "key")
        .write.partitionBy("bucket")
        .parquet(f"{folder}/index")
    )
    return directory


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(
        "key bigint, chain array<struct<text_sha256: string, keep_id: bigint, group_size: bigint>>, bucket int"
    ).parquet(f"{folder}/index")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 200_000,
    key: Callable[[Column], Column] = text_key,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII white space by one space; a
    null text counts as empty. Of equal texts the smallest id stays. A row without id never stays
    if its group has an id; a group without any id has a null ``keep_id`` and all its rows stay.
    Rows that repeat the staying id and text are all marked kept. An empty table gives no rows, and
    other columns are ignored.
    """
    return _marked(docs, id_col, text_col, capacity, key).drop("key")


def _marked(docs: DataFrame, id_col: str, text_col: str, capacity: int, key: Callable[[Column], Column]) -> DataFrame:
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    folder = shared_folder(spark, "exact-dedup")
    build_index(rows, folder, capacity, key)
    norm = spaced(F.col("text"))
    probes = rows.select("doc_id", norm.alias("norm")).select(
        "doc_id", key(F.col("norm")).alias("key"), F.sha2("norm", 256).alias("text_sha256")
    )
    links = read_index(spark, folder).select("key", F.explode("chain").alias("link")).select("key", "link.*")
    return probes.join(links, ["key", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
        "key",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_dedup`` keeps."""
    return _dropped(docs, id_col, text_col)[0]


def drop_all_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of ``docs``, with all its columns, per group of ``exact_dedup``.

    It has the smallest id; of rows with that id, or of a group without ids, one stays (``one_of_each``).
    """
    left, marked = _dropped(docs, id_col, text_col)
    kept = marked.where("kept").groupBy("doc_id", F.col("key").alias("text_key")).count()
    norm = spaced(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return one_of_each(left, kept.where("count > 1"), F.col(id_col).cast("bigint"), text_key(norm))


def _dropped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    marked = written(_marked(docs, id_col, text_col, 200_000, text_key).select("doc_id", "kept", "key"), "marked")
    gone = marked.where(~F.col("kept")).select("doc_id", F.col("key").alias("text_key"))
    norm = spaced(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return without(docs, gone, F.col(id_col).cast("bigint"), text_key(norm)), marked
