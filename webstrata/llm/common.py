"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.session import written


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly the two columns an operator reads; a null text becomes empty.

    Selecting them first keeps any other column of the input, whatever its name, out of the plan.
    """
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def spaced(text: Column) -> Column:
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


#: Up to so many rows are sent to all tasks; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, gone: DataFrame, doc_id: Column, text_key: Column) -> DataFrame:
    """Rows of ``docs`` whose (id, text key) is not among ``gone`` (doc_id, text_key); a null id equals a null id."""
    gone = written(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, doc_id.eqNullSafe(F.col("__gone_id")) & text_key.eqNullSafe(F.col("__gone_key")), "left_anti")


def one_of_each(docs: DataFrame, again: DataFrame, doc_id: Column, text_key: Column) -> DataFrame:
    """Rows of ``docs``, of those whose (id, text key) is among ``again`` (doc_id, text_key) exactly one per pair.

    It is picked by a hash of all its columns; rows that are equal in all of them cannot be told apart.
    A null id equals a null id. Per task one row of a pair is shuffled.
    """
    again = written(again.select(F.col("doc_id").alias("__again_id"), F.col("text_key").alias("__again_key")).distinct(), "again")
    n = again.count()
    if not n:
        return docs
    if n <= BROADCAST_ROWS:
        again = F.broadcast(again)
    same = doc_id.eqNullSafe(F.col("__again_id")) & text_key.eqNullSafe(F.col("__again_key"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    many = docs.join(again, same, "left_semi").select(row.alias("__row"), doc_id.alias("__id"), text_key.alias("__key"))
    one = many.groupBy("__id", "__key").agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row")).select("__row.*")
    return docs.join(again, same, "left_anti").unionAll(one)


_held: list = []


def held(key: tuple, make: Callable):
    """The one large object that a Python worker keeps between tasks.

    Workers outlive stages; asking for another object drops the last one, so a chain of operators
    needs the memory of its largest and not of all.
    """
    if not _held or _held[0] != key:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # freed memory goes back to the system
            libc.malloc_trim(0)
        _held.extend((key, make()))
    return _held[1]


class Memo(dict):
    """Bounded ``word -> value`` memory of one Python worker.

    A missing word is computed by ``make``. Words over ``longest`` characters are not kept. A full
    memory becomes the older generation, from which words still in use come back, so the size is at
    most twice ``entries`` whatever the texts are.
    """

    def __init__(self, make: Callable, entries: int, longest: int = 64):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, word):
        value = self.old[word] if word in self.old else self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


def in_slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
