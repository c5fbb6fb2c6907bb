"""Rows of Parquet tables by physical address: choose on light columns, read wide ones later.

A row's address is its file and its number there. Light rows carry it through aggregates and joins,
and the wide columns of the chosen rows are read from their files in place: files are grouped so that
the addresses of a group are few enough to be sent to every task, each file is read once, and files
without a chosen row are not read. So no wide column is ever shuffled, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.session import shared_folder

#: Addresses (two numbers each) that are sent to the tasks of one group of files. A file with more is a group of its own.
ADDRESSES = 1_000_000


def stored(df: DataFrame, name: str) -> str:
    """Write a frame to the shared folder, without a shuffle, so that its rows have addresses; gives the path."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def address() -> list[Column]:
    """``file_path``, ``file`` (a number for it) and ``row`` of rows read from a Parquet table."""
    path = F.col("_metadata.file_path")
    return [path.alias("file_path"), F.xxhash64(path).alias("file"), F.col("_metadata.row_index").alias("row")]


def file_groups(counts: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Files (number, chosen rows) in groups of at most ``most`` chosen rows, or of one file."""
    groups: list[list[int]] = []
    room = 0
    for file, n in sorted(counts):
        if n > room or not groups:
            groups.append([])
            room = most
        groups[-1].append(file)
        room -= n
    return groups


def fetch(spark: SparkSession, path: str, files: DataFrame, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of the table at ``path`` whose address is among ``wanted(file, row)``, with all their columns.

    ``files(file, file_path)`` names the files; both frames come from columns of :func:`address`.
    Only a row per file reaches the driver.
    """
    table = spark.read.parquet(path)
    counts = {r["file"]: r["n"] for r in wanted.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = [(r["file"], r["file_path"]) for r in files.select("file", "file_path").distinct().collect()]
    if len({f for f, _ in names}) < len(names):
        raise ValueError("two files have the same number")  # one in 10^7 tables of a million files
    path_of = dict(names)
    found = []
    for group in file_groups(list(counts.items()), most or ADDRESSES):
        rows = spark.read.schema(table.schema).option("basePath", path).parquet(*[path_of[f] for f in group])
        here = wanted.select(F.col("file").alias("__file"), F.col("row").alias("__row"))
        if len(group) < len(counts):
            here = here.where(F.col("__file").isin(group))
        at = rows.select(*[F.col(f"`{c}`") for c in table.columns], *[c.alias(f"__{n}") for c, n in zip(address()[1:], ("file", "row"))])
        found.append(at.join(F.broadcast(here), ["__file", "__row"], "left_semi").drop("__file", "__row"))
    return reduce(DataFrame.unionByName, found) if found else table.limit(0)
