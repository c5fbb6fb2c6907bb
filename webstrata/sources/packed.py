"""Pages packed into few large files, read in splits.

A dump of many small pages is kept as ``.dump`` files of page bodies end to end. Beside each lie
``.off`` (signed 64-bit offsets, one more than pages) and ``.ids`` (signed 64-bit page ids), so the
reader plans splits from the sizes of these files alone, and a task seeks to the pages of its split.
Files are named by task attempt and listed in ``parts``, which holds those of attempts that succeeded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webstrata.sources.pages import decoded

#: Bytes of pages in a split, about.
SPLIT = 32 << 20
#: Bytes of pages in a batch that a reader hands on.
BATCH = 4 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_packed_pages(pages: DataFrame, folder: str) -> int:
    """One file set per task of ``pages(page_id, html, charset)`` below a folder that all tasks reach; gives the number of pages.

    ``charset`` is a codec name; characters it lacks become character references.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        name, at, n = f"part-{uuid.uuid4().hex}", 0, 0
        with (
            store.open_output_stream(f"{path}/{name}.dump") as dump,
            store.open_output_stream(f"{path}/{name}.off") as offsets,
            store.open_output_stream(f"{path}/{name}.ids") as ids,
        ):
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for page_id, html, charset in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    data = (html or "").encode(charset, "xmlcharrefreplace")
                    dump.write(data)
                    at += len(data)
                    n += 1
                    offsets.write(np.array([at], "<i8").tobytes())
                    ids.write(np.array([page_id], "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "pages": pa.array([n], pa.int64()), "bytes": pa.array([at], pa.int64())})

    done = pages.select("page_id", "html", "charset").mapInArrow(write, "name string, pages bigint, bytes bigint")
    done.write.mode("overwrite").parquet(f"{folder}/parts")
    return pages.sparkSession.read.parquet(f"{folder}/parts").agg(F.sum("pages")).first()[0] or 0


class PackedSplit(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


class PackedReader(DataSourceReader):
    """Splits of about ``split`` bytes; ``parts`` names the files with their pages and bytes."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.split = options["path"], int(options.get("split", SPLIT))
        rows = options["parts"].split(";") if options["parts"] else []
        self.parts = [(name, int(n), int(size)) for name, n, size in (r.split(",") for r in rows)]

    def partitions(self) -> list[InputPartition]:
        found = []
        for name, n, size in self.parts:
            step = max(1, n * self.split // max(size, 1)) if size > self.split else n
            found += [PackedSplit(name, k, min(k + step, n)) for k in range(0, n, step)]
        return found

    def read(self, partition: PackedSplit) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty dump has one empty split
            return
        store, path = _open(self.folder)

        def numbers(kind: str, count: int) -> np.ndarray:
            with store.open_input_file(f"{path}/{partition.name}.{kind}") as f:
                f.seek(8 * partition.start)
                return np.frombuffer(f.read(8 * count), "<i8")

        n = partition.stop - partition.start
        offsets, ids = numbers("off", n + 1), numbers("ids", n)
        with store.open_input_file(f"{path}/{partition.name}.dump") as dump:
            at = 0
            while at < n:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH, "right")) - 1)
                dump.seek(int(offsets[at]))
                data = dump.read(int(offsets[to] - offsets[at]))
                ends = (offsets[at : to + 1] - offsets[at]).astype("<i4")
                content = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
                urls = [f"{self.folder}/{partition.name}.dump#{k}" for k in ids[at:to].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:to]), pa.array(urls, pa.string()), content], ["page_id", "url", "content"])
                at = to


class PackedPages(DataSource):
    """``spark.read.format("packed_pages")``; see :func:`read_packed_pages`."""

    @classmethod
    def name(cls) -> str:
        return "packed_pages"

    def schema(self) -> str:
        return "page_id bigint, url string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return PackedReader(self.options)


def read_packed_pages(spark: SparkSession, folder: str, charset: str = "UTF-8", split: int = SPLIT) -> DataFrame:
    """``(page_id, url, html)`` of packed pages; file and page id stand in for the URL.

    The character set is found per page, ``charset`` where nothing tells it. A row per file reaches
    the driver; a split holds about ``split`` bytes, so one large file is read by many tasks.
    """
    spark.dataSource.register(PackedPages)
    parts = spark.read.parquet(f"{folder}/parts").where("pages > 0").orderBy("name").collect()
    listed = ";".join(f"{r['name']},{r['pages']},{r['bytes']}" for r in parts)
    rows = spark.read.format("packed_pages").option("parts", listed).option("split", str(split)).load(folder)
    return rows.select("page_id", "url", decoded(F.col("content"), charset).alias("html"))
