"""Sinks: link and table CSV, nested results as parquet or JSON lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webstrata.operators import tables as T
from webstrata.session import written


def _csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


def write_links_csv(results: DataFrame, path: str, keep: Sequence[str] = ("url",)) -> None:
    """``keep, text, href`` of every link; ``keep`` names the page. The header is written even without rows."""
    _csv(T.link_rows(results, list(keep)).select(*keep, "text", "href"), path)


def write_tables_csv(
    results: DataFrame, path: str, width: int | None = None, keep: Sequence[str] = ("url",)
) -> None:
    """``keep, table_index, row_index, col_1 .. col_n``; an empty input still yields ``col_1``.

    Without ``width`` the rows are written once to the shared folder; the widest one is observed on
    the way, so nothing is structured or read twice.
    """
    rows = T.table_rows(results, list(keep))
    if not width:
        seen = Observation()
        rows = written(rows.observe(seen, F.max(F.size("cells")).alias("width")), "table-rows")
        width = seen.get["width"] or 1
    _csv(T.wide_rows(rows, list(keep), width), path)


def write_results(results: DataFrame, path: str) -> None:
    """Nested results as parquet."""
    results.write.mode("overwrite").parquet(path)


def as_json(results: DataFrame, keep: list[str]) -> DataFrame:
    """One JSON document per result row."""
    return results.select(*keep, F.to_json(F.struct("*")).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.write.mode("overwrite").json(path)


def write_html_files(pages: DataFrame, folder: str) -> int:
    """One file ``<page_id>.html`` per row of ``pages(page_id, html, charset)`` below a shared folder.

    ``charset`` is a codec name; characters it lacks become character references. Every task
    writes its own files, and a retry writes the same ones again. Returns their number.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for page_id, html, charset in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with store.open_output_stream(f"{path}/{page_id}.html") as out:
                    out.write((html or "").encode(charset, "xmlcharrefreplace"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = pages.select("page_id", "html", "charset").mapInArrow(write, "n bigint")
    return done.agg({"n": "sum"}).first()[0] or 0
