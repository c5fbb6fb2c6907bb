"""Token ids of documents as flat binary files with 64-bit offsets.

A part holds a range of ascending ids in three flat little-endian files: ``.ids`` (unsigned 16 or
32-bit token ids, by the size of the vocabulary), ``.off`` (signed 64-bit offsets, one more than
documents) and ``.doc`` (signed 64-bit document ids). The manifest, a Parquet table, names every
part with its counts and the number of ids before it, a prefix sum over the parts. Readers map the
files into memory. Files are named by task attempt and only those of attempts that
succeeded enter the manifest, so retries and speculative copies leave the result right.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.common import id_text, in_slices
from webstrata.llm.words import encoder

#: Stands for a null document id in a ``.doc`` file.
NO_ID = -(2**63)
#: Documents encoded before their ids are flushed to the file.
SLICE = 500

MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint, width int, base bigint"
SPANS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> None:
    """Encode every whole text, append ``end_id``, write the parts and the manifest below ``folder``."""
    spark = docs.sparkSession
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        width = words.width
        end = int(end_id).to_bytes(width, "little")
        part = TaskContext.get().partitionId()
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        path = f"{path}/part-{part:06d}-{uuid.uuid4().hex}"
        at, docs_seen = 0, 0
        with (
            store.open_output_stream(f"{path}.ids") as ids,
            store.open_output_stream(f"{path}.off") as offsets,
            store.open_output_stream(f"{path}.doc") as names,
        ):
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in in_slices(batches, SLICE):
                ends = np.empty(batch.num_rows, "<i8")
                for k, text in enumerate(batch.column(1).to_pylist()):
                    data = words.encode(text) + end
                    ids.write(data)
                    at += len(data) // width
                    ends[k] = at
                offsets.write(ends.tobytes())
                names.write(batch.column(0).fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                docs_seen += batch.num_rows
        name = os.path.basename(path)
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "name": [name], "n_docs": [docs_seen], "n_tokens": [at], "width": [width]},
            schema=pa.schema(
                [("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]
            ),
        )

    done = ordered.mapInArrow(write, "part int, name string, n_docs bigint, n_tokens bigint, width int")
    parts = sorted((r for r in done.collect() if r["n_docs"]), key=lambda r: r["part"])  # a row per part
    bases = itertools.accumulate((r["n_tokens"] for r in parts), initial=0)
    rows = [
        (k, f"{folder}/{r['name']}", r["n_docs"], r["n_tokens"], r["width"], base) for k, (r, base) in enumerate(zip(parts, bases))
    ]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")


def _mapped(uri: str, kind: str) -> np.ndarray:
    """A flat file as an array, mapped into memory where the folder is mounted."""
    store, path = _open(uri)
    if not store.get_file_info(path).size:
        return np.empty(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def documents_of(path: str, width: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """``(doc_id, offset in the part, ids)`` of every document of a part."""
    ids, offsets, names = _mapped(f"{path}.ids", f"<u{width}"), _mapped(f"{path}.off", "<i8"), _mapped(f"{path}.doc", "<i8")
    for k, name in enumerate(names.tolist()):
        a, b = int(offsets[k]), int(offsets[k + 1])
        yield (None if name == NO_ID else name), a, ids[a:b]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, ids if asked for."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                found = documents_of(part["path"], part["width"])
                while rows := list(itertools.islice(found, SLICE)):
                    out = [
                        [d for d, _, _ in rows],
                        [part["base"] + a for _, a, _ in rows],
                        [len(ids) for _, _, ids in rows],
                        [zlib.crc32(ids.astype("<u4").tobytes()) for _, _, ids in rows],
                    ]
                    if with_ids:
                        out.append([ids.astype(np.int64) for _, _, ids in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], schema=schema)

    parts = max(1, manifest.count())  # a task per part; an even deal, which no later step merges
    return manifest.repartition(parts).mapInArrow(read, SPANS + (", ids array<bigint>" if with_ids else ""))


def token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the token files of ``docs`` and read them back.

    A null text counts as empty and still gets the end id. Rows of one id stand next to each other,
    ordered by a hash of their texts; rows without an id come first. An empty table gives no parts and no rows; other
    columns are ignored. A text is encoded whole, whatever its length.
    """
    write_token_files(id_text(docs, id_col, text_col), folder, vocabulary, end_id)
    return read_token_files(docs.sparkSession, folder)
