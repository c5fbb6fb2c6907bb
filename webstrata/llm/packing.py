"""Packing of documents into fixed windows by non-negative least squares.

A document longer than the window gives full windows; its rest is one piece. Only the histogram of
piece lengths, one number per length up to the window, reaches the driver. There all combinations
of up to three lengths that fill a window exactly are enumerated and a non-negative least squares
problem finds how often each should be used; repeats are rounded down to what the histogram has,
and the residual is packed greedily, largest first. The plan is a list of runs, "ranks a to b of
length n go to sequences c onwards at offset d", whose size depends on the window alone. A piece
finds its place from its rank among the pieces of its length: its rank within its task plus the
counts of the tasks before, so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import id_text, in_slices
from webstrata.llm.words import encoder
from webstrata.session import written

WINDOW = 2048
#: Iterations of the least squares solver.
STEPS = 250
#: Documents per output batch of the cutting step.
SLICE = 500

#: Ranks of one length stay below this.
_RANKS = 1 << 44


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three of the given lengths, descending, zero for none, that sum to ``window``."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    found = []
    for a in lengths[lengths * 3 >= window]:
        b = np.arange(min(a, window - a), -1, -1)
        c = window - a - b
        ok = (c >= 0) & (c <= b) & there[b] & there[np.clip(c, 0, window)]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.empty((0, 3), int)


def solve(counts: np.ndarray, patterns: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that nearly minimise ``|used(x) - counts|``, by accelerated projected gradient."""
    n = len(counts)
    flat = patterns.T.ravel()
    real = patterns > 0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.tile(x, 3), n)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * real).sum(1)

    v = np.ones(len(patterns))
    for _ in range(10):  # largest curvature
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(used(y) - counts) / top)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass(frozen=True)
class Plan:
    """Runs sorted by (length, first rank): where the ranks of a length go."""

    key: np.ndarray  # length * _RANKS + first rank
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, lengths * _RANKS + ranks, "right") - 1
        return self.sequence[at] + lengths * _RANKS + ranks - self.key[at], self.offset[at]


def plan(histogram: dict[int, int], window: int = WINDOW, steps: int = STEPS) -> Plan:
    """Places for ``histogram[length]`` pieces of every length from 1 to ``window``."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    chosen: list[tuple[dict[int, int], int]] = []  # multiplicity by length, repeats

    def take(pattern: dict[int, int], repeats: int) -> None:
        most = min(repeats, *(left[k] // m for k, m in pattern.items())) if pattern else 0
        if most > 0:
            for k, m in pattern.items():
                left[k] -= m * most
            chosen.append((pattern, int(most)))

    take({window: 1}, int(left[window]))
    patterns = combinations(np.flatnonzero(left), window)
    if len(patterns):
        x = solve(left.astype(float), patterns, steps)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            pattern: dict[int, int] = defaultdict(int)
            for length in patterns[k].tolist():
                if length:
                    pattern[length] += 1
            take(dict(pattern), int(x[k]))
    while (lengths := np.flatnonzero(left)).size:  # every round uses up at least one length
        space, pattern = window, {}
        while (at := np.searchsorted(lengths, space, "right") - 1) >= 0:
            length = int(lengths[at])
            pattern[length] = int(min(space // length, left[length]))
            space -= length * pattern[length]
            lengths = lengths[:at]
        take(pattern, int(left.sum()))
    return laid_out(chosen)


def laid_out(chosen: list[tuple[dict[int, int], int]]) -> Plan:
    """The plan of patterns (multiplicity by length) with their repeats, in that order."""
    runs, ranks, sequence = [], defaultdict(int), 0
    for pattern, repeats in chosen:
        offset = 0
        for length, m in pattern.items():
            for _ in range(m):
                runs.append((length * _RANKS + ranks[length], sequence, offset))
                ranks[length] += repeats
                offset += length
        sequence += repeats
    table = np.array(sorted(runs), np.int64).reshape(-1, 3)
    return Plan(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), sequence)


def cut(docs: DataFrame, vocabulary: str, end_id: int, window: int, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids, with the task that made each and its rank there among equal lengths."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        kind = f"<u{words.width}"
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in in_slices(batches, SLICE):
            rows: list[list] = [[] for _ in schema.names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = words.encode(text) + int(end_id).to_bytes(words.width, "little")
                ids = np.frombuffer(data, kind).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    row = (doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), part, int(seen[n]))
                    for column, value in zip(rows, row + ((piece,) if with_ids else ())):
                        column.append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    kinds = ", ".join(f"{n} bigint" for n in names) + (", ids array<bigint>" if with_ids else "")
    return docs.mapInArrow(run, kinds)


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    A null text counts as empty and is one piece holding the end id. Every row is a document of its
    own, so ids may be null or repeat. An empty table gives no rows; other columns are ignored.
    Whole texts are encoded, and every id lies in exactly one piece. Sequences are numbered from 0.
    """
    pieces = written(cut(id_text(docs, id_col, text_col), vocabulary, end_id, window, with_ids), "pieces")
    return placed(pieces, lambda histogram: plan(histogram, window))


def placed(pieces: DataFrame, planned: Callable[[dict[int, int]], Plan]) -> DataFrame:
    """Pieces (length, part, rank and more) with sequence_id and offset in place of part and rank.

    ``planned`` gets the number of pieces by length, the only figures that reach the driver. ``rank``
    counts the equal lengths before a piece in its part.
    """
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows
    places = planned(histogram)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    kept = [f for f in pieces.schema.fields if f.name not in ("part", "rank")]
    names = [f.name for f in kept]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            sequence, offset = places.place(length, rank)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in kept]
    return ranked.mapInArrow(assign, ", ".join([*kinds, "sequence_id bigint", "offset bigint"]))
