"""Packing into as few fixed windows as possible by a configuration linear program.

Only documents longer than the window are cut. A configuration is a multiset of piece lengths that
fits the window; the linear program asks for the least number of configurations, fractions allowed,
that cover the histogram of lengths. It is solved by multiplicative weights: every length carries a
price, an unbounded-knapsack dynamic program finds for each length the dearest filling of what it
leaves of the window, these configurations serve the round's share of the histogram, and the price
of a length falls exponentially with what it has been served beyond its share. The prices are also a
dual solution and bound from below how many windows any packing needs. Repeats are rounded down, so
the larger the table the smaller the residue, which is packed best fit decreasing.

The histogram, at most one number per length up to the window, is all that reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from webstrata.llm.common import id_text, in_slices
from webstrata.llm.packing import Plan, laid_out, placed
from webstrata.llm.words import encoder
from webstrata.session import written

WINDOW = 1024
#: Rounds of the solution.
ROUNDS = 120
#: How fast a price falls with what a length was served beyond its share, in shares of a round.
RATE = 0.03
#: A length is served in one of so many rounds, for all of them at once.
TURNS = 8
#: Documents per output batch of the cutting step.
SLICE = 500


def price(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best sum of values in every capacity, and the length put in last there.

    ``values[length]`` is positive for lengths that exist. Capacities in which nothing more pays take
    the last length of the largest smaller one; 0 stands for none.
    """
    lengths = np.flatnonzero(values)
    worth = values[lengths]
    best, last = np.zeros(window + 1), np.zeros(window + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(window + 1), "right")
    for c in range(1, window + 1):
        best[c], last[c] = best[c - 1], last[c - 1]
        if fits[c]:
            sums = best[c - lengths[: fits[c]]] + worth[: fits[c]]
            k = int(sums.argmax())
            if sums[k] > best[c]:
                best[c], last[c] = sums[k], lengths[k]
    return best, last


def fillings(last: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    """The lengths that fill each space best, a row per space, zeros at the end."""
    left, columns = spaces.copy(), []
    while (put := last[left]).any():
        columns.append(put)
        left = np.where(put > 0, left - put, 0)
    return np.stack(columns, 1) if columns else np.zeros((len(spaces), 0), np.int64)


@dataclass(frozen=True)
class Solution:
    """Repeats of configurations (descending lengths), and a lower bound on the number of windows."""

    repeats: dict[tuple[int, ...], float]
    bound: float


def solve(counts: np.ndarray, window: int, rounds: int = ROUNDS, rate: float = RATE) -> Solution:
    """Configurations that cover ``counts[length]`` pieces of each length, by multiplicative weights."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return Solution({}, 0.0)
    need = counts[lengths].astype(float)
    served, share = np.zeros(window + 1), np.zeros(window + 1)
    share[lengths] = need / rounds
    repeats: dict[tuple[int, ...], float] = defaultdict(float)
    bound = float((lengths * need).sum() / window)
    for t in range(1, rounds + 1):
        prices = np.zeros(window + 1)
        ahead = served[lengths] / share[lengths] - t
        prices[lengths] = lengths * np.exp(np.clip(-rate * ahead, -30, 30))
        best, last = price(prices, window)
        bound = max(bound, float((prices[lengths] * need).sum() / best[window]))
        due = np.flatnonzero((served[lengths] < share[lengths] * t) & ((np.arange(len(lengths)) + t) % TURNS == 0) | (t == rounds))[::-1]
        for head, row in zip(lengths[due].tolist(), fillings(last, window - lengths[due])):
            short = share[head] * min(rounds, t + TURNS - 1) - served[head]
            if short <= 0:
                continue
            row = row[row > 0]
            times = short / (1 + int((row == head).sum()))
            served[head] += times
            np.add.at(served, row, times)
            repeats[tuple(sorted([head, *row.tolist()], reverse=True))] += times
    return Solution(dict(repeats), bound)


def plan(histogram: dict[int, int], window: int = WINDOW, rounds: int = ROUNDS) -> Plan:
    """Places for ``histogram[length]`` pieces of every length from 1 to ``window``."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    chosen: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], repeats: int) -> int:
        most = int(min([repeats, *(left[k] // m for k, m in pattern.items())]))
        if most > 0:
            for k, m in pattern.items():
                left[k] -= m * most
            chosen.append((pattern, most))
        return most

    if left[window]:
        take({window: 1}, int(left[window]))
    solution = solve(left, window, rounds)
    served = np.full(window + 1, 1e-9)
    for lengths, x in solution.repeats.items():
        np.add.at(served, list(lengths), x)
    scale = np.minimum(1, left / served)  # what was served beyond the histogram is given back
    for lengths, x in sorted(solution.repeats.items(), key=lambda e: (-e[1], e[0])):
        pattern: dict[int, int] = defaultdict(int)
        for length in lengths:
            pattern[length] += 1
        take(dict(pattern), int(x * scale[list(lengths)].min()))
    while (lengths := np.flatnonzero(left)).size:  # best fit decreasing; every round uses up a length or a window
        space, pattern = window, {}
        while (at := np.searchsorted(lengths, space, "right") - 1) >= 0:
            length = int(lengths[at])
            pattern[length] = int(min(space // length, left[length]))
            space -= length * pattern[length]
            lengths = lengths[:at]
        take(pattern, int(left.sum()))
    return laid_out(chosen)


def cut(docs: DataFrame, vocabulary: str, end_id: int, window: int, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids, with the task that made each and its rank there among equal lengths."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    schema = pa.schema([*zip(names, kinds), *[("ids", pa.list_(pa.int64()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        end, kind = int(end_id).to_bytes(words.width, "little"), f"<u{words.width}"
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in in_slices(batches, SLICE):
            rows: list[list] = [[] for _ in schema.names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(words.encode(text) + end, kind).astype("<u4")
                start, stop = 0, len(ids) % window or window
                for piece in range(-(-len(ids) // window)):
                    own = ids[start:stop]
                    row = (doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)]))
                    for column, value in zip(rows, row + ((own,) if with_ids else ())):
                        column.append(value)
                    seen[len(own)] += 1
                    start, stop = stop, stop + window
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint"
    return docs.mapInArrow(run, kinds + (", ids array<bigint>" if with_ids else ""))


def pack_few(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids if asked for,) sequence_id, offset.

    A document of at most ``window`` ids, the end id included, is one piece. A longer one is cut into
    pieces of the whole window, of which the first may be shorter. A null text counts as empty and is
    one piece holding the end id. Every row is a document of its own, so ids may be null or repeat.
    Whole texts of any length are encoded. An empty table gives no rows; other columns, whatever
    their names, are ignored. Sequences are numbered from 0 and their pieces leave no gap.
    """
    pieces = written(cut(id_text(docs, id_col, text_col), vocabulary, end_id, window, with_ids), "few-pieces")
    return placed(pieces, lambda histogram: plan(histogram, window))
