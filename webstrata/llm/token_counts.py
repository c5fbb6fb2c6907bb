"""Token counts of byte-level byte-pair vocabularies without producing ids.

Every word becomes a linked list of byte symbols and a heap of its adjacent pairs by merge rank.
The lowest rank is merged again and again; the count is the number of symbols less the number of
merges. Words are remembered per worker with their counts.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from webstrata.llm.common import held, id_text
from webstrata.llm.words import BYTE_LEVEL, SpacedChunks, byte_symbols

#: Words remembered per worker and generation.
ENTRIES = 300_000

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class Merges:
    """Ranks of pairs, with symbols as small numbers."""

    def __init__(self, merges: list[tuple[str, str]]):
        number: dict[str, int] = {}
        self.of_byte = [number.setdefault(s, len(number)) for _, s in sorted(byte_symbols().items())]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = number.setdefault(a, len(number)), number.setdefault(b, len(number))
            self.ranks[pair] = rank, number.setdefault(a + b, len(number))

    def count(self, word: bytes) -> int:
        """Symbols that are left of ``word`` after all merges."""
        n = len(word)
        if n < 2:
            return n
        ranks = self.ranks
        symbol = [self.of_byte[b] for b in word]
        heap = [(*ranks[p], k, p) for k, p in enumerate(zip(symbol, symbol[1:])) if p in ranks]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = 0
        while heap:
            _, new, k, (a, b) = heapq.heappop(heap)
            nxt = after[k] if symbol[k] == a else n
            if nxt >= n or symbol[nxt] != b:
                continue  # one of the two has been merged meanwhile
            symbol[k], symbol[nxt] = new, -1
            merged += 1
            end = after[k] = after[nxt]
            if end < n:
                before[end] = k
                if (r := ranks.get(p := (new, symbol[end]))) is not None:
                    heapq.heappush(heap, (*r, k, p))
            if (start := before[k]) >= 0 and (r := ranks.get(p := (symbol[start], new))) is not None:
                heapq.heappush(heap, (*r, start, p))
        return n - merged


def counter(vocabulary: str) -> SpacedChunks:
    """The worker's counts of chunks under a byte-level vocabulary file; its special strings count as one token."""
    return held(("counter", vocabulary), lambda: _counter(vocabulary))


def _counter(vocabulary: str) -> SpacedChunks:
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    merges = Merges(pairs)
    split = regex.compile(BYTE_LEVEL).findall
    special = [regex.escape(t["content"]) for t in spec.get("added_tokens", ())]
    cut = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None

    def plain(text: str) -> int:
        return sum([merges.count(w.encode()) for w in split(text)])

    def make(chunk: str) -> int:
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):  # one word
            return merges.count(chunk.encode())
        if cut is None:
            return plain(chunk)
        parts = cut.split(chunk)
        return sum(map(plain, parts)) + len(parts) - 1

    return SpacedChunks(make, ENTRIES)


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null text counts as empty: no bytes and no tokens. Ids may be null or repeat; every row
    counts by itself. An empty table gives no rows, and other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = counter(vocabulary)
        for batch in batches:
            n = pa.array([chunks.reduce(t, sum) for t in batch.column(1).to_pylist()], pa.int64())
            size = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return id_text(docs, id_col, text_col).mapInArrow(count, COUNTS)
