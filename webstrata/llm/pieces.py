"""SentencePiece encoding by batched Viterbi, and decoding.

Words of one length advance together: at every position the keys of all substrings ending there
are looked up among the sorted piece keys, each hit is scored, and the best one is stored as a back
pointer. In a unigram model a hit scores its log probability plus the best score before it. In a
merge (BPE) model the best segmentation is not the one with the largest sum, so there a hit counts
only if merging its text together with the last piece before it gives just these two pieces again.
Exactly one hit passes at each position, and following the back pointers gives the ids that the
merges give; this is the same search with another score. Words are remembered per worker.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import held, id_text, in_slices
from webstrata.llm.lattice import PieceTable, by_length, code_points

#: Remembered words per worker and generation.
ENTRIES = 500_000
#: Log2 of the remembered piece pairs.
PAIR_BITS = 22
#: Documents whose new words are encoded together.
SLICE = 200
#: Stands for a space inside pieces. Fixed value.
MARK = "▁"

_MIX = np.uint64(0x9E3779B97F4A7C15)

ENCODED = "doc_id bigint, n_pieces bigint, ids array<int>"
DECODED = "doc_id bigint, text string"


class Pieces:
    """A SentencePiece model file with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.text = [model.id_to_piece(k) for k in range(size)]
        self.score = np.array([model.get_score(k) for k in range(size)])
        self.unigram, self.unknown = unigram, model.unk_id()
        self.byte_of = {k: int(self.text[k][3:5], 16) for k in range(size) if model.is_byte(k)}
        self.byte_id = {b: k for k, b in self.byte_of.items()}
        special = {k for k in range(size) if model.is_control(k) or model.is_unknown(k) or model.is_unused(k)}
        normal = [k for k in range(size) if k not in special and k not in self.byte_of]
        self.id_of = {self.text[k]: k for k in normal}
        self.table = PieceTable([self.text[k] for k in normal], normal)
        #: Neighbouring characters inside pieces: between any other two a word may be cut.
        self.joined = {t[k : k + 2] for t in self.id_of for k in range(len(t) - 1)}
        self.bytes = [b"" if k in special else bytes([self.byte_of[k]]) if k in self.byte_of else t.replace(MARK, " ").encode() for k, t in enumerate(self.text)]
        self.bytes[self.unknown] = " ⁇ ".encode()
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lowest = self.score[normal].min()

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging the best-scored neighbours, leftmost first, one after the other."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.id_of.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of two pieces gives the two again; below 0 is an unknown character."""
        ok = np.ones(len(left), bool)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[known] << 32 | right[known]
        slots = ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        values = self.pair_ok[slots]
        missed = np.flatnonzero(self.pair_keys[slots] != keys)
        if missed.size:
            fresh, back = np.unique(keys[missed], return_inverse=True)
            found = np.empty(len(fresh), bool)
            for k, key in enumerate(fresh.tolist()):
                a, b = self.text[key >> 32], self.text[key & 0xFFFFFFFF]
                found[k] = a[-1] + b[0] not in self.joined or self.merge(a + b) == [a, b]
            values[missed] = found[back]
            self.pair_keys[slots[missed]] = -1  # two pairs of one slot: the last one written stays, with its value
            self.pair_ok[slots[missed]] = values[missed]
            self.pair_keys[slots[missed]] = keys[missed]
        ok[known] = values
        return ok

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a character without a piece is -1 minus its code point."""
        out: list = [None] * len(words)
        for n, group in by_length(words):
            chars = code_points([words[k] for k in group], n)
            found = self.table.starts(chars)
            found[0] = np.where(found[0] < 0, -2 - chars.astype(np.int64), found[0])
            rows = len(group)
            best = np.zeros((n + 1, rows))
            length_at, piece_at = np.zeros((n + 1, rows), np.int64), np.full((n + 1, rows), -1, np.int64)
            for j in range(1, n + 1):
                top = np.full(rows, -np.inf)
                for length in range(1, min(j, len(found)) + 1):
                    ids = found[length - 1][:, j - length]
                    hit = np.flatnonzero(ids != -1)
                    if not hit.size:
                        continue
                    hits = ids[hit]
                    if self.unigram:
                        gain = np.where(hits >= 0, self.score[hits], self.lowest - 10.0)
                        score = best[j - length, hit] + gain
                    else:
                        before = piece_at[j - length, hit]
                        ok = self._stable(before, hits) if j > length else np.ones(len(hits), bool)
                        score = np.where(ok, float(length), -np.inf)
                    better = score > top[hit]
                    at = hit[better]
                    top[at] = score[better]
                    length_at[j, at], piece_at[j, at] = length, hits[better]
                best[j] = top
            steps, ends = [], np.full(rows, n)
            lanes = np.arange(rows)
            while (ends > 0).any():
                steps.append(np.where(ends > 0, piece_at[ends, lanes], -1))
                ends = ends - np.where(ends > 0, length_at[ends, lanes], 0)
            taken = np.array(steps[::-1]).T
            for k, ids in zip(group.tolist(), taken.tolist()):
                out[k] = [x for x in ids if x != -1]
        return out

    def _final(self, ids: list[int], before_unknown: bool = False) -> bytes:
        flat: list[int] = []
        for k in ids:
            if k >= 0:
                flat.append(k)
            elif self.byte_id:
                flat.extend(self.byte_id[b] for b in chr(-2 - k).encode("utf-8", "replace"))
            elif not (flat and flat[-1] == self.unknown):
                flat.append(self.unknown)
        return np.array(flat, "<i4").tobytes()

    def chunks(self, text: str) -> list[str]:
        """The text with the mark for spaces, cut before every run of marks; joined they give it back."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text:
            return [MARK + c for c in text.split(" ")]
        marked = MARK + text.replace(" ", MARK)
        out, at = [], 0
        for k in range(1, len(marked)):
            if marked[k] == MARK and marked[k - 1] != MARK:
                out.append(marked[at:k])
                at = k
        return [*out, marked[at:]]

    def _cut(self, word: str) -> list[str]:
        """Parts between characters that no piece joins; plain words are left whole."""
        if word[1:].isalnum():
            return [word]
        edges = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.joined]
        return [word[a:b] for a, b in zip([0, *edges], [*edges, len(word)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.chunks(t) for t in texts]
        asked = set().union(*split)
        new = asked.difference(self.words)
        if len(self.words) + len(new) > ENTRIES:  # words still in use come back from the older generation
            self.older, self.words = self.words, {}
            new = asked
        back = new.intersection(self.older)
        self.words.update((w, self.older[w]) for w in back)
        new = new.difference(back)
        if self.unigram:
            words = list(new)
            self.words.update(zip(words, map(self._final, self.viterbi(words))))
        else:
            parts = {w: self._cut(w) for w in new}
            fresh = list(set().union(*parts.values()).difference(self.words)) if parts else []
            self.words.update(zip(fresh, map(self._final, self.viterbi(fresh))))
            self.words.update((w, b"".join([self.words[p] for p in ps])) for w, ps in parts.items() if len(ps) > 1)
        return [b"".join(map(self.words.__getitem__, s)) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the dummy prefix goes and broken byte runs become the replacement character."""
        text = b"".join([self.bytes[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def pieces(path: str, unigram: bool = False) -> Pieces:
    """The worker's model."""
    return held(("pieces", path, unigram), lambda: Pieces(path, unigram))


def encode(docs: DataFrame, path: str, unigram: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces and ids, with neither begin nor end mark.

    A null or empty text has no ids. Ids of rows may be null or repeat; an empty table gives no
    rows, and other columns are ignored. Texts are encoded whole. ``unigram`` reads the scores as
    log probabilities, for models of that kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, unigram)
        for batch in in_slices(batches, SLICE):
            data = model.encode(batch.column(1).to_pylist())
            sizes = np.array([len(d) // 4 for d in data], np.int32)
            flat = pa.array(np.frombuffer(b"".join(data), "<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), ids], ["doc_id", "n_pieces", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in in_slices(batches, SLICE):
            texts = [model.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, int)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of encoding and decoding per row: doc_id, n_pieces, ids_crc32, n_chars of the decoded text, same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in in_slices(batches, SLICE):
            texts = batch.column(1).to_pylist()
            data = model.encode(texts)
            back = [model.decode(np.frombuffer(d, "<i4")) for d in data]
            same = [a == b for a, b in zip(texts, back)]
            n = pa.array([len(d) // 4 for d in data], pa.int64())
            crc = pa.array([zlib.crc32(d) for d in data], pa.int64())
            chars = pc.cast(pc.utf8_length(pa.array(back, pa.string())), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, crc, chars, pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "n_chars", "same"])

    kinds = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, n_chars bigint, same boolean"
    return id_text(docs, id_col, text_col).mapInArrow(run, kinds)
