"""Which pieces of a vocabulary stand where in words, for many words of one length at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def code_points(words: list[str], n: int) -> np.ndarray:
    """Code points of words of ``n`` characters, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)


def by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[int, np.ndarray]]:
    """``(length, positions)`` of the words in blocks of equal length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, edges):
        if len(group):
            n = int(sizes[group[0]])
            step = max(1, most * 8 // max(n, 8))
            for at in range(0, len(group), step):
                yield n, group[at : at + step]


class PieceTable:
    """Sorted 64-bit keys of the pieces. A substring's key is looked up among the few keys that share its top bits."""

    TOP = 20

    def __init__(self, pieces: list[str], ids: list[int]):
        self.longest, self.size = max(map(len, pieces)), len(pieces)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one key")
        edges = np.searchsorted(self.keys >> np.uint64(64 - self.TOP), np.arange((1 << self.TOP) + 1, dtype=np.uint64))
        self.first, self.most = edges[:-1].astype(np.int32), int(np.diff(edges).max())
        pad = np.full(self.most, self.keys[-1])
        self.keys, self.ids = np.append(self.keys, pad), np.append(self.ids, np.full(self.most, self.ids[-1]))

    @staticmethod
    def _key(piece: str) -> int:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for c in piece:
                h = (h + np.uint64(ord(c) + 1)) * _BASE
                h ^= h >> np.uint64(29)
        return int(h)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of keys, -1 where no piece has the key."""
        at = self.first[keys >> np.uint64(64 - self.TOP)]
        out = np.where(self.keys[at] == keys, self.ids[at], -1)
        for _ in range(1, self.most):
            at += 1
            hit = np.flatnonzero(self.keys[at] == keys)
            out[hit] = self.ids[at[hit]]
        return out

    def starts(self, chars: np.ndarray) -> list[np.ndarray]:
        """``out[l - 1][w, i]``: id of the piece of length l at position i of word w, or -1."""
        n = chars.shape[1]
        h, out = np.zeros_like(chars), []
        for length in range(1, min(n, self.longest) + 1):
            h = h[:, : n - length + 1]
            h = (h + chars[:, length - 1 :] + np.uint64(1)) * _BASE
            h = h ^ (h >> np.uint64(29))
            out.append(self.find(h.ravel()).reshape(h.shape))
        return out
