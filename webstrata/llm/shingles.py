"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for positions below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_B, _INVERSE)):
            out = np.full(size, base)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A hash per word; words are runs of anything but ASCII white space, A-Z counts as a-z."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        part = _BYTE[data[low : ends[to - 1]]]
        up, down = _power(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * up[:-1], dtype=np.uint64)])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted different shingles of ``width`` words; a shorter text is one shingle, one without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    h = np.full(n, np.uint64(width_here))
    for k in range(width_here):
        h = h * _B + words[k : k + n]
    return np.unique(mix(h))


def sets_of(texts: list[str], width: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(text, width)
