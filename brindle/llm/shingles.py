"""Hashed word shingles of whole texts, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEED = 90_001
# Bytes of text worked on together; a longer text is worked on alone.
SLICE_BYTES = 1 << 21

_random = np.random.default_rng(SEED)
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)
_SHORT = _random.integers(1, 1 << 63, 64, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_powers = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """Powers of the base up to exponent n."""
    global _powers
    if len(_powers) <= n:
        more = np.full(2 * n + 2, _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each text starts (one more than there are texts). NULL counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every word, A-Z lowered; words are runs of anything but space and 09-0D."""
    low = _LOW[data]
    first = ~_SPACE[low]
    inner = first.copy()
    first[1:] &= ~inner[:-1]
    edge = starts[(starts > 0) & (starts < len(data))]
    first[edge] = inner[edge]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(at, append=len(data)))
    place[~inner[at[0] :]] = 0
    sums = np.add.reduceat(_BYTE[low[at[0] :]] * _power(int(place.max()))[place], at - at[0])
    return mixed(sums), np.searchsorted(starts, at, "right") - 1


def _shingles(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, repeats kept, and where each text starts among them."""
    n = len(starts) - 1
    words, owner = _words(data, starts)
    held = np.bincount(owner, minlength=n)
    bounds = np.concatenate(([0], np.cumsum(np.where(held >= size, held - size + 1, np.minimum(held, 1)))))
    out = np.empty(bounds[-1], np.uint64)
    word_at = np.concatenate(([0], np.cumsum(held)))
    if len(words) >= size:
        windows = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            windows += words[i : len(words) - size + 1 + i] * _PLACE[i]
        inside = np.flatnonzero(owner[: len(windows)] == owner[size - 1 :])
        out[bounds[owner[inside]] + inside - word_at[owner[inside]]] = windows[inside]
    short = np.flatnonzero((held > 0) & (held < size))
    for i in range(size - 1):
        some = short[held[short] > i]
        if i == 0:
            out[bounds[some]] = _SHORT[held[some]]
        out[bounds[some]] += words[word_at[some] + i] * _PLACE[i]
    return mixed(out), bounds


def shingle_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, hashes, bounds) for groups of whole texts.

    A text with fewer than ``size`` words is one shingle, a text without words none.
    """
    data, starts = _bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, *_shingles(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], size)
        lo = hi


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(h[b[i] : b[i + 1]]) for lo, hi, h, b in shingle_slices(texts, size) for i in range(hi - lo)]
