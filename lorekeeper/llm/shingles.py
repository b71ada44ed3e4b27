"""Sets of hashed word shingles, computed over whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, the number of its first word (one more entry at the end)."""
    is_word = _IS_WORD[data]
    edges = offsets[1:-1]
    before = np.empty_like(is_word)
    before[:1], before[1:] = False, is_word[:-1]
    before[edges[edges < len(data)]] = False
    after = np.empty_like(is_word)
    after[-1:], after[:-1] = False, is_word[1:]
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    words = (sums[ends] - sums[starts]) * _power("down", _BASE_INVERSE, len(data))[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix(words + (ends - starts).astype(np.uint64) * _M2), np.searchsorted(starts, offsets)


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of texts of about ``SLICE`` bytes."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct ``k``-word shingles of each text.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` with A-Z in lower case.
    A text with fewer than ``k`` words has its whole sequence as its one shingle;
    a text without words has none.  The column must not have nulls.
    """
    factors = [np.uint64(pow(_BASE, 2 * i + 3, 2**64)) for i in range(k)]
    with np.errstate(over="ignore"):
        for data, offsets in _slices(column):
            words, first = _word_hashes(data, offsets)
            grams = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
            for i, f in enumerate(factors):
                grams += words[i : i + len(grams)] * f
            grams = mix(grams)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= k:
                    g = np.sort(grams[a : b - k + 1])
                    yield g[np.concatenate(([True], g[1:] != g[:-1]))]
                elif b > a:
                    short = sum((words[a + i] * factors[i] for i in range(b - a)), start=np.uint64(b - a))
                    yield mix(np.array([short], dtype=np.uint64))
                else:
                    yield grams[:0]
