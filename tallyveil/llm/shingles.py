"""Word shingles of many texts at once, as 64-bit hashes, on the bytes of an Arrow string column.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lowered. A word's hash is its slice of one
running polynomial sum over the bytes of the piece, shifted back to position 0; a shingle's hash mixes the
hashes of its words in order. Everything is a handful of array operations per piece of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def draws(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def text_pieces(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of neighbouring rows with about ``limit`` bytes; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of the first word of each row and the end)."""
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    n = len(data)
    borders = offsets[(offsets > 0) & (offsets < n)]
    starts[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    running = np.zeros(n + 1, _U)
    np.cumsum(draws(256, 7)[lower] * _power(_BASE, n), out=running[1:])
    words = mix((running[last] - running[first]) * _power(_INVERSE, n + 1)[first] + (last - first).astype(_U))
    return words, np.searchsorted(first, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, index of the first shingle of each row and the end).

    A row with fewer words than ``width`` has its whole sequence as one shingle; a row without words has none.
    """
    words, rows = word_hashes(data, offsets)
    weights = draws(width, 11) | _U(1)
    padded = np.concatenate([words, np.zeros(width, _U)])
    sums = np.zeros(len(words), _U)
    counts = np.diff(rows)
    for k in range(width):
        sums += padded[k : k + len(words)] * weights[k]
    short = np.flatnonzero((counts > 0) & (counts < width))
    for r in short:
        a, n = rows[r], counts[r]
        sums[a] = (words[a : a + n] * weights[:n]).sum(dtype=_U) + _U(int(n) * 0x51)
    kept = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    index = np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(kept)[:-1]]), kept) + np.arange(kept.sum())
    return mix(sums[index]), np.concatenate([[0], np.cumsum(kept)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, at = shingle_hashes(data, offsets, width)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
