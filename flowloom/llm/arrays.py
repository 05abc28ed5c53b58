"""NumPy helpers over batches of texts: bytes, words, shingles, hashes, sliding minima.

Everything works on the concatenated UTF-8 bytes of a bounded group of rows, so the cost per
document is that of its bytes. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
_U = np.uint64
#: Substring hashes are polynomials modulo this prime at two points, so no text collides whatever the points are.
_PRIME = (1 << 31) - 1
_POINTS = (1_318_699_213, 725_304_877)
#: Random 64-bit value of every byte; the second table sees A-Z as a-z.
TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[65:91] = TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def text_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of about ``limit`` bytes; null is empty.

    A text larger than the limit makes a group of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _folded(x: np.ndarray) -> np.ndarray:
    """A value below 2^32 that is equal to ``x`` (below 2^62) modulo the prime."""
    return (x & _U(_PRIME)) + (x >> _U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` below 2^63 modulo the prime."""
    x = _folded(_folded(x))
    return np.minimum(x, x - _U(_PRIME))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.setdefault(base, np.ones(1, np.uint32))
    while len(known) < n:
        more = _reduced(known.astype(np.uint64) * _U(pow(base, len(known), _PRIME))).astype(np.uint32)
        known = _powers[base] = np.concatenate([known, more])
    return known[:n]


class Substrings:
    """62-bit hashes of arbitrary substrings of a byte (or 64-bit symbol) sequence in constant time each.

    Symbols are given as random 64-bit values. Two different strings of n symbols collide with a chance of about (n / 2^31)^2 at most.
    """

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros((2, len(values) + 1), np.uint64)
        for row, base, part in zip(self.sums, _POINTS, (values >> _U(33), values & _U(_PRIME))):
            np.cumsum(_folded(part * _power(base, len(values))), out=row[1:])

    def _joined(self, low: np.ndarray | slice, high: np.ndarray | slice, at: np.ndarray | slice, sizes: np.ndarray | np.uint64) -> np.ndarray:
        n = self.sums.shape[1]
        one, two = (
            _reduced(_folded(row[high] - row[low]) * _power(pow(base, -1, _PRIME), n)[at]) for row, base in zip(self.sums, _POINTS)
        )
        return mix((one << _U(31) | two) + sizes)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._joined(starts, ends, starts, (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of one size, by start."""
        n = max(0, self.sums.shape[1] - size)
        return self._joined(slice(0, n), slice(size, size + n), slice(0, n), _U(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each document's first word (one more at the end)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inner = ~SPACE[data]
    start = inner.copy()
    start[1:] &= ~inner[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] |= inner[edges]
    end = inner.copy()
    end[:-1] &= ~inner[1:]
    end[edges - 1] |= inner[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    return Substrings((LOWER_TABLE if lower else TABLE)[data])(starts, ends)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words and each document's bounds in it.

    With ``short``, a document of fewer words has its whole sequence as its one shingle.
    """
    n_words = np.diff(bounds)
    counts = np.maximum(n_words - size + 1, 0)
    if short:
        counts[(n_words > 0) & (n_words < size)] = 1
    at = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=at[1:])
    if at[-1] == 0:
        return np.zeros(0, np.uint64), at
    starts = np.repeat(bounds[:-1] - at[:-1], counts) + np.arange(at[-1])
    ends = np.minimum(starts + size, np.repeat(bounds[1:], counts))
    return Substrings(hashes)(starts, ends), at


def sets_of(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each document's sorted distinct values."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[start:start + size]``."""
    total = int(sizes.sum())
    if total == 0:
        return flat[:0]
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(total)]


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Index of the leftmost smallest value of every window of ``size`` values, by window start."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64)
    have = 1
    while have < size:  # windows twice as long, the last step with overlap
        step = min(have, size - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best[:n]


def binary_rows(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow binary column of ``data[bounds[i]:bounds[i + 1]]``."""
    data = np.ascontiguousarray(data).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])
