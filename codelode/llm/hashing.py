"""Word and shingle hashes of whole Arrow text columns, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[_BLANK] = 0
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1
_POWERS = np.multiply.accumulate(np.full(1 << 12, _BASE, np.uint64))
#: For words of letters only: everything else in ASCII is blank.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: One odd factor per position of a shingle.
FACTORS = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (runs without ``blank`` bytes), and the rows' bounds among the words."""
    inside = ~blank[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, fold: bool = False, blank: np.ndarray = _BLANK
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z as a-z with ``fold``), and the rows' bounds among the words."""
    starts, ends, bounds = word_spans(data, offsets, blank)
    out = np.empty(len(starts), np.uint64)
    lut = np.where(blank, np.uint64(0), _FOLD if fold else _BYTE)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SLICE)))
        low, high = starts[i], ends[j - 1]
        length = np.diff(np.append(starts[i:j], high))
        at = np.arange(high - low) - np.repeat(starts[i:j] - low, length)
        part = lut[data[low:high]] * _POWERS[at & (len(_POWERS) - 1)]
        if length.max() > len(_POWERS):
            # The powers go on: a block of them further, every factor is multiplied by the power of a whole block once more.
            block = at // len(_POWERS)
            part *= np.multiply.accumulate(np.append(np.uint64(1), np.full(block.max(), _POWERS[-1], np.uint64)))[block]
        out[i:j] = np.add.reduceat(part, starts[i:j] - low) + (ends[i:j] - starts[i:j]).astype(np.uint64) * FACTORS[255]
        i = j
    return mix(out), bounds


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words; callers leave out those across a row's end."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = hashes[: len(hashes) - n + 1] * FACTORS[0]
    for k in range(1, n):
        total += hashes[k : len(hashes) - n + 1 + k] * FACTORS[k]
    return mix(total)


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` consecutive grams the position of the smallest, the rightmost among equals."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    low = np.arange(len(grams) - window + 1)
    best = low.copy()
    least = grams[low].copy()
    for k in range(1, window):
        value = grams[low + k]
        take = value <= least
        least[take] = value[take]
        best[take] = low[take] + k
    return best


def as_longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    """An array column of longs, one run of ``values`` per row."""
    bounds = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), as_longs(values))
