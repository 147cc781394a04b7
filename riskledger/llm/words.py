"""Words of UTF-8 texts as numpy arrays: spans, 64-bit identities and rolling window hashes.

A word is a longest run of bytes other than ``\\x20`` and ``\\x09`` to ``\\x0D``. All functions
work on a slice of several texts laid end to end, as Arrow stores a string column, so the cost
per text is small; no word crosses the border of two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Odd base of the polynomial over the bytes of a word, and over the words of a window.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def text_slices(column: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, row offsets) for runs of rows of about ``most_bytes`` bytes.

    A null counts as an empty text. A single longer text makes a slice of its own.
    """
    for chunk, first in _chunks(column):
        buffers = chunk.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(chunk) + 1 + chunk.offset)[chunk.offset :]
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        low = 0
        while low < len(chunk):
            high = int(np.searchsorted(offsets, offsets[low] + most_bytes, side="right")) - 1
            high = min(max(high, low + 1), len(chunk))
            yield first + low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high


def _chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            yield pc.fill_null(chunk.cast(pa.large_string()), ""), first
        first += len(chunk)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each row the number of words before it."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    border = offsets[(offsets > 0) & (offsets < len(data))]
    opens[border] = inside[border]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[border - 1] = inside[border - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n-1, modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0], done = 1, 1
    step = base & _MASK
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        step, done = step * step & _MASK, done + more
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each word, from a polynomial over its bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(total, dtype=np.int64) - np.repeat(firsts, lengths)
    values = data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    values *= powers(BYTE_BASE, int(lengths.max()))[place]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64) * np.uint64(WORD_BASE))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp values of all windows of ``width`` consecutive words.

    Shorter powers of two are joined, so the work is log(width) passes and no division.
    """
    count = len(words) - width + 1
    if count < 1:
        return np.empty(0, np.uint64)
    have, size, base, shift = words, 1, WORD_BASE, 1
    out, done, rest = np.zeros(count, np.uint64), 0, width
    pieces = []
    while rest:
        if rest & 1:
            pieces.append((size, have))
        rest >>= 1
        if rest:
            have = have[:-size] * np.uint64(base) + have[size:]
            base, size = base * base & _MASK, size * 2
    for size, have in reversed(pieces):
        shift = pow(WORD_BASE, size, 1 << 64)
        out = out * np.uint64(shift) + have[done : done + count]
        done += size
    return mix(out)


def owner(offsets: np.ndarray, count: int) -> np.ndarray:
    """Row of each of ``count`` items when ``offsets`` holds the items before each row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
