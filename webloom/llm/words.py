"""Vectorised word splitting and hashing over Arrow string columns.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the
same as a match of ``[^\\x20\\x09-\\x0D]+`` over code points. Texts are hashed whole, in
segments that end between words, so memory follows the segment and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1 << 62, (1 << 64) - 1, 256, dtype=np.uint64) | np.uint64(1)
_COEF = _RNG.integers(1 << 62, (1 << 64) - 1, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        factors = np.full(max(n, SEGMENT + 4096), base, np.uint64)
        factors[0] = 1
        kept = _powers[base] = np.multiply.accumulate(factors)
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 2 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def _segment(data: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; ``breaks``: positions where a new text begins."""
    inside = ~_SEP[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    breaks = breaks[breaks < len(data)]
    first[breaks] = inside[breaks]
    before = breaks[breaks > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    value = _BYTE[_LOWER[data]] if lower else _BYTE[data]
    value *= _power(_BASE, len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    hashed = (total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return starts, mix(hashed + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the words before each row (rows + 1 numbers)."""
    begin, hashes, starts = 0, [], []
    while begin < len(data):
        end = min(len(data), begin + SEGMENT)
        if end < len(data):
            back = np.flatnonzero(_SEP[data[max(begin, end - 4096) : end]])
            if len(back):
                end = max(begin, end - 4096) + int(back[-1]) + 1
            else:
                ahead = end
                while ahead < len(data):
                    found = np.flatnonzero(_SEP[data[ahead : ahead + SEGMENT]])
                    if len(found):
                        ahead += int(found[0])
                        break
                    ahead = min(len(data), ahead + SEGMENT)
                end = ahead
        at = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end)] - begin
        s, h = _segment(data[begin:end], at, lower)
        starts.append(s + begin)
        hashes.append(h)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, offsets)


def windows(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of ``width`` words within a row: hash, row, and first word's index in the row."""
    n = len(hashes) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    ok = np.flatnonzero(row[:n] == row[width - 1 :])
    total = hashes[:n] * _COEF[0]
    for k in range(1, width):
        total += hashes[k : k + n] * _COEF[k]
    row = row[ok]
    return mix(total[ok]), row, ok - before[row]
