"""Words and shingles of whole texts as numpy arrays, over a column's bytes rather than one Python string at a time.

A batch is worked through in slices of a few MB, so that memory depends on the slice and on the longest text, not on the
batch. A word is a run of bytes other than space and \\t..\\r; A-Z count as a-z. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1_000_000, 512
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_ODD = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_ODD[0])
_INV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the two bases; those for longer texts than a slice are made anew and not kept."""
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_P, _INV):
        steps = np.full(max(n, SLICE_BYTES + 1), np.uint64(base))
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= SLICE_BYTES + 1:
        _powers[:] = made
    return made


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about `limit` bytes; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for at in range(0, len(texts), SLICE_ROWS):
        part = pc.fill_null(texts.slice(at, SLICE_ROWS).cast(pa.large_string()), "")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(part):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield at + row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes for which `member` holds, cut at the ends of rows."""
    inside = member[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte ranges, from one running sum over the slice; `fold` takes A-Z as a-z."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLD if fold else _BYTE)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD[1])


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row number of every word, in order."""
    starts, ends, rows = runs(data, offsets, ~_SPACE)
    return range_hashes(data, starts, ends, fold), rows


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words of one text; of the whole text where it has fewer words, but at least one."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(n, width)
    out = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        out = out + hashes[k : n - size + 1 + k] * _ODD[2 + k]
    return mix(out)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row."""
    for first, data, offsets in slices(texts):
        hashes, rows = words(data, offsets)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        for k in range(len(offsets) - 1):
            s = np.sort(shingles(hashes[bounds[k] : bounds[k + 1]], width))
            yield first + k, s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
