"""Vectorised word and shingle hashing over Arrow string columns (numpy).

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A word's hash is the
sum of a pseudo-random 64-bit value for each (place, byte), mixed with its
length: two different words differ in a value that nothing else cancels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SLOTS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93,
                   0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


#: Values of (place, byte) of the first places, looked up; later ones are computed.
_PLACES = 32
_TABLE = mix(np.arange(_PLACES << 8, dtype=np.uint64) + np.uint64(1))


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(array) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end) of unsigned integers below 2^32; runs don't overlap."""
    size = ends - starts
    at = spread(starts, size)
    place = at - np.repeat(starts, size)
    if values.dtype == np.uint8:
        key = np.minimum(place, _PLACES - 1) << 8 | values[at]
        parts = _TABLE[key]
        far = np.flatnonzero(place >= _PLACES)
        if len(far):
            parts[far] = mix((place[far].astype(np.uint64) << np.uint64(8) | values[at[far]]) + np.uint64(1))
    else:
        parts = mix((place.astype(np.uint64) << np.uint64(32) | values[at]) + np.uint64(1))
    sums = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(parts, out=sums[1:])
    last = np.cumsum(size)
    return mix(sums[last] - sums[last - size] + size.astype(np.uint64))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each of many runs, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def words(raw: np.ndarray, offsets: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in order, the first word's index of each row (n + 1), and
    the words' byte lengths.  ``bare``: ASCII punctuation parts words too."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    low = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    if bare:
        solid = ((low >= 97) & (low <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    else:
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)  # a row begins
    edge[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    edge[n] = True
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return run_hashes(low, starts, ends), np.searchsorted(starts, offsets), ends - starts


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each row, end to end, and
    their row offsets.  A row of 1 to k - 1 words has its whole sequence as the
    one shingle; a row without words has none."""
    if k > len(_SLOTS):
        slots = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    else:
        slots = _SLOTS
    n = len(hashes)
    if n >= k:
        every = hashes[: n - k + 1] * slots[0]
        for i in range(1, k):
            every = every + hashes[i : n - k + 1 + i] * slots[i]
        every = mix(every)
    else:
        every = np.zeros(0, np.uint64)
    out, counts = [], np.zeros(len(first) - 1, np.int64)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= k:
            x = np.sort(every[a : b - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        elif b > a:
            x = mix((hashes[a:b] * slots[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            continue
        counts[d] = len(x)
        out.append(x)
    offsets = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets


def by_row(values: np.ndarray, offsets: np.ndarray, ufunc, empty: int) -> np.ndarray:
    """``ufunc.reduceat`` over rows, with ``empty`` for rows without values."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out
