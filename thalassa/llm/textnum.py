"""Vectorised word and shingle hashing over Arrow string columns (numpy, no per-word Python work).

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash chains
a mixer over its eight-byte pieces, from its length, so equal words have equal 64-bit hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes: a bijection with full avalanche."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: The hash of the end-of-text token of language models.
END = int(mix(np.array([0xE0D], U))[0])


def slices(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of about `limit` bytes (CHUNK_BYTES if not given); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (limit or CHUNK_BYTES), "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word of the rows."""
    solid = ~_SPACE[data]
    first, final = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    final[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] |= solid[edge]
    edge = edge[edge > 0] - 1
    final[edge] |= solid[edge]
    return np.flatnonzero(first), np.flatnonzero(final) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its row, first word of each row as n+1 bounds)."""
    n = len(offsets) - 1
    starts, ends = bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    length = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data]
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    h = mix(length.astype(U) * U(0x9E3779B97F4A7C15))
    h = mix(h ^ (eight[starts] & _FIRST[np.minimum(length, 8)]))
    more = np.flatnonzero(length > 8)
    done = 8
    while len(more):
        h[more] = mix(h[more] ^ (eight[starts[more] + done] & _FIRST[np.minimum(length[more] - done, 8)]))
        done += 8
        more = more[length[more] > done]
    of_row = np.searchsorted(starts, offsets)
    return h, np.repeat(np.arange(n), np.diff(of_row)), of_row


_FACTORS = mix(np.arange(11, 11 + 64, dtype=U)) | U(1)


def shingles(h: np.ndarray, row: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of a row, in order; a row with fewer words has its whole sequence as one."""
    m = len(h) - k + 1
    if m > 0:
        s = np.zeros(m, U)
        for j in range(k):
            s += h[j : j + m] * _FACTORS[j]
        keep = row[:m] == row[k - 1 :]
        s, r = mix(s[keep]), row[:m][keep]
    else:
        s, r = np.zeros(0, U), np.zeros(0, np.int64)
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), U)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += h[bounds[short[has]] + j] * _FACTORS[j]
        extra = mix(extra + count[short].astype(U) * _FACTORS[63])
        s, r = np.append(s, extra), np.append(r, short)
        order = np.argsort(r, kind="stable")
        s, r = s[order], r[order]
    return s, r


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row, in row order."""
    for _, data, offsets in slices(column):
        s, r = shingles(*words(data, offsets), k)
        cut = np.searchsorted(r, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            x = np.sort(s[cut[i] : cut[i + 1]])
            yield x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
