"""Vectorised byte and word primitives on Arrow string columns.

Texts are handled as UTF-8 bytes; a word is a maximal run of bytes other than
0x20 and 0x09-0x0D, which never splits a code point. All hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
PAD = 16
K1, K2, K3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= K2
    return x ^ (x >> U64(32))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls are empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0 or col.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows whose bytes stay within the limit; a longer row stands alone."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + most)
        yield lo, hi
        lo = hi


def padded(b: np.ndarray, lower: bool = False) -> np.ndarray:
    out = np.zeros(len(b) + PAD, np.uint8)
    out[: len(b)] = LOWER[b] if lower else b
    return out


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more at the end)."""
    n = int(off[-1])
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = np.zeros(n + 2, bool)
    np.logical_not(SPACE[b[:n]], out=solid[1 : n + 1])
    first = solid[1 : n + 1] & ~solid[:n]
    last = solid[1 : n + 1] & ~solid[2 : n + 2]
    cut = off[(off > 0) & (off < n)]
    first[cut] = solid[cut + 1]
    last[cut - 1] = solid[cut]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def hash_words(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range; b is padded() by PAD bytes."""
    view = np.ndarray(shape=(max(0, len(b) - 7),), dtype="<u8", buffer=b, strides=(1,))
    size = end - start
    h = mix(size.astype(U64) * K1 + K3)
    if not len(start):
        return h
    h = mix((view[start] & _MASK[np.minimum(size, 8)]) * K1 ^ h)
    live = np.flatnonzero(size > 8)
    at = 8
    while len(live):
        h[live] = mix((view[start[live] + at] & _MASK[np.minimum(size[live] - at, 8)]) * K1 ^ h[live])
        at += 8
        live = live[size[live] > at]
    return h


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive items, and which of them lie within one document.

    The arrays are as long as h; first is as words() gives it.
    """
    m = len(h)
    inside = np.zeros(m, bool)
    if m < n:
        return np.zeros(m, U64), inside
    doc_end = np.repeat(first[1:], np.diff(first))
    inside = np.arange(m) + n <= doc_end
    acc = h[: m - n + 1] * K1
    for i in range(1, n):
        acc = (acc + h[i : m - n + 1 + i]) * K1 if i < n - 1 else acc + h[i : m - n + 1 + i]
    out = np.zeros(m, U64)
    out[: m - n + 1] = mix(acc + U64(n))
    return out, inside


def spans_to_mask(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a range [lo, hi)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:-1]) > 0
