"""Suffix arrays by induced sorting, vectorised, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; the last is larger than the empty suffix."""
    n = len(t)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(p: np.ndarray, t: np.ndarray, to: list[list[np.ndarray]], here: int) -> np.ndarray:
    """Appends positions to the lists of their bytes, in order; returns those of this byte."""
    if not len(p):
        return p
    c = t[p]
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    same = p[:0]
    for part, sym in zip(np.split(p, cuts), c[np.concatenate([[0], cuts])], strict=True):
        if sym == here:
            same = part
        else:
            to[sym].append(part)
    return same


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that leftmost-smaller suffixes in this order induce. A wave holds all that one byte's list gained at once."""
    symbols = np.unique(t)
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(lms, t, seeds, -1)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[t[-1]].append(np.array([len(t) - 1]))
    done = {}
    for c in symbols:
        wave, kept = (np.concatenate(large[c]) if large[c] else lms[:0]), []
        while len(wave):
            kept.append(wave)
            p = wave[wave > 0] - 1
            wave = _deal(p[~small[p]], t, large, c)
        done[c] = np.concatenate(kept) if kept else lms[:0]
        if seeds[c]:
            _deal(seeds[c][0] - 1, t, large, -1)
    tail: list[list[np.ndarray]] = [[] for _ in range(256)]
    parts = []
    for c in symbols[::-1]:
        wave, kept = (np.concatenate(tail[c]) if tail[c] else lms[:0]), []
        while len(wave):
            kept.append(wave)
            p = wave[wave > 0] - 1
            wave = _deal(p[small[p]], t, tail, c)
        back = done[c][::-1]
        p = back[back > 0] - 1
        _deal(p[small[p]], t, tail, -1)
        parts += [*kept, back]
    return np.concatenate(parts)[::-1]


def _ragged(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1]) - np.repeat(ends - size - lo, size)


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A rank for each leftmost-smaller substring, in text order; equal substrings share one."""
    size = np.append(lms[1:] + 1, len(t)) - lms
    where = np.empty(len(t), np.int64)
    where[lms] = np.arange(len(lms))
    o = where[order]
    a, b = o[:-1], o[1:]
    fresh = (size[a] != size[b]) | (a == len(lms) - 1) | (b == len(lms) - 1)
    same = np.flatnonzero(~fresh)
    if len(same):
        n = size[a[same]]
        differ = t[_ragged(lms[a[same]], n)] != t[_ragged(lms[b[same]], n)]
        fresh[same] = np.bitwise_or.reduceat(differ, np.cumsum(n) - n)
    rank = np.empty(len(lms), np.int64)
    rank[o] = np.concatenate([[0], np.cumsum(fresh)])
    return rank


def _induce_names(t: list[int], small: bytearray, lms: list[int], ends: list[int]) -> list[int]:
    """_induce for names: one place after the other, as few names are equal and waves would be tiny. ends: where each name's list ends."""
    n = len(t)
    sa, tail = [-1] * n, ends.copy()
    for i in reversed(lms):
        c = t[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = [0, *ends]
    sa[head[t[-1]]] = n - 1
    head[t[-1]] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = t[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends.copy()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = t[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return sa


def _order_names(rank: np.ndarray, depth: int) -> np.ndarray:
    """Sorts the suffixes of a string of names by their first `depth` names at least, by the same steps: its own
    leftmost-smaller substrings are sorted by induction and named, their names ordered by recursion, the rest induced."""
    m = len(rank)
    if depth <= 1 or int(rank.max()) + 1 == m:
        return np.argsort(rank, kind="stable")
    up = np.full(m, -1, np.int8)
    up[:-1] = np.sign(rank[1:] - rank[:-1])
    at = np.where(up != 0, np.arange(m), m)
    at[-1] = m - 1
    small = up[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(rank)).tolist()
    t, kinds = rank.tolist(), bytearray(small.tobytes())
    if len(lms) > 1:
        is_lms = np.zeros(m, bool)
        is_lms[lms] = True
        first = np.array(_induce_names(t, kinds, lms.tolist(), ends))
        lms = lms[_order_names(_names(rank, lms, first[is_lms[first]]), -(-depth // 2))]
    return np.array(_induce_names(t, kinds, lms.tolist(), ends))


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of the bytes t, sorted by their first `depth` bytes at least.

    Suffixes are classified, leftmost-smaller (LMS) substrings sorted by induction and
    named, the string of names ordered by recursion, and the rest induced from it. An LMS substring
    advances two places or more, so each recursion needs half the depth.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        first = _induce(t, small, lms)
        rank = _names(t, lms, first[is_lms[first]])
        lms = lms[_order_names(rank, -(-depth // 2))]
    return _induce(t, small, lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position in text order, the suffix before it in the array (or -1) and the common prefix with that.

    Where the bytes before both agree, the value is the one before less one; the others are compared, eight bytes a step.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    plain = np.zeros(n, bool)
    plain[1:] = (phi[1:] > 0) & (phi[:-1] == phi[1:] - 1) & (t[:-1] == t[np.maximum(phi[1:] - 1, 0)])
    todo = np.flatnonzero(~plain & (phi >= 0))
    wide = np.concatenate([t, np.arange(8, dtype=np.uint8)])
    view = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=wide, strides=(1,))
    got = np.zeros(n, np.int64)
    live, far = todo, np.zeros(len(todo), np.int64)
    while len(live):
        a, b = live + far, phi[live] + far
        x = view[np.minimum(a, n)] ^ view[np.minimum(b, n)]
        equal = np.where(x == 0, 8, 0)
        odd = x != 0
        low = (x[odd] & (~x[odd] + np.uint64(1))).astype(np.float64)
        equal[odd] = (np.log2(low) // 8).astype(np.int64)
        far = far + equal
        stop = odd | (np.maximum(live, phi[live]) + far >= n)
        got[live[stop]] = np.minimum(far[stop], n - np.maximum(live, phi[live])[stop])
        live, far = live[~stop], far[~stop]
    base = np.maximum.accumulate(np.where(plain, 0, at))
    return phi, np.where(plain, np.maximum(got[base] - (at - base), 0), got)
