"""Exact substring dedup over bytes, by suffix arrays of shards.

A byte goes when a string of ``length`` bytes that covers it also starts
elsewhere. Suffix arrays of separate shards only see repeats within a shard, so
texts are first cut such that all occurrences of a string meet in one: the
smallest of the ranks of all GRAM-grams in a string (bits of their hashes; the leftmost, if equal)
is its *anchor*, and equal strings have it at equal places. The starts that
share an anchor form one fragment of text, keyed by the 132 bytes that they
all hold before or after it.

1. Fragments are put to hash buckets by key. A key seen once holds no repeat. Equal
   fragments (a hash of the whole) repeat altogether and need no more work: that
   settles the inside of long repeats and of copies.
2. What is left, fragments whose key recurs in other surroundings, travels
   as text, one of each kind, to the shard of its key. The shard's suffixes
   are sorted by induction (see suffixes), and neighbours with a common
   prefix of ``length`` are repeats.
3. Each chunk of texts unites what it hears and drops the bytes.

Null texts are empty. Rows without doc_id and repeated rows take part like any
other row; a row given twice repeats itself. One row comes out for each row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import SECOND, Chunk, Chunks, answer_batch, by_bucket, dealt, read_answers, rows, written
from .suffixes import permuted_lcp, suffix_array
from .textops import U64, mix

GRAM = 64
#: Places that are looked at together.
BLOCK = 1 << 15
_RNG = np.random.default_rng(20240607)
_TAB = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
SHARD_BYTES = 2 << 20


def _powers(x: int) -> np.ndarray:
    out = np.full(BLOCK + GRAM, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))
_PLACE, _LOW = np.arange(BLOCK, dtype=np.uint32), np.uint32(BLOCK - 1)


def _windows(b: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial hashes of all GRAM-grams, and the runs [lo, hi] of starts within a text that share an anchor, cut where it comes nearer than half.

    Texts pass in blocks that stay in the cache. A gram's rank is the upper 17 bits of its hash, its place in the block the 15 below:
    the smallest of a window is the leftmost of the smallest rank, and holds its place.
    """
    wide, half, starts = length - GRAM + 1, (length - GRAM) // 2, len(b) - length + 1
    h = np.empty(len(b) - GRAM + 1, np.uint64)
    sums = np.zeros(BLOCK + GRAM, np.uint64)
    cuts = np.unique(np.concatenate([off[:-1], np.maximum(off[:-1], off[1:] - length + 1)]))
    lo, at, last = [], [], -1
    for p in range(0, starts, BLOCK - wide + 1):
        m = min(BLOCK, len(h) - p)
        n = m + GRAM - 1
        x = _TAB[b[p : p + n]]
        x *= _DOWN[:n]
        np.cumsum(x, out=sums[1 : n + 1])
        g = np.multiply(sums[GRAM : n + 1] - sums[:m], _UP[GRAM - 1 : n], out=h[p : p + m])
        v = (g >> U64(32)).astype(np.uint32) & ~_LOW
        v |= _PLACE[:m]
        w = 1
        while w < wide:
            d = min(w, wide - w)
            v, w = np.minimum(v[:-d], v[d:]), w + d
        v &= _LOW
        new = np.empty(len(v), bool)
        new[0] = int(v[0]) + p != last
        np.not_equal(v[1:], v[:-1], out=new[1:])
        new |= v - _PLACE[: len(v)] == half - 1
        new[cuts[slice(*np.searchsorted(cuts, [p, p + len(v)]))] - p] = True
        i = np.flatnonzero(new)
        lo.append(i + p)
        at.append(v[i].astype(np.int64) + p)
        last = int(v[-1]) + p
    first, anchor = np.concatenate(lo), np.concatenate(at)
    inside = first <= np.repeat(off[1:] - length, np.diff(np.searchsorted(first, off)))
    return h, first[inside], (np.append(first[1:], starts) - 1)[inside], anchor[inside]


class _Fragments:
    """A chunk's fragments: windows [lo, hi] of starts around anchor at, with key and fragment hash, sorted and without repeats."""

    def __init__(self, c: Chunk, length: int):
        half = (length - GRAM) // 2
        self.lo = self.hi = self.at = np.zeros(0, np.int64)
        self.key = self.frag = np.zeros(0, U64)
        if len(c.raw) >= length:
            h, self.lo, self.hi, self.at = _windows(c.raw, c.off, length)
            left = self.at - self.lo >= half
            core = np.where(left, self.at - half, self.at)
            self.key = mix(h[core] * U64(3) + mix(h[core + half]) + left.astype(U64)) & ~U64(0xFF)
            f = (self.at - self.lo).astype(U64) << U64(20) | (self.hi - self.lo).astype(U64)
            last = self.hi + length - GRAM
            for k in range(2 * length // GRAM + 1):
                f = mix(f * U64(_BASE) + h[np.minimum(self.lo + GRAM * k, last)])
            self.frag = f & U64(2**48 - 1)
        order = np.argsort(self.key)
        same = self.key[order[1:]] == self.key[order[:-1]]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(order) else order
        alike = order[tied]
        order[tied] = alike[np.lexsort((self.frag[alike], self.key[alike]))]
        self.lo, self.hi, self.at, self.key, self.frag = (x[order] for x in (self.lo, self.hi, self.at, self.key, self.frag))
        new = np.concatenate([[True], (self.key[1:] != self.key[:-1]) | (self.frag[1:] != self.frag[:-1])]) if len(order) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.kind = np.cumsum(new) - 1
        self.many = np.diff(np.append(self.first, len(order))) > 1


class _AskFragments:
    def __init__(self, length: int):
        self.length = length

    def __call__(self, c: Chunk):
        f = _Fragments(c, self.length)
        load = np.concatenate([f.frag[f.first, None].view(np.uint8).reshape(-1, 8)[:, :6], f.many[:, None].astype(np.uint8)], axis=1)
        return f.key[f.first], load


#: Answers: nothing; all starts repeat; send the text; send the text for others' sake, all starts repeat.
NONE, ALL, TEXT, BOTH = range(4)


def _settle_fragments(label: int, got: list):
    key = np.concatenate([k for _, k, _ in got])
    load = np.concatenate([x for _, _, x in got])
    frag = np.zeros((len(key), 8), np.uint8)
    frag[:, :6] = load[:, :6]
    frag = frag.view(np.uint64).ravel()
    order = np.lexsort((frag, key))
    k, f, many = key[order], frag[order], load[order, 6] > 0
    nk = np.concatenate([[True], k[1:] != k[:-1]])
    nf = nk | np.concatenate([[True], f[1:] != f[:-1]])
    fi, ki = np.flatnonzero(nf), np.flatnonzero(nk)
    dup = (np.diff(np.append(fi, len(k))) > 1) | np.logical_or.reduceat(many, fi)
    kinds_before = np.cumsum(nf) - 1
    lo = kinds_before[ki]
    kinds = np.diff(np.append(lo, len(fi)))
    lone = np.logical_or.reduceat(~dup, lo) & (kinds > 1)
    asks = np.repeat(lone, kinds)
    by_kind = np.where(dup, ALL, np.where(asks, TEXT, NONE)).astype(np.uint8)
    answer = np.repeat(by_kind, np.diff(np.append(fi, len(k))))
    answer[fi[dup & asks]] = BOTH
    back = np.zeros(len(k), np.uint8)
    back[order] = answer
    at, who, what = 0, [], []
    for c, x, _ in got:
        if back[at : at + len(x)].any():
            who.append(c)
            what.append(back[at : at + len(x)].tobytes())
        at += len(x)
    if who:
        yield answer_batch(label, who, what)


class _Send:
    """The text of fragments that are asked for."""

    def __init__(self, length: int, parts: int, labels: np.ndarray):
        self.length, self.parts, self.labels = length, parts, labels

    def __call__(self, batches):
        for c in rows(batches, True):
            if not c.answers:
                continue
            f = _Fragments(c, self.length)
            key = f.key[f.first]
            said = read_answers(c, key, self.parts, self.labels, bits=False)
            lo, hi = dealt(key, self.parts)
            for i in range(self.parts):
                pick = np.flatnonzero(said[lo[i] : hi[i]] >= TEXT) + lo[i]
                if len(pick):
                    one = f.first[pick]
                    head = np.stack([key[pick].view(np.int64), pick, f.hi[one] - f.lo[one] + 1])
                    body = b"".join(c.raw[a : b + self.length - 1].tobytes() for a, b in zip(f.lo[one], f.hi[one] + 1, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([int(self.labels[i])], pa.int32()), pa.array([c.id], pa.int64()), pa.array([head.tobytes()], pa.binary()), pa.array([body], pa.binary())], names=["bucket", "chunk", "head", "body"])


class _Shards:
    def __init__(self, length: int):
        self.length = length

    def __call__(self, batches):
        for label, parts in by_bucket(batches):
            yield from self.settle(label, [(r["chunk"], np.frombuffer(r["head"], np.int64).reshape(3, -1), np.frombuffer(r["body"], np.uint8)) for part in parts for r in part.to_pylist()])

    def settle(self, label: int, got: list):
        head = np.concatenate([h for _, h, _ in got], axis=1)
        text = np.concatenate([b for _, _, b in got])
        chunk = np.repeat([c for c, _, _ in got], [h.shape[1] for _, h, _ in got])
        size = head[2] + self.length - 1
        start = np.cumsum(size) - size
        order = np.argsort(head[0], kind="stable")
        key = head[0][order]
        group = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
        far = np.concatenate([[0], np.cumsum(size[order])])
        found: dict[int, list] = {}
        g = 0
        while g < len(group) - 1:
            e = max(g + 1, int(np.searchsorted(far[group], far[group[g]] + SHARD_BYTES)) - 1)
            pick = order[group[g] : group[e]]
            for i, bits in zip(pick, self.repeats(text, start[pick], head[2][pick]), strict=True):
                if bits.any():
                    found.setdefault(int(chunk[i]), []).append((int(head[1][i]), np.packbits(bits, bitorder="little")))
            g = e
        if found:
            wide = (self.length - GRAM + 8) // 8
            answers = []
            for x in found.values():
                grid = np.zeros((len(x), wide), np.uint8)
                for row, (_, bits) in zip(grid, x, strict=True):
                    row[: len(bits)] = bits
                answers.append(np.array([i for i, _ in x], np.int64).tobytes() + grid.tobytes())
            yield answer_batch(label + SECOND, list(found), answers)

    def repeats(self, text: np.ndarray, start: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each fragment, which of its starts begin a string that begins elsewhere in the shard too. No two fragments end in the same bytes."""
        parts, at, place = [], [], 0
        for i, (s, n) in enumerate(zip(start, starts, strict=True)):
            at.append(place)
            mark = np.array([0xFF, *(0xC0 + (i >> 5 * k & 31) for k in range(5)), 0xFE], np.uint8)
            parts += [text[s : s + n + self.length - 1], mark]
            place += n + self.length - 1 + len(mark)
        t = np.concatenate(parts)
        sa = suffix_array(t, self.length)
        phi, lcp = permuted_lcp(t, sa)
        again = lcp >= self.length
        both = again.copy()
        both[phi[again]] = True
        return [both[a : a + n] for a, n in zip(at, starts, strict=True)]


def _united(lo: np.ndarray, end: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges within texts, in order and united where they overlap or touch within a text."""
    order = np.argsort(lo)
    lo, reach = lo[order], np.maximum.accumulate(end[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    touch = np.flatnonzero(lo[1:] == reach[:-1]) + 1
    new[touch] = np.isin(lo[touch], off)
    i = np.flatnonzero(new)
    return lo[i], reach[np.append(i[1:], len(lo))[: len(i)] - 1]


class _Finish:
    def __init__(self, length: int, parts: int, labels: np.ndarray, with_text: bool):
        self.length, self.parts, self.labels, self.with_text = length, parts, labels, with_text

    def __call__(self, c: Chunk) -> pa.RecordBatch:
        lo = end = np.zeros(0, np.int64)
        if c.answers:
            f = _Fragments(c, self.length)
            said = read_answers(c, f.key[f.first], self.parts, self.labels, bits=False)[f.kind]
            whole = (said == ALL) | (said == BOTH)
            los, ends = [f.lo[whole]], [f.hi[whole] + self.length]
            wide = (self.length - GRAM + 8) // 8
            for label, a in c.answers.items():
                if label >= SECOND:
                    m = len(a) // (8 + wide)
                    kind = np.frombuffer(a, np.int64, m)
                    bits = np.unpackbits(np.frombuffer(a, np.uint8, offset=8 * m).reshape(m, wide), axis=1, bitorder="little")
                    row, place = np.nonzero(bits)
                    s = f.lo[f.first[kind[row]]] + place
                    los.append(s)
                    ends.append(s + self.length)
            lo, end = _united(np.concatenate(los), np.concatenate(ends), c.off)
        left = np.concatenate([c.raw[a:b] for a, b in zip(np.append(0, end), np.append(lo, len(c.raw)), strict=True)])
        runs = np.searchsorted(lo, c.off)
        removed = np.concatenate([[0], np.cumsum(end - lo)])[runs]
        off = c.off - removed
        texts = [memoryview(left)[off[i] : off[i + 1]] for i in range(len(c.ids))]
        cols = [c.doc_ids(), pa.array(np.diff(c.off), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(np.diff(runs), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if self.with_text:
            cols.append(pa.array([bytes(x) for x in texts], pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(cols, names=names)


def suffix_dedup(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text), and the kept bytes if asked for."""
    if not 2 * GRAM <= length <= 4 * GRAM - 2:
        raise ValueError(f"length must be {2 * GRAM} to {4 * GRAM - 2} bytes")
    chunks = Chunks(docs)
    answers = written(chunks.ask(_AskFragments(length), _settle_fragments))
    sent = chunks._with(answers).mapInArrow(_Send(length, chunks.buckets, chunks.labels), "bucket int, chunk long, head binary, body binary")
    found = chunks.dealt(sent).mapInArrow(_Shards(length), "chunk long, bucket int, answer binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return chunks.finish(answers.unionByName(found), _Finish(length, chunks.buckets, chunks.labels, with_text), schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
