"""Substring dedup over words, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of BLOCK words, and
every rolling BLOCK-gram of every text probes that index. As a window of
``window >= 2 * BLOCK - 1`` words always holds one whole reference block of
its own document, two equal windows of different documents always meet at a
block: the anchors lose nothing. Around the hits, whole windows are extended
and compared by 96-bit hashes across documents, and runs of consecutive
repeated windows are the maximal exact repeats.

Two questions are put to hash buckets (see chunks): which BLOCK-grams are a
block and occur in two documents, and which of the windows around those start
in a smaller document. Equal keys of one task travel once, so a passage that a
third of all documents share costs a bucket one key per chunk.

Rows without text have no words. A row without doc_id counts as larger than
any id. Rows of equal doc_id are one document to each other: windows they
share remain. The result has one row per input row, whatever else the input's
columns are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SECOND, Chunk, Chunks, answer_batch, read_answers, written
from .textops import U64, grams, hash_words, mix, padded, spans_to_mask, words

BLOCK = 7
_DOC_BITS = U64(17)


class _Text:
    """A chunk's words, and for each place its BLOCK-gram."""

    def __init__(self, c: Chunk):
        self.b = padded(c.raw)
        self.start, self.end, self.first = words(c.raw, c.off)
        self.h = hash_words(self.b, self.start, self.end)
        self.row = np.repeat(np.arange(len(c.ids)), np.diff(self.first))

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The upper 47 bits of each place's gram, which places have one, and the sorted distinct keys with two flags in the low bits: 1 for a block, 2 for two documents."""
        g, ok = grams(self.h, self.first, BLOCK)
        upper = g >> _DOC_BITS
        place = np.arange(len(g)) - self.first[self.row]
        both = np.sort(((g >> _DOC_BITS) << _DOC_BITS | self.row.astype(U64) << U64(1) | (place % BLOCK == 0).astype(U64))[ok])
        key = both >> _DOC_BITS
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(at):
            return upper, ok, np.zeros(0, U64)
        block = np.bitwise_or.reduceat(both & U64(1), at)
        row = (both >> U64(1)) & U64(0xFFFF)
        last = np.append(at[1:], len(key)) - 1
        return upper, ok, key[at] << _DOC_BITS | block | (row[at] != row[last]).astype(U64) << U64(1)


def _ask_blocks(c: Chunk):
    return _Text(c).probes()[2], None


def _settle_blocks(label: int, got: list):
    keys = np.concatenate([k for _, k, _ in got])
    order = np.argsort(keys >> _DOC_BITS, kind="stable")
    s = keys[order]
    k = s >> _DOC_BITS
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(at, len(k)))
    flags = np.bitwise_or.reduceat(s & U64(3), at)
    hit = ((flags & U64(1)) > 0) & (((flags & U64(2)) > 0) | (size > 1))
    bits = np.zeros(len(k), bool)
    bits[order] = np.repeat(hit, size)
    yield from _bit_answers(label, [c for c, _, _ in got], [len(x) for _, x, _ in got], bits)


def _bit_answers(label: int, chunks: list[int], sizes: list[int], bits: np.ndarray):
    lo, who, what = 0, [], []
    for c, n in zip(chunks, sizes, strict=True):
        if bits[lo : lo + n].any():
            who.append(c)
            what.append(np.packbits(bits[lo : lo + n]).tobytes())
        lo += n
    if who:
        yield answer_batch(label, who, what)


class _Windows:
    """A chunk's windows around the hits of the first question: distinct hashes with the smallest id in the chunk."""

    def __init__(self, window: int, parts: int, labels: np.ndarray):
        self.window, self.parts, self.labels = window, parts, labels

    def find(self, c: Chunk):
        t = _Text(c)
        upper, ok, keys = t.probes()
        hit = keys[read_answers(c, keys, self.parts, self.labels) > 0] >> _DOC_BITS
        t.hash, t.check, t.place = np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(hit):
            at = np.minimum(np.searchsorted(hit, upper), len(hit) - 1)
            shared = np.concatenate([[0], np.cumsum(ok & (hit[at] == upper))])
            n = len(t.h)
            g, inside = grams(t.h, t.first, self.window)
            reach = np.minimum(np.arange(n) + self.window - BLOCK + 1, n)
            t.place = np.flatnonzero(inside & (shared[reach] > shared[:n]))
            t.hash = g[t.place]
            t.check = (grams(mix(t.h ^ U64(0xA5A5A5A5)), t.first, self.window)[0][t.place] >> U64(32)).astype(np.uint32)
        t.order = np.lexsort((t.check, t.hash))
        h, x = t.hash[t.order], t.check[t.order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])]) if len(h) else np.zeros(0, bool)
        t.at = np.flatnonzero(new)
        t.group = np.cumsum(new) - 1
        ids = c.ids[t.row[t.place[t.order]]]
        t.least = np.minimum.reduceat(ids, t.at) if len(h) else ids
        return t

    def __call__(self, c: Chunk):
        t = self.find(c)
        load = np.concatenate([t.check[t.order][t.at, None].view(np.uint8).reshape(-1, 4), t.least[:, None].view(np.uint8).reshape(-1, 8)], axis=1)
        return t.hash[t.order][t.at], load


def _settle_windows(label: int, got: list):
    keys = np.concatenate([k for _, k, _ in got])
    load = np.concatenate([x for _, _, x in got])
    check = np.ascontiguousarray(load[:, :4]).view(np.uint32).ravel()
    ids = np.ascontiguousarray(load[:, 4:]).view(np.int64).ravel()
    order = np.lexsort((check, keys))
    k, x = keys[order], check[order]
    at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])]))
    least = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(k))))
    bits = np.zeros(len(k), bool)
    bits[order] = least < ids[order]
    yield from _bit_answers(label + SECOND, [c for c, _, _ in got], [len(y) for _, y, _ in got], bits)


class _Finish:
    def __init__(self, windows: _Windows, with_text: bool):
        self.windows, self.with_text = windows, with_text

    def __call__(self, c: Chunk) -> pa.RecordBatch:
        w = self.windows
        t = w.find(c)
        keys = t.hash[t.order][t.at]
        gone = np.zeros(len(t.place), bool)
        if len(keys):
            elsewhere = read_answers(c, keys, w.parts, w.labels, second=True) > 0
            gone[t.order] = elsewhere[t.group] | (t.least[t.group] < c.ids[t.row[t.place[t.order]]])
        dropped = spans_to_mask(t.place[gone], t.place[gone] + w.window, len(t.h))
        keep = np.flatnonzero(~dropped)
        out = t.b[: len(c.raw)].copy()
        mask = spans_to_mask(t.start[keep], t.end[keep], len(out))
        more = keep[:-1][t.row[keep[:-1]] == t.row[keep[1:]]]
        out[t.end[more]] = 0x20
        mask[t.end[more]] = True
        text, off = out[mask], np.concatenate([[0], np.cumsum(mask)])[c.off]
        left = [memoryview(text)[off[i] : off[i + 1]] for i in range(len(c.ids))]
        removed = np.concatenate([[0], np.cumsum(dropped)])
        cols = [c.doc_ids(), pa.array(np.diff(t.first), pa.int64()), pa.array(removed[t.first[1:]] - removed[t.first[:-1]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if self.with_text:
            cols.append(pa.array([bytes(x) for x in left], pa.binary()).cast(pa.string()))
            names.append("text")
        return pa.RecordBatch.from_arrays(cols, names=names)


def substring_dedup(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs (doc_id, text), and the kept text if asked for."""
    if window < 2 * BLOCK - 1:
        raise ValueError(f"window must be at least {2 * BLOCK - 1} words")
    chunks = Chunks(docs)
    blocks = written(chunks.ask(_ask_blocks, _settle_blocks))
    windows = _Windows(window, chunks.buckets, chunks.labels)
    starts = chunks.ask(windows, _settle_windows, blocks)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return chunks.finish(blocks.unionByName(starts), _Finish(windows, with_text), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")))


#: Words are what the runs of other bytes leave; each window's words, joined, are its key.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w WHERE len(ws) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, s + i AS p
  FROM (SELECT g.doc_id, g.s FROM g JOIN m USING (k) WHERE m.least < g.doc_id), unnest(range(0, 13)) AS t(i)),
p AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(ps, i), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN p USING (doc_id)
"""
