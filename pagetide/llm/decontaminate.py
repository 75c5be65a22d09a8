"""Benchmark decontamination by spaced-seed hashing.

A stretch of ``min(least, item's length)`` aligned tokens of which ``percent`` agree is
contamination. It is cut into equal parts, so many more than tokens may differ that some
are whole wherever the others differ; a mask selects so many parts, and there is one for every choice of them, so
that no such stretch is missed (13 tokens of which 3 differ: 10 masks of 6 tokens). All
masked windows of all benchmark items are hashed, and so is every position of
every document, once for each mask; equal tokens at a mask's places are a hit. Around a hit, document and item
are aligned on its diagonal and tokens compared.
Tokens are words with A-Z lower-cased and, at both ends, no ASCII punctuation, so that edits of case and punctuation don't hide a copy.

The benchmark's hashes go to the tasks in blocks of at most BLOCK_TOKENS tokens, a stated
bound; a larger benchmark is met by one pass over the documents for each
block, and the passes' results are joined. Hits are taken up in bounded lots, in the order of items: once a document agrees in full with
an item, only smaller items are of interest, so neither texts of repeated words nor passages that many items share
make pairs without end. Of an item shorter than MIN_TOKENS (and than ``least``) all tokens must agree, so it is contamination wherever a document holds it as a run;
an item of one token is not sought, as its word alone is no passage.
Items without item_id are sought too; they come after all others and are given as null. Null and empty texts are clean. Each row gives one row; repeated rows and rows without doc_id are
judged like others; other columns are kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NO_ID, written
from .textops import U64, hash_words, mix, padded, slices, text_buffers, words

#: Shorter items are sought as they are.
MIN_TOKENS = 8
#: A mask selects so many tokens, if the stretch is long enough.
WEIGHT = 6
BLOCK_TOKENS = 4_000_000
SLICE = 4 << 20
_FILTER_BITS = 22
#: Hits that are looked at together.
MOST_PAIRS = 1 << 21
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def tokens(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts and where each text's begin."""
    text = padded(b, lower=True)
    start, end, _ = words(b, off)
    while True:
        on = np.flatnonzero((start < end) & _PUNCT[text[start]])
        if not len(on):
            break
        start[on] += 1
    while True:
        on = np.flatnonzero((start < end) & _PUNCT[text[end - 1]])
        if not len(on):
            break
        end[on] -= 1
    keep = start < end
    start, end = start[keep], end[keep]
    return hash_words(text, start, end), np.searchsorted(start, off)


def masks(need: int, misses: int) -> list[str]:
    """Masks (1 compares the token, 0 ignores it) of which at least one hits any stretch of need tokens in which at most so many differ."""
    sizes = [(whole, need // (whole + misses)) for whole in range(1, need - misses + 1)]
    whole, size = next((x for x in sizes if x[0] * x[1] >= WEIGHT), max(sizes, key=lambda x: x[0] * x[1]))
    # a choice without the first part is another one, shifted
    picks = ((0, *rest) for rest in combinations(range(1, whole + misses), whole - 1))
    return ["".join(("1" if i in p else "0") * size for i in range(p[-1] + 1)) for p in picks]


def seeds(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The places at which a masked window lies within one text, and their hashes."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    acc = np.zeros(n, U64)
    for i, on in enumerate(mask):
        if on == "1":
            acc = (acc + h[i : i + n]) * U64(0x9E3779B97F4A7C15)
    inside = np.arange(n) + len(mask) <= np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(inside)
    return at, mix(acc[at] + U64(int(mask, 2)))


class Index:
    """A block of benchmark items: tokens, and the sorted hashes of their masked windows with a bit filter before them."""

    def __init__(self, ids: np.ndarray, h: np.ndarray, first: np.ndarray, least: int = 13, percent: int = 75):
        self.ids, self.h, self.first, self.least, self.percent = ids, h, first, least, percent
        self.tables = []
        needs = np.minimum(np.diff(first), least)
        for need in np.unique(needs[np.diff(first) > 1]).tolist():
            of_items = np.repeat((needs == need) & (np.diff(first) > 1), np.diff(first))
            for mask in masks(need, self.misses(need)):
                at, key = seeds(h, first, mask)
                self.tables.append((mask, *self._table(key[of_items[at]], at[of_items[at]])))

    def misses(self, need: int) -> int:
        """How many of so many tokens may differ."""
        return 0 if need < min(MIN_TOKENS, self.least) else need * (100 - self.percent) // 100

    @staticmethod
    def _table(key: np.ndarray, at: np.ndarray):
        """The sorted keys, each with its place below it, and the filter."""
        key = (key >> U64(32)).astype(U64)
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[key >> U64(32 - _FILTER_BITS)] = True
        return np.sort(key << U64(32) | at.astype(U64)), bits

    def hits(self, h: np.ndarray, first: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the documents and in the benchmark that agree in a masked window, at most about MOST_PAIRS at a time.
        until: for each row the benchmark's place from which on nothing can better what is known of the row; it may change between two steps."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for mask, key, bits in self.tables:
            place, k = seeds(h, first, mask)
            k >>= U64(32)
            on = bits[k >> U64(32 - _FILTER_BITS)]
            place, k = place[on], k[on]
            low = np.searchsorted(key, k << U64(32))
            n = np.searchsorted(key, k << U64(32) | U64(0xFFFFFFFF)) - low
            some = n > 0
            place, k, low, n = place[some], k[some], low[some], n[some]
            begin = 0
            while begin < len(place):
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(n[begin:]), MOST_PAIRS, side="right")))
                part = slice(begin, end)
                size = np.searchsorted(key, k[part] << U64(32) | until[row[place[part]]].astype(U64)) - low[part]
                ends = np.cumsum(size)
                x = np.repeat(place[part], size)
                y = (key[np.arange(ends[-1]) - np.repeat(ends - size - low[part], size)] & U64(0xFFFFFFFF)).astype(np.int64)
                for i in (i for i, c in enumerate(mask) if c == "1"):
                    same = h[x + i] == self.h[y + i]
                    x, y = x[same], y[same]
                if len(x):
                    yield x, y
                begin = end

    def verified(self, h: np.ndarray, first: np.ndarray) -> dict[int, tuple[int, int]]:
        """For each contaminated row, the most agreeing tokens of a stretch and the smallest item with as many."""
        best: dict[int, tuple[int, int]] = {}
        until = np.full(len(first) - 1, len(self.h), np.int64)
        done: set[tuple[int, int, int]] = set()
        for left, right in self.hits(h, first, until):
            doc = np.searchsorted(first, left, side="right") - 1
            item = np.searchsorted(self.first, right, side="right") - 1
            # one check of each diagonal: hits on it differ in the place only
            for d, i, shift in np.unique(np.stack([doc, item, left - right]), axis=1).T.tolist():
                if self.first[i] >= until[d] or (d, i, shift) in done:
                    continue
                if len(done) > MOST_PAIRS:
                    done.clear()
                done.add((d, i, shift))
                lo = max(self.first[i], first[d] - shift)
                hi = min(self.first[i + 1], first[d + 1] - shift)
                need = min(self.least, int(self.first[i + 1] - self.first[i]))
                if hi - lo < need:
                    continue
                same = np.concatenate([[0], np.cumsum(self.h[lo:hi] == h[lo + shift : hi + shift])])
                most = int((same[need:] - same[:-need]).max())
                if most >= need - self.misses(need):
                    found = (-most, int(self.ids[i]))
                    best[d] = min(best.get(d, found), found)
                    if most == self.least:  # no item agrees more, and those from here on have larger ids
                        until[d] = min(until[d], self.first[i])
        return {d: (-m, i) for d, (m, i) in best.items()}


class _Scan:
    def __init__(self, index: Index):
        self.index = index

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, off = text_buffers(batch.column(1))
            agree, item = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, NO_ID, np.int64)
            for lo, hi in slices(off, SLICE):
                h, first = tokens(text[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for d, (m, i) in self.index.verified(h, first).items():
                    agree[lo + d], item[lo + d] = m, i
            cols = [batch.column(0), pa.array(agree > 0), pa.array(item, pa.int64(), mask=item == NO_ID), pa.array(agree)]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[2:]], names=["doc_id", "contaminated", "item_id", "n_agree", *batch.schema.names[2:]])


def index_blocks(benchmark: DataFrame, least: int, percent: int, block_tokens: int = BLOCK_TOKENS) -> Iterator[Index]:
    """The benchmark (item_id, text) in blocks of a bounded number of tokens; an item is never split."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len((row["text"] or "").split())
        if ids and held + n > block_tokens:
            yield _index(ids, texts, least, percent)
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"] or "")
        held += n
    yield _index(ids, texts, least, percent)


def _index(ids: list[int], texts: list[str], least: int, percent: int) -> Index:
    order = np.argsort(np.array(ids, np.int64), kind="stable")  # so that the first item that agrees best is the smallest
    texts = [texts[i] for i in order]
    return Index(np.array(ids, np.int64)[order], *tokens(*text_buffers(pa.array(texts, pa.string()))), least, percent)


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = 13, percent: int = 75, block_tokens: int = BLOCK_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, contaminated, item_id (of the longest agreement; null if clean) and n_agree of each row of docs, and the columns to keep."""
    names = {f"_k{i}": c for i, c in enumerate(keep)}
    d = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("_text"), *(F.col(c).alias(k) for k, c in names.items()))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[2:])
    head = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, contaminated boolean, item_id long, n_agree long"
    schema = head + (", " + fields if fields else "")
    blocks = index_blocks(benchmark, least, percent, block_tokens)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = d.mapInArrow(_Scan(first), schema)
    else:  # a pass for each block; rows are told apart by a number that is written down first
        d = written(d.withColumn("_row", F.monotonically_increasing_id()))
        full = head + ", " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[2:])
        passes = [written(d.mapInArrow(_Scan(x), full).select("_row", "contaminated", "item_id", "n_agree")) for x in chain([first, second], blocks)]
        best = passes[0]
        for p in passes[1:]:
            best = best.unionByName(p)
        best = best.groupBy("_row").agg(F.max("contaminated").alias("contaminated"), F.min_by("item_id", F.struct(-F.col("n_agree"), F.coalesce("item_id", F.lit(NO_ID)))).alias("item_id"), F.max("n_agree").alias("n_agree"))
        out = d.join(best, "_row").select("doc_id", "contaminated", "item_id", "n_agree", *names)
    return out.select("doc_id", "contaminated", "item_id", "n_agree", *(F.col(k).alias(c) for k, c in names.items()))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark passage, all columns kept."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return contamination(docs, benchmark, keep=rest, **options).where(~F.col("contaminated")).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
