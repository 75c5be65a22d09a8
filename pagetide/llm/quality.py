"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Statistics of the bytes and words of a whole text (shares of kinds of bytes, entropy, word
and line lengths, repeats) are standardised; cosines of random projections of them
approximate a Gaussian kernel. Each task sums its rows' normal equations,
the sums are added block by block in a shuffle, and the driver gets one matrix of a fixed size.
Ridge scores of rows that took no part in the fit are counted in BINS bins by label, and pooling
adjacent violators over the bins gives the calibration: a score is the share of
label 1. Every labelled row outside the held-out fold is used, none is sampled.

Never inputs of a score: labels, lang, source, doc_id. Null texts are scored as empty ones.
A row without doc_id is held out and has no label. Repeated rows are scored alike;
of several labels of one doc_id the smallest counts. Without labels of both kinds all scores are the share of label 1, or one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import written
from .textops import U64, hash_words, padded, slices, text_buffers, words

SLICE, BINS, ROWS_PER_BLOCK = 4 << 20, 4096, 32
_KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", "\t\r", ".", ",", "!?", "*", "$%&", "#@", "|", "()[]{}<>", "\"'`", "-_=+/\\", ":;"]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _i, _s in enumerate(_KINDS):
    _KIND[list(_s.encode())] = _i
_KIND[0x80:] = len(_KINDS) + 1
N_KINDS = len(_KINDS) + 2
N_STATS = N_KINDS + 19


def _by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)


def statistics(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of N_STATS numbers for each text."""
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    by_byte = np.bincount(row * 256 + b[: off[-1]], minlength=n * 256).reshape(n, 256)
    share = by_byte / np.maximum(size, 1)[:, None]
    kinds = np.zeros((n, N_KINDS))
    for k in range(N_KINDS):
        kinds[:, k] = share[:, k == _KIND].sum(axis=1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    text = padded(b)
    start, end, first = words(b, off)
    count = np.diff(first)
    wrow = np.repeat(np.arange(n), count)
    length = (end - start).astype(float)
    h = hash_words(text, start, end)
    order = np.lexsort((h, wrow))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (wrow[order][1:] != wrow[order][:-1])
    per = np.maximum(count, 1)
    mean = lambda x: _by_row(x.astype(float), wrow, n) / per
    word = mean(length)
    spread = np.sqrt(np.maximum(mean(length**2) - word**2, 0))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
    last, head = text[end - 1] if len(end) else end, text[start] if len(start) else start
    upper = lambda x: (x >= 65) & (x <= 90)
    caps = upper(head) & upper(text[np.minimum(start + 1, len(text) - 1)]) if len(start) else same
    gram = np.unique(np.stack([wrow[1:], (h[1:] * U64(3) + h[:-1]).view(np.int64)]), axis=1)[0] if len(h) > 1 else wrow[:0]
    lines = by_byte[:, 10] + 1
    distinct = np.bincount(wrow[order][new], minlength=n)
    counts = np.diff(np.append(np.flatnonzero(new), len(h))) if len(h) else np.zeros(0)
    top = np.zeros(n)
    np.maximum.at(top, wrow[order][new], counts)
    more = [
        np.log1p(size), np.log1p(count), np.log1p(lines), np.log1p(size / lines), entropy, word, spread, np.sqrt(distinct / per), distinct / np.sqrt(per),
        np.sqrt(np.bincount(gram, minlength=n) / per), mean(same), top / per, mean(length > 20), mean(length <= 3), mean(upper(head)), mean(caps), mean(_KIND[last] >= 2) if len(end) else np.zeros(n), mean(_KIND[last] == 9) if len(end) else np.zeros(n), mean(length == 1),
    ]
    return np.column_stack([np.sqrt(kinds), *more])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, off = text_buffers(batch.column(1))
        out = []
        for lo, hi in slices(off, SLICE, 4096):
            x = statistics(text[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).astype(np.float32)
            out += [r.tobytes() for r in x]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *batch.columns[2:]], names=["doc_id", "stats", *batch.schema.names[2:]])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, N_STATS).astype(float)


class Features:
    """Standardised statistics, their random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n: int, width: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w, self.phase = rng.normal(size=(len(mean), n)) / width, rng.uniform(0, 2 * np.pi, n)
        self.dim = n + len(mean) + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.phase) * np.sqrt(2 / self.w.shape[1]), z / len(self.mean), np.ones(len(x))])


class _Equations:
    """A task's sums of the normal equations, ROWS_PER_BLOCK rows of the matrix a block; the last column is the right side."""

    def __init__(self, features: Features):
        self.features = features

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((self.features.dim, self.features.dim + 1))
        for batch in batches:
            if batch.num_rows:
                x = self.features(_matrix(batch.column(0)))
                total += x.T @ np.column_stack([x, batch.column(1).to_numpy().astype(float)])
        for lo in range(0, len(total), ROWS_PER_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([total[lo : lo + ROWS_PER_BLOCK].tobytes()], pa.binary())], names=["block", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(s)
            sums[b] = sums[b] + x if b in sums else x
    for b, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "sums"])


class _Raw:
    def __init__(self, features: Features, beta: np.ndarray):
        self.features, self.beta = features, beta

    def of(self, col: pa.Array) -> np.ndarray:
        return self.features(_matrix(col)) @ self.beta if len(col) else np.zeros(0)

    def bins(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(to_bin(self.of(batch.column(0))), pa.int32()), batch.column(1)], names=["bin", "quality"])


def to_bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int32)


def isotonic(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """A non-decreasing share of ones for each bin: the least-squares solution, by pooling adjacent violators; bins that hold nothing are interpolated."""
    pools: list[list[float]] = []
    for at in np.flatnonzero(all_):
        pools.append([float(ones[at]), float(all_[at]), at, at])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            o, a, _, e = pools.pop()
            pools[-1][0] += o
            pools[-1][1] += a
            pools[-1][3] = e
    x = [p for o, a, s, e in pools for p in (s, e)]
    y = [o / a for o, a, s, e in pools for _ in (s, e)]
    return np.interp(np.arange(len(all_)), x, y)


class _Score:
    def __init__(self, raw: _Raw | None, curve: np.ndarray, threshold: float):
        self.raw, self.curve, self.threshold = raw, curve, threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = self.curve[to_bin(self.raw.of(batch.column(1)))] if self.raw is not None else np.full(n, self.curve[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= self.threshold).astype(np.int32)), *batch.columns[2:]], names=["doc_id", "score", "predicted", *batch.schema.names[2:]])


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


class QualityModel:
    """Fitted on tables stats (doc_id, stats) and labels (doc_id, quality)."""

    def __init__(self, stats: DataFrame, labels: DataFrame, n_features: int = 384, width: float = 6.0, ridge: float = 0.3, threshold: float = 0.3):
        self.threshold = threshold
        own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
        known = written(stats.where("doc_id is not null").join(own, "doc_id").withColumn("fold", fold(F.col("doc_id"), 5)).where("fold <> 0").select("stats", "quality", "fold"))
        count = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
        total = sum(count.values())
        self.raw, self.curve = None, np.full(BINS, count.get(1, 0) / total if total else 0.5)
        if len(count) < 2:
            return
        sums = known.mapInArrow(_moments, "block int, sums binary").repartition(1, "block").mapInArrow(_add_up, "block int, sums binary")
        m = np.frombuffer(sums.first()["sums"]).reshape(3, -1)
        mean = m[1] / m[0]
        scale = np.sqrt(np.maximum(m[2] / m[0] - mean**2, 0)) + 1e-6
        features = Features(mean, scale, n_features, width)
        blocks = known.where("fold <> 1").select("stats", "quality").mapInArrow(_Equations(features), "block int, sums binary")
        rows = blocks.repartition(-(-features.dim // ROWS_PER_BLOCK), "block").mapInArrow(_add_up, "block int, sums binary").collect()
        a = np.concatenate([np.frombuffer(r["sums"]).reshape(-1, features.dim + 1) for r in sorted(rows, key=lambda r: r["block"])])
        beta = np.linalg.solve(a[:, :-1] + ridge * np.eye(features.dim), a[:, -1])
        self.raw = _Raw(features, beta)
        bins = known.where("fold = 1").select("stats", "quality").mapInArrow(self.raw.bins, "bin int, quality int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("ones")).collect()
        ones, all_ = np.zeros(BINS), np.zeros(BINS)
        for r in bins:
            ones[r["bin"]], all_[r["bin"]] = r["ones"], r["n"]
        if all_.any():
            self.curve = isotonic(ones, all_)

    def score(self, stats: DataFrame) -> DataFrame:
        """doc_id, score, predicted, and row if stats has it."""
        more = [c for c in stats.columns if c == "row"]
        return stats.select("doc_id", "stats", *more).mapInArrow(_Score(self.raw, self.curve, self.threshold), "doc_id long, score double, predicted int" + ", row long" * len(more))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = np.zeros((3, N_STATS))
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            m += np.stack([np.full(N_STATS, len(x)), x.sum(axis=0), (x**2).sum(axis=0)])
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["block", "sums"])


def document_statistics(docs: DataFrame, row: str | None = None) -> DataFrame:
    more = [F.col(row).cast("long").alias("row")] if row else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return written(d.mapInArrow(_stats, "doc_id long, stats binary" + ", row long" * len(more)))


def quality_scores(docs: DataFrame, labels: DataFrame, row: str | None = None, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text); row: a column of longs to give beside them, as row."""
    stats = document_statistics(docs, row)
    got = QualityModel(stats, labels, **options).score(stats)
    return got.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted", *(["row"] if row else []))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
