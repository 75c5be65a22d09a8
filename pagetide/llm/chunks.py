"""Documents packed into chunks, and questions that chunks put to hash buckets.

Operators that look every window of every text up in corpus-wide state would
move one row per window. Here a task packs a few MB of texts into one row, a
*chunk*; a question sends each hash bucket one binary of sorted distinct keys
per chunk (repeats inside a chunk never travel, and sorted keys are what the
bucket merges), and the bucket's answer travels back to the chunk as one bit
or byte per key in the same order. The chunk table is bucketed by chunk, so
that putting an answer beside its texts moves the answer only.

Buckets are counted by the size of the texts, BUCKET_BYTES each, and at least one a shuffle partition. A partition's buckets
come sorted, by Spark's spilling sort, and are settled one after the other: what a Python worker holds is one chunk
or one bucket, whatever the corpus. A text is never split: a worker needs some 30 times the bytes of the longest text, so
texts of hundreds of MB need workers of many GB.

Everything written lies in the shared folder spark.checkpoint.dir names, so a
lost executor costs a retried task and no more. ``release`` drops the tables of a session and their files once results are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store, shared_folder
from .textops import slices, text_buffers

#: The id under which rows without doc_id travel: above every other.
NO_ID = np.iinfo(np.int64).max
CHUNK_BYTES = 4 << 20
#: Rows of a chunk; a row's place within its chunk then fits 16 bits.
MOST_ROWS = 1 << 16


#: Bytes of text whose keys one bucket takes, about.
BUCKET_BYTES = 32 << 20
_MADE: dict[str, str] = {}

shared_dir = shared_folder


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read back: the plan is cut there."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Drops the chunk tables made so far and their files; frames that still read them are of no more use."""
    for table, path in list(_MADE.items()):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        Store(path).delete("")
        del _MADE[table]


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def even_labels(spark: SparkSession, n: int, each: int = 1) -> np.ndarray:
    """each * n labels of which repartition(n, label) sends `each` to every partition."""
    span, labels = 16 * n * each + 64, {}
    while len(labels) < n or any(len(x) < each for x in labels.values()):
        ids = spark.range(span).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
        labels = {r["p"]: r["ids"] for r in ids.groupBy("p").agg(F.slice(F.array_sort(F.collect_list("id")), 1, each).alias("ids")).collect()}
        span *= 2
    return np.array([labels[i][k] for k in range(each) for i in range(n)], np.int32)


CHUNK_SCHEMA = "chunk long, ids binary, offs binary, data binary, size long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    texts: list[np.ndarray] = []
    lens: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        off = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([(task << 24) + seq], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([off.tobytes()], pa.binary()), pa.array([np.concatenate(texts).tobytes()], pa.binary()), pa.array([int(off[-1])], pa.int64())], names=["chunk", "ids", "offs", "data", "size"])

    for batch in batches:
        doc = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        b, off = text_buffers(batch.column(1))
        for lo, hi in slices(off, CHUNK_BYTES, MOST_ROWS // 2):
            ids.append(doc[lo:hi])
            texts.append(b[off[lo] : off[hi]].copy())
            lens.append(np.diff(off[lo : hi + 1]))
            held += int(off[hi] - off[lo])
            if held >= CHUNK_BYTES // 2 or sum(map(len, ids)) > MOST_ROWS // 2:
                yield flush()
                seq, held = seq + 1, 0
                ids, texts, lens = [], [], []
    if ids:
        yield flush()


class Chunks:
    """The texts of docs (doc_id, text), packed and bucketed in the shared folder."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.parts = parts_of(self.spark)
        packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack, CHUNK_SCHEMA)
        self.table, path = f"pagetide_{uuid.uuid4().hex}", shared_dir(self.spark)
        packed.write.bucketBy(self.parts, "chunk").option("path", path).option("compression", "zstd").saveAsTable(self.table)
        _MADE[self.table] = path
        self.size = self.spark.table(self.table).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.each = max(1, -(-self.size // (BUCKET_BYTES * self.parts)))
        self.buckets = self.parts * self.each
        self.labels = even_labels(self.spark, self.parts, self.each)

    def df(self) -> DataFrame:
        return self.spark.table(self.table).select("chunk", "ids", "offs", "data")

    def ask(self, emit: Callable, settle: Callable, answers: DataFrame | None = None, out: str = "chunk long, bucket int, answer binary", whole: int = 32, squeeze: bool = False) -> DataFrame:
        """Put a question. emit(chunk) gives, per chunk, (sorted distinct keys uint64, payload bytes per key as a 2-d uint8 array or None);
        settle gets one bucket's [(chunk, keys, payload)] and yields rows of out. Keys that agree in their `whole` upper bits share a bucket.
        squeeze: compress what travels, which pays for keys that are no hashes."""
        asked = self._with(answers).mapInArrow(_Emit(emit, self.buckets, self.labels, answers is not None, whole, squeeze), "bucket int, chunk long, n int, body binary")
        return self.dealt(asked).mapInArrow(_Settle(settle, squeeze), out)

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows with a column bucket at their partitions, bucket after bucket."""
        return df.repartition(self.parts, "bucket").sortWithinPartitions("bucket")

    def _with(self, answers: DataFrame | None) -> DataFrame:
        if answers is None:
            return self.df()
        got = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
        return self.df().join(got.hint("shuffle_hash"), "chunk", "left").select("chunk", "ids", "offs", "data", "answers")

    def finish(self, answers: DataFrame | None, fn: Callable, schema: str) -> DataFrame:
        """fn(chunk) gives a RecordBatch of the schema for each chunk."""
        return self._with(answers).mapInArrow(_Each(fn, answers is not None), schema)


class Chunk:
    """One chunk: id, ids (int64), off, b (padded bytes)."""

    def __init__(self, cid: int, ids: bytes, offs: bytes, data: bytes, answers: list | None):
        self.id, self.ids, self.off = cid, np.frombuffer(ids, np.int64), np.frombuffer(offs, np.int64)
        self.raw = np.frombuffer(data, np.uint8)
        self.answers = {int(a["bucket"]): a["answer"] for a in answers or []}

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)


def rows(batches: Iterator[pa.RecordBatch], answered: bool) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            a = batch.column(4)[i].as_py() if answered else None
            yield Chunk(batch.column(0)[i].as_py(), *(memoryview(batch.column(j)[i].as_buffer()) for j in (1, 2, 3)), a)


def bucket_of(keys: np.ndarray, parts: int, whole: int = 32) -> np.ndarray:
    """From the upper bits of a well-mixed key."""
    return (((keys >> np.uint64(64 - whole)) * np.uint64(parts)) >> np.uint64(whole)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)


def dealt(keys: np.ndarray, parts: int, whole: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """For distinct sorted keys: where each bucket begins. Buckets are ranges of keys, so order is kept."""
    edges = np.searchsorted(bucket_of(keys, parts, whole), np.arange(parts + 1))
    return edges[:-1], edges[1:]


def planes(keys: np.ndarray, load: np.ndarray | None) -> bytes:
    """All first bytes, then all second ones and so on: the upper bytes of sorted keys compress to nothing."""
    both = keys.view(np.uint8).reshape(-1, 8)
    if load is not None:
        both = np.concatenate([both, load], axis=1)
    return np.ascontiguousarray(both.T).tobytes()


def unplanes(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    both = np.frombuffer(body, np.uint8).reshape(-1, n)
    keys = np.ascontiguousarray(both[:8].T).view(np.uint64).ravel()
    return keys, (np.ascontiguousarray(both[8:].T) if len(both) > 8 else None)


class _Emit:
    def __init__(self, emit: Callable, parts: int, labels: np.ndarray, answered: bool, whole: int, squeeze: bool):
        self.emit, self.parts, self.labels, self.answered, self.whole, self.squeeze = emit, parts, labels, answered, whole, squeeze

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress if self.squeeze else bytes
        for c in rows(batches, self.answered):
            keys, load = self.emit(c)
            lo, hi = dealt(keys, self.parts, self.whole)
            full = np.flatnonzero(hi > lo)
            if not len(full):
                continue
            bodies = [pack(planes(keys[lo[i] : hi[i]], None if load is None else load[lo[i] : hi[i]])) for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(self.labels[full], pa.int32()), pa.array(np.full(len(full), c.id), pa.int64()), pa.array((hi - lo)[full].astype(np.int32), pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "chunk", "n", "body"])


def by_bucket(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Each bucket with its rows, as slices of batches; a bucket ends where the next begins."""
    now, held = None, []
    for batch in batches:
        labels = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if held and labels[lo] != now:
                    yield now, held
                    held = []
                now = int(labels[lo])
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, held


class _Settle:
    def __init__(self, settle: Callable, squeeze: bool):
        self.settle, self.squeeze = settle, squeeze

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress if self.squeeze else bytes
        for label, parts in by_bucket(batches):
            got = [(r["chunk"], *unplanes(unpack(r["body"]), r["n"])) for part in parts for r in part.select(["chunk", "n", "body"]).to_pylist()]
            yield from self.settle(label, got)


class _Each:
    def __init__(self, fn: Callable, answered: bool):
        self.fn, self.answered = fn, answered

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in rows(batches, self.answered):
            yield self.fn(c)


def answer_batch(label: int, chunks: list[int], answers: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([label] * len(chunks), pa.int32()), pa.array(answers, pa.binary())], names=["chunk", "bucket", "answer"])


#: Added to the bucket of answers to a second question, so that a chunk can get both.
SECOND = 1 << 30


@lru_cache(maxsize=4)
def _places(labels: bytes) -> dict[int, int]:
    return {x: i for i, x in enumerate(np.frombuffer(labels, np.int32).tolist())}


def answers_of(c: Chunk, keys: np.ndarray, parts: int, labels: np.ndarray, second: bool = False, whole: int = 32) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of each answer to sorted distinct keys: the range of keys that it is for, and its bytes."""
    lo, hi = dealt(keys, parts, whole)
    where = _places(labels.tobytes())
    for label, a in c.answers.items():
        if (label >= SECOND) == second:
            i = where[label - SECOND * second]
            yield int(lo[i]), int(hi[i]), np.frombuffer(a, np.uint8)


def read_answers(c: Chunk, keys: np.ndarray, parts: int, labels: np.ndarray, bits: bool = True, second: bool = False) -> np.ndarray:
    """The answers to sorted distinct keys, in order: 0 or 1 (bits), or a byte each; nothing sent means 0."""
    out = np.zeros(len(keys), np.uint8)
    for lo, hi, got in answers_of(c, keys, parts, labels, second):
        out[lo:hi] = np.unpackbits(got, count=hi - lo) if bits else got
    return out
