"""Nearest neighbours by additive quantisation.

A vector of length one is written as the sum of STAGES codewords of full dimension, one
of each residual codebook. Encoding is a beam search: the BEAM best partial sums
are extended by every codeword of the next book. Stored per vector: its codes and the squared norm of
its sum. A query makes one table of products with all codewords; a
vector's approximate product is a sum of table entries, divided by the stored norm's root for the cosine.
These guesses prune an exact search. With a class go the cosine of its vector and its sum and the vector itself. The angle of a
query and a vector is at least that of the query and the sum less that of the sum and the vector; a class whose cosine by this
bound is less than that of the worst result held is left out, all others are scored by their vectors in double precision. In the first block
that a query meets, its best CANDIDATES guesses are scored before, so that there is something to prune by. Results are therefore those of a search
of all pairs, whatever the vectors; what hangs on the books is the work: vectors without structure are hardly pruned in many dimensions.
A task gives one row a query, with its few best; the rows are merged, scored once more and the nearest given.

Equal vectors are one class, which is encoded, searched and reranked once and stands for its smallest ids, one more
than a query asks for; of equal guesses and scores the smaller ids come first.

Codebooks are fitted on at most SAMPLE classes, those with the smallest hashes of id; every class is
encoded. Codes travel in blocks of BLOCK vectors (4 MB at most) and queries in blocks of QUERY_BLOCK, a stated query set against all
rows: codes are dealt to groups of at most about GROUP classes and GROUP_BYTES, queries to shares, and each pair of group and share is one task's.

Vectors that are null, zero, of another dimension than most, or hold a null or non-finite component, and rows without vec_id
take no part. Rows that share an id are one another's own: the smallest of their vectors asks, none of them is found by it,
and elsewhere such an id is given once, by its nearest vector. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import parts_of, written

STAGES, WORDS, BEAM = 16, 256, 4
SAMPLE, BLOCK, QUERY_BLOCK, CANDIDATES = 8192, 8192, 128, 400
#: The most classes and bytes of them that one task holds, and the pairs of query and class worth a task of their own.
GROUP, GROUP_BYTES, PAIRS = 1 << 22, 1 << 26, 1 << 23
#: Results held beyond those asked for, against rounding at the cut; what 32-bit guesses may be off by; norms of sums too short for them.
SPARE, EPS, SHORT = 3, 5e-5, 0.1
#: Hits of a query in a block that are sorted before they are merged.
MANY = 64


def _clean(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = v.where(fine & F.exists("v", lambda x: x != 0))
    return v


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten().to_numpy().astype(float)
    return flat.reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_codebooks(x: np.ndarray, stages: int = STAGES, k: int = WORDS, rounds: int = 5, seed: int = 5) -> np.ndarray:
    """Residual k-means: each book is fitted to what the books before it leave."""
    rng = np.random.default_rng(seed)
    books, rest = [], x.copy()
    for _ in range(stages):
        c = rest[rng.choice(len(rest), k, replace=len(rest) < k)].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(axis=1) - 2 * rest @ c.T, axis=1)
            n = np.bincount(near, minlength=k)
            s = np.zeros_like(c)
            np.add.at(s, near, rest)
            c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), k)])
        near = np.argmin((c * c).sum(axis=1) - 2 * rest @ c.T, axis=1)
        rest = rest - c[near]
        books.append(c)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Beam-searched codes and the squared norms of their sums."""
    out, norms = [], []
    for lo in range(0, len(x), 2048):
        y = x[lo : lo + 2048]
        n = len(y)
        codes, rest = np.zeros((n, 1, 0), np.uint8), y[:, None, :]
        for book in books:
            far = (rest**2).sum(axis=2)[:, :, None] + (book**2).sum(axis=1) - 2 * rest @ book.T
            flat = far.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            stem, word = best // len(book), best % len(book)
            i = np.arange(n)[:, None]
            codes = np.concatenate([codes[i, stem], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[i, stem] - book[word]
        top = np.argmin((rest**2).sum(axis=2), axis=1)
        i = np.arange(n)
        out.append(codes[i, top])
        norms.append(((y - rest[i, top]) ** 2).sum(axis=1))
    return np.concatenate(out), np.concatenate(norms)


class _Classes:
    """Of each batch, equal vectors as one row with their smallest ids."""

    def __init__(self, most: int, dim: int):
        self.most, self.dim = most, dim

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(1), self.dim) + 0.0  # one zero
            group = np.unique(x.view(np.dtype((np.void, 8 * self.dim))).ravel(), return_inverse=True)[1].ravel()
            ids = batch.column(0).to_numpy()
            order = np.lexsort((ids, group))
            g, i = group[order], ids[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
            order, g, i = order[new], g[new], i[new]
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            size = np.diff(np.append(at, len(g)))
            keep = np.arange(len(g)) - np.repeat(at, size) < self.most
            ends = np.concatenate([[0], np.cumsum(np.minimum(size, self.most))])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(order[at])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(i[keep], pa.int64()))], names=["v", "ids"])


class _Encode:
    """Blocks of classes: their ids, vectors, codes, norms, and the cosines and sines of vectors and sums."""

    def __init__(self, books: np.ndarray, dim: int, kind: str):
        self.books, self.dim, self.kind = books, dim, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        stages = np.arange(len(self.books))
        most = max(1, min(BLOCK, (1 << 22) // (self.dim * np.dtype(self.kind).itemsize)))
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                x = _rows(part.column(1), self.dim)
                unit = _unit(x)
                codes, norms = encode(unit, self.books)
                dot = np.concatenate([(unit[i : i + 2048] * self.books[stages, codes[i : i + 2048]].sum(axis=1)).sum(axis=1) for i in range(0, len(unit), 2048)])
                cos = np.clip(dot / np.sqrt(np.maximum(norms, 1e-30)), -1, 1)
                sin = np.sqrt(1 - cos * cos)
                ids = part.column(2)
                arrays = [part.column(0).to_numpy(), ids.value_lengths().to_numpy().astype(np.int32), ids.flatten().to_numpy(), x.astype(self.kind), codes, *(a.astype(np.float32) for a in (norms, cos, sin))]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 24) + seq], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["block", *_Encode.COLUMNS])
                seq += 1

    COLUMNS = ["classes", "sizes", "ids", "vectors", "codes", "norms", "cosines", "sines"]


class _Queries:
    """Blocks of queries, numbered by task and place."""

    def __init__(self, dim: int, kind: str):
        self.dim, self.kind = dim, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(lo, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([task + (seq << 32)], pa.int64()), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_rows(part.column(1), self.dim).astype(self.kind).tobytes()], pa.binary())], names=["asked", "query_ids", "queries"])
                seq += 1


class _Held:
    """The best results of a block of queries: of each id the best, of equal scores the smaller ids."""

    def __init__(self, own: np.ndarray, most: int):
        self.own, self.most = own, most
        self.q, self.s, self.i, self.c = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(len(own), -np.inf)  # a score below it is of no use

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray, c: np.ndarray) -> None:
        new = i != self.own[q]
        q, s, i, c = (np.concatenate([a, b[new]]) for a, b in zip((self.q, self.s, self.i, self.c), (q, s, i, c), strict=True))
        order = np.lexsort((c, -s, i, q))
        first = np.concatenate([[True], (np.diff(q[order]) != 0) | (np.diff(i[order]) != 0)])[: len(order)]
        order = order[first]
        order = order[np.lexsort((i[order], -s[order], q[order]))]
        n = np.bincount(q[order], minlength=len(self.own))
        place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        order, place = order[place < self.most], place[place < self.most]
        self.q, self.s, self.i, self.c = q[order], s[order], i[order], c[order]
        last = place == self.most - 1
        self.least[self.q[last]] = self.s[last]

    def packed(self) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.q, minlength=len(self.own)))])
        best = pa.StructArray.from_arrays([pa.array(-self.s), pa.array(self.i), pa.array(self.c)], names=["s", "vec_id", "class"])
        return pa.RecordBatch.from_arrays([pa.array(self.own), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), best)], names=["query_id", "c"])


class _Search:
    """The best results of each query in all code blocks of its group: blocks of codes that meet the same block of
    queries come one after another, and only a running best of them is held and given."""

    def __init__(self, books: np.ndarray, most: int, candidates: int, kind: str):
        self.books, self.most, self.candidates, self.kind = books, most, candidates, kind

    def _add(self, held: _Held, q: np.ndarray, s: np.ndarray, at: np.ndarray, block: dict) -> None:
        """Results of queries q (in order) by classes at places of a block. Of many of one query only the first are merged, if these alone name enough ids."""
        n = np.bincount(q, minlength=len(held.own))
        for i in np.flatnonzero(n > MANY):
            mine = np.flatnonzero(q == i)
            order = mine[np.lexsort((block["least"][at[mine]], -s[mine]))]
            named = np.unique(block["least"][at[order[:MANY]]])
            if (named != held.own[i]).sum() >= self.most:
                q[order[MANY:]] = -1
        q, s, at = q[q >= 0], s[q >= 0], at[q >= 0]
        size = block["sizes"][at]
        ids = np.repeat(block["starts"][at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        held.add(np.repeat(q, size), np.repeat(s, size), block["ids"][ids], np.repeat(block["classes"][at], size))

    def _scan(self, held: _Held, lo: int, q: np.ndarray, table: np.ndarray, block: dict) -> None:
        """Queries q, from place lo, against a block."""
        codes, x = block["codes"], block["vectors"]
        got = np.zeros((len(q), len(codes)), np.float32)
        for j in range(codes.shape[1]):
            got += np.take(table[:, j], codes[:, j], axis=1)
        got *= block["scale"]
        own = slice(lo, lo + len(q))
        if np.isneginf(held.least[own]).any():
            most = min(self.candidates, len(codes))
            best = np.argpartition(-got, most - 1, axis=1)[:, :most]
            s = np.stack([_unit(x[b].astype(float)) @ y for b, y in zip(best, q, strict=True)])
            self._add(held, np.repeat(np.arange(lo, lo + len(q)), most), s.ravel(), best.ravel(), block)
        t = np.clip(held.least[own], -1, 1)[:, None]
        cos, sin = block["cosines"], block["sines"]
        near = got >= t.astype(np.float32) * cos - np.sqrt(1 - t * t).astype(np.float32) * sin - np.float32(EPS)
        near |= (t <= EPS - cos) | block["short"]
        at = np.flatnonzero(near.any(axis=0))
        for k in range(0, len(at), 8192):
            some = at[k : k + 8192]
            s = q @ _unit(x[some].astype(float)).T
            i, j = np.nonzero(s >= held.least[own, None])
            if len(i):
                self._add(held, i + lo, s[i, j], some[j], block)

    def _block(self, r: dict, stages: int, dim: int) -> dict:
        kinds = dict(zip(_Encode.COLUMNS, (np.int64, np.int32, np.int64, self.kind, np.uint8, np.float32, np.float32, np.float32), strict=True))
        b = {c: np.frombuffer(r[c], t) for c, t in kinds.items()}
        norm = np.sqrt(b["norms"])
        starts = np.cumsum(b["sizes"], dtype=np.int64) - b["sizes"]
        return b | {"codes": b["codes"].reshape(-1, stages), "vectors": b["vectors"].reshape(-1, dim), "starts": starts, "least": b["ids"][starts], "scale": 1 / np.maximum(norm, 1e-6), "short": norm < SHORT}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stages, k, dim = self.books.shape
        key, q, tables, held = None, None, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                if key != (r["group"], r["asked"]):
                    if held:
                        yield held.packed()
                    key, held = (r["group"], r["asked"]), _Held(np.frombuffer(r["query_ids"], np.int64), self.most)
                    q = _unit(np.frombuffer(r["queries"], self.kind).reshape(-1, dim).astype(float))
                    tables = (q @ self.books.reshape(-1, dim).T).astype(np.float32).reshape(-1, stages, k)
                block = self._block(r, stages, dim)
                for lo in range(0, len(q), 64):
                    self._scan(held, lo, q[lo : lo + 64], tables[lo : lo + 64], block)
        if held:
            yield held.packed()


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact cosines of pairs, in double precision."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (_unit(_rows(batch.column(i), len(batch.column(i)[0]))) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x * y).sum(axis=1))], names=["query_id", "ids", "score"])


def nearest(vectors: DataFrame, is_query, n: int = 5, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id and score: the n nearest rows of vectors (vec_id, embedding) found for those that the Column is_query picks."""
    spark = vectors.sparkSession
    v = _clean(vectors)
    dims = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out)
    dim = dims["d"]
    kind = "f4" if v.schema["v"].dataType.elementType.typeName() == "float" else "f8"
    v = written(v.where(F.size("v") == dim))
    parts = v.select("vec_id", "v").mapInArrow(_Classes(n + 1, dim), f"v {v.schema['v'].dataType.simpleString()}, ids array<bigint>")
    classes = parts.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, n + 1).alias("ids"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "v", "ids", F.col("ids")[0].alias("least")))
    sample = classes.orderBy(F.xxhash64("least"), "least").limit(SAMPLE).toPandas()
    books = fit_codebooks(_unit(np.stack(sample["v"].to_numpy()).astype(float)))
    codes = written(classes.select("class", "v", "ids").mapInArrow(_Encode(books, dim, kind), "block long, " + ", ".join(f"{c} binary" for c in _Encode.COLUMNS)))
    queries = v.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries, n_classes = queries.count(), classes.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    tasks = min(parts_of(spark), max(1, n_queries * n_classes // PAIRS))
    asks = dim * np.dtype(kind).itemsize + 8
    weighs = asks + 40  # bytes of a class
    even = min(tasks, round((tasks * n_classes * weighs / max(1, n_queries * asks)) ** 0.5))  # as many bytes of classes as of queries
    groups = max(-(-n_classes // min(GROUP, max(1, GROUP_BYTES // weighs))), even, 1)
    shares = min(blocks, max(1, -(-tasks // groups)))
    asked = queries.repartition(blocks).mapInArrow(_Queries(dim, kind), "asked long, query_ids binary, queries binary")
    left = asked.withColumns({"group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "share": F.pmod("asked", F.lit(shares)).cast("int")})
    right = codes.withColumns({"group": F.pmod(F.hash("block"), F.lit(groups)), "share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))})
    pairs = left.join(right.hint("shuffle_hash"), ["group", "share"]).select("group", "asked", *_Encode.COLUMNS, "query_ids", "queries")
    most = n + SPARE
    found = pairs.mapInArrow(_Search(books, most, candidates, kind), "query_id long, c array<struct<s: double, vec_id: long, class: long>>")
    more = lambda most: lambda got, x: F.when((F.size(got) < most) & ~F.exists(got, lambda y: y["vec_id"] == x["vec_id"]), F.concat(got, F.array(x))).otherwise(got)
    top = found.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("c"))).alias("c"))
    top = top.select("query_id", F.array_distinct(F.transform(F.aggregate("c", F.slice("c", 1, 0), more(most)), lambda x: x["class"])).alias("c"))
    short = top.select("query_id", F.explode("c").alias("class"))
    full = short.join(classes.select("class", "ids", "v"), "class").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = full.select("query_id", "ids", "q", "v").mapInArrow(_best, "query_id long, ids array<bigint>, score double")
    exact = exact.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    ranked = exact.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("b"))
    best = ranked.select("query_id", F.aggregate("b", F.slice("b", 1, 0), more(n)).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def op5(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
