"""N-gram Jaccard self-join: size bands, bitmap signatures, exact intersection.

Documents are sets of word shingles; equal sets are one class, which takes
part once. Two classes of sizes m <= n can only link when m >= t * n and when they share one of
the first ``n - ceil(t * n) + 1`` shingles of each, whatever common order those are
taken in. The order here is by the number of classes that hold a shingle, so a
document of which more than a fifth occurs nowhere else has no candidate, and what many documents
share comes last.

A shingle's candidates are sorted by size and compared in tiles of adjacent
size bands. Up to SMALL candidates, a tile gives all its pairs of fitting
sizes. In a larger tile every member is paired with a few leaders only; the
links that these give are joined into components, and then what is not yet in
one component is paired within the tile, so that no link
between components is lost and a group of n near copies needs about n pairs.

Of each pair, 1024-bit parity bitmaps bound the difference of the sets from
below, hence the overlap from above; what passes is intersected as sorted
arrays. Counts and candidate sets are dealt by hash; nothing is collected.

Null and empty texts have no shingles and no links. Rows without doc_id
take part as if larger than every id. Repeated rows are one class. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NO_ID, Chunk, Chunks, answer_batch, read_answers, rows, written
from .graph import components, join_salted
from .textops import U64, grams, hash_words, mix, padded, words

SMALL, LEADERS, BITS = 32, 4, 1024
_LOW = U64(0xFFFF)


def _shingles(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, by document and then hash, and where each document's begin."""
    b = padded(c.raw, lower=True)
    start, end, first = words(c.raw, c.off)
    h = hash_words(b, start, end)
    n = np.diff(first)
    g, ok = grams(h, first, size)
    row = np.repeat(np.arange(len(n)), n)
    short = np.flatnonzero((n > 0) & (n < size))
    extra = [mix(np.bitwise_xor.reduce(mix(h[first[i] : first[i + 1]] + np.arange(n[i], dtype=U64)), keepdims=True) + U64(n[i]))[0] for i in short]
    g = np.concatenate([g[ok], np.array(extra, U64)])
    row = np.concatenate([row[ok], short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])]) if len(g) else np.zeros(0, bool)
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(n) + 1))


class _Features:
    """doc_id, n_shingles, two hashes of the set and the place of the row."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, c: Chunk) -> pa.RecordBatch:
        g, first = _shingles(c, self.size)
        n = np.diff(first)
        sums = [np.concatenate([[U64(0)], np.cumsum(mix(g ^ U64(salt)), dtype=U64)]) for salt in (0x1234567, 0x89ABCDE)]
        h = [mix((s[first[1:]] - s[first[:-1]]) + n.astype(U64)).view(np.int64) for s in sums]
        return pa.RecordBatch.from_arrays([pa.array(c.ids), pa.array(n, pa.int64()), pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(n), c.id, np.int64)), pa.array(np.arange(len(n)), pa.int32())], names=["doc_id", "n", "h1", "h2", "chunk", "row"])


#: The bucket of an answer that lists the rows of a chunk that stand for their class.
REPS = -1


def _reps(c: Chunk) -> np.ndarray:
    out = np.zeros(len(c.ids), bool)
    if REPS in c.answers:
        out[np.frombuffer(c.answers.pop(REPS), ">u2")] = True
    return out


class _Rare:
    """A chunk's shingles of standing rows: distinct keys of 48 bits, with the number of rows that hold each."""

    def __init__(self, size: int):
        self.size = size

    def find(self, c: Chunk):
        g, first = _shingles(c, self.size)
        n = np.diff(first)
        stand = np.repeat(_reps(c), n)
        keys = np.sort(g[stand] & ~_LOW)
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return g, first, stand, keys[at], np.minimum(np.diff(np.append(at, len(keys))), 0xFFFF)

    def __call__(self, c: Chunk):
        _, _, _, keys, n = self.find(c)
        return keys | n.astype(U64), None


def _settle_rare(label: int, got: list):
    """Each key's number of classes: 0 for one, then the rounded logarithm."""
    both = np.concatenate([k for _, k, _ in got])
    order = np.argsort(both, kind="stable")
    s = both[order]
    k = s & ~_LOW
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    total = np.add.reduceat((s & _LOW).astype(np.int64), at)
    rank = np.where(total < 2, 0, np.minimum(np.log2(total) * 8, 255)).astype(np.uint8)
    back = np.empty(len(k), np.uint8)
    back[order] = np.repeat(rank, np.diff(np.append(at, len(k))))
    lo, who, what = 0, [], []
    for c, x, _ in got:
        if back[lo : lo + len(x)].any():
            who.append(c)
            what.append(back[lo : lo + len(x)].tobytes())
        lo += len(x)
    if who:
        yield answer_batch(label, who, what)


class _Prefixes:
    """The first shingles of each standing row, rarest first, but for those that no other class has."""

    def __init__(self, size: int, percent: int, parts: int, labels: np.ndarray):
        self.rare, self.percent, self.parts, self.labels = _Rare(size), percent, parts, labels

    def __call__(self, c: Chunk):
        g, first, stand, keys, _ = self.rare.find(c)
        rank = np.zeros(len(g), np.uint8)
        if len(keys):
            rank[stand] = read_answers(c, keys, self.parts, self.labels, bits=False)[np.searchsorted(keys, g[stand] & ~_LOW)]
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((g, rank, row))
        prefix = n - -(-n * self.percent // 100) + 1
        keep = (np.arange(len(g)) - first[row] < prefix[row]) & (rank[order] > 0) & stand
        g, row = g[order][keep], row[keep]
        by = np.argsort(g, kind="stable")
        g, row = g[by], row[by]
        node = (c.id << 16) + row
        load = np.concatenate([node[:, None].astype(np.int64).view(np.uint8).reshape(-1, 8), n[row, None].astype(np.int32).view(np.uint8).reshape(-1, 4)], axis=1)
        return g, load


class _Tiles:
    """Pairs of a key's candidates (key 0), and the members of tiles that were paired with leaders only (b is null)."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, label: int, got: list) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([k for _, k, _ in got])
        load = np.concatenate([x for _, _, x in got])
        node = np.ascontiguousarray(load[:, :8]).view(np.int64).ravel()
        n = np.ascontiguousarray(load[:, 8:]).view(np.int32).ravel().astype(np.int64)
        order = np.lexsort((node, n, key))
        key, node, n = key[order], node[order], n[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        size = np.diff(at)
        start = np.repeat(at[:-1], size)
        end = np.repeat(at[1:], size)
        small = np.repeat(size <= SMALL, size)
        a, b = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero(small & (np.arange(len(key)) + d < end))
            if not len(i):
                break
            i = i[n[i] * 100 >= n[i + d] * self.percent]
            a.append(node[i])
            b.append(node[i + d])
        big_key, big_node, big_n = [], [], []
        for i in np.flatnonzero(size > SMALL):
            m, who = n[at[i] : at[i + 1]], node[at[i] : at[i + 1]]
            band = np.floor(np.log(m) / np.log(100 / self.percent)).astype(int)
            chief = None
            for x in np.unique(band):
                tile = np.flatnonzero(band == x)
                lead = tile[np.argsort(mix(who[tile].view(U64)))[:LEADERS]]
                for j in lead if chief is None else [*lead, *chief]:
                    ok = tile[(np.minimum(m[tile], m[j]) * 100 >= np.maximum(m[tile], m[j]) * self.percent) & (tile != j)]
                    a.append(who[ok])
                    b.append(np.full(len(ok), who[j]))
                chief = lead
            big_key.append(np.full(len(m), key[at[i]].view(np.int64)))
            big_node.append(who)
            big_n.append(m)
        if a:
            p = np.unique(np.stack([np.minimum(np.concatenate(a), np.concatenate(b)), np.maximum(np.concatenate(a), np.concatenate(b))]), axis=1)
            for lo in range(0, p.shape[1], 1 << 16):
                q = p[:, lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(q.shape[1], np.int64)), pa.array(q[0]), pa.array(q[1]), pa.nulls(q.shape[1], pa.int64())], names=["key", "a", "b", "n"])
        if big_key:
            k, w, m = (np.concatenate(x) for x in (big_key, big_node, big_n))
            for lo in range(0, len(k), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(k[s]), pa.array(w[s]), pa.nulls(len(k[s]), pa.int64()), pa.array(m[s])], names=["key", "a", "b", "n"])


class _Sets:
    """node, n, parity bitmap and sorted shingles of the rows that the answer lists."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in rows(batches, True):
            pick = np.flatnonzero(_reps(c))
            if not len(pick):
                continue
            g, first = _shingles(c, self.size)
            bits = np.zeros((len(pick), BITS), np.uint8)
            for j, i in enumerate(pick):
                bits[j] = np.bincount((g[first[i] : first[i + 1]] >> U64(8)).astype(np.int64) % BITS, minlength=BITS) & 1
            yield pa.RecordBatch.from_arrays([pa.array((c.id << 16) + pick, pa.int64()), pa.array((first[1:] - first[:-1])[pick], pa.int64()), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()), pa.array([g[first[i] : first[i + 1]].tobytes() for i in pick], pa.binary())], names=["node", "n", "bitmap", "shingles"])


class _Bound:
    """Pairs whose bitmaps allow the similarity."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                keep = 100 * (total - apart) >= self.percent * (total + apart)
                yield batch.select([0, 1]).filter(pa.array(keep))


class _Exact:
    """Pairs whose sets have the similarity."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint64) for j in (2, 3))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= self.percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class _Across:
    """Of each tile, the pairs of fitting sizes and bitmaps whose roots differ, one of them outside the largest component, one of them of the tile's own band. Members of one tile follow one another."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, bands = batch.column(0).to_numpy(), batch.column(6).to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (bands[1:] != bands[:-1])) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (keys[lo], bands[lo]) != key:
                    yield from self.tile(held)
                    held = []
                key = (keys[lo], bands[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from self.tile(held)

    def tile(self, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        node, n, root, most = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
        bits = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint64).reshape(len(node), -1)
        rest, own = root != most, t.column(7).to_numpy()
        for i in np.flatnonzero(rest):
            other = (own | own[i]) & (root != root[i]) & (~rest | (node > node[i])) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * self.percent)
            j = np.flatnonzero(other)
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            total = n[j] + n[i]
            j = j[100 * (total - apart) >= self.percent * (total + apart)]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[j], node[i])), pa.array(np.maximum(node[j], node[i]))], names=["a", "b"])


class NgramJoin:
    """links (a, b between class nodes), classes (h1, h2, node, least doc_id) and members of docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 80):
        self.size, self.percent = size, percent
        self.chunks = Chunks(docs)
        schema = "doc_id long, n long, h1 long, h2 long, chunk long, row int"
        self.members = written(self.chunks.finish(None, _Features(size), schema))
        node = F.shiftleft("chunk", 16) + F.col("row")
        self.classes = written(self.members.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min(node).alias("node")))
        reps = self._listed(self.classes.select("node"))
        rare = written(self.chunks.ask(_Rare(size), _settle_rare, reps).unionByName(reps))
        prefixes = _Prefixes(size, percent, self.chunks.buckets, self.chunks.labels)
        found = written(self.chunks.ask(prefixes, _Tiles(percent), rare, "key long, a long, b long, n long"))
        pairs, self.big = found.where("b is not null").select("a", "b").distinct(), found.where("b is null").select("key", F.col("a").alias("node"), "n")
        pairs = written(pairs)
        # members of large tiles that no leader fits are in no pair yet
        need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(self.big.select("node")).distinct()
        sets = self.chunks._with(self._listed(need)).mapInArrow(_Sets(size), "node long, n long, bitmap binary, shingles binary")
        self.sets = written(sets)
        self.links = self._verified(pairs)
        self.roots = written(components(self.links))
        if self.big.limit(1).count():
            more = self._verified(self._left_over())
            self.links = self.links.unionByName(more)
            if more.limit(1).count():
                self.roots = components(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    @staticmethod
    def _listed(nodes: DataFrame) -> DataFrame:
        """Answers that list the nodes' rows to their chunks: two bytes for each, at most one list a chunk."""
        two = F.unhex(F.lpad(F.hex(F.col("node").bitwiseAND(0xFFFF)), 4, "0"))
        return nodes.groupBy(F.shiftright("node", 16).alias("chunk")).agg(F.collect_list(F.hex(two)).alias("l")).select("chunk", F.lit(REPS).alias("bucket"), F.unhex(F.array_join("l", "")).alias("answer"))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. A leader is in many pairs: its row is copied for each load of them."""

        def with_sets(df: DataFrame, *c: str) -> DataFrame:
            for x, other in (("a", "b"), ("b", "a")):
                df = join_salted(df, self.sets.select(F.col("node").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in c)), x, other)
            return df

        maps = with_sets(pairs, "n", "bitmap").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b")
        near = written(maps.mapInArrow(_Bound(self.percent), "a long, b long"))
        full = with_sets(near, "shingles").select("a", "b", "shingles_a", "shingles_b")
        return written(full.mapInArrow(_Exact(self.percent), "a long, b long"))

    def _left_over(self) -> DataFrame:
        """Within large tiles, the pairs of fitting sizes across components: members outside a key's largest component with all that are in another.

        Sizes that fit are of one band or of two next to each other, so a key's members are compared band by band, each with the band below.
        """
        comp = self.big.join(self.roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        comp = written(comp)
        most = comp.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
        band = F.floor(F.log("n") / (1.0001 * math.log(100 / self.percent)))  # a little wider, so that rounding parts none
        open_ = comp.join(most.select("key", "most"), "key").join(self.sets.select("node", "bitmap"), "node").withColumn("own", band)
        open_ = open_.withColumn("band", F.explode(F.array("own", F.col("own") + 1))).withColumn("own", F.col("own") == F.col("band"))
        tiles = open_.select("key", "node", "n", "root", "most", "bitmap", "band", "own").repartition(self.chunks.parts, "key", "band").sortWithinPartitions("key", "band", "node")
        return written(tiles.mapInArrow(_Across(self.percent), "a long, b long").distinct())

    def labelled(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        named = self.classes.join(self.roots, "node", "left").select("h1", "h2", "least", F.coalesce("root", "node").alias("root"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        by_set = named.join(least, "root").select("h1", "h2", "component_id")
        got = self.members.join(by_set, ["h1", "h2"], "left")
        own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        known = lambda x: F.when(x != NO_ID, x)
        return got.select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(own).alias("component_id"))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    return NgramJoin(docs, size, percent).labelled()


def op4(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
