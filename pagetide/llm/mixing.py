"""Language-model scores by logistic context mixing, and a unigram base.

A text is coded byte by byte and bit by bit, with 0xFF (no byte of UTF-8) as its end and
before its start. Six predictors, with contexts of 0 to 5 bytes, know how often each byte followed their
context, and so how often the next bit was 0 and 1 after the bits so far. The logits of the
six are mixed by weights that a gate picks (the longest context seen before, how often it was, the bit's
place). The mixed probability is refined by a second estimate: an interpolated table, by the longest context and the
bits so far, of what really came where the mixer said so much; both are averaged, and
the probabilities of all bits multiply to that of the text.

All that a predictor knows of a byte follows from the *event*, the byte and the five before it. Distinct events with their counts over all
training texts are kept in hash buckets by the three bytes before the byte, so that the counts of the contexts of three to five
bytes are exact and lie in one bucket; they grow with the corpus and are never on the driver. Contexts of up to
two bytes cross buckets: their counts are added up over the corpus and shipped, at most 2^24 of them.

Learning is online: events are dealt by hash to ranges, as many as the size of the texts asks for; each range
runs through its events in batches, every event predicted without itself, weighted by its count, and corrects the gates'
weights by gradient steps that adapt to the gradients seen (Adagrad). The ranges' weights are averaged by the bits that each gate saw, the
refinement's counts are added. Ranges, their order and what they hold depend on the texts alone, so scores don't depend on partitions. Chunks then ask
the buckets for the probabilities of their distinct events: each event is mixed once, however many texts hold it.

The base takes lower-cased words and one end a text: sum of log10((c + 1) / (N + V + 1)).

Null texts are empty: an end only. Rows without doc_id are held out. Repeated rows count each time. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NO_ID, SECOND, Chunk, Chunks, answer_batch, answers_of, by_bucket, written
from .textops import U64, hash_words, mix, padded, words

ORDERS = 6
#: Bytes of text for each learner, events that are mixed side by side, and events of one step of learning.
LEARN_BYTES, SHELF, STEP = 8 << 20, 1 << 16, 1024
#: Ranges of low-order counts that are added up in one place.
LOW_PARTS = 64
#: Gates: the longest context, how often it was seen (once, twice, 4 and 16 times), the bit's place.
SEEN = 4
GATES = ORDERS * SEEN * 8
#: The refinement: cells of logits from -8 to 8 for each longest context and place in the byte's tree, and how many bits a cell's own logit is worth.
CELLS, PRIOR = 33, 16.0
TREES = ORDERS * 256
_LOG_BIAS = 0.3
_24 = U64((1 << 24) - 1)
_ODD24 = 0x9E3779
_INV24 = pow(_ODD24, -1, 1 << 24)
END_WORD = U64(0xE4D0E4D0E4D0E4D0)


def to_key(code: np.ndarray) -> np.ndarray:
    """The three bytes before the byte, scattered, then the two before these, the nearer first, then the byte; 16 bits are free."""
    three = ((code >> U64(8) & _24) * U64(_ODD24)) & _24
    three ^= three >> U64(12)
    return three << U64(40) | (code >> U64(32) & U64(255)) << U64(32) | (code >> U64(40)) << U64(24) | (code & U64(255)) << U64(16)


def three_before(key: np.ndarray) -> np.ndarray:
    three = key >> U64(40)
    three = three ^ three >> U64(12)
    return (three * U64(_INV24)) & _24


def events(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six bytes for each byte and end of the texts, and the text of each."""
    n, gap = len(off) - 1, ORDERS - 1
    size = np.diff(off)
    s = np.full(len(raw) + gap * (n + 1), 0xFF, np.uint8)
    row = np.repeat(np.arange(n), size)
    s[np.arange(len(raw)) + gap * (row + 1)] = raw
    two = s[:-1].astype(np.uint16) << np.uint16(8) | s[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    code = four[:-2].astype(U64) << U64(16) | two[4:]
    both = np.repeat(np.arange(n), size + 1)
    at = np.arange(len(both)) + (gap - 1) * both
    return code[at], both


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([i == NO_ID or zlib.crc32(str(i).encode()) % 7 == 2 for i in ids.tolist()], bool)


def _bytes4(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint32)[:, None].view(np.uint8).reshape(-1, 4)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n[order], at)


class _Events:
    """A chunk's distinct events as sorted keys, the rows that each came from and how many of these are learnt from."""

    def __init__(self, c: Chunk):
        code, row = events(c.raw, c.off)
        both = np.sort(to_key(code) | row.astype(U64))  # rows of a chunk fit 16 bits
        self.key, self.row = both >> U64(16) << U64(16), (both & U64(0xFFFF)).astype(np.int64)
        new = np.concatenate([[True], self.key[1:] != self.key[:-1]]) if len(both) else np.zeros(0, bool)
        self.at, self.which = np.flatnonzero(new), np.cumsum(new) - 1
        self.keys = self.key[self.at]

    def learnt(self, out: np.ndarray) -> np.ndarray:
        return np.add.reduceat((~out)[self.row].astype(np.int64), self.at) if len(self.at) else self.at


def _ask_learnt(c: Chunk):
    e = _Events(c)
    n = e.learnt(held_out(c.ids))
    return e.keys[n > 0], _bytes4(n[n > 0])


def _ask_all(c: Chunk):
    e = _Events(c)
    return e.keys, _bytes4(e.learnt(held_out(c.ids)))


def _counts(got: list) -> np.ndarray:
    return np.concatenate([x.view(np.uint32).ravel() for _, _, x in got]).astype(np.int64)


def shelves(keys: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of about `most` sorted keys that share no three bytes before the byte."""
    edge = np.concatenate([[0], np.flatnonzero(keys[1:] >> U64(40) != keys[:-1] >> U64(40)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(keys):
        hi = int(edge[max(np.searchsorted(edge, lo + most, side="right") - 1, np.searchsorted(edge, lo, side="right"))])
        yield slice(lo, hi)
        lo = hi


class _SettleLearnt:
    """The bucket's distinct events, cut where learners' ranges meet: range, the first key as its place, keys and counts."""

    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, label: int, got: list):
        keys, n = _added(np.concatenate([k for _, k, _ in got]), _counts(got))
        of = (keys >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(keys)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for part in shelves(keys[lo:hi], 1 << 18):
                k, m = keys[lo:hi][part], n[lo:hi][part]
                yield pa.RecordBatch.from_arrays([pa.array([int(of[lo])], pa.int32()), pa.array([int(k[0] >> U64(16))], pa.int64()), pa.array([k.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["range", "place", "keys", "n"])


LEARNT = "range int, place long, keys binary, n binary"


def branches(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sorted distinct keys (context, then byte): how many events of the context share the byte's first 0 to 8 bits."""
    out = np.empty((9, len(keys)), np.int64)
    out[8] = n
    for bit in range(8):
        p = keys >> U64(8 - bit)
        at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        out[bit] = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(p))))
    return out


class Low:
    """Counts of each byte after contexts of two, one and no bytes, over the whole corpus."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.tables = []
        for bits in (24, 16, 8):
            k, m = _added(keys & U64((1 << bits) - 1), n)
            self.tables.append((bits, k, np.concatenate([[0], np.cumsum(m)])))

    def branches(self, event: np.ndarray) -> Iterator[np.ndarray]:
        """The same as branches() for any events (three bytes: two before, and the byte), by order from 0."""
        for bits, keys, sums in reversed(self.tables):
            mine, back = np.unique(event & U64((1 << bits) - 1), return_inverse=True)
            out = np.empty((9, len(mine)), np.int64)
            for bit in range(9):
                first = mine >> U64(8 - bit) << U64(8 - bit)
                out[bit] = sums[np.searchsorted(keys, first + U64(1 << (8 - bit)))] - sums[np.searchsorted(keys, first)]
            yield out[:, back.ravel()]


def _low_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, U64), np.zeros(0, np.int64)
    for batch in batches:
        for body, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = np.frombuffer(body, U64)
            k, m = _added((three_before(key) & U64(0xFFFF)) << U64(8) | key >> U64(16) & U64(255), np.frombuffer(count, np.int64))
            keys, n = _added(np.concatenate([keys, k]), np.concatenate([n, m]))
    yield from _low_rows(keys, n)


def _low_rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    edges = np.searchsorted(keys, np.arange(LOW_PARTS + 1, dtype=U64) << U64(18))
    for part in np.flatnonzero(np.diff(edges)).tolist():
        mine = slice(edges[part], edges[part + 1])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([keys[mine].tobytes()], pa.binary()), pa.array([n[mine].tobytes()], pa.binary())], names=["bucket", "keys", "n"])


def _add_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = np.zeros(0, U64), np.zeros(0, np.int64)
    for batch in batches:
        for body, count in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keys, n = _added(np.concatenate([keys, np.frombuffer(body, U64)]), np.concatenate([n, np.frombuffer(count, np.int64)]))
    yield from _low_rows(keys, n)


class Inputs:
    """What the predictors say of events of one shelf: logits (order, bit, event) of a 1, the gate, the place in the refinement's tables and the bits."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: Low, spare: int):
        byte = keys >> U64(16) & U64(255)
        tables = list(low.branches((three_before(keys) & U64(0xFFFF)) << U64(8) | byte))
        for back in (32, 24):  # of three and four bytes, which other events share
            k, i = np.unique((keys >> U64(back + 8)) << U64(8) | byte, return_inverse=True)
            tables.append(branches(k, np.bincount(i.ravel(), weights=n, minlength=len(k)).astype(np.int64))[:, i.ravel()])
        tables.append(branches(keys >> U64(16), n))
        seen = np.stack([t[0] for t in tables]) - spare
        longest = ORDERS - 1 - np.argmax(seen[::-1] > 0, axis=0)
        longest[seen[0] <= 0] = 0
        often = np.searchsorted([2, 4, 16], seen[longest, np.arange(len(keys))], side="right")
        self.gate = (longest * SEEN + often) * 8
        self.on = (byte[None, :] >> np.arange(7, -1, -1, dtype=U64)[:, None] & U64(1)).astype(bool)
        node = (U64(1) << np.arange(8, dtype=U64))[:, None] | byte[None, :] >> np.arange(8, 0, -1, dtype=U64)[:, None]
        self.tree = longest * 256 + node.astype(np.int64)
        x = np.empty((8, ORDERS + 1, len(keys)), np.float32)
        x[:, ORDERS] = _LOG_BIAS
        for order, t in enumerate(tables):
            same = np.log(np.maximum(t[1:] - spare, 0) + 0.3)
            other = np.log(t[:-1] - t[1:] + 0.3)
            x[:, order] = np.where(self.on, same - other, other - same)
        self.x = x


def _cell(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.clip((z + 8) * ((CELLS - 1) / 16), 0, CELLS - 1.001)
    low = at.astype(np.int64)
    return low, at - low


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Mixer:
    """Weights of the gates, and the refinement's counts of ones and of all bits in each cell."""

    def __init__(self, low: Low, weights: np.ndarray, ones: np.ndarray, seen: np.ndarray):
        self.low, self.weights = low, weights.astype(np.float32)
        first = _squash(np.linspace(-8, 8, CELLS))
        self.table = (ones + PRIOR * first) / (seen + PRIOR)

    def log2(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The binary logarithm of each event's last byte; events (sorted distinct keys) with their training counts, whole shelves."""
        out = np.zeros(len(keys))
        for part in shelves(keys, SHELF):
            i = Inputs(keys[part], n[part], self.low, 0)
            for bit in range(8):
                z = np.clip((i.x[bit] * self.weights[i.gate + bit].T).sum(axis=0), -12, 12)
                low, far = _cell(z)
                row = self.table[i.tree[bit]]
                at = np.arange(len(z))
                p = (_squash(z) + row[at, low] * (1 - far) + row[at, low + 1] * far) / 2
                out[part] += np.log2(np.where(i.on[bit], p, 1 - p))
        return out


class _Learn:
    """The online pass of each range. What leaves a task are sums over its ranges, in parts: weights times the bits that each gate
    saw, these bits, and the refinement's ones and bits. All are multiples of 1/1024, so their sums are exact in any order."""

    def __init__(self, low, rate: float = 0.05):
        self.low, self.rate = low, rate

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GATES * (ORDERS + 2) + 2 * TREES * CELLS,))
        some = False
        for _, parts in by_bucket(batches):
            got = [r for part in parts for r in part.to_pylist()]
            got.sort(key=lambda r: r["place"])
            keys, n = (np.concatenate([np.frombuffer(r[c], t) for r in got]) for c, t in (("keys", U64), ("n", np.int64)))
            total += np.round(self.learn(keys, n) * 1024) / 1024
            some = True
        if some:
            for part, sums in enumerate(np.array_split(total, LOW_PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["bucket", "sums"])

    def learn(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        w, low = first_weights(), self.low.value
        grads, mass = np.full((GATES, ORDERS + 1), 1e-3), np.zeros(GATES)
        ones, seen = np.zeros(TREES * CELLS), np.zeros(TREES * CELLS)
        for part in shelves(keys, SHELF):
            i, m = Inputs(keys[part], n[part], low, 1), n[part].astype(float)
            order = np.argsort(mix(keys[part]))
            said = np.empty((8, len(m)))
            for lo in range(0, len(m), STEP):
                pick = order[lo : lo + STEP]
                for bit in range(8):
                    x, gate = i.x[bit][:, pick], i.gate[pick] + bit
                    z = np.clip((x * w[gate].T).sum(axis=0), -12, 12)
                    said[bit, pick] = z
                    err = (i.on[bit, pick] - _squash(z)) * m[pick]
                    here = np.bincount(gate, weights=m[pick], minlength=GATES)
                    g = np.stack([np.bincount(gate, weights=err * x[k], minlength=GATES) for k in range(ORDERS + 1)], axis=1) / np.maximum(here, 1)[:, None]
                    grads += g * g
                    w += self.rate * g / np.sqrt(grads)
                    mass += here
            for bit in range(8):
                cell, far = _cell(said[bit])
                for at, share in ((cell, 1 - far), (cell + 1, far)):
                    place = i.tree[bit] * CELLS + at
                    seen += np.bincount(place, weights=share * m, minlength=len(seen))
                    ones += np.bincount(place, weights=share * m * i.on[bit], minlength=len(ones))
        return np.concatenate([(w * mass[:, None]).ravel(), mass, ones, seen])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(body)
    for part, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["bucket", "sums"])


def first_weights() -> np.ndarray:
    w = np.zeros((GATES, ORDERS + 1))
    w[:, :ORDERS] = 0.25
    w[np.arange(GATES), np.arange(GATES) // (8 * SEEN)] = 0.6
    return w


class _SettleScores:
    """The upper three bytes of the probability's logarithm, as a float, for each event of each chunk."""

    def __init__(self, mixer):
        self.mixer = mixer

    def __call__(self, label: int, got: list):
        keys = np.concatenate([k for _, k, _ in got])
        distinct, n = _added(keys, _counts(got))
        logs = self.mixer.value.log2(distinct, n).astype(np.float32)
        near = (logs.view(np.uint32) + np.uint32(128)).view(np.uint8).reshape(-1, 4)
        answers = [np.ascontiguousarray(near[np.searchsorted(distinct, k)][:, 1:].T).tobytes() for _, k, _ in got]
        yield answer_batch(label, [c for c, _, _ in got], answers)


class _Words:
    """A chunk's words and ends: distinct keys with counts."""

    def __init__(self, c: Chunk):
        b = padded(c.raw, lower=True)
        start, end, first = words(c.raw, c.off)
        n = len(c.ids)
        self.key = np.concatenate([hash_words(b, start, end), np.full(n, END_WORD)])
        self.row = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.arange(n)])
        self.keys, self.which = np.unique(self.key, return_inverse=True)


def _ask_words(c: Chunk):
    w = _Words(c)
    n = np.bincount(w.which[~held_out(c.ids)[w.row]], minlength=len(w.keys))
    return w.keys, _bytes4(n)


def _settle_words(label: int, got: list):
    """Four bytes of count for each key, plane by plane, and in a row of its own (chunk -1) this bucket's tokens and distinct tokens."""
    keys, n = np.concatenate([k for _, k, _ in got]), np.concatenate([x.view(np.uint32).ravel() for _, _, x in got]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.add.reduceat(n[order], at)
    back = np.empty(len(keys), np.uint64)
    back[order] = np.repeat(total, np.diff(np.append(at, len(s)))).astype(np.uint64)
    lo, answers = 0, []
    for _, k, _ in got:
        answers.append(np.ascontiguousarray(back[lo : lo + len(k)].view(np.uint8).reshape(-1, 8).T[:6]).tobytes())
        lo += len(k)
    yield answer_batch(label, [c for c, _, _ in got] + [-1], [*answers, np.array([total.sum(), (total > 0).sum()]).tobytes()])


class _Score:
    def __init__(self, tokens: int, distinct: int, parts: int, labels: np.ndarray):
        self.tokens, self.distinct, self.parts, self.labels = tokens, distinct, parts, labels

    def __call__(self, c: Chunk) -> pa.RecordBatch:
        n = len(c.ids)
        w, e = _Words(c), _Events(c)
        count, near = np.zeros((len(w.keys), 8), np.uint8), np.zeros((len(e.keys), 4), np.uint8)
        for lo, hi, a in answers_of(c, w.keys, self.parts, self.labels):
            count[lo:hi, :6] = a.reshape(6, -1).T
        for lo, hi, a in answers_of(c, e.keys, self.parts, self.labels, second=True, whole=24):
            near[lo:hi, 1:] = a.reshape(3, -1).T
        count = count.view(np.int64).ravel()
        logs = np.log10(count + 1.0) - np.log10(self.tokens + self.distinct + 1.0)
        tokens = np.bincount(w.row, minlength=n)
        base = np.bincount(w.row, weights=logs[w.which], minlength=n)
        known = np.bincount(w.row, weights=(count > 0)[w.which], minlength=n).astype(np.int64)
        bits = -np.bincount(e.row, weights=near.view(np.float32).ravel().astype(float)[e.which], minlength=n)
        cols = [c.doc_ids(), pa.array(held_out(c.ids)), pa.array(tokens, pa.int64()), pa.array(known), pa.array(np.full(n, self.tokens, np.int64)), pa.array(base), pa.array(-bits * np.log10(2)), pa.array(bits / np.maximum(np.diff(c.off), 1))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])


def learnt_mixer(chunks: Chunks) -> Mixer:
    """A model of the chunks' training texts; what it holds on the driver is bounded by LOW and the gates and cells."""
    bits = max(0, min(20, int(np.ceil(np.log2(max(1, chunks.size / LEARN_BYTES))))))
    seen = written(chunks.ask(_ask_learnt, _SettleLearnt(bits), out=LEARNT, whole=24, squeeze=True))
    low = seen.select("keys", "n").mapInArrow(_low_of, "bucket int, keys binary, n binary").repartition(LOW_PARTS, "bucket").mapInArrow(_add_low, "bucket int, keys binary, n binary")
    keys, n = np.zeros(0, U64), np.zeros(0, np.int64)
    for r in low.toLocalIterator():  # at most 2^24 counts, whatever the corpus
        keys, n = np.concatenate([keys, np.frombuffer(r["keys"], U64)]), np.concatenate([n, np.frombuffer(r["n"], np.int64)])
    table = Low(*_added(keys, n))
    shared = chunks.spark.sparkContext.broadcast(table)
    parts = seen.repartition(chunks.parts, "range").sortWithinPartitions("range", "place").mapInArrow(_Learn(shared), "bucket int, sums binary")
    rows = parts.repartition(LOW_PARTS, "bucket").mapInArrow(_sum_parts, "bucket int, sums binary").collect()  # one row a part
    if not rows:
        return Mixer(table, first_weights(), np.zeros((TREES, CELLS)), np.zeros((TREES, CELLS)))
    sums = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["bucket"])])
    weights, mass, ones, all_ = np.split(sums, np.cumsum([GATES * (ORDERS + 1), GATES, TREES * CELLS]))
    weights, mass = weights.reshape(GATES, -1), mass[:, None]
    weights = np.where(mass > 0, weights / np.maximum(mass, 1), first_weights())
    return Mixer(table, weights, ones.reshape(TREES, CELLS), all_.reshape(TREES, CELLS))


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row of docs (doc_id, text)."""
    chunks = Chunks(docs)
    mixer = chunks.spark.sparkContext.broadcast(learnt_mixer(chunks))
    said = written(chunks.ask(_ask_words, _settle_words))
    sums = [np.frombuffer(r["answer"], np.int64) for r in said.where("chunk = -1").select("answer").toLocalIterator()]
    tokens, distinct = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0)
    logs = chunks.ask(_ask_all, _SettleScores(mixer), whole=24, squeeze=True).withColumn("bucket", F.col("bucket") + SECOND)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return chunks.finish(said.where("chunk >= 0").unionByName(logs), _Score(tokens, distinct, chunks.buckets, chunks.labels), schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
