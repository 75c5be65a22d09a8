"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is encoded as a space (the dummy prefix) and itself; the whitespace
marker U+2581 of a piece is a space. Among all ways to write the text as pieces,
the one with the largest sum of scores is taken; of equal ones, by the longest last piece.
A character that is no piece itself may be given as its UTF-8 bytes (byte pieces), at
the least score minus ten. Pieces hold a marker only in front, so the
best way of a text is those of its words one after another, and each distinct word of a slice of
texts is solved once; all of them side by side, a byte at a time.

Decoding writes the pieces' bytes, markers as spaces, and takes the dummy prefix off; it gives back every text. A U+2581 in a
text is given as bytes, so that it isn't taken for a space.

Null and empty texts have no pieces. Each row gives one row; rows without doc_id and repeated rows change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import hash_words, padded, slices, text_buffers

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 4 << 20


def read_model(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The pieces' bytes (empty for control pieces), their scores and the ids of the 256 byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, of_byte = [], np.full(256, -1, np.int32)
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            of_byte[int(p[1:-1], 16)] = i
        plain = not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
        texts.append(p.replace(MARK, " ").encode() if plain else b"")
    return texts, np.array([m.get_score(i) for i in range(len(texts))]), of_byte


class DoubleArray:
    """A trie in two arrays: the child of node s by byte c is t = base[s] + c + 1, if check[t] is s. piece[s] ends at s, or -1."""

    def __init__(self, texts: list[bytes]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, text in enumerate(texts):
            node = 0
            for c in text:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            if text and node not in ends:
                ends[node] = i
        size = 2 * len(tree) + 1024
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, low, dense = {0: 0}, 257, 257
        for node, kids in enumerate(tree):  # a parent comes before its children
            if not kids:
                continue
            codes = [c + 1 for c in sorted(kids)]
            while used[low]:
                low += 1
            at, tries = max((low if len(codes) == 1 else dense) - codes[0], 0), 0
            while any(used[at + c] for c in codes):
                at, tries = at + 1, tries + 1
                if at + 258 > len(used):
                    used += bytes(size)
            if at + 258 > len(base):
                base, check, piece = np.append(base, np.zeros(size, np.int32)), np.append(check, np.full(size, -1, np.int32)), np.append(piece, np.full(size, -1, np.int32))
                used += bytes(max(0, len(base) - len(used)))
            if tries > 64:
                dense = at + codes[0]  # what lies before is left to nodes of one child
            s = place[node]
            base[s] = at
            for c in sorted(kids):
                used[at + c + 1], check[at + c + 1], place[kids[c]] = 1, s, at + c + 1
        for node, i in ends.items():
            piece[place[node]] = i
        self.base, self.check, self.piece = base, np.append(check, np.full(260, -1, np.int32)), piece


#: Longer words are solved alone, WINDOW places at a time.
LONG_WORD, WINDOW = 1024, 1 << 16
_WIDTH = np.ones(256, np.int64)
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4


class Pieces:
    def __init__(self, model: str = MODEL):
        self.texts, self.scores, self.of_byte = read_model(model)
        if any(b" " in t.lstrip(b" ") for t in self.texts):
            raise ValueError("a piece holds a marker that is not in front")
        self.trie = DoubleArray(self.texts)
        self.unknown = min([self.scores[i] for i, t in enumerate(self.texts) if t], default=0.0) - 10
        self.longest = max(map(len, self.texts))
        self.cut_lines = not any(b"\n" in t for t in self.texts)
        out = [t if t else b"" for t in self.texts]
        for b, i in enumerate(self.of_byte):
            out[i] = bytes([b])
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(t) for t in out])
        self.out_at = np.cumsum(self.out_size) - self.out_size

    def words(self, b: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where to cut: before the spaces that precede a word, around line ends and at texts' edges."""
        space = b == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        if self.cut_lines:
            line = b == 0x0A
            cut |= line
            cut[1:] |= line[:-1]
        cut[edge] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(b))

    def solve(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best pieces of each byte range, flat, and where each range's begin. Byte pieces are listed one by one."""
        long = end - start > LONG_WORD
        short = np.flatnonzero(~long)
        ids, at = self._side_by_side(b, start[short], end[short])
        if not long.any():
            return ids, at
        size = np.zeros(len(start), np.int64)
        size[short] = np.diff(at)
        alone = {int(i): self._alone(b, int(start[i]), int(end[i])) for i in np.flatnonzero(long)}
        for i, x in alone.items():
            size[i] = len(x)
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(begin[-1], np.int32)
        out[np.arange(len(ids)) + np.repeat(begin[short] - at[:-1], np.diff(at))] = ids
        for i, x in alone.items():
            out[begin[i] : begin[i + 1]] = x
        return out, begin

    def _alone(self, b: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The best pieces of one long range: the trie is walked from WINDOW places side by side, then the paths are relaxed in order of their places."""
        n, trie, width = hi - lo, self.trie, _WIDTH
        best, origin, took = [-np.inf] * (n + 1), np.zeros(n + 1, np.int64), np.full(n + 1, -2, np.int32)
        best[0] = 0.0
        for w in range(0, n, WINDOW):
            live = np.arange(w, min(n, w + WINDOW))
            node, single, found = np.zeros(len(live), np.int32), np.zeros(len(live), bool), []
            for k in range(self.longest):
                ok = live + k < n
                live, node = live[ok], node[ok]
                if not len(live):
                    break
                child = trie.base[node] + b[lo + live + k] + 1
                ok = trie.check[child] == node
                live, node = live[ok], child[ok]
                piece = trie.piece[node]
                ends = np.flatnonzero(piece >= 0)
                who = live[ends]
                single[who - w] |= width[b[lo + who]] == k + 1
                found.append((who, who + k + 1, self.scores[piece[ends]], piece[ends]))
            who = w + np.flatnonzero(~single)
            found.append((who, np.minimum(who + width[b[lo + who]], n), np.full(len(who), self.unknown), np.full(len(who), -1)))
            who, to, score, piece = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(who, kind="stable")
            for i, j, x, p in zip(who[order].tolist(), to[order].tolist(), score[order].tolist(), piece[order].tolist(), strict=True):
                x += best[i]
                if x > best[j]:
                    best[j], origin[j], took[j] = x, i, p
        out, at = [], n
        while at:
            before = int(origin[at])
            out.append(int(took[at])) if took[at] >= 0 else out.extend(self.of_byte[b[lo + before : lo + at]][::-1].tolist())
            at = before
        return np.array(out[::-1], np.int32)

    def _side_by_side(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        order = np.argsort(-size, kind="stable")
        size = size[order]
        at = np.concatenate([[0], np.cumsum(size + 1)])
        flat = at[:-1]
        best = np.full(at[-1], -np.inf)
        best[flat] = 0
        origin, took = np.zeros(at[-1], np.int64), np.full(at[-1], -2, np.int32)
        text = start[order]
        trie = self.trie
        width = _WIDTH
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for t in range(len(alive)):
            k = np.flatnonzero(best[flat[: alive[t]] + t] > -np.inf)
            if not len(k):
                continue
            here, score = flat[k] + t, best[flat[k] + t]
            char = width[b[text[k] + t]]
            single = np.zeros(len(k), bool)
            live, node = np.arange(len(k)), np.zeros(len(k), np.int32)
            for n in range(self.longest):
                ok = t + n < size[k[live]]
                live, node = live[ok], node[ok]
                if not len(live):
                    break
                child = trie.base[node] + b[text[k[live]] + t + n] + 1
                ok = trie.check[child] == node
                live, node = live[ok], child[ok]
                piece = trie.piece[node]
                ends = np.flatnonzero(piece >= 0)
                if len(ends):
                    who, p = live[ends], piece[ends]
                    single[who] |= char[who] == n + 1
                    to, value = here[who] + n + 1, score[who] + self.scores[p]
                    better = value > best[to]
                    to, who = to[better], who[better]
                    best[to], origin[to], took[to] = value[better], here[who], p[better]
            lone = np.flatnonzero(~single)
            if len(lone):
                to, value = here[lone] + char[lone], score[lone] + self.unknown
                better = value > best[to]
                to = to[better]
                best[to], origin[to], took[to] = value[better], here[lone[better]], -1
        return self._trace(b, text, flat, size, order, origin, took)

    def _trace(self, b, text, flat, size, order, origin, took):
        who, cur = np.arange(len(size)), flat + size
        rows, ids = [], []
        step = 0
        while len(who):
            live = cur > flat[who]
            who, cur = who[live], cur[live]
            if not len(who):
                break
            prev, p = origin[cur], took[cur]
            plain = p >= 0
            rows.append(np.stack([who[plain], np.full(plain.sum(), step)]))
            ids.append(p[plain])
            raw, back = who[~plain], cur[~plain]
            for j in range(4):  # a character's bytes, the last first
                on = back - 1 - j >= prev[~plain]
                w, pos = raw[on], (back - 1 - j)[on]
                rows.append(np.stack([w, np.full(len(w), step + j)]))
                ids.append(self.of_byte[b[text[w] + pos - flat[w]]])
            step += 4
            cur = prev
        if not rows:
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
        r, i = np.concatenate(rows, axis=1), np.concatenate(ids)
        rank = order[r[0]]
        i = i[np.lexsort((-r[1], rank))]
        return i.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(size)))])

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, and where each text's begin."""
        full = np.flatnonzero(np.diff(off))
        n = len(off) - 1
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        edge = off[full] + np.arange(len(full))
        body = np.insert(b[: off[-1]], off[full], 0x20)
        start, end = self.words(body, edge)
        text = padded(body)
        _, first, which = np.unique(hash_words(text, start, end), return_index=True, return_inverse=True)
        ids, begin = self.solve(text, start[first], end[first])
        size = np.diff(begin)[which]
        to = np.cumsum(size)
        flat = ids[np.arange(to[-1]) - np.repeat(to - size - begin[which], size)]
        before = np.concatenate([[0], to])
        out = np.zeros(n + 1, np.int64)
        out[full + 1] = np.diff(np.append(before[np.searchsorted(start, edge)], to[-1]))
        return flat, np.cumsum(out)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and where each begins."""
        size = self.out_size[ids]
        to = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
        b = self.out[np.arange(to[-1]) - np.repeat(to - size - self.out_at[ids], size)]
        begin = np.concatenate([[0], to])[off]
        full = np.flatnonzero(np.diff(begin))
        b = np.delete(b, begin[full])
        return b, begin - np.concatenate([[0], np.cumsum(np.diff(begin) > 0)])


class _Encode:
    def __init__(self, pieces: Pieces, real: bool):
        self.pieces, self.real = pieces, real

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = self.pieces
        for batch in batches:
            text, off = text_buffers(batch.column(1))
            for lo, hi in slices(off, SLICE):
                b, o = text[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                ids, at = p.encode(b, o)
                back, to = p.decode(ids, at)
                whole = len(back) == len(b) and bool((back == b).all()) and bool((to == o).all())
                same = [whole or np.array_equal(back[to[i] : to[i + 1]], b[o[i] : o[i + 1]]) for i in range(hi - lo)]
                raw = np.concatenate([[0], np.cumsum(np.isin(ids, p.of_byte))])[at]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(np.diff(raw), pa.int64()), pa.array([hashlib.sha256(memoryview(ids)[at[i] : at[i + 1]]).hexdigest() for i in range(hi - lo)], pa.string()), pa.array([hashlib.sha256(memoryview(back)[to[i] : to[i + 1]]).hexdigest() for i in range(hi - lo)], pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip"]
                if self.real:
                    cols += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array([back[to[i] : to[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()).cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)


def encode_pieces(docs: DataFrame, model: str = MODEL, real: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte pieces), digests of ids (32 bits each, little-endian) and decoded text, round_trip; with real also ids and decoded."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>, decoded string" * real
    return d.mapInArrow(_Encode(Pieces(model), real), schema)


def op7(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), real=False)
