"""Secret scan by one combined deterministic automaton.

All rules are compiled into one minimal automaton (see automaton). Texts are cut at
bytes that lead from every state back to the start, which no match can hold;
the pieces then run through the transition arrays side by side, a byte of each at a
time, so each byte is read once for all rules. That pass says which rules may match in which piece. A second
automaton, of the same rules in full and anchored, then reads the exact spans of these few pieces from its arrays: from each place where
a rule may begin it runs to where the rule can go no further, and the last accepting place ends the match; the next is sought from there. A long piece is
run in stretches from all states at once, and a state that a byte leads back to itself is left by one search.

Spans are code points, end exclusive. Null texts are empty; every input row gives one
row; rows without doc_id, repeated rows and other columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton
from .textops import slices, text_buffers

_KEYWORD = "(password|passwd|secret|token|api_?key)"
#: Kind, what the first pass detects (how each match begins, as far as counting on only multiplies states), the rule in full, the group that has a least length, that length. The first three are the base.
#: Group 0 is the whole match; group 2 ends with it and begins at the byte that first completes the rule.
RULES = [
    ("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]{3}""", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{4}", rb"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16}", rb"[0-9a-f]+", 0, 16),
    ("github", r"gh[opsru]_[A-Za-z0-9]{4}", rb"gh[opsru]_[A-Za-z0-9]+", 0, 24),
    ("slack", r"xox[abprs]\-[A-Za-z0-9\-]{2}", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("pem", r"\-\-\-\-\-BEGIN [A-Z ]*PRIVATE KEY\-\-\-\-\-", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
BASE = 3
SLICE = 4 << 20
#: A longer piece is run in stretches.
LONG = 8192
_COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


class Scanner:
    def __init__(self):
        self.dfa = Automaton([(detect, kind == "assign") for kind, detect, *_ in RULES])
        self.full = Automaton([(rule.decode(), False) for _, _, rule, _, _ in RULES], anchored=True)

    def pieces(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and accepting rules (bits) of each piece that reaches any."""
        n = len(b)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        hard = self.dfa.reset[b]
        soft = ~hard
        begin = np.flatnonzero(soft & (edge[:-1] | np.concatenate([[True], hard[:-1]])))
        if not len(begin):
            return begin, begin, begin
        end = np.flatnonzero(soft & (edge[1:] | np.concatenate([hard[1:], [True]]))) + 1
        order = np.argsort(begin - end, kind="stable")
        begin, end = begin[order], end[order]
        long = int(np.searchsorted(begin - end, -LONG))
        _, got = self.dfa.run(np.zeros(len(begin) - long, np.int64), b, begin[long:], (end - begin)[long:])
        got = np.concatenate([np.array([self.dfa.run_long(b[x:y]) for x, y in zip(begin[:long], end[:long], strict=True)], np.int64), got])
        hit = np.flatnonzero(got)
        hit = hit[np.argsort(begin[hit])]
        return begin[hit], end[hit], got[hit]

    def matches(self, text: np.ndarray, kind: int) -> list[tuple[int, int]]:
        """The leftmost matches of a rule in a piece, none overlapping, whose group is as long as it must be."""
        step, accept, alive, cls = self.full.next, self.full.accept >> kind & 1, self.full.alive >> kind & 1, self.full.byte_class[text]
        group, least = RULES[kind][3:]
        begins = np.flatnonzero(alive[step[0, cls]])
        loops: dict[int, np.ndarray] = {}
        kinds, n, out, at, k = cls.tolist(), len(text), [], 0, 0
        while (k := k + int(np.searchsorted(begins[k:], at))) < len(begins):
            begin = i = int(begins[k])
            state, first, last = 0, -1, -1
            while i < n:
                new = int(step[state, kinds[i]])
                if not alive[new]:
                    break
                i += 1
                if new == state and i < n and kinds[i] == kinds[i - 1]:  # a run of bytes that lead back here
                    if new not in loops:
                        loops[new] = np.flatnonzero(step[new, cls] != new)
                    j = int(np.searchsorted(loops[new], i))
                    i = int(loops[new][j]) if j < len(loops[new]) else n
                state = new
                if accept[state]:
                    first, last = (i if first < 0 else first), i
            if last < 0:
                at = begin + 1
                continue
            if last - (first - 1 if group else begin) >= least:
                out.append((begin, last))
            at = last
        return out

    def spans(self, b: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each document with any: (start, kind, end) in bytes."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        begin, end, rules = self.pieces(b, off)
        doc = np.searchsorted(off, begin, side="right") - 1
        for a, e, bits, d in zip(begin.tolist(), end.tolist(), rules.tolist(), doc.tolist(), strict=True):
            for kind in range(len(RULES)):
                if bits >> kind & 1 and (found := self.matches(b[a:e], kind)):
                    out.setdefault(d, []).extend((a + x, kind, a + y) for x, y in found)
        return out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, shas, spans = np.zeros((BASE, n), np.int64), [empty] * n, [""] * n
            text, off = text_buffers(batch.column(1))
            for lo, hi in slices(off, SLICE):
                b = text[off[lo] : off[hi]]
                for d, found in self.spans(b, off[lo : hi + 1] - off[lo]).items():
                    at = int(off[lo + d] - off[lo])
                    points = np.concatenate([[0], np.cumsum((b[at : int(off[lo + d + 1] - off[lo])] & 0xC0) != 0x80)])
                    names = [(k, f"{RULES[k][0]}:{points[s - at]}:{points[e - at]}") for s, k, e in sorted(found)]
                    for k, _ in names:
                        if k < BASE:
                            counts[k, lo + d] += 1
                    shas[lo + d] = hashlib.sha256(",".join(x for k, x in names if k < BASE).encode()).hexdigest()
                    spans[lo + d] = ",".join(x for _, x in names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=_COLUMNS)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs (doc_id, text)."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.mapInArrow(Scanner(), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
