"""Regexes to one minimal deterministic automaton over bytes.

Supported: literals, escapes (\\x20, \\., \\-), classes, groups ((...), (?:...), (?i:...)), |, ?, *, +, {m}, {m,}.
"""

from __future__ import annotations

import numpy as np

ALL = frozenset(range(256))


class _Nfa:
    """States with moves on byte sets and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def either(self):
        parts = [self.run()]
        while self.peek() == "|":
            self.take()
            parts.append(self.run())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def run(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("seq", parts)

    def repeat(self):
        item = self.one()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.p.index("}", self.i)
                a, comma, b = self.p[self.i : end].partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
                self.i = end + 1
            item = ("rep", item, low, high)
        return item

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def one(self):
        c = self.peek()
        if c == "(":
            self.take()
            fold = self.fold
            if self.p.startswith("?:", self.i):
                self.i += 2
            elif self.p.startswith("?i:", self.i):
                self.i += 3
                self.fold = True
            inner = self.either()
            assert self.take() == ")"
            self.fold = fold
            return inner
        if c == "[":
            self.take()
            negated = self.peek() == "^"
            self.i += negated
            got: set[int] = set()
            while self.peek() != "]":
                a = self.byte()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    got |= set(range(a, self.byte() + 1))
                else:
                    got.add(a)
            self.take()
            return ("set", frozenset(ALL - got if negated else got))
        b = self.byte()
        both = {b, ord(chr(b).swapcase())} if self.fold and chr(b).isalpha() and b < 128 else {b}
        return ("set", frozenset(both))


def _build(nfa: _Nfa, node, start: int) -> int:
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((node[1], end))
        return end
    if kind == "seq":
        for part in node[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for part in node[1]:
            nfa.empty[_build(nfa, part, start)].append(end)
        return end
    _, item, low, high = node
    for _ in range(low):
        start = _build(nfa, item, start)
    if high is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[_build(nfa, item, loop)].append(loop)
        return loop
    for _ in range(high - low):
        end = _build(nfa, item, start)
        nfa.empty[start].append(end)
        start = end
    return start


class Automaton:
    """`next` (states x byte classes), `byte_class` (256), `accept` (a bit per rule that ends in the state) and `reset`: bytes that lead from every state to the start.

    A match may begin at every byte, or at the first one only (anchored); `alive` is then the rules, as bits, that a state may still end in.
    """

    def __init__(self, rules: list[tuple[str, bool]], anchored: bool = False):
        nfa = _Nfa()
        root = nfa.state()
        ends: dict[int, int] = {}
        for bit, (pattern, fold) in enumerate(rules):
            parser = _Parser(pattern, fold)
            begin = nfa.state()
            nfa.empty[root].append(begin)
            end = _build(nfa, parser.either(), begin)
            assert parser.i == len(pattern), pattern
            ends[end] = ends.get(end, 0) | 1 << bit
        close = self._closures(nfa)
        sets = {s for moves in nfa.moves for s, _ in moves}
        marks: dict[tuple, int] = {}
        byte_class = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)])
        sample = [int(np.flatnonzero(byte_class == k)[0]) for k in range(len(marks))]
        step = [[frozenset().union(*(close[t] for s, t in nfa.moves[q] if b in s)) for b in sample] for q in range(len(nfa.moves))]
        first = frozenset(close[root])
        known, table, todo = {first: 0}, [], [first]
        for state in todo:
            row = []
            for k in range(len(sample)):
                to = frozenset().union(() if anchored else first, *(step[q][k] for q in state))
                if to not in known:
                    known[to] = len(todo)
                    todo.append(to)
                row.append(known[to])
            table.append(row)
        accept = np.array([sum({1 << b for q in s if q in ends for b in range(len(rules)) if ends[q] >> b & 1}) for s in todo], np.int64)
        self._minimise(np.array(table), accept, byte_class)

    @staticmethod
    def _closures(nfa: _Nfa) -> list[frozenset]:
        out = []
        for q in range(len(nfa.moves)):
            seen, todo = {q}, [q]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            out.append(frozenset(seen))
        return out

    def _minimise(self, table: np.ndarray, accept: np.ndarray, byte_class: np.ndarray) -> None:
        """Partition refinement until no group splits."""
        group = np.unique(accept, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        order = np.unique(group, return_index=True)[1]
        start = group[0]
        swap = np.arange(len(order))
        swap[[0, start]] = [start, 0]
        self.next = swap[group[table[order]]][swap].astype(np.int32)
        self.accept = accept[order][swap].astype(np.uint8 if accept.max() < 256 else np.int64)
        self.byte_class = byte_class.astype(np.int32)
        self.reset = np.array([bool((self.next[:, k] == 0).all()) for k in byte_class])
        assert self.accept[0] == 0, "a rule matches the empty text"
        self.alive = self.accept.astype(np.int64)
        while ((more := self.alive | np.bitwise_or.reduce(self.alive[self.next], axis=1)) != self.alive).any():
            self.alive = more

    def run(self, state: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after ranges of bytes, side by side, a byte of each at a time, and all that they accept on the way. Sizes descend."""
        width = self.next.shape[1]
        flat, cls = (self.next * width).ravel().astype(np.int32), self.byte_class[b]
        accept = np.repeat(self.accept.astype(np.int64), width)
        state, got = (state * width).astype(np.int32), np.zeros(len(begin), np.int64)
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else []
        for t in range(int(size[0]) if len(size) else 0):
            k = int(alive[t])
            s = flat[state[:k] + cls[begin[:k] + t]]
            state[:k] = s
            got[:k] |= accept[s]
        return state // width, got

    def run_long(self, b: np.ndarray, step: int = 512) -> int:
        """All that one long text makes the automaton accept: stretches are run from every state at once, then joined, then run from the states that they begin in."""
        n, states = len(b) // step, len(self.next)
        flat = self.next.astype(np.int32)
        rows = self.byte_class[b[: n * step]].reshape(n, step)
        begins, state = np.zeros(n, np.int64), 0
        for lo in range(0, n, 4096):  # bounded: 4096 stretches at once
            part = rows[lo : lo + 4096]
            ends = np.tile(np.arange(states, dtype=np.int32), (len(part), 1))
            for t in range(step):
                ends = flat[ends, part[:, t, None]]
            for i in range(len(part)):
                begins[lo + i] = state
                state = int(ends[i, state])
        _, got = self.run(begins, b, np.arange(n) * step, np.full(n, step))
        rest = len(b) - n * step
        _, last = self.run(np.array([state]), b, np.array([n * step]), np.array([rest]))
        return int(np.bitwise_or.reduce(got) | last[0]) if n else int(last[0])
