"""Byte automata: a small regular-expression reader, subset construction, minimisation, transition arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))


class _Nfa:
    """Thompson automaton: ``moves[s]`` are (byte set, state), ``free[s]`` the states reached by no byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class _Reader:
    """Literals, ``[...]`` with ranges, ``(...|...)``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``, ``\\xHH``, escaped characters."""

    def __init__(self, nfa: _Nfa, pattern: str, any_case: bool) -> None:
        self.nfa, self.p, self.at, self.any_case = nfa, pattern, 0, any_case

    def _char(self) -> int:
        c = self.p[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.p[self.at - 2 : self.at], 16)
        return ord(c)

    def _cased(self, s: set[int]) -> frozenset:
        return frozenset(s | {ord(chr(c).swapcase()) for c in s if chr(c).isalpha()} if self.any_case else s)

    def _set(self) -> frozenset:
        out: set[int] = set()
        while self.p[self.at] != "]":
            lo = hi = self._char()
            if self.p[self.at] == "-" and self.p[self.at + 1] != "]":
                self.at += 1
                hi = self._char()
            out |= set(range(lo, hi + 1))
        self.at += 1
        return self._cased(out)

    def either(self):
        """A tree of the alternatives from here to the end or a closing bracket."""
        branches = [self._row()]
        while self.at < len(self.p) and self.p[self.at] == "|":
            self.at += 1
            branches.append(self._row())
        return ("or", branches)

    def _row(self):
        parts = []
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            if self.p[self.at] == "(":
                self.at += 1
                one = self.either()
                self.at += 1
            elif self.p[self.at] == "[":
                self.at += 1
                one = ("set", self._set())
            else:
                one = ("set", self._cased({self._char()}))
            low, high = 1, 1
            if self.at < len(self.p) and self.p[self.at] in "?*+{":
                c = self.p[self.at]
                self.at += 1
                if c == "{":
                    end = self.p.index("}", self.at)
                    a, comma, b = self.p[self.at : end].partition(",")
                    low, high = int(a), (int(b) if b else None) if comma else int(a)
                    self.at = end + 1
                else:
                    low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            parts.append((one, low, high))
        return ("row", parts)

    def build(self, tree, start: int) -> int:
        """Adds the tree from ``start``; the state in which it has been read."""
        kind, body = tree
        if kind == "set":
            end = self.nfa.state()
            self.nfa.moves[start].append((body, end))
            return end
        if kind == "or":
            end = self.nfa.state()
            for b in body:
                s = self.nfa.state()
                self.nfa.free[start].append(s)
                self.nfa.free[self.build(b, s)].append(end)
            return end
        for one, low, high in body:
            for _ in range(low):
                start = self.build(one, start)
            if high is None:
                loop, end = self.nfa.state(), self.nfa.state()
                self.nfa.free[start] += [loop, end]
                self.nfa.free[self.build(one, loop)] += [loop, end]
                start = end
            else:
                ends = []
                for _ in range(high - low):
                    ends.append(start)
                    start = self.build(one, start)
                end = self.nfa.state()
                for s in [*ends, start]:
                    self.nfa.free[s].append(end)
                start = end
        return start


@dataclass(frozen=True)
class Dfa:
    """``next[state * classes + of_byte[byte]]``; state 0 is the start, ``dead`` (-1 if none) leads nowhere."""

    next: np.ndarray
    of_byte: np.ndarray
    classes: int
    accepts: np.ndarray
    dead: int

    def resets(self) -> np.ndarray:
        """Bytes that lead from every state that does not accept to the start."""
        t = self.next.reshape(-1, self.classes)[~self.accepts]
        return (t == 0).all(axis=0)[self.of_byte]


def compile_dfa(rules: list[tuple[str, bool]], search: bool) -> Dfa:
    """One minimal automaton for all ``rules`` (pattern, any case).

    With ``search`` it finds a match anywhere and stays in the accepting state from then on; without, it reads a
    match from the first byte on and accepts after each byte that ends one.
    """
    nfa = _Nfa()
    start = nfa.state()
    final = set()
    for pattern, any_case in rules:
        s = nfa.state()
        nfa.free[start].append(s)
        r = _Reader(nfa, pattern, any_case)
        final.add(r.build(r.either(), s))
    sets = list({m[0] for ms in nfa.moves for m in ms})
    masks = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {m: i for i, m in enumerate(dict.fromkeys(masks))}
    of_byte = np.array([kinds[m] for m in masks], np.int64)
    sample = [masks.index(m) for m in kinds]
    # sets of states are the bits of whole numbers; by[s] are the (class, closed set) that a byte leads to
    closed = [sum(1 << t for t in nfa.closure([s])) for s in range(len(nfa.moves))]
    by: list[list[tuple[int, int]]] = []
    for ms in nfa.moves:
        to: dict[int, int] = {}
        for chars, t in ms:
            for c, b in enumerate(sample):
                if b in chars:
                    to[c] = to.get(c, 0) | closed[t]
        by.append(list(to.items()))
    goal_bits = sum(1 << s for s in final)
    busy = sum(1 << s for s, moves in enumerate(by) if moves) | goal_bits
    first = closed[start] & busy
    found, table, accepts = {first: 0}, [], []
    order = [first]
    for here in order:
        good = bool(here & goal_bits)
        accepts.append(good)
        if search and good:
            table.append([found[here]] * len(sample))
            continue
        row, left = [first if search else 0] * len(sample), here
        while left:
            s = (left & -left).bit_length() - 1
            left &= left - 1
            for c, bits in by[s]:
                row[c] |= bits
        numbers = []
        for goal in row:
            goal = goal_bits if search and goal & goal_bits else goal & busy
            if goal not in found:
                found[goal] = len(found)
                order.append(goal)
            numbers.append(found[goal])
        table.append(numbers)
    t, acc = np.array(table), np.array(accepts)
    part = acc.astype(np.int64)
    while True:
        _, new = np.unique(np.column_stack([part, part[t]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == part.max():
            break
        part = new
    rename = {p: i for i, p in enumerate(dict.fromkeys(new.tolist()))}
    new = np.array([rename[p] for p in new.tolist()])
    one = np.zeros(len(rename), np.int64)
    one[new[::-1]] = np.arange(len(new))[::-1]
    t, acc = new[t[one]], acc[one]
    dead = [s for s in range(len(t)) if not acc[s] and (t[s] == s).all()]
    return Dfa(t.reshape(-1).astype(np.int32), of_byte.astype(np.int32), len(sample), acc, dead[0] if dead else -1)


def search_lanes(dfa: Dfa, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, few: int = 48) -> np.ndarray:
    """For each piece of ``buffer`` whether the automaton accepts in it. One step reads one byte of every piece."""
    by = np.argsort(-lengths, kind="stable")
    s, n = starts[by], lengths[by]
    cls = dfa.of_byte[buffer]
    state = np.zeros(len(by), np.int32)
    step, c = dfa.next, np.int32(dfa.classes)
    ends = -n
    i, most = 0, int(n[0]) if len(n) else 0
    while i < most:
        k = int(np.searchsorted(ends, -i, "left"))
        if k <= few:
            break
        state[:k] = step[state[:k] * c + cls[s[:k] + i]]
        i += 1
    else:
        k = 0
    if k:
        table, size = step.tolist(), dfa.classes
        for j in range(k):
            at = int(state[j])
            for x in cls[s[j] + i : s[j] + n[j]].tolist():
                at = table[at * size + x]
            state[j] = at
    out = np.zeros(len(by), bool)
    out[by] = dfa.accepts[state]
    return out


def spans(dfa: Dfa, data: bytes) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of an automaton without search."""
    table, classes = dfa.next.tolist(), dfa.of_byte.tolist()
    accepts, size, dead = dfa.accepts.tolist(), dfa.classes, dfa.dead
    out, i, n = [], 0, len(data)
    while i < n:
        state, end = 0, -1
        for j in range(i, n):
            state = table[state * size + classes[data[j]]]
            if state == dead:
                break
            if accepts[state]:
                end = j + 1
        if end > i:
            out.append((i, end))
            i = end
        else:
            i += 1
    return out


def longest(dfa: Dfa, data: bytes, start: int) -> int:
    """The length of the longest match of an automaton without search that begins at ``start``; 0 if none does."""
    table, classes = dfa.next.tolist(), dfa.of_byte.tolist()
    state, end = 0, 0
    for j in range(start, len(data)):
        state = table[state * dfa.classes + classes[data[j]]]
        if state == dfa.dead:
            break
        if dfa.accepts[state]:
            end = j + 1 - start
    return end
