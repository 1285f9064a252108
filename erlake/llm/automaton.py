"""Regular expressions over bytes as one deterministic automaton: subset construction, then minimisation.

The syntax is what secret rules need: literals, classes with ranges and negation, groups, alternation, ``* + ? {m} {m,} {m,n}``,
``\\xHH`` and escaped characters. ``icase`` lets ASCII letters stand in either case.
"""

from __future__ import annotations

import numpy as np

_INF = None


class Rule:
    """A nondeterministic automaton for one expression (Thompson's construction)."""

    def __init__(self, pattern: str, icase: bool = False) -> None:
        self.p, self.i, self.icase = pattern, 0, icase
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []
        self.start, self.end = self._any()
        if self.i != len(pattern):
            raise ValueError(f"unexpected {pattern[self.i]!r} at {self.i} in {pattern!r}")

    def _new(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def _any(self) -> tuple[int, int]:
        a, b = self._new(), self._new()
        while True:
            x, y = self._row()
            self.empty[a].append(x)
            self.empty[y].append(b)
            if self.p[self.i : self.i + 1] != "|":
                return a, b
            self.i += 1

    def _row(self) -> tuple[int, int]:
        a = b = self._new()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            x, y = self._repeat()
            self.empty[b].append(x)
            b = y
        return a, b

    def _repeat(self) -> tuple[int, int]:
        at = self.i
        one = self._atom()
        end = self.i
        mark = self.p[self.i : self.i + 1]
        if mark == "" or mark not in "*+?{":
            return one
        self.i += 1
        least, most = {"*": (0, _INF), "+": (1, _INF), "?": (0, 1)}.get(mark, (0, 0))
        if mark == "{":
            close = self.p.index("}", self.i)
            low, comma, high = self.p[self.i : close].partition(",")
            least, most = int(low), (int(high) if high else _INF) if comma else int(low)
            self.i = close + 1
        after = self.i

        def copy() -> tuple[int, int]:
            self.i = at
            x = self._atom()
            assert self.i == end
            self.i = after
            return x

        a = b = self._new()
        for _ in range(least):
            x, y = copy()
            self.empty[b].append(x)
            b = y
        if most is _INF:
            x, y = copy()
            loop, out = self._new(), self._new()
            self.empty[b].append(loop)
            self.empty[loop] += [x, out]
            self.empty[y].append(loop)
            return a, out
        out = self._new()
        for _ in range(most - least):
            self.empty[b].append(out)
            x, y = copy()
            self.empty[b].append(x)
            b = y
        self.empty[b].append(out)
        return a, out

    def _char(self) -> int:
        x = self.p[self.i]
        self.i += 1
        if x != "\\":
            return ord(x)
        x = self.p[self.i]
        self.i += 1
        if x == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(x, ord(x))

    def _atom(self) -> tuple[int, int]:
        x = self.p[self.i]
        if x == "(":
            self.i += 1
            if self.p[self.i : self.i + 2] == "?:":
                self.i += 2
            got = self._any()
            if self.p[self.i : self.i + 1] != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return got
        if x == "[":
            self.i += 1
            negative = self.p[self.i] == "^"
            self.i += negative
            found: set[int] = set()
            first = True
            while self.p[self.i] != "]" or first:
                first = False
                low = self._char()
                high = low
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self._char()
                found |= set(range(low, high + 1))
            self.i += 1
        elif x == ".":
            self.i += 1
            negative, found = True, {10}
        else:
            negative, found = False, {self._char()}
        if self.icase:
            found |= {y ^ 32 for y in found if 65 <= y & ~32 <= 90 and y < 128}
        if negative:
            found = set(range(256)) - found
        a, b = self._new(), self._new()
        self.step[a] = (frozenset(found), b)
        return a, b


class Automaton:
    """``next[state, byte class]``, ``of[byte]`` (its class) and ``accepts[state]``, a bit for each rule.

    ``search`` keeps trying at every byte; without it the match must begin where the scan does, and ``dead`` is the
    state that nothing leaves.
    """

    def __init__(self, rules: list[Rule], search: bool) -> None:
        base, empty, step = [], [], []
        for x in rules:
            base.append(len(empty))
            empty += [[base[-1] + y for y in ys] for ys in x.empty]
            step += [s and (s[0], base[-1] + s[1]) for s in x.step]
        ends = {b + x.end: 1 << k for k, (b, x) in enumerate(zip(base, rules))}
        # bytes that no class tells apart
        told: dict[tuple, int] = {}
        sets = list({s[0] for s in step if s})
        self.of = np.array([told.setdefault(tuple(b in x for x in sets), len(told)) for b in range(256)], np.uint8)
        sample = {int(k): b for b, k in reversed(list(enumerate(self.of)))}

        def closure(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for y in empty[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return frozenset(y for y in seen if step[y] or y in ends)

        begin = closure({b + x.start for b, x in zip(base, rules)})
        # subset construction
        number, order, table = {begin: 0}, [begin], []
        for state in order:
            row = []
            for k in range(len(told)):
                b = sample[k]
                new = closure({step[y][1] for y in state if step[y] and b in step[y][0]})
                if search:
                    new |= begin
                if new not in number:
                    number[new] = len(order)
                    order.append(new)
                row.append(number[new])
            table.append(row)
        accepts = np.array([sum(ends[y] for y in s if y in ends) for s in order], np.int64)
        table = np.array(table, np.int64)
        # minimisation: split blocks of states until all states of one agree in the blocks they lead to (Moore)
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        one = np.unique(block, return_index=True)[1]
        self.next, self.accepts, self.start, self.size = block[table[one]].astype(np.int32), accepts[one], int(block[0]), len(one)
        dead = [k for k in range(self.size) if not self.accepts[k] and (self.next[k] == k).all()]
        self.dead = dead[0] if dead else -1
        #: Bytes after which every state is the start again: no match holds one.
        self.resets = (self.next[:, self.of] == self.start).all(axis=0)
        self._rows = self.next.tolist()
        self._ok = (self.accepts > 0).tolist()
        self._bits = self.accepts.tolist()

    def longest(self, classes: bytes, at: int, stop: int) -> int:
        """End of the longest match that starts at ``at``; -1 if none does. ``classes``: the text as byte classes."""
        state, end, rows, ok, dead = self.start, -1, self._rows, self._ok, self.dead
        if ok[state]:
            end = at
        for i in range(at, stop):
            state = rows[state][classes[i]]
            if state == dead:
                break
            if ok[state]:
                end = i + 1
        return end

    def walk(self, classes: bytes, state: int) -> int:
        """The bits of all rules that accept somewhere on the way from ``state`` along ``classes``."""
        rows, seen = self._rows, 0
        accepts = self._bits
        for k in classes:
            state = rows[state][k]
            if accepts[state]:
                seen |= accepts[state]
        return seen


#: Lanes that are left for single steps.
FEW = 24


def lanes(data: np.ndarray, at: np.ndarray, resets: np.ndarray, size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of about ``size`` bytes that no match crosses: cut at document ends and after resetting bytes."""
    cut = np.flatnonzero(resets[data]) + 1
    at = np.unique(at)
    goal = np.arange(size, len(data), size)
    ahead = np.searchsorted(cut, goal)
    more = cut[ahead[ahead < len(cut)]]
    starts = np.unique(np.concatenate([at[:-1], more[more < len(data)]]))
    return starts, np.append(starts[1:], len(data))


def scan(auto: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each lane, the bits of the rules that some prefix of it ends a match of: one transition for each byte.

    All lanes step together, the longest first, so each step is one indexed read over the lanes still running. The last
    ``FEW`` lanes, which may be much longer, are walked one by one.
    """
    order = np.argsort(starts - ends, kind="stable")
    s, n = starts[order], (ends - starts)[order]
    hit = np.zeros(len(s), np.int64)
    if not len(s):
        return hit
    classes = auto.of[data]
    width = auto.next.shape[1]
    flat = (auto.next * width).ravel().astype(np.int32)
    accepts = np.zeros(len(flat), np.int64)
    accepts[::width] = auto.accepts
    some = bool(auto.accepts.any())
    state = np.full(len(s), auto.start * width, np.int32)
    running = len(s) - np.searchsorted(n[::-1], np.arange(int(n[0])), "right")
    for i, k in enumerate(running.tolist()):
        if k < len(state):
            state = state[:k]
        if k <= FEW:
            for j in range(k):
                hit[j] |= auto.walk(classes[s[j] + i : s[j] + n[j]].tobytes(), int(state[j]) // width)
            break
        state = flat[state + classes[s[:k] + i]]
        if some:
            hit[:k] |= accepts[state]
    out = np.zeros(len(s), np.int64)
    out[order] = hit
    return out
