"""SentencePiece encoding and decoding with distinct sampled segmentations (Gumbel top-k without replacement).

A text becomes ``▁`` + itself with blanks as ``▁``, and is cut into chunks that no piece crosses (blanks before other
characters, line ends). Each chunk has a lattice of pieces; a path's probability is the product of its pieces' prior, a Zipf law
over the model's ranks with exponent ``theta``. Whole texts are then a tree with a level for each chunk.
Perturbed A-star search runs over it: a node's largest Gumbel-perturbed log-probability is known from its parent's, so the
search pops the node with the largest value, walks down to a whole segmentation by drawing chunks' segmentations from
their posteriors, and leaves at each level one node for all segmentations not drawn, with a Gumbel value truncated at its
parent's. The k popped leaves are exactly the k largest perturbed segmentations, hence a sample without replacement;
``inclusion`` is the chance to pass the (k+1)-th largest value: ``1 - exp(-exp(logp - value))``.

All draws depend on the seed and the row's doc_id only, so partitioning doesn't matter, nor which lattices a task still holds. Characters without a piece, and a
``▁`` that stands in the text itself, become byte pieces; ``decode`` gives back the exact text.

Defined cases: null texts count as empty; the empty text has the one segmentation of the dummy ``▁``; fewer than k
segmentations give fewer samples, all with inclusion 1; a null doc_id draws as id -1; repeated rows repeat; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as c
from .common import U

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K, THETA, SEED = 2, 1.0, 17
#: Bytes of text whose lattices a task holds at once.
STEP = 500_000
#: Characters up to which all substrings are looked up.
SHORT = 4
#: Cells (chunk, position, length) of lattices that are built at once.
CELLS = 300_000
#: Edges of lattices beyond which a task forgets those of chunks that only one of its steps had.
HELD = 1_000_000
_ESCAPED = "\U0010fffe"  # stands for a ▁ of the text; a noncharacter, itself always in byte pieces
_BITS = 20
_MASK = (1 << 64) - 1


class Pieces:
    """The model's pieces: hashes of their code points, prior log-probabilities, byte pieces."""

    def __init__(self, model: bytes, theta: float) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.texts = [p.id_to_piece(i) for i in range(n)]
        self.byte = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        ordinary = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        self.longest = max(len(self.texts[i]) for i in ordinary)
        names = np.zeros(len(ordinary), np.uint64)
        self.begins = np.zeros(1 << _BITS, bool)  # names of beginnings of pieces, from SHORT characters on
        size = np.array([len(self.texts[i]) for i in ordinary])
        for n_ in np.unique(size).tolist():
            at = np.flatnonzero(size == n_)
            x = _codes(np.array([[ord(y) for y in self.texts[ordinary[i]]] for i in at.tolist()], np.uint32))
            h = x[:, 0].copy()
            for k in range(1, n_):
                h = c.pair(h, x[:, k])
                if k + 1 >= SHORT:
                    self.begins[self._place(h, 64 - _BITS)] = True
            names[at] = h
        self.names, self.ids = names, np.array(ordinary, np.int64)
        # direct addressing by _BITS bits of the name; names whose place is taken go to a table over other bits
        self.tables, left = [], np.arange(len(names))
        for shift in (64 - _BITS, 24, 4, 34, 14):
            table, at = np.full(1 << _BITS, -1, np.int32), self._place(names[left], shift)
            table[at] = left
            self.tables.append((shift, table))
            left = left[table[at] != left]
            if not len(left):
                break
        else:
            raise ValueError("pieces can't be placed")
        rank = np.full(n, n, float)
        rank[ordinary] = np.arange(1, len(ordinary) + 1)
        self.logp = -theta * (np.log(rank + 1) + math.log(math.log(n) + 0.5772))
        self.byte_logp = float(self.logp.min())
        self.logp_or_none = np.concatenate([self.logp, [-np.inf]])  # also of the id -1

    @staticmethod
    def _place(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> U(shift)) & U((1 << _BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these names, -1 where there is none."""
        out = np.full(h.size, -1, np.int64)
        todo, x = None, h.ravel()
        for shift, table in self.tables:
            k = table[self._place(x, shift)]
            at = np.flatnonzero(k >= 0)
            k, x = k[at], x[at]
            todo = at if todo is None else todo[at]
            ok = self.names[k] == x
            out[todo[ok]] = self.ids[k[ok]]
            todo, x = todo[~ok], x[~ok]
        return out.reshape(h.shape)


def _codes(x: np.ndarray) -> np.ndarray:
    return c.mix((x.astype(np.uint64) + U(3)) * c._A)


@functools.lru_cache
def of_bytes(model: bytes, theta: float) -> Pieces:
    return Pieces(model, theta)


def pieces(model: str, theta: float) -> Pieces:
    """The pieces of a model file, which the driver reads; tasks get its bytes."""
    return of_bytes(Path(model).read_bytes(), theta)


def _cuts(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the chunks of texts that begin ``at`` these places begin, and the end: ``\\n+|▁*[^▁\\n]+|▁+`` in each text."""
    kind = (code == 10) + np.uint8(2) * (code == 0x2581)
    first = np.ones(len(code), bool)
    first[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] != 0) | (kind[:-1] != 2))
    first[at[:-1]] = True
    return np.append(np.flatnonzero(first), len(code))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranges of these sizes from these numbers on, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


class Lattices:
    """Lattices of all chunks seen, each built once: ``base[chunk] + position`` is a node, its edges are those from ``start[node]`` to ``start[node + 1]``."""

    def __init__(self, p: Pieces) -> None:
        self.pieces = p
        self.size, self.base, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int32)
        self.code, self.length, self.id = np.zeros(0, np.uint32), np.zeros(0, np.int16), np.zeros(0, np.int32)
        self.cum, self.logp = np.zeros(0), np.zeros(0)
        self.clear()

    def clear(self) -> None:
        self.chunks, self.nodes, self.edges = 0, 0, 0
        self.names, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # chunks by name

    def forget(self) -> None:
        """Keeps the lattices of chunks that several calls had, halving their counts of calls; none if those are still too many."""
        held = np.flatnonzero(self.uses[: self.chunks] > 1)
        size = self.size[held]
        nodes = _ranges(self.base[held], size)
        count = self.start[nodes + 1] - self.start[nodes]
        edges = _ranges(self.start[nodes], count)
        if len(edges) > HELD:
            return self.clear()
        number = np.full(self.chunks, -1, np.int64)
        number[held] = np.arange(len(held))
        self.numbers = number[self.numbers]
        self.names, self.numbers = self.names[self.numbers >= 0], self.numbers[self.numbers >= 0]
        self.chunks, self.nodes, self.edges = len(held), len(nodes), len(edges)
        self.size[: len(held)], self.base[: len(held)], self.uses[: len(held)] = size, np.cumsum(size) - size, self.uses[held] // 2
        self.code[: len(nodes)], self.start[1 : len(nodes) + 1] = self.code[nodes], np.cumsum(count)
        for x in (self.length, self.id, self.cum, self.logp):
            x[: len(edges)] = x[edges]

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' chunks by number, and where each text's begin (one more entry); lattices of new chunks are built."""
        if self.edges > HELD:
            self.forget()
        parts = ["▁" + t.replace("▁", _ESCAPED).replace(" ", "▁") for t in texts]
        at = np.cumsum([0, *map(len, parts)])
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = _cuts(code, at)
        s, size = cut[:-1], np.diff(cut)
        name, one, which = np.unique(self._names(code, cut), return_index=True, return_inverse=True)
        place = np.searchsorted(self.names, name)
        known = np.append(self.names, U(0))[place] == name
        known &= place < len(self.names)
        number = np.full(len(name), -1, np.int64)
        number[known] = self.numbers[place[known]]
        number[~known] = np.arange(self.chunks, self.chunks + np.count_nonzero(~known))
        one, name, place = one[~known], name[~known], place[~known]
        self.names, self.numbers = np.insert(self.names, place, name), np.insert(self.numbers, place, number[~known])
        self._build(code, s[one], size[one])
        self.uses[number] += 1
        chunk = number[which]
        if (size != self.size[chunk]).any() or (code != self.code[_ranges(self.base[chunk], size)]).any():
            self.clear()  # different chunks share a name: each place gets a lattice of its own, under no name
            self._build(code, s, size)
            self.uses[: self.chunks] = 0
            chunk = np.arange(len(s))
        return chunk, np.searchsorted(cut, at)

    @staticmethod
    def _names(code: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """A 64-bit name for each chunk, from a polynomial prefix sum."""
        c.Powers.need(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_codes(code) * c.Powers.up[: len(code)], out=total[1:])
        return c.mix((total[cut[1:]] - total[cut[:-1]]) * c.Powers.down[cut[:-1]] + np.diff(cut).astype(np.uint64) * c._C)

    def _room(self, names: tuple[str, ...], n: int) -> None:
        for name in names:
            x = getattr(self, name)
            if n > len(x):
                y = np.empty(max(n + n // 2, HELD), x.dtype)  # pages that nothing is written to take no memory
                y[: len(x)] = x
                setattr(self, name, y)

    def _build(self, code: np.ndarray, s: np.ndarray, size: np.ndarray) -> None:
        """Lattices of chunks that begin at these places and have these sizes; they get the next numbers."""
        self._room(("size", "base", "uses"), self.chunks + len(s))
        self._room(("code", "start"), self.nodes + int(size.sum()) + 1)
        self.size[self.chunks : self.chunks + len(s)] = size
        self.uses[self.chunks : self.chunks + len(s)] = 0
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            size_ = max(1, CELLS // (n * min(n, self.pieces.longest)))
            for i in range(0, len(which), size_):
                part = which[i : i + size_]
                x = code[s[part] + np.arange(n)[:, None]]
                self.base[self.chunks + part] = self.nodes + n * np.arange(len(part))
                self.code[self.nodes : self.nodes + x.size] = x.T.ravel()
                count, *edges = self._edges(x)
                self._room(("length", "id", "cum", "logp"), self.edges + len(edges[0]))
                for held, y in zip((self.length, self.id, self.cum, self.logp), edges):
                    held[self.edges : self.edges + len(y)] = y
                self.start[self.nodes + 1 : self.nodes + x.size + 1] = self.edges + np.cumsum(count)
                self.nodes += x.size
                self.edges += len(edges[0])
        self.chunks += len(s)

    def _edges(self, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of chunks of one length (characters by chunks), the number of edges of each node, and length, id, cumulated and log-probability of each edge.

        Arrays are by position, length, chunk here, so that all sums over lengths run over whole rows.
        """
        p, (n, chunks) = self.pieces, code.shape
        x, most = _codes(code), min(n, p.longest)
        ids = np.full((n, most, chunks), -1, np.int32)
        h = x
        for k in range(min(most, SHORT)):
            if k:
                h = c.pair(h[:-1], x[k:])
            ids[: n - k, k] = p.find(h)
        # longer pieces only where one begins so
        i, w = np.nonzero(p.begins[p._place(h, 64 - _BITS)]) if most > SHORT else (np.zeros(0, np.int64),) * 2
        h = h[i, w]
        for k in range(SHORT, most):
            go = i + k < n
            w, i = w[go], i[go]
            h = c.pair(h[go], x[i + k, w])
            go = p.begins[p._place(h, 64 - _BITS)]
            w, i, h = w[go], i[go], h[go]
            if not len(w):
                most = k
                break
            ids[i, k, w] = p.find(h)
        ids = ids[:, :most]
        lone = ids[:, 0] < 0
        ids[:, 0][lone] = len(p.texts) + code[lone]
        logp = p.logp_or_none[np.minimum(ids, len(p.texts))]
        wide = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        logp[:, 0][lone] = p.byte_logp * wide[lone]
        cum = np.zeros(logp.shape)
        beta = np.zeros((n + 1, chunks))
        for i in range(n - 1, -1, -1):
            k = min(most, n - i)
            s = logp[i, :k]
            s += beta[i + 1 : i + 1 + k]
            top = s.max(0)
            e = np.exp(s - top)
            if chunks < 128:
                e = np.add.accumulate(e, 0)
            else:
                for j in range(1, k):
                    e[j] += e[j - 1]
            np.divide(e, e[-1], out=cum[i, :k])
            beta[i] = top + np.log(e[-1])
            s -= beta[i]
        held = ids >= 0
        count = held.sum(1, dtype=np.int32).T.ravel()
        whole = np.int32 if held.size < 1 << 31 else np.int64
        chunk, cell = np.divmod(np.flatnonzero(held.transpose(2, 0, 1).ravel()).astype(whole), whole(n * most))
        at = cell.astype(np.int64) * chunks + chunk
        cum = cum.ravel()[at]
        cum[np.cumsum(count) - 1] = 2.0
        return count, (cell % most + 1).astype(np.int16), ids.ravel()[at], cum, logp.ravel()[at]

    def draw(self, chunk: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of every occurrence from its chunk's posterior: (occurrence, edge) in order, and log-probabilities."""
        node = self.base[chunk]
        end = node + self.size[chunk]
        live = np.arange(len(chunk))
        whos, edges, logp, step = [], [], np.zeros(len(chunk)), 0
        while len(live):
            step += 1
            u = (c.mix(noise[live] + U(step * int(c._C) & _MASK)) >> U(11)).astype(float) * 2.0**-53
            e = self.start[node]
            todo = np.flatnonzero(self.cum[e] < u)
            while len(todo):
                e[todo] += 1
                todo = todo[self.cum[e[todo]] < u[todo]]
            logp[live] += self.logp[e]
            whos.append(live)
            edges.append(e)
            node = node + self.length[e]
            go = node < end[live]
            live, node = live[go], node[go]
        who = np.concatenate(whos) if whos else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        return who[order], (np.concatenate(edges) if edges else who)[order], logp

    def draw_other(self, chunk: int, taken: list[tuple[tuple[int, ...], float]], rng: np.random.Generator) -> tuple[tuple[int, ...], float]:
        """A segmentation that isn't among ``taken`` (edges, probability), from the posterior without those."""
        node = int(self.base[chunk])
        end = node + int(self.size[chunk])
        path: list[int] = []
        mass, logp = 1.0, 0.0
        while node < end:
            lo, hi = int(self.start[node]), int(self.start[node + 1])
            probs = [math.exp(x) for x in self.logp[lo:hi].tolist()]
            left = [mass * x for x in probs]
            for t, q in taken:  # those that begin with the path
                left[t[len(path)] - lo] -= q
            left = [max(x, 0.0) for x in left]
            if sum(left) <= 0:  # only rounding is left: the first edge that isn't the end of a taken path
                left = [0.0 if any(len(t) == len(path) + 1 and t[-1] == e for t, _ in taken) else 1.0 for e in range(lo, hi)]
            upto = list(itertools.accumulate(left))
            e = min(bisect.bisect_right(upto, rng.random() * upto[-1]), bisect.bisect_left(upto, upto[-1]))
            taken = [x for x in taken if x[0][len(path)] == lo + e]
            path.append(lo + e)
            logp += float(self.logp[lo + e])
            mass *= probs[e]
            node += int(self.length[lo + e])
        return tuple(path), logp


def _gumbel(logmass: np.ndarray, bound: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Largest Gumbel value of nodes with these log-masses, given that it is at most ``bound``."""
    u = ((c.mix(noise.copy()) >> U(11)).astype(float) + 0.5) * 2.0**-53
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(logmass > -np.inf, logmass - np.log(-np.log(u) + np.exp(np.minimum(logmass - bound, 700))), -np.inf)


def sample_texts(ids: np.ndarray, texts: list[str], p: Pieces, k: int, seed: int, lattices: Lattices | None = None) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its samples (piece ids, log-probability, inclusion), the largest perturbed value first; ``lattices`` may hold those of earlier calls."""
    lat = lattices or Lattices(p)
    chunk, cut = lat.add(texts)
    key = c.mix(ids.astype(np.int64).view(np.uint64) * c._A + U(seed))
    doc = np.repeat(np.arange(len(texts)), np.diff(cut))
    level = np.arange(len(chunk)) - cut[doc]
    top = _gumbel(np.zeros(len(texts)), np.full(len(texts), np.inf), key + U(1))
    heaps: list[list] = [[] for _ in texts]
    # a sample: per chunk edges as (flat edges, cuts by chunk, log-probabilities by chunk, value)
    done: list[list] = [[] for _ in texts]

    def walk(which: np.ndarray, starts: np.ndarray, values: np.ndarray, heads: list, turn: int) -> None:
        """Draws all levels from ``starts`` on for the texts ``which``, whose nodes have these values, and leaves the rests on the heaps."""
        begin = np.full(len(texts), 1 << 60)
        begin[which] = starts
        at = np.flatnonzero(level >= begin[doc])
        noise = c.mix(key[doc[at]] + level[at].astype(np.uint64) * c._B + U(turn * int(c._C) & _MASK))
        who, edge, logp = lat.draw(chunk[at], noise.copy())
        edge_cut = np.searchsorted(who, np.arange(len(at) + 1))
        span = np.searchsorted(doc[at], np.arange(len(texts) + 1))
        bound = np.zeros(len(texts))
        bound[which] = values
        before = np.cumsum(logp) - logp
        head_logp = np.zeros(len(texts))
        head_logp[which] = [h[2].sum() if h is not None else 0.0 for h in heads]
        head = before - (before[np.minimum(span[:-1], max(len(at) - 1, 0))] if len(at) else np.zeros(len(texts)))[doc[at]] + head_logp[doc[at]]
        with np.errstate(divide="ignore"):
            rest = np.where(logp < -1e-12, head + np.log(-np.expm1(np.minimum(logp, -1e-300))), -np.inf)
        value = _gumbel(rest, bound[doc[at]], noise + U(7))
        for w, s, v, h in zip(which.tolist(), starts.tolist(), values.tolist(), heads):
            a, b = int(span[w]), int(span[w + 1])
            e, cuts, lp = edge[edge_cut[a] : edge_cut[b]], edge_cut[a : b + 1] - edge_cut[a], logp[a:b]
            if h is not None:
                e, cuts, lp = np.concatenate([h[0], e]), np.concatenate([h[1][:-1], len(h[0]) + cuts]), np.concatenate([h[2], lp])
            done[w].append((e, cuts, lp, v))
            own = value[a:b]
            need = k - turn  # nodes that may still be popped, and the one that sets the inclusion threshold
            best = np.array([own.argmax()]) if need == 1 and len(own) else np.argpartition(-own, need)[:need] if len(own) > need else np.arange(len(own))
            for i in best.tolist():
                if own[i] > -np.inf:
                    j = s + i
                    heapq.heappush(heaps[w], (-float(own[i]), len(done[w]) - 1, j, [(tuple(e[cuts[j] : cuts[j + 1]].tolist()), math.exp(lp[j]))]))

    if len(texts):
        walk(np.arange(len(texts)), np.zeros(len(texts), np.int64), top, [None] * len(texts), 0)
    for turn in range(1, k):
        which, starts, values, heads = [], [], [], []
        for w, heap in enumerate(heaps):
            if not heap or len(done[w]) < turn:
                continue
            value, src, j, taken = heapq.heappop(heap)
            rng = np.random.default_rng([int(key[w]), turn])
            e, cuts, lp, _ = done[w][src]
            path, logp = lat.draw_other(int(chunk[cut[w] + j]), taken, rng)
            taken = [*taken, (path, math.exp(logp))]
            mass = 1 - sum(q for _, q in taken)
            if mass > 1e-12:
                again = _gumbel(np.array([lp[:j].sum() + math.log(mass)]), np.array([-value]), np.array([key[w] + U(1000 + turn)]))
                heapq.heappush(heap, (-float(again[0]), src, j, taken))
            which.append(w)
            starts.append(j + 1)
            values.append(-value)
            heads.append((np.concatenate([e[: cuts[j]], np.array(path, np.int64)]), np.concatenate([cuts[: j + 1], [cuts[j] + len(path)]]), np.concatenate([lp[:j], [logp]])))
        if which:
            walk(np.array(which), np.array(starts), np.array(values), heads, turn)
    edges = [x[0] for samples in done for x in samples]
    flat, count = expand(lat.id[np.concatenate(edges)] if edges else np.zeros(0, np.int32), p)
    ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *map(len, edges)])].tolist()
    out, n = [], 0
    for w, samples in enumerate(done):
        kappa = -heaps[w][0][0] if heaps[w] else -math.inf
        rows = []
        for _, _, lp, _ in samples:
            total = float(lp.sum())
            n += 1
            rows.append((flat[ends[n - 1] : ends[n]], total, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(total - kappa, 700)))))
        out.append(rows)
    return out


def expand(ids: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters without a piece as their bytes' pieces, and how many each became."""
    n = len(p.texts)
    lone = np.flatnonzero(ids >= n)
    raw = [x.encode() for x in "".join(map(chr, (ids[lone] - n).tolist())).replace(_ESCAPED, "▁")]
    count = np.ones(len(ids), np.int64)
    count[lone] = [len(x) for x in raw]
    out = np.repeat(ids, count)
    out[out >= n] = [p.byte[y] for y in b"".join(raw)]
    return out, count


def decode(ids, model: str = MODEL) -> str:
    """The text that was encoded."""
    p = pieces(model, THETA)
    out = bytearray()
    for i in ids:
        out += bytes([p.byte_of[i]]) if i in p.byte_of else p.texts[i].replace("▁", " ").encode()
    return out[1:].decode()


SAMPLES = "array<struct<ids:array<int>,logp:double,inclusion:double>>"


def encode(df: DataFrame, k: int = K, theta: float = THETA, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """doc_id and its distinct sampled segmentations."""
    held = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())  # some 0.5 MB
    kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("logp", pa.float64()), ("inclusion", pa.float64())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = of_bytes(held.value, theta)
        lattices = Lattices(p)
        for b in batches:
            keys = b.column(0).fill_null(-1).to_numpy()
            _, at = c.byte_parts(b.column(1))
            for i, j in c.steps(at, STEP):
                got = sample_texts(keys[i:j], b.column(1).slice(i, j - i).to_pylist(), p, k, seed, lattices)
                rows = [x for y in got for x in y]
                size = np.array([len(x[0]) for x in rows], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate([x[0] for x in rows] or [np.zeros(0)]).astype(np.int32)))
                structs = pa.StructArray.from_arrays([lists, pa.array([x[1] for x in rows], pa.float64()), pa.array([x[2] for x in rows], pa.float64())], ["ids", "logp", "inclusion"])
                samples = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in got])]).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), samples.cast(kind)], ["doc_id", "samples"])

    return c.documents(df).mapInArrow(emit, f"doc_id long, samples {SAMPLES}")


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(c.table(spark, sf_dir, "documents"))
