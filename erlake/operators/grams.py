"""Weighted grams of short texts as arrays: exact nearest texts and cosines of pairs, within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Two scores that differ by less may be equal when rounded to six places.
SLACK = 2e-6


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the texts' lengths."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


class CharGrams:
    """Finds known grams in texts, letter by letter, by the ranks of their prefixes; a gram's id is its place in the list."""

    def __init__(self, grams: list[str]) -> None:
        points, n = _points(grams)
        self.size, self.letters = len(grams), np.unique(points)
        letter, start = np.searchsorted(self.letters, points), np.cumsum(n) - n
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(max(n, default=0)):
            longer = np.flatnonzero(n > j)
            key = letter[start[longer] + j] if j == 0 else rank[longer] * len(self.letters) + letter[start[longer] + j]
            table, at = (np.arange(len(self.letters)), key) if j == 0 else np.unique(key, return_inverse=True)
            rank = np.zeros(len(grams), np.int64)
            rank[longer] = at
            ids = np.full(len(table), -1)
            ids[rank[n == j + 1]] = np.flatnonzero(n == j + 1)
            self.levels.append((table, ids))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, gram, times), in order of text and gram."""
        if not self.levels:
            return (np.zeros(0, np.int64),) * 3
        points, n = _points(texts)
        letter = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        known = np.append(self.letters[letter] == points, False)
        text, end = np.repeat(np.arange(len(texts)), n), np.repeat(np.cumsum(n), n)
        place = np.flatnonzero(known)
        rank, found = letter[place], []
        for j, (table, ids) in enumerate(self.levels):
            if j:
                on = (place + j < end[place]) & known[np.minimum(place + j, len(points))]
                place, rank = place[on], rank[on]
                key = rank * len(self.letters) + letter[place + j]
                rank = np.minimum(np.searchsorted(table, key), len(table) - 1)
                on = table[rank] == key
                place, rank = place[on], rank[on]
            g = ids[rank]
            found.append(text[place[g >= 0]] * self.size + g[g >= 0])
        return counted(np.concatenate(found), self.size)


def counted(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, times) of keys text * size + gram."""
    keys, times = np.unique(keys, return_counts=True)
    return *np.divmod(keys, max(size, 1)), times


def weighed(counts: tuple[np.ndarray, np.ndarray, np.ndarray], idf: np.ndarray, texts: int, sublinear: bool = False) -> np.ndarray:
    """TF-IDF weights, each text's of length 1."""
    of, g, times = counts
    w = (1 + np.log(times) if sublinear else times) * idf[g]
    return w / np.sqrt(np.bincount(of, w * w, texts))[of]


def pair_cosines(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], idf: np.ndarray, texts: int) -> np.ndarray:
    """Cosine of each pair of texts of the same number, by sublinear weights; 0 where they share no gram."""
    wa, wb = weighed(a, idf, texts, True), weighed(b, idf, texts, True)
    _, i, j = np.intersect1d(a[0] * len(idf) + a[1], b[0] * len(idf) + b[1], assume_unique=True, return_indices=True)
    return np.bincount(a[0][i], wa[i] * wb[j], texts)


class Nearest:
    """Texts with those nearest to a query by cosine: rare grams gather and bound, what may be among the first is scored in full."""

    #: Grams are taken in steps: those that at most so large a share of the texts holds.
    STEPS = (0.02, 0.06, 1.0)
    #: A posting's cost in that of a text scored in full. Sets the time alone, not the result.
    FULL = 150

    def __init__(self, grams: CharGrams, idf: np.ndarray, texts: list[str], copies: np.ndarray) -> None:
        self.grams, self.idf, self.texts, self.copies = grams, idf, len(texts), copies
        counts = grams.counts(texts)
        w, (of, g, _) = weighed(counts, idf, len(texts)), counts
        self.own, self.own_g, self.own_w = np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))), g.astype(np.int32), w
        order = np.argsort(g, kind="stable")
        held = np.bincount(g, minlength=grams.size)
        self.post, self.post_of, self.post_w = np.append(0, np.cumsum(held)), of[order].astype(np.int32), w[order]
        self.step = np.searchsorted(np.array(self.STEPS) * len(texts), held)
        # the length of what a text has of the grams after each step
        self.rest = [np.sqrt(np.bincount(of[later], w[later] * w[later], len(texts))) for later in (self.step[g] > i for i in range(len(self.STEPS)))]
        self.weight = np.zeros(grams.size)

    def _scores(self, of: np.ndarray) -> np.ndarray:
        """Whole scores of some texts against ``weight``."""
        n = self.own[of + 1] - self.own[of]
        at = np.repeat(self.own[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(np.repeat(np.arange(len(of)), n), self.weight[self.own_g[at]] * self.own_w[at], len(of))

    def _floor(self, of: np.ndarray, scores: np.ndarray, k: int) -> float:
        """A score that ``k`` records reach, less what rounding may hide; 0 if there are fewer."""
        order = np.argsort(-scores)
        i = np.searchsorted(np.cumsum(self.copies[of[order]]), k)
        return max(float(scores[order[i]]) - SLACK, 0.0) if i < len(of) else 0.0

    def _first(self, g: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.step[g], kind="stable")
        a, b, w = self.post[g[order]], self.post[g[order] + 1], w[order]
        ends = np.searchsorted(self.step[g[order]], range(len(self.STEPS)), "right")
        sums, floor, at = np.zeros(self.texts), 0.0, 0
        for step, to in enumerate(ends):
            if to > at:
                sums += np.bincount(np.concatenate([self.post_of[a[i] : b[i]] for i in range(at, to)]), np.concatenate([self.post_w[a[i] : b[i]] * w[i] for i in range(at, to)]), self.texts)
                at = to
            if to == len(w):
                may = np.flatnonzero(sums > max(floor - SLACK, 0))
                break
            more = (b[at : ends[step + 1]] - a[at : ends[step + 1]]).sum()
            if not more and step + 1 < len(ends):
                continue
            met = np.flatnonzero(sums > floor / 2)
            if len(met) >= k:
                best = met if len(met) <= 4 * k else met[np.argpartition(sums[met], -4 * k)[-4 * k :]]
                floor = max(floor, self._floor(best, self._scores(best), k))
            if floor > 0:
                # what the rest adds is at most the product of both lengths
                may = np.flatnonzero(sums + self.rest[step] * (np.sqrt((w[at:] * w[at:]).sum()) + 1e-9) >= floor)
                if len(may) * self.FULL < more:
                    break
        scores = self._scores(may)
        high = scores >= max(self._floor(may, scores, k), 1e-9)
        return may[high], scores[high]

    def search(self, queries: list[str], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, texts, scores): all texts that may hold one of the ``k`` highest scores when rounded to six places."""
        counts = self.grams.counts(queries)
        w, ends = weighed(counts, self.idf, len(queries)), np.append(0, np.cumsum(np.bincount(counts[0], minlength=len(queries))))
        for q in range(len(queries)):
            g, x = counts[1][ends[q] : ends[q + 1]], w[ends[q] : ends[q + 1]]
            if len(g):
                self.weight[g] = x
                yield q, *self._first(g, x, k)
                self.weight[g] = 0
