"""Candidates of all routes with their rank scores, without moving pairs: anchors are dealt into parts, each key's list of
candidates and each candidate's record go once to every part that asks for them, and a part makes and scores its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..sources import index
from . import blocking as b

#: Anchors of a part; listed candidates and anchors of a vector step.
ANCHORS, STEP, MOST = 5000, 100_000, 512
#: Characters and different words that a vector step takes; longer texts are compared one pair at a time.
LONGEST, WORDS = 63, 12
_FIELDS = ("name_n", "addr_n", "postal", "state", "city")
_OTHER, _CORE, _APPROXIMATE, _LEFT_OUT = range(4)
SCORED = "s1 string, candidate string, score double, second double"
U = np.uint64


class _Texts:
    """Texts as columns of codes, their different words in order, and where each word stands among them."""

    def __init__(self, texts: list[str], alphabet: dict[str, int], words: dict[str, int], pad: int) -> None:
        self.texts, n = texts, len(texts)
        sets = [sorted(set(x.split())) for x in texts]
        self.n = np.fromiter(map(len, texts), np.int64, n)
        self.count = np.fromiter(map(len, sets), np.int64, n)
        # each word with a blank before it, so that leaving words out leaves blanks in their places but for the first
        ordered = ["".join(" " + w for w in s) for s in sets]
        size = np.fromiter(map(len, ordered), np.int64, n)
        self.long = (self.n > LONGEST) | (size > LONGEST) | (self.count > WORDS)
        self.n_ordered = size
        self.codes, self.ordered = self._codes(texts, alphabet), self._codes(ordered, alphabet)
        short = [() if x else s for x, s in zip(self.long.tolist(), sets)]
        self.count[self.long] = 0
        flat = [w for s in short for w in s]
        ids = np.fromiter((words.setdefault(w, len(words)) for w in flat), np.int32, len(flat))
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        row = np.repeat(np.arange(n), self.count)
        first = np.cumsum(self.count) - self.count
        place = np.arange(len(flat)) - first[row]
        end = np.cumsum(lengths + 1)
        begin = end - lengths - 1
        begin -= begin[first[row]] if len(flat) else 0
        self.most = int(self.count.max(initial=0))
        self.ids = np.full((self.most, n), pad, np.int32)
        self.spans, self.sizes = np.zeros((self.most, n), U), np.zeros((self.most, n), np.int16)
        self.ids[place, row], self.sizes[place, row] = ids, lengths
        self.spans[place, row] = ((U(1) << (lengths + 1).astype(U)) - U(1)) << begin.astype(U)

    @staticmethod
    def _codes(texts: list[str], alphabet: dict[str, int]) -> np.ndarray:
        """Code of each character by place and text; 0 where there is none."""
        texts = [x[: LONGEST + 1] for x in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        found, at = np.unique(points, return_inverse=True)
        of = np.array([alphabet.setdefault(int(p), len(alphabet) + 1) for p in found], np.int32)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts)), n)
        out = np.zeros((int(n.max(initial=0)), len(texts)), np.min_scalar_type(len(alphabet)))
        if len(points):
            out[np.arange(len(points)) - (np.cumsum(n) - n)[row], row] = of[at]
        return out


def _masks(codes: np.ndarray, lo: int, hi: int, letters: int) -> np.ndarray:
    """For each text from lo to hi and each letter, the places that hold it, flat."""
    out, row = np.zeros((hi - lo, letters), U), np.arange(hi - lo)
    for j in range(min(len(codes), 64)):
        out[row, codes[j, lo:hi]] |= U(1 << j)
    out[:, 0] = 0
    return out.ravel()


def _lcs(masks: np.ndarray, at: np.ndarray, codes: np.ndarray, size: np.ndarray, y: np.ndarray, keep: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs at once: kernels.lcs with 64-bit words.

    ``at``: where each pair's masks begin; ``y``: its text among ``codes``; ``keep``: the places of either text that count.
    """
    order = np.argsort(-size[y].astype(np.int16), kind="stable")
    at, y, one = at[order], y[order], keep and keep[0][order]
    two = keep and keep[1][order]
    s = np.full(len(y), ~U(0))
    longer = len(y) - np.cumsum(np.bincount(size[y], minlength=len(codes) + 1))
    for j in range(len(codes)):
        n = int(longer[j])
        if not n:
            break
        u = masks[at[:n] + codes[j][y[:n]]]
        v = s[:n]
        u &= v
        if keep:
            u &= one[:n]
            u &= -(two[:n] >> U(j) & U(1))
        w = v + u
        v -= u
        v |= w
    out = np.empty(len(y), np.int64)
    out[order] = np.bitwise_count(~s)
    return out


def _similarity(x: _Texts, y: _Texts, lo: int, hi: int, i: np.ndarray, j: np.ndarray, letters: int) -> np.ndarray:
    """The greater of kernels.indel and kernels.token_set of texts i of x (from lo to hi) and texts j of y, to the last bit."""
    long = x.long[i] | y.long[j]
    out = np.zeros(len(i))
    for at in np.flatnonzero(long):
        one, two = x.texts[i[at]], y.texts[j[at]]
        out[at] = max(k.indel(one, two), k.token_set(one, two))
    if long.any():
        short = np.flatnonzero(~long)
        i, j = i[short], j[short]
    row = (i - lo) * letters
    with np.errstate(divide="ignore", invalid="ignore"):
        total = x.n[i] + y.n[j]
        ratio = np.where(total > 0, 2 * _lcs(_masks(x.codes, lo, hi, letters), row, y.codes, y.n, j) / total, 1.0)
        mine, theirs = [x.ids[a][i] for a in range(x.most)], [y.ids[c][j] for c in range(y.most)]
        shared = np.zeros((3, len(i)), np.int64)  # words, their characters
        used_x, used_y = np.zeros(len(i), U), np.zeros(len(i), U)
        met = [np.zeros(len(i), bool) for _ in theirs]
        for a, w in enumerate(mine):
            hit = np.zeros(len(i), bool)
            for c, v in enumerate(theirs):
                same = w == v
                hit |= same
                met[c] |= same
            shared[0] += hit
            shared[1] += np.where(hit, x.sizes[a][i], 0)
            used_x |= np.where(hit, x.spans[a][i], U(0))
        for c, hit in enumerate(met):
            used_y |= np.where(hit, y.spans[c][j], U(0))
        whole = lambda n: (U(1) << n.astype(U)) - U(1)
        keep_x, keep_y = whole(x.n_ordered[i]) & ~used_x, whole(y.n_ordered[j]) & ~used_y
        keep_x, keep_y = keep_x & (keep_x - U(1)), keep_y & (keep_y - U(1))
        n_x, n_y = np.bitwise_count(keep_x).astype(np.int64), np.bitwise_count(keep_y).astype(np.int64)
        some = shared[0] > 0
        both = shared[1] + np.maximum(shared[0] - 1, 0)
        gap = some.astype(np.int64)
        l_x, l_y = both + gap + n_x, both + gap + n_y
        rest = n_x + n_y - 2 * _lcs(_masks(x.ordered, lo, hi, letters), row, y.ordered, y.n_ordered, j, (keep_x, keep_y))
        best = 1 - rest / (l_x + l_y)
        best = np.where(some, np.maximum(best, np.maximum(1 - (gap + n_x) / (both + l_x), 1 - (gap + n_y) / (both + l_y))), best)
        best = np.where(some & ((n_x == 0) | (n_y == 0)), 1.0, best)
        best = np.where((x.count[i] == 0) | (y.count[j] == 0), 0.0, best)
    both_ways = np.maximum(ratio, best)
    if long.any():
        out[short] = both_ways
        return out
    return both_ways


def _expanded(lists: pa.ListArray, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of each listed id among ``values`` (-1: none), and where each list begins (one more entry)."""
    return pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _scored_part(t: pa.Table, trigger: int, top: int | None, largest: bool) -> Iterator[pa.RecordBatch]:
    """The scored pairs of one part; ``top``: of an anchor and source only so many, best first, ties by id."""
    kind = t["kind"].to_numpy()
    side = lambda n: t.filter(pa.array(kind == n))
    anchors, corpus, lists = side(0), side(1), side(2)
    if not len(anchors) or not len(corpus) or not len(lists):
        return
    ids, others = (x["id"].combine_chunks() for x in (anchors, corpus))
    of, of_at = _expanded(lists["anchors"].combine_chunks(), ids)
    found, found_at = _expanded(lists["candidates"].combine_chunks(), others)
    way, n = lists["way"].to_numpy(), len(others)
    line = np.repeat(np.arange(len(lists)), np.diff(of_at))
    order = np.argsort(of, kind="stable")[np.count_nonzero(of < 0) :]
    of, line = of[order], line[order]
    many = np.diff(found_at)[line]
    upto = np.concatenate([[0], np.cumsum(np.bincount(of, weights=many, minlength=len(ids)))])
    alphabet: dict[int, int] = {}
    text = lambda x, c: [v or "" for v in x[c].to_pylist()]
    sides = []
    for c in ("name_n", "addr_n"):
        words: dict[str, int] = {}
        sides.append((_Texts(text(anchors, c), alphabet, words, -1), _Texts(text(corpus, c), alphabet, words, -2)))
    letters = len(alphabet) + 1
    places = []
    for c, weight in (("postal", 18), ("state", 8), ("city", 5)):
        codes = pa.chunked_array([pc.fill_null(x[c].combine_chunks(), "") for x in (anchors, corpus)]).combine_chunks().dictionary_encode()
        empty = pc.index(codes.dictionary, "").as_py()  # -1: none
        codes = codes.indices.to_numpy()
        places.append((codes[: len(ids)], codes[len(ids) :], empty, weight))
    if top is not None:
        place = np.empty(n, np.int64)
        place[pc.array_sort_indices(others, order="descending" if largest else "ascending").to_numpy()] = np.arange(n)
        source = pc.list_element(pc.split_pattern(others, "-"), 0).dictionary_encode().indices.to_numpy()
    lo = 0
    while lo < len(ids):
        hi = min(lo + MOST, max(lo + 1, int(np.searchsorted(upto, upto[lo] + STEP, "right")) - 1))
        f, g = np.searchsorted(of, [lo, hi])
        rows, count = line[f:g], many[f:g]
        first = np.repeat(found_at[rows] - (np.cumsum(count) - count), count)
        theirs = found[first + np.arange(len(first))]
        pairs, ways = (np.repeat(of[f:g], count) * n + theirs)[theirs >= 0], np.repeat(way[rows], count)[theirs >= 0]
        core = np.unique(pairs[ways == _CORE])
        enough = np.bincount(core // n - lo, minlength=hi - lo) >= trigger
        more = pairs[(ways == _OTHER) | (ways == _APPROXIMATE) & ~enough[pairs // n - lo]]
        pairs = np.setdiff1d(np.union1d(core, more), pairs[ways == _LEFT_OUT], assume_unique=True)
        i, j = np.divmod(pairs, n)
        name, address = (100 * _similarity(x, y, lo, hi, i, j, letters) for x, y in sides)
        score = 0.58 * name + 0.27 * address
        for x, y, empty, weight in places:
            score += np.where((x[i] == y[j]) & (x[i] != empty), weight, 0)
        second = name + address
        if top is not None:
            order = np.lexsort((place[j], -second, -score, source[j], i))
            group = i[order] * (int(source.max()) + 1) + source[j[order]]
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            order = order[rank < top]
            i, j, score, second = i[order], j[order], score[order], second[order]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), others.take(pa.array(j)), pa.array(score), pa.array(second)], ["s1", "candidate", "score", "second"])
        lo = hi


def scored_candidates(keyed: DataFrame, per_key: int = 30, trigger: int = 20, left_out: DataFrame | None = None, top: int | None = None, largest: bool = False) -> DataFrame:
    """(s1, candidate, score, second): the pairs of ``route_pairs`` over all routes, each once, with the values of ``ranked``.

    ``left_out``: pairs (s1, candidate) to leave out. ``top``: return an anchor's first so many of each source only, by score,
    second, then the smallest id (the largest, if ``largest``); what is not returned was scored all the same. Ids of records are distinct.
    """
    anchors, corpus = keyed.where("source = 'S1'"), keyed.where("source <> 'S1'")
    # anchors of one country and name stand together, as they ask for the same candidates
    parts = max(1, -(-anchors.count() // ANCHORS))
    near = anchors.select("entity_id", "country_key", "state", "city", F.try_element_at("name_tokens", F.lit(1)).alias("name"))
    near = near.repartitionByRange(parts, "country_key", "state", "city", "name", "entity_id") if parts > 1 else near.coalesce(1)
    part_of = index.stored(near.select("entity_id", F.spark_partition_id().alias("part")))
    anchors = anchors.join(part_of, "entity_id")
    # one short text for route, slot and key; the route's letter comes first
    letter = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(b.ROUTES) for x in (r, chr(65 + i))]), F.col("route"))
    short = lambda x, *more: x.select("entity_id", "source", *more, F.concat(letter, "slot", F.lit("\u0002"), "key").alias("key"))
    asked = short(b.block_keys(anchors, True), "part").groupBy("key", "part").agg(F.collect_set("entity_id").alias("anchors"))
    held = b.capped(short(b.block_keys(corpus, False)), per_key, ("key",)).groupBy("key", "source").agg(F.collect_set("entity_id").alias("candidates"))
    way = F.when(F.substring("key", 1, 1).isin(*[chr(65 + i) for i, r in enumerate(b.ROUTES) if r.startswith("approximate")]), _APPROXIMATE).when(F.substring("key", 1, 1).isin(*[chr(65 + b.ROUTES.index(r)) for r in b.CORE]), _CORE).otherwise(_OTHER)
    lists = index.stored(asked.join(held, "key").select("part", way.cast("int").alias("way"), "anchors", "candidates"))
    wanted = lists.select("part", F.explode("candidates").alias("entity_id")).distinct()
    record = lambda x, kind: x.select("part", F.lit(kind).alias("kind"), F.col("entity_id").alias("id"), *_FIELDS)
    rows = record(anchors, 0).union(record(wanted.join(corpus, "entity_id"), 1)).unionByName(lists.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if left_out is not None:
        pairs = left_out.join(part_of.withColumnRenamed("entity_id", "s1"), "s1").select("part", F.lit(2).alias("kind"), F.lit(_LEFT_OUT).alias("way"), F.array("s1").alias("anchors"), F.array("candidate").alias("candidates"))
        rows = rows.unionByName(pairs, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            p = batch["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)] if len(p) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[0]["part"][0].as_py() != int(p[lo]):
                    yield from _scored_part(pa.Table.from_batches(held), trigger, top, largest)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _scored_part(pa.Table.from_batches(held), trigger, top, largest)

    return rows.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(run, SCORED)
