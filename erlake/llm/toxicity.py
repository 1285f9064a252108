"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index, distance-weighted votes.

``fit`` takes at most ``per_class`` labelled examples of each class (those with the smallest hash of their id; the one
bounded sample here) and keeps every word that any of them holds; document frequencies are counted over all documents. A search
adds up all posting lists of a text's words (long lists as rows of a matrix, many texts at a time), so its neighbours are exact.
The neighbours' vote, the text's TF-IDF vector times each word's signed chi-squared (all words take part) and the largest chi-squared
of its words are calibrated
on the examples themselves, each without itself, at the class rates of all labelled rows; a document that is an example is
scored in the same way, by the others alone, so that no score sees its own label. Words that no example holds have no place in the vectors, nor in their lengths.

Defined cases: null and empty texts and texts without any word of the examples get the rate of toxic examples among such texts; ties
in cosine go to the example that stands first in the index; a null label or id is no example, and of several labels of a
document the largest holds; without examples of both classes the score is the rate of the class there is (0 for
no labels); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched, tee

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .common import U

PER_CLASS = 4000
K = 25
#: Words that more than this share of the examples hold are rows of a matrix; so many texts are multiplied with it at once.
DENSE, BATCH = 0.125, 64
#: Words are runs of ASCII letters, digits and any byte of other characters.
WORD = np.zeros(256, bool)
WORD[128:] = WORD[48:58] = WORD[65:91] = WORD[97:123] = True


def term_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the names of its distinct words and how often each occurs."""
    data, at = c.byte_parts(pc.utf8_lower(texts.fill_null("")))
    for i, j in c.steps(at):
        part = data[at[i] : at[j]]
        s, e, first = c.word_bounds(part, at[i : j + 1] - at[i], WORD)
        names = c.word_names(part, s, e)
        for k in range(j - i):
            yield np.unique(names[first[k] : first[k + 1]], return_counts=True)


class Index:
    """The examples' posting lists, and the calibration of their votes."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, ids: np.ndarray, rate: float, terms: np.ndarray, df: np.ndarray, total: int) -> None:
        n, pos = len(docs), max(1, int(label.sum()))
        neg = max(1, n - pos)
        self.terms, self.idf = terms, np.log((1 + total) / (1 + df)) + 1
        self.rate = rate
        vectors = [self.vector(*x) for x in docs]
        order = [i for i in range(n) if len(vectors[i][0])]
        self.label, self.ids = label[order].astype(float), ids[order]
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        example = np.repeat(np.arange(len(order), dtype=np.int32), np.array([len(vectors[i][0]) for i in order], np.int64))
        by = np.lexsort((example, term))
        term, self.example, self.weight = term[by], example[by], weight[by]
        self.cut = np.searchsorted(term, np.arange(len(terms))[:, None] + np.arange(2))
        # long lists as rows of a matrix
        held = self.cut[:, 1] - self.cut[:, 0]
        heavy = np.flatnonzero(held > DENSE * len(order))
        self.row = np.full(len(terms), -1, np.int64)
        self.row[heavy] = np.arange(len(heavy))
        self.dense = np.zeros((len(heavy), len(order)))
        at = self.row[term] >= 0
        self.dense[self.row[term[at]], self.example[at]] = self.weight[at]
        # calibration at the population's class rates
        share = np.where(label == 1, rate / pos, (1 - rate) / neg)
        bare = np.array([len(v[0]) == 0 for v in vectors], bool)
        prior = 1e-3
        self.bare = float((share[bare & (label == 1)].sum() + prior * rate) / (share[bare].sum() + prior)) if n else rate
        y = label[order]
        self.held, self.toxic, self.pos, self.neg = held, np.bincount(term[y[self.example] == 1], minlength=len(terms)), int(y.sum()), int((1 - y).sum())
        self.chi, votes = _signed_chi(self.toxic, held - self.toxic, self.pos, self.neg), []
        near = self.cosines(self.without_itself(*vectors[i]) for i in order)
        for place, (i, x) in enumerate(zip(order, near)):
            votes.append((self.vote(*self.nearest(x, place)), *self.lean(*vectors[i], place)))
        self.places = {int(x): k for k, x in enumerate(self.ids)}
        self.slope, self.shift = _logistic(np.array(votes), label[order].astype(float), share[order]) if len(votes) > 1 else (np.zeros(3), _logit(rate))

    def vector(self, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and TF-IDF weights, of length 1, of the words that any example holds."""
        if not len(self.terms) or not len(names):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.searchsorted(self.terms, names)
        at[at == len(self.terms)] = 0
        ok = self.terms[at] == names
        at, w = at[ok], (1 + np.log(counts[ok])) * self.idf[at[ok]]
        return at, w / max(float(np.sqrt((w * w).sum())), 1e-12)

    def without_itself(self, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An example's vector as it would be were it no example: its own words would not be known."""
        more = self.held[t] > 1
        t, w = t[more], w[more]
        return t, w / max(float(np.sqrt((w * w).sum())), 1e-12)

    def lean(self, t: np.ndarray, w: np.ndarray, place: int = -1) -> tuple[float, float]:
        """The vector times signed chi-squared, and the largest among its words; those of the other examples for the example at ``place``."""
        chi = self.chi[t]
        if place >= 0:
            y = int(self.label[place])
            a, b = self.toxic[t] - y, (self.held - self.toxic)[t] - (1 - y)
            chi = _signed_chi(np.maximum(a, 0), np.maximum(b, 0), self.pos - y, self.neg - (1 - y))
        return float(np.arcsinh(w @ chi)), float(np.arcsinh(chi.max(initial=0)))

    def cosines(self, vectors: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """For each vector its cosine with every example."""
        for part in batched(vectors, BATCH):
            rows = [self.row[t] for t, _ in part]
            heavy = np.zeros((len(part), len(self.dense)))
            for i, (r, (_, w)) in enumerate(zip(rows, part)):
                heavy[i, r[r >= 0]] = w[r >= 0]
            out = heavy @ self.dense
            for r, (t, w), total in zip(rows, part, out):
                cut, w = self.cut[t[r < 0]], w[r < 0]
                size = cut[:, 1] - cut[:, 0]
                at = np.repeat(cut[:, 0] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                total += np.bincount(self.example[at], weights=self.weight[at] * np.repeat(w, size), minlength=len(total))
                yield np.round(total, 12)

    def nearest(self, cosines: np.ndarray, skip: int = -1, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above 0: (places, cosines) by falling cosine."""
        if skip >= 0:
            cosines[skip] = 0
        least = np.partition(cosines, -k)[-k] if len(cosines) > k else 0
        places = np.flatnonzero((cosines >= least) & (cosines > 0))
        best = places[np.lexsort((places, -cosines[places]))[:k]]
        return best, cosines[best]

    def search(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest(next(self.cosines([(terms, weights)])), skip, k)

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Mean label by closeness, as log odds; each neighbour weighs its cosine squared."""
        w = cosines**2
        return _logit((float((w * self.label[places]).sum()) + 0.02) / (float(w.sum()) + 0.04))

    def scores(self, ids: Iterable[int | None], docs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[tuple[int, float, int]]]]:
        """Score and evidence of each document; a document that is an example itself is scored by the other examples alone."""
        mine, again = tee((self.places.get(i, -1), *self.vector(*d)) for i, d in zip(ids, docs))
        for (place, t, w), x in zip(again, self.cosines(self.without_itself(t, w) if place >= 0 else (t, w) for place, t, w in mine)):
            places, cosines = self.nearest(x, place)
            if not len(places):
                yield self.bare, []
                continue
            z = float(self.slope @ np.array([self.vote(places, cosines), *self.lean(t, w, place)])) + self.shift
            yield float(1 / (1 + np.exp(-z))), [(int(self.ids[p]), round(float(x), 6), int(self.label[p])) for p, x in zip(places[:3], cosines)]


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def _signed_chi(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Chi-squared of words that a toxic and b other examples hold; below 0 for words of the others."""
    a, b, n = a.astype(float), b.astype(float), pos + neg
    lean = a * neg - b * pos
    return np.where(a + b > 0, n * lean * np.abs(lean) / np.maximum((a + b) * (n - a - b) * pos * neg, 1e-9), 0) if pos and neg else np.zeros(len(a))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift by Newton's method on the weighted likelihood, with a weak prior."""
    w = w / w.sum() * len(x)
    x = np.column_stack([x, np.ones(len(x))])
    prior = np.array([1.0, *[0.0] * (x.shape[1] - 1)])
    a = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        v = w * p * (1 - p)
        step = np.linalg.solve((x * v[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), x.T @ (w * (p - y)) + 0.1 * (a - prior))
        a = a - step
        if np.abs(step).max() < 1e-8:
            break
    return a[:-1], float(a[-1])


def held_out(doc_id: str = "doc_id"):
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5) == 0


def fit(df: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Index:
    """The index over at most ``per_class`` examples a class, from labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    given = c.documents(df).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    rows = given.mapInArrow(_counted, "doc_id long, y int, names array<long>, counts array<int>").toArrow().sort_by([("doc_id", "ascending")])
    total = max(1, sum(counts.values()))
    found = [(np.asarray(x.values).view(np.uint64), np.asarray(n.values)) for x, n in zip(rows.column("names"), rows.column("counts"))]
    terms = np.unique(np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)]))
    df_, n = document_frequencies(c.documents(df).select("text"), terms)
    index = Index(found, rows.column("y").to_numpy().astype(int), rows.column("doc_id").to_numpy(), counts.get(1, 0) / total, terms, df_, n)
    del rows, found
    c.give_back()
    return index


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, y and the words' names and counts of each text: the driver never sees whole texts."""
    for b in batches:
        got = list(term_counts(b.column(2)))
        cut = pa.array(np.cumsum([0, *(len(x) for x, _ in got)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))) for x, t in ((([c.signed(x) for x, _ in got]), np.int64), ([n for _, n in got], np.int32))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc_id", "y", "names", "counts"])


def document_frequencies(texts: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of the texts hold each of ``terms`` (sorted names), and the number of texts."""
    if not len(terms):
        return np.zeros(0, np.int64), 0
    held = texts.sparkSession.sparkContext.broadcast(terms)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        count, n = np.zeros(len(terms) + 1, np.int64), len(terms)
        for b in batches:
            count[n] += b.num_rows
            data, at = c.byte_parts(pc.utf8_lower(b.column(0)))
            for i, j in c.steps(at):
                part = data[at[i] : at[j]]
                s, e, first = c.word_bounds(part, at[i : j + 1] - at[i], WORD)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                names, word = np.unique(c.word_names(part, s, e), return_inverse=True)
                place = np.searchsorted(terms, names)
                place[place == n] = 0
                place = np.where(terms[place] == names, place, -1)[word]
                seen = np.unique(doc[place >= 0] * n + place[place >= 0]) % n
                count[:n] += np.bincount(seen, minlength=n)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["place", "n"])

    got = texts.mapInArrow(emit, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[got.column("place").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def score_toxicity(df: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence (id, cosine, label of the three nearest examples) of every row."""
    held = df.sparkSession.sparkContext.broadcast(index)  # bounded by PER_CLASS examples and their words

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in batches:
            got = list(index.scores(b.column(0).to_pylist(), term_counts(b.column(1))))
            evidence = pa.array([[{"doc_id": i, "cosine": x, "label": y} for i, x, y in e] for _, e in got], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    return c.documents(df).mapInArrow(emit, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")


def drop_toxic(df: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with the columns of ``df``."""
    index = df.sparkSession.sparkContext.broadcast(fit(df, labels))
    c.give_back()
    col, own, schema = df.columns.index("text"), df.columns.index("doc_id"), df.schema

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [x < threshold for x, _ in index.value.scores(b.column(own).to_pylist(), term_counts(b.column(col)))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(emit, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, c.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("evidence").alias("evidence"))
