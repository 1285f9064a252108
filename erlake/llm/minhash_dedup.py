"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five consecutive words (all words, where there are fewer); its weight is its count times the inverse document
frequency of its hash cell, ``log((1 + N) / (1 + df)) + 1`` over ``2**DF_BITS`` cells, counted over all documents. Each text
gets ``BANDS * ROWS`` samples; two texts agree in one with the probability of their weighted Jaccard similarity, so a pair at
0.8 meets in some band with probability 0.997 (8 bands of 3). In every band's bucket all members are compared with a
leader, chosen by hash; a second round compares members that aren't yet in their leader's
class with another leader of the bucket. Buckets of any size so cost a pair a member. What is left are buckets with
several classes. Their members are described by what sets them apart from the leader, and only those pairs of different
classes are compared whose differences can cancel out far enough (``left_over``); all other pairs are proven to be below
``threshold``. So each pair that meets in a band is compared, in one class already, or ruled out exactly; no cap drops any.
Only pairs whose exact weighted Jaccard is ``threshold`` or more link.

Defined cases: identical texts are one class (if they have a word); null and empty texts and null ids link with nothing
(a null id has a null class and is kept); rows that share a doc_id are one document, with
the text whose digest is the smallest; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c
from .common import U
from .toxicity import WORD

WORDS, DF_BITS, BANDS, ROWS = 5, 21, 8, 3
#: So many ids (of 8 bytes) at most are broadcast to filter texts before a join; beyond, all texts are shuffled.
FEW = 2_000_000
#: Room for rounding where a pair is ruled out without a comparison.
SLACK = 1e-6
_BLOCK_BITS = 15
_LOG = -np.log((np.arange(65536, dtype=np.float32) + np.float32(0.5)) / np.float32(65536))
_SEEDS = c.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * c._A)[:, None]


def shingles(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles' names and counts."""
    data, at = c.byte_parts(pc.utf8_lower(texts))
    for i, j in c.steps(at):
        part = data[at[i] : at[j]]
        s, e, first = c.word_bounds(part, at[i : j + 1] - at[i], WORD)
        names = c.word_names(part, s, e)
        if len(names) >= WORDS:
            two = c.pair(names[:-1], names[1:])
            five = c.pair(c.pair(two[:-2], two[2:])[:-1], names[4:])
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= WORDS:
                yield np.unique(five[a : b - WORDS + 1], return_counts=True)
            elif b > a:
                one = names[a : a + 1]
                for x in range(a + 1, b):
                    one = c.pair(one, names[x : x + 1])
                yield one, np.ones(1, np.int64)
            else:
                yield names[:0], np.zeros(0, np.int64)


def _cell(names: np.ndarray) -> np.ndarray:
    return (names >> U(64 - DF_BITS)).astype(np.int64)


def idf_cells(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies by hash cell, over all documents; the table's size doesn't depend on the data."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << DF_BITS, np.int64), 0
        for b in batches:
            held, size = [], 0
            for names, _ in shingles(b.column(0)):
                held.append(_cell(names))
                size += len(names)
                n += 1
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=1 << DF_BITS)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=1 << DF_BITS)
        if n:
            blocks = total.astype(np.uint32).reshape(-1, 1 << _BLOCK_BITS)
            some = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*(zlib.compress(blocks[k].tobytes(), 1) for k in some), zlib.compress(np.array([n], np.uint32).tobytes())], pa.binary())], ["block", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
                held[k] = held[k] + x if k in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "n"])

    df, n = np.zeros((1 << (DF_BITS - _BLOCK_BITS), 1 << _BLOCK_BITS), np.int64), 0
    for row in docs.select("text").mapInArrow(partial, "block int, n binary").repartition("block").mapInArrow(merge, "block int, n binary").collect():
        x = np.frombuffer(row.n, np.int64)
        if row.block < 0:
            n += int(x[0])
        else:
            df[row.block] += x
    return (np.log((1 + n) / (1 + np.minimum(df.ravel(), n))) + 1).astype(np.float32)


def samples(names: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The consistent weighted samples of one set, one name for each seed."""
    k = len(_SEEDS)
    best, out = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
    logs = np.log(weights.astype(np.float32))
    row = np.arange(k)
    for i in range(0, len(names), 4096):
        part, lw = names[i : i + 4096], logs[i : i + 4096]
        h = c.mix(part[None, :] ^ _SEEDS)
        u = h.view(np.uint16).reshape(k, len(part), 4)
        r = _LOG[u[:, :, 0]] + _LOG[u[:, :, 1]]
        t = lw / r
        beta = ((h * U(0xD6E8FEB86659FD93)) >> U(48)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(t + beta)
        a = np.log(_LOG[u[:, :, 2]] + _LOG[u[:, :, 3]]) - r * (t - beta) - r
        at = a.argmin(axis=1)
        low = a[row, at]
        new = low < best
        best[new] = low[new]
        out[new] = c.pair(part[at[new]], t[row, at][new].astype(np.int64).astype(np.uint64))
    return out


def sketches(docs: DataFrame, idf) -> DataFrame:
    """doc, h1, h2 (of the text) and its bands' keys, for texts with a word."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for b in batches:
            rows, keys = [], []
            for k, (names, n) in enumerate(shingles(b.column(3))):
                if len(names):
                    w = n * table[_cell(names)]
                    x = samples(names, w).reshape(BANDS, ROWS)
                    key = c.pair(c.pair(x[:, 0].copy(), x[:, 1]), x[:, 2]) + np.arange(BANDS, dtype=np.uint64)
                    rows.append(k)
                    keys.append(c.signed(key))
            if rows:
                take = pa.array(rows, pa.int64())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), bands], ["doc", "h1", "h2", "bands"])

    given = docs.select("doc", F.xxhash64("text").alias("h1"), F.hash("text").cast("long").alias("h2"), "text")
    return given.mapInArrow(emit, "doc long, h1 long, h2 long, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two sets (names, counts) under the cells' weights."""
    wa, wb = a[1] * idf[_cell(a[0])].astype(float), b[1] * idf[_cell(b[0])].astype(float)
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = float(np.minimum(wa[same], wb[at[same]]).sum())
    total = float(wa.sum() + wb.sum()) - both
    return both / total if total > 0 else 0.0


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` for joins with the ids (doc, stored): where these are few, their broadcast spares the others a shuffle."""
    return texts.join(F.broadcast(ids), "doc", "left_semi") if ids.count() <= FEW else texts


def compared(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) with their weighted Jaccard ``sim``; ``texts``: stored (doc, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, left = idf.value, None, None
        for b in batches:
            sim = []
            x = b.column(0).to_pylist()
            for k, right in enumerate(shingles(b.column(3))):
                if x[k] != last:
                    last, left = x[k], next(iter(shingles(b.column(2).slice(k, 1))))
                sim.append(weighted_jaccard(left, right, table))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    of_a, of_b = (of_ids(texts, c.stored(pairs.select(F.col(k).alias("doc")).distinct())) for k in ("a", "b"))
    with_b = pairs.join(of_b.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    with_a = with_b.join(of_a.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    return with_a.select("a", "b", "ta", "tb").mapInArrow(emit, "a long, b long, sim double")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _elements(names: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A weighted set as a plain one: the second occurrence of a shingle is an element of its own. Names and weights, by name."""
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    every = np.repeat(names, n)
    weight = idf[_cell(every)].astype(float)
    more = nth > 0
    every[more] = c.pair(every[more], nth[more].astype(np.uint64))
    order = np.argsort(every)
    return every[order], weight[order]


APART = "at long, node long, root long, main long, w double, d double, extra array<struct<name:long,weight:double>>, missing array<struct<name:long,weight:double>>"


def differences(members: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """``members`` (at: the leader, node, root, main) with the node's weight w, the elements that it has besides the leader's and those it lacks, and their weight d."""

    def lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
        cut = np.cumsum([0, *(len(x) for x, _ in parts)]).astype(np.int32)
        both = [np.concatenate([np.zeros(0, t), *x]) for x, t in zip(zip(*parts), (np.uint64, float))]
        return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(c.signed(both[0])), pa.array(both[1])], ["name", "weight"]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, left = idf.value, None, None
        for b in batches:
            extra, missing, own, apart = [], [], [], []
            for k, (leader, (right, n)) in enumerate(zip(b.column(0).to_pylist(), shingles(b.column(5)))):
                if leader != last:
                    last, left = leader, _elements(*next(iter(shingles(b.column(4).slice(k, 1)))), table)
                x, wx = _elements(right, n, table)
                new, gone = ~np.isin(x, left[0], assume_unique=True), ~np.isin(left[0], x, assume_unique=True)
                extra.append((x[new], wx[new]))
                missing.append((left[0][gone], left[1][gone]))
                own.append(float(wx.sum()))
                apart.append(float(wx[new].sum() + left[1][gone].sum()))
            if own:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(own), pa.array(apart), lists(extra), lists(missing)], ["at", "node", "root", "main", "w", "d", "extra", "missing"])

    of_node, of_at = (of_ids(texts, c.stored(members.select(F.col(k).alias("doc")).distinct())) for k in ("node", "at"))
    with_node = members.join(of_node.select(F.col("doc").alias("node"), F.col("text").alias("tn")), "node")
    both = with_node.join(of_at.select(F.col("doc").alias("at"), F.col("text").alias("tl")), "at")
    return both.select("at", "node", "root", "main", "tl", "tn").mapInArrow(emit, APART)


def left_over(members: DataFrame, texts: DataFrame, root: DataFrame, tried: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs (a, b) that meet under one leader, aren't in one class and could still link.

    ``members``: band, key, node and its leader; ``tried``: compared pairs. All is counted from the leader: D(x) are the elements that
    x and the leader don't share. x and y link if what D(x) and D(y) don't share weighs at most q (w(x) + w(y)), with q = (1 - t) / (1 + t).
    Of two classes one isn't the main one, so only elements that some odd node (of no main class) holds, and another node too, can be
    shared; let S(x) be the weight of those in D(x) and u(x) that of the others. So a link needs
    u(x) + u(y) + abs(S(x) - S(y)) <= q (w(x) + w(y)), or h <= g of the other for the one with the larger S,
    where h = S + u - q w and g = S - u + q w; nodes that meet no other class's extreme leave at once. Two nodes that share nothing
    of their D link only if both link with the leader, and then they are in one class. Any others share elements of weight
    (h(x) + h(y)) / 2 or more, so they meet at one before the point, in one order of all elements, where less than that is left of either.
    """
    q = (1 - threshold) / (1 + threshold)
    every = c.stored(members.select(F.col("leader").alias("at"), "node").distinct().join(root.select(F.col("id").alias("node"), "root"), "node", "left").select("at", "node", F.coalesce("root", "node").alias("root")))
    sizes = every.groupBy("at", "root").agg(F.count("*").alias("n"))
    several = c.stored(sizes.groupBy("at").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("n")).where("n > 1").select("at", F.col("top.root").alias("main")))
    apart = c.stored(differences(c.stored(every.join(several, "at").select("at", "node", "root", "main")), texts, idf).withColumn("who", F.monotonically_increasing_id()))
    odd = _spread(apart.where("root <> main"))
    keys = odd.select("key").distinct()
    held = c.stored(odd.union(_spread(apart.where("root = main")).join(keys, "key", "left_semi").select(odd.columns)))
    common = c.stored(held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    held = c.stored(held.join(common, "key"))
    rest = held.groupBy("who").agg(F.sum("weight").alias("s"))
    state = apart.select("who", "at", "node", "root", "main", "w", "d").join(rest, "who")
    state = c.stored(state.select("who", "at", "node", "root", "main", "w", "s", (F.col("d") - q * F.col("w")).alias("h"), (2 * F.col("s") - F.col("d") + q * F.col("w")).alias("g")))
    met = _meeting(_within_reach(state), held)
    return met.select(*_ordered("x", "y")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _spread(apart: DataFrame) -> DataFrame:
    """who, weight and key of every element that sets a node apart from its leader; a key names an element under one leader."""
    return apart.select("who", "at", F.explode(F.concat("extra", "missing")).alias("e")).select("who", "e.weight", F.xxhash64("at", "e.name").alias("key"))


def _within_reach(state: DataFrame) -> DataFrame:
    """Those that could link with the extremes of the other classes under their leader; ``low_h``: the least h of the others."""
    of_root = c.stored(state.groupBy("at", "root").agg(F.max("g").alias("g"), F.min("h").alias("h")))
    first = of_root.groupBy("at").agg(F.max(F.struct("g", "root")).alias("top"), F.min(F.struct("h", "root")).alias("low"))
    others = of_root.join(first, "at")
    second = others.groupBy("at").agg(F.max(F.when(F.col("root") != F.col("top.root"), F.col("g"))).alias("g2"), F.min(F.when(F.col("root") != F.col("low.root"), F.col("h"))).alias("h2"))
    both = first.join(second, "at")
    other = state.join(both, "at").withColumns({"high_g": F.when(F.col("root") != F.col("top.root"), F.col("top.g")).otherwise(F.col("g2")), "low_h": F.when(F.col("root") != F.col("low.root"), F.col("low.h")).otherwise(F.col("h2"))})
    slack = SLACK * F.col("w")
    return c.stored(other.where((F.col("h") <= F.col("high_g") + slack) | (F.col("g") >= F.col("low_h") - slack)).select(*state.columns, "low_h"))


def _meeting(active: DataFrame, held: DataFrame) -> DataFrame:
    """(x, y) of different classes that share an element early enough to link; ``held``: elements (who, weight, key) and how many nodes n hold them."""
    before = W.partitionBy("who").orderBy(F.desc("n"), F.desc("key")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rarer = W.partitionBy("who").orderBy("n", "key").rowsBetween(W.unboundedPreceding, -1)
    left = held.join(active.select("who"), "who", "left_semi").withColumn("left", F.sum("weight").over(before)).select("who", "n", "key", "left").join(active, "who")
    slack = SLACK * F.col("w")
    early = left.where((F.col("left") >= (F.col("h") + F.col("low_h")) / 2 - slack)).withColumn("past", F.collect_list("key").over(rarer))
    early = c.stored(early.select("key", "node", "root", "main", "w", "s", "h", "g", "left", "past"))
    odd = early.where("root <> main").select("key", *[F.col(k).alias(f"{k}_") for k in ("node", "root", "w", "s", "h", "g", "left", "past")])
    enough = F.least("left", "left_") >= (F.col("h") + F.col("h_")) / 2 - slack
    reach = F.when(F.col("s") >= F.col("s_"), F.col("g_") - F.col("h")).otherwise(F.col("g") - F.col("h_")) >= -slack
    once = (F.col("root") == F.col("main")) | (F.col("node_") < F.col("node"))  # of two odd ones the smaller asks
    first = ~F.arrays_overlap("past", "past_")  # a pair that shares several elements meets at the rarest
    return odd.join(early, "key").where((F.col("root") != F.col("root_")) & once & enough & reach & first).select(F.col("node_").alias("x"), F.col("node").alias("y"))


def classes(df: DataFrame, threshold: float = 0.8, rounds: int = 2) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (whether it is that) of every row."""
    spark = df.sparkSession
    docs = c.documents(df).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    idf = spark.sparkContext.broadcast(idf_cells(docs))
    c.give_back()
    found = c.stored(sketches(docs, idf).groupBy("doc").agg(F.min(F.struct("h1", "h2", "bands")).alias("of")).select("doc", "of.*"))
    # one node for each distinct text: its smallest id
    nodes = c.stored(found.groupBy("h1", "h2").agg(F.min(F.struct("doc", "bands")).alias("of")).select("h1", "h2", F.col("of.doc").alias("node"), "of.bands"))
    copies = found.select("doc", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("doc").alias("a"), F.col("node").alias("b")).where("a <> b")
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = c.stored(members.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(_draw(0)).alias("drawn")).where("n > 1").select("band", "key", F.col("drawn.node").alias("leader")))
    members = c.stored(members.join(shared, ["band", "key"]))
    wanted = c.stored(members.select("node").distinct().join(nodes.select("node", "h1", "h2"), "node"))
    given = of_ids(docs, c.stored(wanted.select(F.col("node").alias("doc"))))
    texts = c.stored(given.join(wanted.select(F.col("node").alias("doc"), "h1", "h2"), "doc").where((F.xxhash64("text") == F.col("h1")) & (F.hash("text") == F.col("h2"))).select("doc", "text").dropDuplicates(["doc"]))
    links, root, tried = copies, None, None
    for r in range(rounds + 1):
        if r == 0:
            pairs = members.where("node <> leader").select(*_ordered("node", "leader")).distinct()
        elif r < rounds:
            leaders = c.stored(members.groupBy("band", "key").agg(F.min(_draw(r)).alias("drawn")).select("band", "key", F.col("drawn.node").alias("other")))
            pairs = members.join(leaders, ["band", "key"]).where("node <> other").select(*_ordered("node", "other")).distinct()
            of = lambda x: root.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
            pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b").join(tried, ["a", "b"], "left_anti")
        else:
            pairs = left_over(members, texts, root, tried, idf, threshold)
        now = c.stored(compared(c.stored(pairs), texts, idf))
        tried = now if tried is None else tried.union(now)
        links = c.stored(links.union(now.where(F.col("sim") >= threshold).select("a", "b")))
        root = c.stored(c.components(links))
    all_ = c.documents(df).select("doc_id").join(root.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
    return all_.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _draw(r: int) -> Column:
    """The leader of a bucket is the node with the smallest of these; the same in all bands, so that a group's buckets share leaders."""
    return F.struct(F.xxhash64("node", F.lit(r)).alias("draw"), "node")


def one_of_each(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` that are kept, with the columns of ``df``."""
    gone = classes(df, threshold).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, df["doc_id"] == gone["_gone"], "left_anti")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(c.table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int | None, str | None]], threshold: float = 0.8) -> dict[int, int]:
    """doc_id to class_id by comparing all pairs in memory."""
    rows = [(d, t or "") for d, t in rows if d is not None]
    sets = list(shingles(pa.array([t for _, t in rows], pa.string())))
    df = np.zeros(1 << DF_BITS, np.int64)
    for names, _ in sets:
        np.add.at(df, _cell(names), 1)
    idf = (np.log((1 + len(rows)) / (1 + np.minimum(df, len(rows)))) + 1).astype(np.float32)
    root = {d: d for d, _ in rows}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and min(len(sets[i][0]), len(sets[j][0])) and weighted_jaccard(sets[i], sets[j], idf) >= threshold:
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in rows}
