"""Suffix-array dedup by bucket-pointer refinement, for repeated byte strings of a fixed length.

Suffixes start in buckets of their q-grams (``repeats``: those at anchors; a bucket of one is settled at once and goes no
further). ``refine`` sorts the suffixes of a bucket by the bucket identifiers that stand q bytes later, which halves the
depth still to sort each time: 64, 128, then ``length`` bytes; each pass reads the identifiers that the pass before it
has updated. Identifiers that the same pass has updated already aren't read: they stand for more bytes than those of the pass before,
and would part suffixes that agree in ``length`` bytes but not beyond. Two suffixes end in one bucket exactly if they agree
in ``length`` bytes. A task sorts many buckets at once. A bucket of more than ``HOT`` contents isn't sorted in one task: its suffixes are named by a digest of all
``length`` bytes and grouped by name over the whole cluster, which leaves the same buckets.

``suffix_dedup`` removes each byte that a string of ``length`` bytes covers which also starts anywhere else, the same
document included. Matches never cross documents; all strings are judged on the input.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose none; two rows with one text lose
all of it (if long enough), also if they share a doc_id; a null doc_id is kept as null; an empty table gives an
empty result; other columns are ignored, whatever their names. Removed runs may cut a character of several bytes, so the
operator returns the kept bytes as binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import repeats as r
from .common import U

#: Contents in a bucket beyond which it isn't sorted within one task.
HOT = 256
#: Bytes of contents that a task sorts at once.
SORT_BYTES = 6_000_000

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _pointers(key: np.ndarray) -> np.ndarray:
    """For each key, where its bucket starts in sorted order."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    out = np.empty(len(k), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return out


def refine(bucket: np.ndarray, kept: np.ndarray, at: np.ndarray, later: int) -> None:
    """One pass over the suffixes ``at``: sorted by (bucket, bucket ``later`` bytes on), read from ``kept``, written to ``bucket``.

    A suffix alone in its bucket is settled: it isn't sorted again.
    """
    size = np.bincount(kept[at], minlength=len(kept))
    alone = size[kept[at]] == 1
    live = at[~alone]
    bucket[:] = -1
    bucket[at[alone]] = len(kept) + np.flatnonzero(alone)
    if len(live):
        bucket[live] = _pointers((kept[live].astype(np.uint64) << U(32)) | kept[live + later].astype(np.uint64))


def repeated(data: np.ndarray, at: np.ndarray, weight: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of ``length`` bytes within the contents ``data[at[i]:at[i + 1]]`` occur twice: (content, start in it).

    ``weight`` has how often each content occurs.
    """
    grams = r.depth_names(c.mix((data.astype(np.uint64) + U(77)) * c._A), (q,))[q]
    bucket = _pointers(grams)
    size = np.diff(at)
    depth = q
    while depth < length:
        more = min(depth, length - depth)
        room = np.maximum(size - (depth + more) + 1, 0)
        doc = np.repeat(np.arange(len(room)), room)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + at[:-1][doc]
        # reads are of the last pass: positions beyond a content's last full string of this depth keep old pointers
        kept = bucket.copy()
        refine(bucket, kept, pos, more)
        depth += more
    own = bucket[pos]
    total = np.bincount(own, weights=weight[doc].astype(float), minlength=len(data) + 1)
    twice = total[own] >= 2
    return doc[twice], (pos - at[:-1][doc])[twice]


def sorted_windows(rows: DataFrame, w: r.Windows) -> DataFrame:
    """(doc, th, s) of the repeated strings of contents that occur once, from the content rows of buckets that fit a task."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        docs, ths, starts, ns, contents = zip(*held)
        at = np.r_[0, np.cumsum([len(x) for x in contents])]
        n = np.array(ns)
        k, s = repeated(np.frombuffer(b"".join(contents), np.uint8), at, n, w.length, w.q)
        k, s = k[n[k] == 1], s[n[k] == 1]
        return pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[k]), pa.array(np.array(ths, np.int64)[k]), pa.array((np.array(starts, np.int64)[k] + s).astype(np.int32))], ["doc", "th", "s"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for g, *row in zip(*(x.to_pylist() for x in b.columns)):
                if size > SORT_BYTES and g != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[-1])
                last = g
        if held:
            yield solve(held)

    given = rows.where("content IS NOT NULL").select("g", "doc", "th", "s", "n", "content")
    return given.repartition("g").sortWithinPartitions("g").mapInArrow(emit, "doc long, th long, s int")


def removed_spans(docs: DataFrame, w: r.Windows, bits: int, hot: int) -> DataFrame:
    """(doc, th, s, e): runs of bytes to remove, perhaps overlapping."""
    ranges = r.judged(r.candidate_ranges(docs, w, bits))
    whole = ranges.where("n > 1").select("doc", "th", F.col("lo").alias("s"), (F.col("hi") + w.length).alias("e"))
    first = ranges.where("n_contents > 1 AND top.doc = doc AND top.th = th AND top.lo = lo").withColumn("named", F.lit(False))
    rows = r.window_rows(docs, first, w)
    end = (F.col("s") + w.length).alias("e")
    cold = sorted_windows(rows.where(F.col("n_contents") <= hot), w).select("doc", "th", "s", end)
    return whole.union(cold).union(hot_spans(rows.where(F.col("n_contents") > hot), w))


def hot_spans(rows: DataFrame, w: r.Windows) -> DataFrame:
    """(doc, th, s, e) of the repeated strings of contents that occur once, from buckets too large for a task.

    Two more rounds of refinement over the cluster: by the pieces of ``slots``, then, within pieces whose core several
    contents share, by single strings. Equal pieces settle all their strings, so only strings at the edges of what
    the bucket shares reach the last round.
    """
    pieces = r.slots(rows, w)
    contents = c.stored(pieces.groupBy("w1", "w2").agg(F.sum("n").alias("total"), F.min(F.struct("doc", "th", "s")).alias("top"), F.min("core").alias("core")))
    cores = c.stored(contents.groupBy("core").agg(F.count("*").alias("n_pieces")).where("n_pieces > 1").select("core", F.lit(True).alias("mixed")))
    contents = c.stored(contents.join(cores, "core", "left").select("w1", "w2", "total", "top", F.coalesce("mixed", F.lit(False)).alias("mixed")))
    pieces = c.stored(pieces.drop("core").join(contents, ["w1", "w2"]))
    whole = pieces.where("n = 1 AND total > 1").select("doc", "th", "s", (F.col("s") + F.length("content")).alias("e"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            doc, th, s, n, content = b.columns
            size = [len(x) - w.length + 1 for x in content.to_pylist()]
            at = np.repeat(np.arange(len(size)), size)
            step = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[i : i + w.length]) for x, k in zip(content.to_pylist(), size) for i in range(k)), np.int64).reshape(-1, 2)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([doc.take(take), th.take(take), pa.array((s.to_numpy()[at] + step).astype(np.int32)), n.take(take), pa.array(names[:, 0]), pa.array(names[:, 1])], ["doc", "th", "s", "n", "w1", "w2"])

    named = c.stored(pieces.where("mixed AND top.doc = doc AND top.th = th AND top.s = s").select("doc", "th", "s", F.col("total").alias("n"), "content").mapInArrow(emit, "doc long, th long, s int, n long, w1 long, w2 long"))
    often = c.stored(named.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2"))
    return whole.union(named.where("n = 1").join(often, ["w1", "w2"]).select("doc", "th", "s", (F.col("s") + w.length).alias("e")))


def suffix_dedup(df: DataFrame, length: int = 200, q: int = 64, bits: int = r.SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of ``df``."""
    w = r.Windows("bytes", length, q)
    docs = r.keyed(df)
    joined = r.removal(docs, removed_spans(docs, w, bits, hot))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ss, ee = b.column(0), b.column(2), b.column(3)
            data, at = c.byte_parts(b.column(1))
            out: list[list] = [[], [], [], [], []]
            for k in range(len(ids)):
                text = data[at[k] : at[k + 1]]
                gone = spans = 0
                if ss[k].is_valid:
                    dead = r.covered(ss[k].values.to_numpy(), ee[k].values.to_numpy(), len(text))
                    gone, spans = int(dead.sum()), int(dead[0]) + int((dead[1:] & ~dead[:-1]).sum())
                    text = text[~dead]
                kept = text.tobytes()
                for x, y in zip(out, (int(at[k + 1] - at[k]), gone, spans, c.sha256(kept), kept)):
                    x.append(y)
            types = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, SCHEMA)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(c.table(spark, sf_dir, "documents")).drop("kept")


def brute_force(rows: list[tuple[int | None, str | None]], length: int = 200) -> list[tuple]:
    """The same by comparing all strings in memory."""
    from collections import Counter

    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        dead = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                dead[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~dead])
        out.append((d, len(t), int(dead.sum()), sum(1 for i in range(len(t)) if dead[i] and not (i and dead[i - 1])), c.sha256(kept)))
    return out
