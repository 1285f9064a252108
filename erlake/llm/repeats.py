"""Exact repeated windows of a corpus, by content-defined anchors; shared by substring dedup and suffix-array dedup.

A window of ``length`` tokens holds ``length - q + 1`` q-grams; its anchor is the leftmost of those with the smallest
name. Equal windows have their anchors at the same offset, so windows are compared only within a bucket of equal anchor
q-grams. Consecutive windows with one anchor form a range, about one for each ``(length - q + 1) / 2`` tokens, and the
work goes by ranges:

1. Every range's bucket goes into a count-min sketch (``sketch``). The estimate is never too low, so a range in a bucket
   estimated at 1 has no repeated window and goes no further.
2. The other ranges are grouped exactly by a 128-bit digest of their whole content. Equal contents decide all their
   windows at once.
3. Only in buckets with several different contents are single windows compared (``window_rows`` names them for a grouped
   count, ``bpr.refine`` sorts them within a task).

Nothing is sampled or capped: a full sketch only sends more ranges to step 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .common import U

#: Two rows of 2**SKETCH_BITS cells; the merged sketch is 2 * 2**SKETCH_BITS / 8 bytes (32 MB) whatever the input is.
SKETCH_BITS = 27
SKETCH_ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BLOCK_BITS = 20
_NULL_ID = (1 << 63) - 1

WHITE = np.ones(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = False


@dataclass(frozen=True)
class Windows:
    """What counts as a token, how many make a window, and the length of the anchor q-gram (a power of two)."""

    tokens: str  # "words" or "bytes"
    length: int
    q: int

    def read(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names of the tokens, first token of each document (one more entry), and tokens' byte bounds (words only)."""
        if self.tokens == "bytes":
            return c.mix((data.astype(np.uint64) + U(77)) * c._A), at, at, at
        s, e, first = c.word_bounds(data, at, WHITE)
        return c.word_names(data, s, e), first, s, e

    def content(self, data: np.ndarray, names: np.ndarray) -> tuple[memoryview, int]:
        """The bytes that stand for the tokens in digests, and how many stand for one."""
        return (memoryview(np.ascontiguousarray(data)), 1) if self.tokens == "bytes" else (memoryview(names.view(np.uint8)), 8)


def depth_names(names: np.ndarray, depths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Names of all substrings of the given lengths: a name of length 2d is that of the names at i and i + d."""
    out, d, x = {}, 1, names
    while True:
        for depth in depths:
            if d <= depth < 2 * d:
                out[depth] = x if depth == d else c.pair(x[: len(x) - (depth - d)], x[depth - d :])
        if 2 * d > max(depths):
            return out
        x = c.pair(x[:-d], x[d:])
        d *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    d = 1
    while 2 * d <= width:
        x = np.minimum(x[:-d], x[d:])
        d *= 2
    return np.minimum(x[: len(x) - (width - d)], x[width - d :]) if width > d else x


def ranges(names: np.ndarray, first: np.ndarray, w: Windows) -> tuple[np.ndarray, ...] | None:
    """(document, first start, last start, anchor, anchor's name) of every range, positions within the whole step."""
    if len(names) < w.length:
        return None
    grams = depth_names(names, (w.q,))[w.q]
    key = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    a = (_sliding_min(key, w.length - w.q + 1) & U(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(len(a) + 1, np.int32)
    long = np.flatnonzero(np.diff(first) >= w.length)
    if not len(long):
        return None
    fits[first[long]] += 1
    fits[first[long + 1] - w.length + 1] -= 1
    ok = np.cumsum(fits[:-1]) > 0
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | ~ok[:-1]
    new[first[long]] = True
    new &= ok
    lo = np.flatnonzero(new)
    last = np.zeros(len(a), bool)
    last[:-1] = new[1:] | ~ok[1:]
    last[-1] = True
    hi = np.flatnonzero(last & ok)
    return np.searchsorted(first, lo, "right") - 1, lo, hi, a[lo], grams[a[lo]]


def cells(names: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((names * U(SKETCH_ROWS[row])) >> U(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, w: Windows, bits: int = SKETCH_BITS) -> np.ndarray:
    """The merged count-min sketch, packed to one bit a cell: counted twice at least. Its size doesn't depend on the data."""
    block_bits = min(_BLOCK_BITS, bits)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            names, ids, values = np.concatenate(held), [], []
            held.clear()
            for r in range(len(SKETCH_ROWS)):
                got, n = np.unique(cells(names, r, bits), return_counts=True)
                cut = np.searchsorted(got, np.arange(1, 1 << (bits - block_bits)) << block_bits)
                inner = (got & ((1 << block_bits) - 1)).astype(np.uint32) | (np.uint32(1 << 31) * (n > 1).astype(np.uint32))
                for k, x in enumerate(np.split(inner, cut)):
                    if len(x):
                        ids.append(r << (bits - block_bits) | k)
                        values.append(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(values, pa.binary())], ["block", "cells"])

        for b in batches:
            data, at = c.byte_parts(b.column(0))
            for i, j in c.steps(at):
                names, first, _, _ = w.read(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if got := ranges(names, first, w):
                    held.append(got[4])
            if sum(map(len, held)) > 4_000_000:
                yield flush()
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), np.uint32)
                once, twice = held.setdefault(k, (np.zeros(1 << block_bits, bool), np.zeros(1 << block_bits, bool)))
                at = (x & np.uint32(0x7FFFFFFF)).astype(np.int64)
                twice[at] |= once[at] | (x >> np.uint32(31)).astype(bool)
                once[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(t).tobytes() for _, t in held.values()], pa.binary())], ["block", "cells"])

    merged = docs.select("text").mapInArrow(partial, "block int, cells binary").repartition("block").mapInArrow(merge, "block int, cells binary")
    out = np.zeros((len(SKETCH_ROWS) << bits) >> 3, np.uint8)
    size = (1 << block_bits) >> 3
    for row in merged.collect():  # bounded by the sketch's own size
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(row.cells, np.uint8)
    return out


def estimated_repeated(names: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch's estimate is 2 or more."""
    ok = np.ones(len(names), bool)
    for r in range(len(SKETCH_ROWS)):
        at = cells(names, r, bits) + (r << bits)
        ok &= ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
    return ok


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, doc (null ids come last), th (64 bits that tell texts of one doc_id apart; rows alike in both fare alike) and text."""
    return c.documents(df).select("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")


RANGE = "doc long, th long, lo int, hi int, a int, g long, k1 long, k2 long"


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def candidate_ranges(docs: DataFrame, w: Windows, bits: int = SKETCH_BITS) -> DataFrame:
    """Every range whose bucket is estimated repeated, with the digest of its content; positions within the document."""
    held = docs.sparkSession.sparkContext.broadcast(sketch(docs, w, bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = held.value
        for b in batches:
            docs_, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, at = c.byte_parts(b.column(2))
            for i, j in c.steps(at):
                part = data[at[i] : at[j]]
                names, first, _, _ = w.read(part, at[i : j + 1] - at[i])
                if not (got := ranges(names, first, w)):
                    continue
                ok = estimated_repeated(got[4], packed, bits)
                if not ok.any():
                    continue
                d, lo, hi, a, g = (x[ok] for x in got)
                view, size = w.content(part, names)
                digest = xxhash.xxh3_128_digest
                # a - lo belongs to the key: it fixes which windows of the content belong to this anchor
                k1, k2 = _halves([digest(view[x * size : (y + w.length) * size], seed=z) for x, y, z in zip(lo.tolist(), hi.tolist(), (a - lo).tolist())])
                base = first[d]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs_[i:j][d], ths[i:j][d], (lo - base).astype(np.int32), (hi - base).astype(np.int32), (a - base).astype(np.int32), c.signed(g), k1, k2)], ["doc", "th", "lo", "hi", "a", "g", "k1", "k2"])

    return c.stored(docs.select("doc", "th", "text").mapInArrow(emit, RANGE))


def judged(found: DataFrame) -> DataFrame:
    """The ranges with their content's number of occurrences and first place, and with the number of contents in their bucket."""
    contents = c.stored(found.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "lo")).alias("top"), F.min("g").alias("g")))
    buckets = c.stored(contents.groupBy("g").agg(F.count("*").alias("n_contents")).where("n_contents > 1"))
    # a bucket may hold a third of all contents: both sides are plain scans, so skewed partitions are split
    mixed = c.stored(contents.select("k1", "k2", "n", "top", "g").join(buckets, "g", "left").select("k1", "k2", "n", "top", F.coalesce("n_contents", F.lit(1)).alias("n_contents")))
    return c.stored(found.join(mixed, ["k1", "k2"]))


def of_documents(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Documents with the list of their ``parts`` rows; those without any are left out."""
    cols = [x for x in parts.columns if x not in ("doc", "th")]
    return docs.join(parts.groupBy("doc", "th").agg(F.collect_list(F.struct(*cols)).alias("parts")), ["doc", "th"])


#: w1, w2 name one window that starts at s; or content holds all windows of a range, the first of which starts at s.
WINDOW = "g long, doc long, th long, s int, n long, a int, n_contents long, w1 long, w2 long, content binary"


def window_rows(docs: DataFrame, parts: DataFrame, w: Windows) -> DataFrame:
    """For the ``parts`` (doc, th, lo, hi, n, g, a, n_contents, named): a row for each window, or the content in one row where not ``named``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            data, at = c.byte_parts(b.column(2))
            lists = b.column(3).combine_chunks() if isinstance(b.column(3), pa.ChunkedArray) else b.column(3)
            for i, j in c.steps(at):
                part = data[at[i] : at[j]]
                names, first, _, _ = w.read(part, at[i : j + 1] - at[i])
                view, size = w.content(part, names)
                one: list[list] = [[] for _ in range(8)]
                all_: list[list] = [[] for _ in range(8)]
                for k in range(i, j):
                    doc, th, base = b.column(0)[k].as_py(), b.column(1)[k].as_py(), int(first[k - i])
                    for lo, hi, n, g, a, n_contents, named in zip(*(y.to_pylist() for y in lists[k].values.flatten())):
                        if named:
                            m = hi - lo + 1
                            more = [g] * m, [doc] * m, [th] * m, range(lo, hi + 1), [n] * m, [a] * m, [n_contents] * m, [digest(view[(base + s) * size : (base + s + w.length) * size]) for s in range(lo, hi + 1)]
                            for x, y in zip(one, more):
                                x.extend(y)
                        else:
                            for x, y in zip(all_, (g, doc, th, lo, n, a, n_contents, bytes(view[(base + lo) * size : (base + hi + w.length) * size]))):
                                x.append(y)
                for rows in (one, all_):
                    if m := len(rows[0]):
                        w1, w2 = (pa.array(x) for x in _halves(rows[7])) if rows is one else (pa.nulls(m, pa.int64()),) * 2
                        content = pa.nulls(m, pa.binary()) if rows is one else pa.array(rows[7], pa.binary())
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))), w1, w2, content], ["g", "doc", "th", "s", "n", "a", "n_contents", "w1", "w2", "content"])

    given = of_documents(docs, parts.select("doc", "th", "lo", "hi", "n", "g", "a", "n_contents", "named")).select("doc", "th", "text", "parts")
    return c.stored(given.mapInArrow(emit, WINDOW))


SLOT = "core long, doc long, th long, s int, n long, w1 long, w2 long, content binary"


def slots(rows: DataFrame, w: Windows, size: int = 8) -> DataFrame:
    """The content rows (g, doc, th, s, n, a, content) cut into pieces of at most ``size`` windows at fixed distances from the anchor.

    All windows of a piece share the bytes in ``core``, a refinement of their bucket; w1, w2 name the piece's content.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, th, s, n, a, content in zip(*(x.to_pylist() for x in b.columns)):
                i, last = s, s + len(content) - w.length
                while i <= last:
                    piece = (a - i) // size
                    top = a - size * piece  # the last window of the piece; its bytes up to the first window's end are in all of them
                    j = min(last, top)
                    part = content[i - s : j - s + w.length]
                    core = xxhash.xxh3_64_intdigest(content[top - s : top - s - size + 1 + w.length], seed=piece)
                    for x, y in zip(out, (core - (1 << 63), doc, th, i, n, digest(part, seed=a - i), part)):
                        x.append(y)
                    i = j + 1
            if out[0]:
                w1, w2 = _halves(out[5])
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out[:5], kinds)), pa.array(w1), pa.array(w2), pa.array(out[6], pa.binary())], ["core", "doc", "th", "s", "n", "w1", "w2", "content"])

    return c.stored(rows.select("doc", "th", "s", "n", "a", "content").mapInArrow(emit, SLOT))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens some [start, end) covers."""
    x = np.zeros(n + 1, np.int64)
    np.add.at(x, starts, 1)
    np.add.at(x, ends, -1)
    return np.cumsum(x[:-1]) > 0


def removal(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All documents, with ``spans`` (doc, th, s, e) as two lists, null where there are none."""
    lists = spans.groupBy("doc", "th").agg(F.collect_list("s").alias("ss"), F.collect_list("e").alias("ee"))
    return docs.join(lists, ["doc", "th"], "left").select("doc_id", "text", "ss", "ee")
