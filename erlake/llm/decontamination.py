"""Benchmark decontamination by template windows.

Words are canonicalised: a number becomes NUMBER, a capitalised word inside a sentence NAME, a unit after a number UNIT;
any other word stays, in lower case. A capitalised word that opens a sentence may be a name or not, so windows that hold one are
read both ways. Windows of ``WINDOW`` canonical words are hashed as templates if at least ``LITERAL`` of the words
aren't placeholders; all other windows (and the whole of a shorter item) are hashed with their very words, and match only those. A bitmap
of the benchmark's windows, whose size is fixed, keeps other document windows from the join; the hash join on the 128-bit
keys is exact. Matches of one item on one diagonal (document position less item position) form an alignment. It counts if its
slots are consistent: a value that a placeholder has in the item stands for one value in the document. Where it stands for several,
the windows that hold it don't count, nor those with different values of the item that became one; windows with the item's
own values always count. So a question with other numbers or names matches, and a table that merely looks alike doesn't. A document is
contaminated by an item if consistent alignments cover ``COVERED`` of the item's windows, or of its templates.

Defined cases: null and empty texts and items match nothing; null ids match nothing; repeated items and rows that
share a doc_id count once; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .common import U
from .toxicity import WORD

WINDOW, LITERAL, COVERED, BITS = 8, 4, 0.4, 23
#: Bytes of text a step; each window takes several arrays.
STEP = 250_000
#: Unit words, abbreviated and in full (fixed values).
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr d w v hz khz mhz ghz pa bar kb mb gb tb percent pct usd eur gbp dollars dollar euros euro pounds pound cents cent meters meter metres metre kilometers kilometer kilometres miles mile feet foot inches inch grams gram kilograms kilogram liters liter litres litre seconds second minutes minute hours hour days day weeks week months month years year".split()
_NUMBER, _NAME, _UNIT, _EXACT = (c.mix(np.array([x], np.uint64))[0] for x in (11, 22, 33, 44))
_DIGIT, _LETTER, _STOP = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_LETTER[65:91] = 1
_STOP[[10, 33, 46, 63]] = 1


def _unit_names() -> np.ndarray:
    data, at = c.byte_parts(pa.array(UNITS))
    return np.sort(c.word_names(data, at[:-1], at[1:]))


def canonical(part: np.ndarray, lower: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical names, values (of the words themselves), whether each is a placeholder, each document's first word, and
    whether a word opens a sentence with a capital, and so may be a name or not."""
    s, e, first = c.word_bounds(lower, at, WORD)
    value = c.word_names(lower, s, e)
    if not len(s):
        return value, value, np.zeros(0, bool), first, np.zeros(0, bool)
    total = lambda kind: np.concatenate([[0], np.cumsum(kind[part])])
    digits, stops = total(_DIGIT), total(_STOP)
    number = digits[e] - digits[s] == e - s
    start = np.ones(len(s), bool)
    start[1:] = stops[s[1:]] > stops[e[:-1]]
    start[first[:-1][first[:-1] < len(s)]] = True
    # capital letters of ASCII, and those of the Latin-1 supplement in UTF-8
    second = part[np.minimum(s + 1, len(part) - 1)]
    capital = (_LETTER[part[s]] == 1) | ((part[s] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~start & (e - s > 1)
    unit = np.zeros(len(s), bool)
    unit[1:] = number[:-1] & ~start[1:]
    if unit.any():
        names = _unit_names()
        k = np.minimum(np.searchsorted(names, value), len(names) - 1)
        unit &= names[k] == value
    out = value.copy()
    out[number], out[name & ~unit], out[unit] = _NUMBER, _NAME, _UNIT
    return out, value, number | name | unit, first, capital & start & (e - s > 1)


def _same_length(b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The texts and their lower case, byte for byte alike: only ASCII letters and the Latin-1 supplement are folded."""
    data, at = c.byte_parts(b)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] |= 32
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    fold = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    low[fold] += 0x20
    return data, low, at


def _windows(names: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two names of every window of ``size`` words, and how many of its words are literal."""
    n = len(names) - size + 1
    k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(size):
        x = names[i : i + n]
        k1 = c.pair(k1, x)
        k2 += x * (x ^ U(0xA24BAED4963EE407 + 2 * i))
        k2 *= U(0x9FB21C651E98DF25)
        k2 ^= k2 >> U(29)
    held = np.concatenate([[0], np.cumsum(~slot)])
    return k1, k2 + U(size), held[size:] - held[:-size]


MATCH = "id long, pos int, n int, n_templates int, size int, template boolean, k1 long, k2 long, offsets array<int>, vals array<long>"


def windows(rows: DataFrame, kinds, bitmap=None) -> DataFrame:
    """(id, pos, n, n_templates, size, template, k1, k2, offsets, vals): every window, templates with their placeholders' places and
    values; n, n_templates: the text's windows, and how many of them are templates.

    ``kinds``: None for a benchmark (one size for each item), else the (size, template) to look for; ``bitmap`` filters.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for b in batches:
            ids = b.column(0).to_numpy()
            data, low, at = _same_length(b.column(1))
            for i, j in c.steps(at, STEP):
                own = at[i : j + 1] - at[i]
                names, value, slot, first, opens = canonical(data[at[i] : at[j]], low[at[i] : at[j]], own)
                named = np.where(opens, _NAME, names), slot | opens
                words = np.diff(first)
                doc = np.repeat(np.arange(j - i), words)
                for size in sorted({int(min(x, WINDOW)) for x in words if x} if kinds is None else {x for x, _ in kinds}):
                    if len(names) < size:
                        continue
                    start = np.arange(len(names) - size + 1)
                    inside = start + size <= first[doc[start] + 1]
                    if bits is None:
                        inside &= np.minimum(words[doc[start]], WINDOW) == size
                    strong, of_kind = np.zeros(len(inside), bool), []
                    for template, kind, held in ((True, names, slot), (True, *named), (False, value, slot)):
                        if template and size < WINDOW or kinds is not None and (size, template) not in kinds:
                            continue
                        k1, k2, literal = _windows(kind, held, size)
                        if template:
                            ok = inside & (literal >= LITERAL)
                            if kind is not names:  # only where it differs from the first reading
                                ok &= np.convolve(opens, np.ones(size, np.int64), "valid") > 0
                            strong |= ok
                        else:
                            k1, k2 = c.pair(k1, np.full(len(k1), _EXACT)), k2 ^ _EXACT
                            ok = inside & ~strong if bits is None else inside
                        of_kind.append((template, held, k1, k2, ok))
                    n_templates = np.bincount(doc[start[strong]], minlength=j - i)
                    for template, held, k1, k2, ok in of_kind:
                        if bits is not None:
                            ok = ok & bits[(k1 >> U(64 - BITS)).astype(np.int64)]
                        at_ = np.flatnonzero(ok)
                        if not len(at_):
                            continue
                        d = doc[at_]
                        cells = at_[:, None] + np.arange(size)
                        mask = held[cells] & template
                        off = np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)
                        offsets = pa.ListArray.from_arrays(pa.array(off), pa.array((np.broadcast_to(np.arange(size), mask.shape)[mask]).astype(np.int32)))
                        vals = pa.ListArray.from_arrays(pa.array(off), pa.array(c.signed(value[cells[mask]])))
                        columns = [ids[i:j][d], (at_ - first[d]).astype(np.int32), (words[d] - size + 1).astype(np.int32), n_templates[d].astype(np.int32), np.full(len(at_), size, np.int32), np.full(len(at_), template), c.signed(k1[at_]), c.signed(k2[at_])]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), offsets, vals], ["id", "pos", "n", "n_templates", "size", "template", "k1", "k2", "offsets", "vals"])

    return rows.mapInArrow(emit, MATCH)


def _bitmap(found: DataFrame) -> np.ndarray:
    """Cells of k1 that some benchmark window has; 2**BITS of them whatever the benchmark's size."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for b in batches:
            bits[(b.column(0).to_numpy().view(np.uint64) >> U(64 - BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros((1 << BITS) >> 3, np.uint8)
    for row in found.select("k1").coalesce(4).mapInArrow(emit, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(out).astype(bool)


def contaminated(df: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_slots, reparameterised) of every contaminated pair."""
    spark = df.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("id IS NOT NULL")
    known = c.stored(windows(items, None).withColumnsRenamed({"id": "item_id", "pos": "at", "n": "n_windows", "offsets": "slots", "vals": "item_vals"}))
    bits = spark.sparkContext.broadcast(_bitmap(known))
    docs = c.documents(df).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    kinds = {(x.size, x.template) for x in known.select("size", "template").distinct().collect()}
    seen = c.stored(windows(docs, kinds, bits))
    hits = c.stored(seen.drop("n", "n_templates", "size", "template").withColumnRenamed("id", "doc_id").join(known, ["k1", "k2"]).select("doc_id", "item_id", "n_windows", "n_templates", "template", "at", (F.col("pos") - F.col("at")).alias("diagonal"), "slots", "item_vals", "vals").distinct())
    line = ["doc_id", "item_id", "diagonal"]
    slots = hits.where("size(vals) > 0").select(*line, F.explode(F.arrays_zip("item_vals", "vals")).alias("x")).select(*line, F.col("x.item_vals").alias("i"), F.col("x.vals").alias("d")).distinct()
    several = lambda x, name: slots.groupBy(*line, x).count().where("count > 1").select(*line, x, F.lit(True).alias(name))
    torn = c.stored(several("i", "torn"))
    # values that become one are no conflict unless another slot of the alignment is torn
    merged = several("d", "merged").join(torn.select(*line).distinct(), line, "left_semi")
    same = ~F.col("template") | (F.col("item_vals") == F.col("vals"))
    loose = hits.where(~same).select(*line, "at", F.explode(F.arrays_zip("item_vals", "vals")).alias("x")).select(*line, "at", F.col("x.item_vals").alias("i"), F.col("x.vals").alias("d"))
    bad = loose.join(torn, [*line, "i"], "left").join(merged, [*line, "d"], "left").where("torn OR merged").select(*line, "at", F.lit(False).alias("same")).distinct()
    good = hits.withColumn("same", same).join(bad, [*line, "at", "same"], "left_anti")
    held = good.where("size(vals) > 0").select(*line, F.explode(F.arrays_zip("item_vals", "vals")).alias("x")).distinct().groupBy(*line).count().groupBy("doc_id", "item_id").agg(F.max("count").alias("n_slots"))
    placed = good.groupBy("doc_id", "item_id", "at").agg(F.max("n_windows").alias("n_windows"), F.max("n_templates").alias("n_templates"), F.max("template").alias("template"), F.max(~F.col("same")).alias("changed"))
    out = placed.groupBy("doc_id", "item_id").agg(F.max("n_windows").cast("long").alias("n_windows"), F.count("*").alias("n_matched"), F.max("n_templates").cast("long").alias("n_templates"), F.count_if("template").alias("n_filled"), F.max("changed").alias("reparameterised"))
    out = out.join(held, ["doc_id", "item_id"], "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0)))
    # numbers and names that are changed all over leave only the templates to match
    whole = F.col("n_matched") >= covered * F.col("n_windows")
    out = out.where(whole | ((F.col("n_templates") > 0) & (F.col("n_filled") >= covered * F.col("n_templates"))))
    return out.select("doc_id", "item_id", F.when(whole, F.col("n_windows")).otherwise(F.col("n_templates")).alias("n_windows"), F.when(whole, F.col("n_matched")).otherwise(F.col("n_filled")).alias("n_matched"), "n_slots", "reparameterised")


def drop_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` that no item contaminates, with the columns of ``df``."""
    # stored, so that its size is known and the documents need not move for a few ids
    bad = c.stored(contaminated(df, benchmark).select(F.col("doc_id").alias("_bad")).distinct())
    return df.join(bad, df["doc_id"] == bad["_bad"], "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
