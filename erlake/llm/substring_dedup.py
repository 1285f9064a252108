"""Substring dedup: a count-min prefilter over windows of words, then exact grouping of what it estimates repeated.

``substring_dedup`` removes each word that a window of ``length`` words covers whose word sequence also starts in a
document with a smaller doc_id; all windows are judged on the input. Words are maximal runs of bytes other than space and
\\t\\n\\v\\f\\r.

Defined cases: null and empty texts have no words and lose none; texts shorter than a window lose none; repeated windows
within one document, and rows that share a doc_id, don't remove each other; a null doc_id counts as larger than any
other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import repeats as r

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def removed_spans(docs: DataFrame, w: r.Windows, bits: int) -> DataFrame:
    """(doc, th, s, e): runs of words to remove, perhaps overlapping."""
    ranges = r.judged(r.candidate_ranges(docs, w, bits)).withColumn("later", F.col("doc") > F.col("top.doc"))
    whole = ranges.where("later").select("doc", "th", F.col("lo").alias("s"), (F.col("hi") + w.length).alias("e"))
    windows = r.window_rows(docs, ranges.where("NOT later AND n_contents > 1").withColumn("named", F.lit(True)), w)
    least = c.stored(windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("w1", "w2", "least"))
    single = windows.join(least, ["w1", "w2"]).where("doc > least").select("doc", "th", "s", (F.col("s") + w.length).alias("e"))
    return whole.union(single)


def substring_dedup(df: DataFrame, length: int = 50, q: int = 16, bits: int = r.SKETCH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space) of every row of ``df``."""
    w = r.Windows("words", length, q)
    docs = r.keyed(df)
    joined = r.removal(docs, removed_spans(docs, w, bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ss, ee = b.column(0), b.column(2), b.column(3)
            data, at = c.byte_parts(b.column(1))
            out: list[list] = [[], [], [], []]
            for k in range(len(ids)):
                text = data[at[k] : at[k + 1]].tobytes()
                words = text.split()  # bytes.split cuts at exactly these six bytes
                gone = 0
                if ss[k].is_valid and words:
                    dead = r.covered(ss[k].values.to_numpy(), ee[k].values.to_numpy(), len(words))
                    gone = int(dead.sum())
                    kept = b" ".join([x for x, y in zip(words, dead.tolist()) if not y])
                else:
                    kept = b" ".join(words)
                for x, y in zip(out, (len(words), gone, c.sha256(kept), kept.decode())):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return joined.mapInArrow(cut, SCHEMA)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(c.table(spark, sf_dir, "documents")).drop("kept_text")


def brute_force(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """The same by comparing all windows in memory."""
    import re

    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first: dict[tuple, int] = {}
    for (d, _), ws in zip(rows, words):
        for i in range(len(ws) - length + 1):
            k = tuple(ws[i : i + length])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), ws in zip(rows, words):
        dead = np.zeros(len(ws), bool)
        for i in range(len(ws) - length + 1):
            m = first.get(tuple(ws[i : i + length]))
            if m is not None and (d is None or m < d):
                dead[i : i + length] = True
        kept = b" ".join(x for x, y in zip(ws, dead) if not y)
        out.append((d, len(ws), int(dead.sum()), c.sha256(kept)))
    return out
