"""Shared kernels: Arrow text buffers as byte arrays, word boundaries, hashing, checkpoints and connected components."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that one vector step takes; a longer document is a step of its own.
STEP_BYTES = 1_000_000
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns can't clash with working names; null texts become empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def with_shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a local one where the session names none (single-machine tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file:///tmp/checkpoints/erlake"
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{with_shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64; ``x`` is overwritten."""
    x ^= x >> U(30)
    x *= _B
    x ^= x >> U(27)
    x *= _C
    x ^= x >> U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names for pairs of names, order kept."""
    x = a * _A
    x += b
    return mix(x)


def byte_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each value starts (one more entry than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, one document at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: workers live on between tasks, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, STEP_BYTES + 1)
            cls.up = np.full(n, _R, np.uint64)
            cls.down = np.full(n, _R_INV, np.uint64)
            cls.up[0] = cls.down[0] = 1
            np.multiply.accumulate(cls.up, out=cls.up)
            np.multiply.accumulate(cls.down, out=cls.down)


_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * _A)


def word_bounds(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes within each document, and for each document its first word (one more entry)."""
    w = is_word[data]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    inner = at[(at > 0) & (at < len(data))]
    start[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, at)


def word_names(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit name for each run of bytes, from a polynomial prefix sum."""
    n = len(data)
    Powers.need(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_NAMES[data] * Powers.up[:n], out=total[1:])
    x = (total[e] - total[s]) * Powers.down[s]
    x += (e - s).astype(np.uint64) * _C
    return mix(x)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sha256(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b): root is the smallest id reachable.

    Alternating large-star and small-star steps; each state is stored in the shared folder, so lineage stays
    short. Every step moves each neighbour to the smallest one, grouped by a map-side-combined minimum and a join, so no
    neighbourhood is ever gathered.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = large.where("a <> b").distinct()
        down = stored(edges)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        edges = stored(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").union(edges.select("b", "b").distinct())
