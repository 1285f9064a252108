"""Embedding near-dedup over an inverted multi-index: product codebooks on the vectors' halves, multi-sequence traversal.

Vectors are scaled to length 1, so a cosine of t is a squared distance of ``2 - 2t``. Each half has a codebook whose size grows with the
square root of the number of vectors (``centres``), so that the cells of the product grid grow with the vectors; it is learnt from
``PER_CENTRE`` vectors a centre, ``SAMPLE`` at most (those with the smallest hash of their id). Every vector is indexed in the
cell of the grid its halves fall in. A query visits cells by rising lower bound of the distance to any vector
there (two sorted lists and a heap); it ends when the bound passes the threshold's distance. That bound holds for all
members of a cell, so the target recall is 1: no link is lost, whatever the codebooks are like.

Exact copies are one node with a count. The cells of one first half are a row of the grid; a vector travels once to each row that
it visits, with the set of cells that it visits there. A row's members and visitors are cut into parts of ``PART``; a pair of
parts is compared cell by cell, and returns a number of links per node and a spanning forest, never pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, null labels and null
ids link with nothing; vectors of different sizes don't link; rows that share an id count as separate vectors;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

LEAST, PER_CENTRE, SAMPLE, PART = 16, 64, 65_536, 1024


def centres(n: int) -> int:
    """Centres of a half for n vectors: about 64 vectors a cell, and 16 to 1,024 centres, as the sample allows."""
    return int(min(max(LEAST, np.sqrt(n) / 8), SAMPLE // PER_CENTRE))


def codebook(x: np.ndarray, k: int = LEAST, rounds: int = 12) -> np.ndarray:
    """k-means centres; the first are spread by the farthest-point rule."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = [x[0]]
    far = ((x - x[0]) ** 2).sum(1)
    while len(centres) < k and far.max() > 1e-12:
        centres.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    m = np.array(centres)
    for _ in range(rounds):
        near = squared(x, m).argmin(1)
        for i in range(len(m)):
            if (near == i).any():
                m[i] = x[near == i].mean(0)
    return np.unique(m, axis=0)


def squared(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ m.T + (m * m).sum(1), 0)


def bounds(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell, and a lower bound of its squared distance to what lies in each cell: that to the plane between the two centres."""
    d = squared(x, m)
    near = d.argmin(1)
    gap = np.sqrt(squared(m, m))[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(gap > 0, (d - d[np.arange(len(x)), near][:, None]) / (2 * gap), 0.0)
    return near, np.maximum(plane - 1e-9, 0) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by rising a[i] + b[j], while that is at most ``limit``."""
    oa, ob = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    heap = [(a[oa[0]] + b[ob[0]], 0, 0)]
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > limit:
            return
        yield oa[i], ob[j]
        if j + 1 < len(ob):
            heapq.heappush(heap, (a[oa[i]] + b[ob[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(oa):
            heapq.heappush(heap, (a[oa[i + 1]] + b[ob[0]], i + 1, 0))


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _places(near: DataFrame, books, limit: float) -> DataFrame:
    """Each vector with its home (row, cell in it), and the rows that it visits with a bit for each cell there."""

    def visits(a: np.ndarray, b: np.ndarray) -> list[tuple[int, bytes]]:
        rows: dict[int, np.ndarray] = {}
        for i, j in multi_sequence(a, b, limit):
            if i not in rows:
                rows[i] = np.zeros(len(b), bool)
            rows[i][j] = True
        return [(i, np.packbits(x).tobytes()) for i, x in rows.items()]

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, part in f.groupby("size"):
                one, two = books.value[size]
                x = unit(part["vector"])
                ha, ba = bounds(x[:, : size // 2], one)
                hb, bb = bounds(x[:, size // 2 :], two)
                seen = [visits(a, b) for a, b in zip(ba, bb)]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "label": part["label"].to_numpy(), "size": size, "n": part["n"].to_numpy(), "vector": [v.tobytes() for v in x], "home": ha, "cell": hb, "rows": [[i for i, _ in y] for y in seen], "masks": [[m for _, m in y] for y in seen]})

    return near.mapInPandas(emit, "node long, label string, size int, n long, vector binary, home int, cell int, rows array<int>, masks array<binary>")


def _solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One part of a row's visitors against one part of its members: links per visitor, and each touched node's smallest in this block."""
    out = {"node": [], "links": [], "low": []}
    if len(left) and len(right):
        q, v = left["node"].to_numpy(), right["node"].to_numpy()
        mine, theirs, cell = _matrix(left["vector"]), _matrix(right["vector"]), right["cell"].to_numpy()
        masks = np.unpackbits(np.frombuffer(b"".join(left["mask"]), np.uint8).reshape(len(left), -1), axis=1).astype(bool)
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.unique(cell):
            a, b = np.flatnonzero(masks[:, k]), np.flatnonzero(cell == k)
            x, y = np.nonzero((mine[a] @ theirs[b].T >= threshold) & (q[a][:, None] != v[b][None, :]))
            rows.append(a[x])
            cols.append(b[y])
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        links = np.bincount(rows, weights=right["n"].to_numpy()[cols], minlength=len(q)).astype(np.int64)
        lq, lv = q.copy(), v.copy()
        while len(rows):
            before = lq.copy(), lv.copy()
            np.minimum.at(lq, rows, lv[cols])
            np.minimum.at(lv, cols, lq[rows])
            if (lq == before[0]).all() and (lv == before[1]).all():
                break
        some = np.flatnonzero(links)
        touched = np.unique(cols)
        out = {"node": np.concatenate([q[some], v[touched]]), "links": np.concatenate([links[some], np.zeros(len(touched), np.int64)]), "low": np.concatenate([lq[some], lv[touched]])}
    return pd.DataFrame(out).astype("int64")


def near_duplicates(df: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``df`` (vec_id, embedding, label)."""
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    good = good.withColumn("h1", F.xxhash64("vector", "label"))
    copies = c.stored(good.groupBy("h1", "label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    nodes = copies.select("node", "label", F.size("vector").alias("size"), "n", "vector")
    books = {}
    for size, n in nodes.groupBy("size").count().collect():
        k = centres(n)
        x = nodes.where(F.col("size") == size).orderBy(F.xxhash64("node"), "node").limit(k * PER_CENTRE).select("vector").toPandas()["vector"]
        books[size] = codebook(unit(x)[:, : size // 2], k), codebook(unit(x)[:, size // 2 :], k)
    places = c.stored(_places(nodes, spark.sparkContext.broadcast(books), 2 - 2 * threshold + 1e-7))
    cell = ["label", "size", "row"]
    base = places.select("label", "size", F.col("home").alias("row"), "cell", "node", "n", "vector")
    query = places.select("label", "size", F.explode(F.arrays_zip("rows", "masks")).alias("at"), "node", "vector").select("label", "size", F.col("at.rows").alias("row"), F.col("at.masks").alias("mask"), "node", "vector")
    parts = lambda x, name: x.groupBy(*cell).agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    cut = c.stored(parts(base, "pb").join(parts(query, "pq"), cell))
    base = base.join(cut, cell).withColumn("b", F.pmod(F.xxhash64("node"), "pb")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pq").cast("long") - 1)))
    query = query.join(cut, cell).withColumn("q", F.pmod(F.xxhash64("node"), "pq")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb").cast("long") - 1)))
    key = [*cell, "b", "q"]
    solve = lambda k, a, b: _solve(k, a, b, threshold)
    # stored apart, as the two sides of a cogroup must not share columns
    query, base = c.stored(query.select(*key, "node", "mask", "vector")), c.stored(base.select(*key, "node", "n", "cell", "vector"))
    found = c.stored(query.groupBy(*key).cogroup(base.groupBy(*key)).applyInPandas(solve, "node long, links long, low long"))
    root = c.components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    counted = c.stored(nodes.select("node", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(root.select(F.col("id").alias("node"), "root"), "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    of_vector = copies.select("h1", "label", "vector", "node").join(counted, "node").select("h1", "label", "vector", "n_links", "root")
    ids = c.stored(good.join(of_vector, ["h1", "label", "vector"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root")))
    out = rows.select("vec_id").join(ids, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("root") == F.col("vec_id"), F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "embeddings"))


SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, v.vec_id = low.component_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN low ON low.a = v.vec_id"""
