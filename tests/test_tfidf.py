"""Vectors make and shuffle the grams of texts once."""

import math
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from erlake.operators import grams, tfidf


def test_vectors_make_grams_once(spark):
    """Once for the texts and once for the document frequencies; norms by a join made both twice."""
    texts = spark.createDataFrame([("1", "red big house"), ("2", "red big"), ("3", None)], "id string, text string")
    v = tfidf.vectors(texts, texts)
    assert v._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
    of = {}
    for x in v.collect():
        of[x.id] = of.get(x.id, 0) + x.w * x.w
    assert set(of) == {"1", "2"} and all(abs(n - 1) < 1e-9 for n in of.values())


def test_all_anchors_are_queries(spark):
    """Not those alone whose number is divisible by 20; the same rows as the SQL."""
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["char_tfidf_topk"](spark, sf).select("s1", "candidate", "score", "rank").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(f"SELECT s1, candidate, score, rank FROM ({entry.oracle_sql()['char_tfidf_topk']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {x.s1 for x in got} == {f"S1-{n}" for (n,) in c.execute("SELECT doc_id FROM documents").fetchall()}


def test_search_shuffles_texts_not_their_grams(spark):
    """Odd texts against a plain reading of the definition, ties by the higher id; no gram of a text is joined."""
    names = ["red big house", "red big", "big house", "big house", "", None, "a", "\U0001f600\U0001f600 big", "ab", "ab", "ab", "日本 big 日本", "zzzz"]
    corpus = [(f"c{i:02d}", x) for i, x in enumerate(names)]
    asked = [(f"q{i}", x) for i, x in enumerate([*names, "red big house", "nothing like it?"])]
    found = tfidf.top_k(spark.createDataFrame(asked, "id string, text string"), spark.createDataFrame(corpus, "id string, text string"), 3)
    assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString()

    of = lambda x: Counter(x[i : i + n] for n in range(2, 6) for i in range(len(x) - n + 1)) if x else {}
    df = Counter(g for _, x in corpus for g in of(x))
    idf = {g: math.log((1 + len(corpus)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

    def unit(x):
        w = {g: n * idf[g] for g, n in of(x).items() if g in idf}
        length = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / length for g, v in w.items()}

    units, want = [(i, unit(x)) for i, x in corpus], set()
    for q, x in asked:
        u = unit(x)
        scores = sorted(((round(sum(u[g] * v.get(g, 0) for g in u), 6), i) for i, v in units), reverse=True)
        want |= {(q, i, s, n + 1) for n, (s, i) in enumerate(scores[:3]) if s > 0}
    assert {tuple(x) for x in found.select("s1", "candidate", "score", "rank").collect()} == want


def test_nearest_bounds_lose_nothing():
    """Common and rare grams over several steps; the texts kept are those of a full comparison."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts = sorted({" ".join(["the", *rng.choice(words, 2), "and", "co"]) for _ in range(1500)})
    known = sorted({x[i : i + n] for x in texts for n in range(2, 6) for i in range(len(x) - n + 1)})
    g = grams.CharGrams(known)
    df = np.bincount(g.counts(texts)[1], minlength=len(known))
    near = grams.Nearest(g, np.log((1 + len(texts)) / (1 + df)) + 1, texts, np.ones(len(texts), np.int64))
    assert len(set(near.step)) == len(near.STEPS)
    queries = texts[::15]
    counts = g.counts(queries)
    w = grams.weighed(counts, near.idf, len(queries))
    for q, of, scores in near.search(queries, 5):
        near.weight[counts[1][counts[0] == q]] = w[counts[0] == q]
        full = near._scores(np.arange(len(texts)))
        near.weight[:] = 0
        assert set(of) == set(np.flatnonzero(full >= np.sort(full)[-5] - grams.SLACK)) and np.allclose(full[of], scores)


def test_cosines_of_pairs_join_no_grams(spark):
    """The same as by vectors, with odd texts and a limit of grams, in a plan that makes no grams of characters."""
    names = ["red big house", "red big", "big house", "", None, "😀😀 big", "aaaa aaaa", "aaaa", "zzz"]
    texts = spark.createDataFrame([(str(i), x, x and x[::-1]) for i, x in enumerate(names)], "id string, name string, address string")
    pairs = spark.createDataFrame([(str(i), str(j)) for i in range(9) for j in range(9)], "s1 string, candidate string")
    of = {"char": ("name", False, 3, 5), "word": ("name", True, 1, 2), "back": ("address", False, 2, 3)}
    for most in (None, 7):
        found = tfidf.cosines_of_pairs(pairs, texts, of, 2, most)
        assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(x.s1, x.candidate): x for x in found.collect()}
        assert len(got) == 81
        for name, (column, words, low, high) in of.items():
            one = texts.select("id", F.col(column).alias("text"))
            v = tfidf.vectors(one, one, words, low, high, 2, most, True)
            want = tfidf.row_cosines(pairs, v, v).collect()
            assert len(want) == 81 and all(abs(got[x.s1, x.candidate][name] - x.cosine) < 1e-9 for x in want)


def test_row_cosines_equal_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["s1", "candidate", "name_char", "name_word", "address_char"]
    want = sorted(c.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()['row_cosines']})").fetchall())
    got = entry.queries()["row_cosines"](spark, sf)
    assert got.columns == names and sorted(map(tuple, got.collect())) == want
