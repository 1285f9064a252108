"""Evaluation of candidate lists and of matchers over them: top K, methods, caps, folds, thresholds, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t

PAIR = ["s1", "candidate"]
#: Decimal places of reported columns (fixed values).
REPORTED = {"candidate_recall": 4, "full_hit_rate": 4, "avg_candidates": 1}


def wide_thresholds() -> list[float]:
    """0.05 to 0.95 in steps of 0.05, from 0.9 on in steps of 0.01, and seven between 0.99 and 1."""
    coarse, fine = [round(0.05 * i, 3) for i in range(1, 20)], [round(0.9 + 0.01 * i, 4) for i in range(10)]
    return sorted({*coarse, *fine, 0.991, 0.9925, 0.995, 0.9975, 0.999, 0.9995, 0.9999})


def source_of(candidate: str = "candidate") -> Column:
    return F.split_part(candidate, F.lit("-"), F.lit(1))


def _per_k(df: DataFrame, ks: list[int]) -> DataFrame:
    return df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))])))


def check_candidates(anchors: DataFrame, candidates: DataFrame) -> None:
    """Raises where a pair repeats or an anchor isn't one of ``anchors``, or there are no anchors."""
    if anchors.isEmpty():
        raise ValueError("no anchors")
    if not candidates.groupBy(*PAIR).count().where("count > 1").isEmpty():
        raise ValueError("repeated candidate pairs")
    if not candidates.join(anchors, "s1", "left_anti").isEmpty():
        raise ValueError("candidates of unknown anchors")


def evaluate_top_k(anchors: DataFrame, truth: DataFrame, candidates: DataFrame, corpus: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each K over ranked candidates (s1, candidate, rank): recall, full hits, volumes, reduction, misses.

    An anchor without links is a full hit; rates over nothing are null.
    """
    links = truth.groupBy("s1").agg(F.count("*").alias("links"))
    found = _per_k(candidates, ks).where(F.col("rank") <= F.col("k")).join(truth.withColumn("hit", F.lit(1)), PAIR, "left")
    found = found.groupBy("s1", "k").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    each = _per_k(anchors.select("s1"), ks).join(links, "s1", "left").join(found, ["s1", "k"], "left").na.fill(0)
    full, linked = F.col("links") == F.col("hits"), F.col("links") > 0
    size = F.broadcast(corpus.agg(F.count("*").alias("candidate_corpus_records")))
    out = each.groupBy("k").agg(
        F.sum("links").alias("true_links"), F.sum("hits").alias("retrieved_true_links"), F.count("*").alias("s1_entities"),
        F.count_if(linked).alias("non_singleton_s1_entities"), F.count_if(full).alias("full"), F.count_if(full & linked).alias("full_linked"),
        F.avg("n").alias("avg_candidates"), F.percentile("n", F.lit(0.5)).alias("median_candidates"), F.max("n").alias("max_candidates"), F.sum("n").alias("volume"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return out.join(size).select(
        "k", F.round(ratio("retrieved_true_links", "true_links"), 6).alias("candidate_recall"), F.round(ratio("full", "s1_entities"), 6).alias("full_hit_rate"),
        F.round(ratio("full_linked", "non_singleton_s1_entities"), 6).alias("non_singleton_full_hit_rate"), F.round("avg_candidates", 6).alias("avg_candidates"), "median_candidates", "max_candidates",
        F.round(1 - F.col("volume") / (F.col("s1_entities") * F.col("candidate_corpus_records")), 6).alias("reduction_ratio"), "true_links", "retrieved_true_links",
        (F.col("true_links") - F.col("retrieved_true_links")).alias("missed_true_links"), (F.col("s1_entities") - F.col("full")).alias("affected_s1_entities"), "s1_entities", "non_singleton_s1_entities", "candidate_corpus_records",
    )


def missed_at_k(truth: DataFrame, candidates: DataFrame, ks: list[int]) -> DataFrame:
    """(k, s1, candidate): true links that the first K candidates of their anchor don't hold."""
    return _per_k(truth.select(*PAIR), ks).join(_per_k(candidates, ks).where(F.col("rank") <= F.col("k")).select("k", *PAIR), ["k", *PAIR], "left_anti")


def reported(evaluation: DataFrame) -> DataFrame:
    """The compact table: rounded, then with fixed decimal places as text."""
    text = [F.format_string(f"%.{n}f", F.round(x, n)).alias(x) for x, n in REPORTED.items()]
    return evaluation.select("k", *text, F.col("missed_true_links").cast("long").alias("missed_true_links"))


def union_top_k(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """Pairs that either ranked list has among its first K."""
    first = lambda df: df.where(F.col("rank") <= k).select(*PAIR)
    return first(one).union(first(two)).distinct()


def evaluate_methods(anchors: DataFrame, truth: DataFrame, ranked: dict[str, DataFrame], unions: dict[str, tuple[str, str]], corpus: DataFrame, ks: list[int]) -> DataFrame:
    """(method, k) with recall, recall of each source, and candidates an anchor; ``unions`` name two methods each."""
    lists = None
    methods = {m: (m,) for m in ranked} | unions
    for m, parts in methods.items():
        for part in parts:
            rows = _per_k(ranked[part], ks).where(F.col("rank") <= F.col("k")).select(F.lit(m).alias("method"), "k", *PAIR)
            lists = rows if lists is None else lists.union(rows)
    lists = lists.distinct()
    keys = lists.sparkSession.createDataFrame([(m, k) for m in methods for k in sorted(set(ks))], "method string, k int")
    sizes = anchors.select("s1").join(F.broadcast(keys)).join(lists.groupBy("method", "k", "s1").agg(F.count("*").alias("n")), ["method", "k", "s1"], "left").na.fill(0)
    sizes = sizes.groupBy("method", "k").agg(F.round(F.avg("n"), 6).alias("avg_candidates"), F.percentile("n", F.lit(0.5)).alias("median_candidates"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95_candidates"), F.max("n").alias("max_candidates"))
    hits = truth.join(F.broadcast(keys)).join(lists.withColumn("hit", F.lit(1)), ["method", "k", *PAIR], "left").withColumn("source", source_of())
    share = lambda x: F.round(100 * F.avg(x), 6)
    hit = F.col("hit").isNotNull().cast("double")
    hits = hits.groupBy("method", "k").agg(F.count("*").alias("true_pairs"), share(hit).alias("recall_pct"), *[share(F.when(F.col("source") == s, hit)).alias(f"{s}_recall_pct") for s in ("S2", "S3")])
    size = F.broadcast(corpus.agg(F.count("*").alias("corpus")))
    return hits.join(sizes, ["method", "k"]).join(size).withColumn("reduction_ratio", F.round(1 - F.col("avg_candidates") / F.col("corpus"), 6)).drop("corpus")


def cap_report(anchors: DataFrame, truth: DataFrame, union: DataFrame, capped: DataFrame) -> DataFrame:
    """For each cap of ``capped`` (s1, candidate, cap): recall of the whole union and of what the cap keeps, full hits, volumes."""
    caps = F.broadcast(capped.select("cap").distinct())
    raw = truth.join(union.select(*PAIR).distinct(), PAIR, "left_semi").groupBy("s1").agg(F.count("*").alias("raw"))
    kept = capped.join(truth.withColumn("hit", F.lit(1)), PAIR, "left").groupBy("s1", "cap").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    links = truth.groupBy("s1").agg(F.count("*").alias("links"))
    each = anchors.select("s1").join(caps).join(links, "s1", "left").join(raw, "s1", "left").join(kept, ["s1", "cap"], "left").na.fill(0)
    linked = F.col("links") > 0
    return each.groupBy("cap").agg(
        F.sum("links").alias("links"), F.round(F.try_divide(F.sum("raw"), F.sum("links")), 6).alias("raw_recall"), F.round(F.try_divide(F.sum("hits"), F.sum("links")), 6).alias("retained_recall"),
        F.round(F.try_divide(F.count_if(linked & (F.col("hits") == F.col("links"))), F.count_if(linked)), 6).alias("full_hit_rate"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"),
    )


def fold_counters(anchors: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Anchors, links, recalled links and candidates of each fold."""
    found = candidates.join(truth.withColumn("hit", F.lit(1)), PAIR, "left").groupBy("s1").agg(F.count("*").alias("candidates"), F.count("hit").alias("recalled"))
    each = anchors.select("s1").join(truth.groupBy("s1").agg(F.count("*").alias("links")), "s1", "left").join(found, "s1", "left").na.fill(0)
    return each.groupBy(t.fold(F.col("s1")).alias("fold")).agg(F.count("*").alias("anchors"), *[F.sum(x).alias(x) for x in ("links", "recalled", "candidates")])


def wide_sweep(anchors: DataFrame, truth: DataFrame, capped: DataFrame) -> DataFrame:
    """(cap, metric, score, threshold): the best macro F1 and F0.5 over ``wide_thresholds`` of ``capped`` (s1, candidate, cap, p); ties
    go to the smaller threshold. Rounded to 9 places first, so that ties don't hang on the order of sums."""
    steps = F.explode(F.array(*[F.lit(x) for x in wide_thresholds()]))
    hits = capped.join(truth.withColumn("hit", F.lit(1)), PAIR, "left").withColumn("t", steps).where("p >= t")
    pred = hits.groupBy("cap", "t", "s1").agg(F.count("*").alias("pred"), F.count("hit").alias("tp"))
    keys = capped.select("cap").distinct().withColumn("t", steps)
    each = anchors.select("s1").join(F.broadcast(keys)).join(truth.groupBy("s1").agg(F.count("*").alias("actual")), "s1", "left").join(pred, ["cap", "t", "s1"], "left").na.fill(0)
    p, r = F.col("tp") / F.col("pred"), F.col("tp") / F.col("actual")
    f = lambda b: F.when((F.col("actual") == 0) & (F.col("pred") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise((1 + b) * p * r / (b * p + r))
    means = each.groupBy("cap", "t").agg(F.round(F.avg(f(1.0)), 9).alias("f1"), F.round(F.avg(f(0.25)), 9).alias("f05"))
    best = means.groupBy("cap").agg(*[F.max(F.struct(F.col(m), (-F.col("t")).alias("t"))).alias(m) for m in ("f1", "f05")])
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.{m}").alias("score"), (-F.col(f"{m}.t")).alias("threshold")) for m in ("f1", "f05")]))
    return best.select("cap", both.alias("b")).select("cap", "b.metric", F.round("b.score", 6).alias("score"), "b.threshold")


def other_neighbours(ranked: DataFrame, truth: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` candidates of each anchor, by rank, that aren't its links."""
    place = F.row_number().over(W.partitionBy("s1").orderBy("rank"))
    return ranked.join(truth, PAIR, "left_anti").withColumn("place", place).where(F.col("place") <= n)


def filled(pairs: DataFrame, first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the candidate's ``columns`` from ``first`` or, where that has no such candidate, from ``second``."""
    side = lambda df, p: df.dropDuplicates(["candidate"]).select("candidate", F.lit(True).alias(f"_{p}"), *[F.col(x).alias(f"_{p}_{x}") for x in columns])
    both = pairs.join(side(first, "a"), "candidate", "left").join(side(second, "b"), "candidate", "left")
    return both.select(*pairs.columns, *[F.when(F.col("_a"), F.col(f"_a_{x}")).otherwise(F.col(f"_b_{x}")).alias(x) for x in columns])


def top_scores(anchors: DataFrame, ranked: DataFrame, second: str, k: int = 10) -> DataFrame:
    """(s1, top, best_combined, gap): the best score, the best mean of score and ``second`` among the first ``k``, and the lead over the next."""
    near = ranked.where(F.col("rank") <= k).groupBy("s1").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max((F.col("score") + F.col(second)) / 2).alias("best_combined"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next")
    )
    return anchors.select("s1").join(near, "s1", "left").select("s1", "top", F.round("best_combined", 6).alias("best_combined"), F.round(F.col("top") - F.col("next"), 6).alias("gap"))


def by_label(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Count, median and mean of each column for each label; nulls don't count."""
    of = lambda x: [F.count(x).alias(f"{x}_count"), F.round(F.percentile(x, F.lit(0.5)), 6).alias(f"{x}_median"), F.round(F.avg(x), 6).alias(f"{x}_mean")]
    return df.groupBy(label).agg(*[y for x in columns for y in of(x)])


def restricted(truth: DataFrame, wanted: DataFrame) -> DataFrame:
    """The truth of the wanted anchors; raises if one of them has no row in ``truth`` (s1, matched: list of ids)."""
    if not wanted.join(truth, "s1", "left_anti").isEmpty():
        raise ValueError("anchors without truth")
    return truth.join(wanted, "s1", "left_semi")


def joined_once(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join of many to one; raises if a key repeats on the right."""
    if not right.groupBy(on).count().where("count > 1").isEmpty():
        raise ValueError(f"{on} repeats on the side that should be unique")
    return left.join(right, on)
