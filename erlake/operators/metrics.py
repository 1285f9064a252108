"""Retrieval and matching metrics; every denominator starts from the anchors, so singletons count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_anchor(anchors: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1, actual, pred, tp) of every anchor."""
    both = truth.withColumn("t", F.lit(1)).join(predicted.select("s1", "candidate").distinct().withColumn("p", F.lit(1)), ["s1", "candidate"], "full")
    sums = both.groupBy("s1").agg(F.count("t").alias("actual"), F.count("p").alias("pred"), F.sum(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"))
    return anchors.select("s1").join(sums, "s1", "left").na.fill(0)


def macro_f(counts: DataFrame, beta2: float) -> DataFrame:
    """Mean F score an anchor; nothing expected and nothing predicted is 1."""
    p, r = F.col("tp") / F.col("pred"), F.col("tp") / F.col("actual")
    f = F.when((F.col("actual") == 0) & (F.col("pred") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise((1 + beta2) * p * r / (beta2 * p + r))
    return counts.agg(F.round(F.avg(f), 6).alias("score"))


def threshold_sweep(anchors: DataFrame, truth: DataFrame, scored: DataFrame, beta2: float = 0.25) -> DataFrame:
    """(threshold, score) for 0.05, 0.10 ... 0.95; the best is the largest score, ties to the larger threshold."""
    spark = anchors.sparkSession
    steps = spark.range(1, 20).select((F.col("id") * 0.05).alias("t"))
    wide = anchors.select("s1").join(F.broadcast(steps))
    hit = scored.join(truth.withColumn("hit", F.lit(1)), ["s1", "candidate"], "left").join(F.broadcast(steps), F.col("p") >= F.col("t"))
    pred = hit.groupBy("s1", "t").agg(F.count("*").alias("pred"), F.count("hit").alias("tp"))
    counts = wide.join(pred, ["s1", "t"], "left").join(truth.groupBy("s1").agg(F.count("*").alias("actual")), "s1", "left").na.fill(0)
    p, r = F.col("tp") / F.col("pred"), F.col("tp") / F.col("actual")
    f = F.when((F.col("actual") == 0) & (F.col("pred") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise((1 + beta2) * p * r / (beta2 * p + r))
    return counts.groupBy("t").agg(F.round(F.avg(f), 6).alias("score")).select(F.round("t", 2).alias("threshold"), "score")


def volume(anchors: DataFrame, pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidate numbers over all anchors, those without any included."""
    n = anchors.select("s1").join(pairs.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").na.fill(0)
    size = corpus.agg(F.count("*").alias("corpus"))
    out = n.agg(F.count("*").alias("anchors"), F.sum("n").alias("candidates"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"), F.round(F.percentile("n", F.lit(0.99)), 6).alias("p99"), F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.col("n") > 100).alias("over_100"))
    return out.join(F.broadcast(size)).select("*", F.round(1 - F.col("candidates") / (F.col("anchors") * F.col("corpus")), 6).alias("reduction")).drop("corpus")


def source_recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    hit = truth.join(pairs.select("s1", "candidate").distinct().withColumn("hit", F.lit(1)), ["s1", "candidate"], "left")
    return hit.groupBy(F.split_part("candidate", F.lit("-"), F.lit(1)).alias("source")).agg(F.count("*").alias("links"), F.count("hit").alias("found"))


def route_report(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """A route's candidates, links, and those that no other route finds."""
    of_pair = pairs.groupBy("s1", "candidate").agg(F.count("*").alias("n_routes"))
    df = pairs.join(of_pair, ["s1", "candidate"]).join(truth.withColumn("hit", F.lit(1)), ["s1", "candidate"], "left")
    alone = F.col("n_routes") == 1
    return df.groupBy("route").agg(F.count("*").alias("candidates"), F.count("hit").alias("links"), F.count_if(alone).alias("unique_candidates"), F.count_if(alone & F.col("hit").isNotNull()).alias("unique_links"))


def top_k(anchors: DataFrame, truth: DataFrame, candidates: DataFrame, ks: list[int]) -> DataFrame:
    """Recall, full-hit rate and misses of ranked candidates (s1, candidate, rank) at each K."""
    spark = anchors.sparkSession
    k = F.broadcast(spark.createDataFrame([(x,) for x in ks], "k int"))
    links = truth.join(k).join(candidates, ["s1", "candidate"], "left").select("k", "s1", (F.coalesce("rank", F.lit(1 << 30)) <= F.col("k")).alias("hit"))
    of_anchor = links.groupBy("k", "s1").agg(F.count_if("hit").alias("hits"), F.count("*").alias("links"))
    out = of_anchor.groupBy("k").agg(F.sum("links").alias("links"), F.sum("hits").alias("found"), F.count_if(F.col("hits") == F.col("links")).alias("full"), F.count("*").alias("linked_anchors"))
    return out.select("k", "links", "found", F.round(F.col("found") / F.col("links"), 6).alias("recall"), F.round(F.col("full") / F.col("linked_anchors"), 6).alias("full_hit_rate"), (F.col("links") - F.col("found")).alias("missed"))
