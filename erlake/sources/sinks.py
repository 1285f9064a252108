"""Sinks: candidate tables, the two aligned result files, metrics and manifests; reading them back to resume."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES, CANDIDATES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids")


def write_candidates(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").option("compression", "zstd").parquet(path)


def aligned_lists(anchors: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """(position, source1_entity_id, candidate_entity_ids, matched_entity_ids), a row an anchor (s1, position), in input order.

    ``candidates`` and ``matches`` (s1, candidate) are joined by comma in the order of ids.
    """
    joined = lambda df, name: df.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("candidate")), ",").alias(name))
    out = anchors.select("position", "s1").join(joined(candidates, CANDIDATES[1]), "s1", "left").join(joined(matches, MATCHES[1]), "s1", "left").na.fill("")
    return out.select("position", F.col("s1").alias(MATCHES[0]), CANDIDATES[1], MATCHES[1]).orderBy("position")


def write_submission(lists: DataFrame, match_path: str, candidate_path: str) -> None:
    """Both files, headed, tab-separated, unquoted; range-partitioned by position, so the parts in order are the input's order."""
    ordered = lists.repartitionByRange("position").sortWithinPartitions("position")
    for path, columns in ((match_path, MATCHES), (candidate_path, CANDIDATES)):
        ordered.select(*columns).write.mode("append").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)


def read_submission(spark: SparkSession, match_path: str, candidate_path: str) -> DataFrame:
    """(source1_entity_id, matched_entity_ids, candidate_entity_ids) of two files written before.

    Raises on other headers, repeated anchors, or anchors that only one of the files has.
    """
    sides = []
    for path, columns in ((match_path, MATCHES), (candidate_path, CANDIDATES)):
        raw = spark.read.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)
        if tuple(raw.columns) != columns:
            raise ValueError(f"{path} has the columns {raw.columns}")
        sides.append(raw.na.fill(""))
    both = sides[0].withColumn("_m", F.lit(1)).join(sides[1].withColumn("_c", F.lit(1)), MATCHES[0], "full")
    if not both.where("_m IS NULL OR _c IS NULL").isEmpty() or not both.groupBy(MATCHES[0]).count().where("count > 1").isEmpty():
        raise ValueError("the two files don't hold the same anchors once each")
    return both.select(MATCHES[0], MATCHES[1], CANDIDATES[1])


def zipped(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of two ordered tables (position, id) side by side; raises where they differ in length or in an id."""
    both = one.select("position", F.col("id").alias("a")).join(two.select("position", F.col("id").alias("b")), "position", "full")
    if not both.where("a IS NULL OR b IS NULL OR a <> b").isEmpty():
        raise ValueError("the tables diverge")
    return both.select("position", F.col("a").alias("id"))


def write_metrics(metrics: DataFrame, path: str, kind: str = "json") -> None:
    """A small table of figures as one JSON-lines, CSV or TSV file."""
    out = metrics.coalesce(1).write.mode("overwrite")
    {"json": lambda: out.json(path), "csv": lambda: out.option("header", True).csv(path), "tsv": lambda: out.option("header", True).option("sep", "\t").csv(path)}[kind]()


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def repaired(lists: DataFrame) -> tuple[DataFrame, int, str | None]:
    """Rows (position, source1_entity_id, ...) before the first that repeats an anchor, how many those are, and that anchor's id."""
    first = lists.groupBy("source1_entity_id").agg(F.min("position").alias("_first"))
    again = lists.join(first, "source1_entity_id").where("position > _first").agg(F.min_by("source1_entity_id", "position").alias("id"), F.min("position").alias("cut")).first()
    kept = lists if again.cut is None else lists.where(F.col("position") < again.cut)
    return kept, kept.count(), again.id
