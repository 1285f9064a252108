"""Reports over pairs and records: regions, gaps, histograms, validation, repair of result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t


def score_region(name: Column, address: Column) -> Column:
    return F.when((name >= 0.8) & (address >= 0.7), "both").when(name >= 0.8, "name").when(address >= 0.7, "address").otherwise("neither")


def top_gap(scored: DataFrame) -> DataFrame:
    """Best score of each anchor and its distance to the second (to 0 where there is one candidate)."""
    w = W.partitionBy("s1").orderBy(F.desc("score"), F.asc("candidate"))
    df = scored.withColumns({"n": F.row_number().over(w), "next": F.lead("score").over(w)}).where("n = 1")
    return df.select("s1", "candidate", "score", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6).alias("gap"))


def before_first_repeat(rows: DataFrame) -> DataFrame:
    """Rows (id, pos) before the first position that repeats an earlier id; all, if none does."""
    first = rows.groupBy("id").agg(F.min("pos").alias("first"))
    cut = rows.join(first, "id").where("pos > first").agg(F.min("pos").alias("cut"))
    return rows.join(F.broadcast(cut)).where("cut IS NULL OR pos < cut").select("id", "pos")


def validate(anchors: DataFrame, matches: DataFrame, candidates: DataFrame, corpus: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(rule, violations) of result lists in long form (s1, candidate); ``rows``: the anchors (s1) that the lists have rows of."""
    rule = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
    known = corpus.select(F.col("entity_id").alias("candidate")).distinct()
    return (
        rule("duplicate_ids", matches.groupBy("s1", "candidate").count().where("count > 1"))
        .union(rule("match_not_candidate", matches.join(candidates, ["s1", "candidate"], "left_anti")))
        .union(rule("unknown_id", candidates.join(known, "candidate", "left_anti")))
        .union(rule("unknown_anchor", candidates.join(anchors, "s1", "left_anti")))
        .union(rule("anchor_without_row", anchors.join(rows if rows is not None else anchors, "s1", "left_anti")))
        .union(rule("wrong_source", candidates.where(~F.col("candidate").rlike("^S[23]-"))))
    )


STAGES = ("raw", "casefold", "unicode", "ampersand", "punctuation", "whitespace", "legal_suffix", "token_sort")


def normalisation_stages(pairs: DataFrame, address: bool = False) -> DataFrame:
    """Share of pairs (a, b) that are equal, or of which one holds the other, after each step; addresses stop at ``whitespace``."""
    df = pairs.select("a", "b")
    for x in ("a", "b"):
        df = df.withColumn(f"{x}_casefold", t.folded(F.col(x), kind="casefold"))
        df = df.withColumn(f"{x}_unicode", t.folded(F.col(f"{x}_casefold"), kind="nfkc"))
    short = F.create_map(*[F.lit(y) for k, v in t.LEGAL.items() for y in (v, k)])
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    steps = {
        "ampersand": lambda x: F.replace(x, F.lit("&"), F.lit(" and ")),
        "punctuation": lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " "),
        "whitespace": lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")),
        "legal_suffix": lambda x: F.array_join(F.transform(words(x), lambda w: F.coalesce(short[w], w)), " "),
        "token_sort": lambda x: F.array_join(F.array_sort(words(x)), " "),
    }
    out = []
    now = {x: F.coalesce(F.col(x), F.lit("")) for x in ("a", "b")}
    for name in STAGES[: STAGES.index("whitespace") + 1] if address else STAGES:
        now = {x: F.col(f"{x}_{name}") if name in ("casefold", "unicode") else steps[name](y) if name in steps else y for x, y in now.items()}
        a, b = now["a"], now["b"]
        some = (a != "") & (b != "")
        out.append(F.struct(F.lit(name).alias("stage"), (some & (a == b)).alias("equal"), (some & (F.contains(a, b) | F.contains(b, a))).alias("held")))
    share = lambda x: F.round(F.avg(F.col(f"s.{x}").cast("double")), 6).alias(x)
    return df.select(F.explode(F.array(*out)).alias("s")).groupBy("s.stage").agg(share("equal"), share("held"))


def describe(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    q = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9]
    return df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), *[F.round(F.percentile(c, F.lit(x)), 6).alias(f"p{int(100 * x)}") for x in q])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
