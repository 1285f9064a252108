"""Profiles of record sources: missing values, shapes of addresses, distinct counts by sketch, frequent values, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes looked for in addresses (fixed values).
SHAPES = {"five_digit": r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)", "six_digit": r"(?<!\d)[1-9]\d{5}(?!\d)", "alphanumeric": r"(?i)\b[A-Z0-9][A-Z0-9 -]{2,9}\b"}


def _commas(x: str) -> Column:
    return F.length(x) - F.length(F.replace(F.col(x), F.lit(","), F.lit("")))


def shapes(records: DataFrame) -> DataFrame:
    """Rows, missing fields, postal shapes and comma segments of each source, in one pass."""
    missing = [F.count_if(F.trim(x) == "").alias(f"missing_{x}") for x in ("entity_id", "business_name", "business_address", "country")]
    found = [F.count_if(F.col("business_address").rlike(p)).alias(n) for n, p in SHAPES.items()]
    segments = [F.count_if(_commas("business_address") >= n - 1).alias(f"segments_{n}") for n in (2, 3)]
    words = F.sum(F.size(F.regexp_extract_all("business_name", F.lit(r"\S+"), F.lit(0)))).alias("name_words")
    return records.groupBy("source").agg(F.count("*").alias("n_rows"), *missing, *found, *segments, words)


def distinct_estimates(records: DataFrame, columns: list[str], bits: int = 12) -> DataFrame:
    """Distinct values of each column by source, from HyperLogLog sketches of ``2 ** bits`` registers that merge across partitions."""
    return records.groupBy("source").agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(x), F.lit(bits))).alias(f"n_{x}") for x in columns])


def most_common(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent values with their counts; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def duplicate_rate(df: DataFrame, column: str) -> DataFrame:
    """The share of rows whose value occurs more than once."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.agg(F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0)), 6).alias("duplicate_rate"))


def malformed(records: DataFrame) -> DataFrame:
    """(entity_id, n, bad): ids that repeat or don't look like ids."""
    bad = ~F.col("entity_id").rlike("^S[123]-[0-9]+$")
    return records.groupBy("entity_id").agg(F.count("*").alias("n")).select("entity_id", "n", bad.alias("bad")).where("n > 1 OR bad")


def one_of_each_id(records: DataFrame) -> DataFrame:
    """One row for each entity_id: the smallest by all columns, in order."""
    rest = [x for x in records.columns if x != "entity_id"]
    return records.groupBy("entity_id").agg(F.min(F.struct(*rest)).alias("r")).select("entity_id", "r.*")


def drawn(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """n rows by the hash of ``column`` and the seed, the same for any partitioning."""
    draw = F.crc32(F.concat(F.col(column), F.lit(f"|{seed}")).cast("binary"))
    return df.orderBy(draw, column).limit(n)


def histogram_2d(df: DataFrame, x: str, y: str, bins: int, low: float = 0.0, high: float = 1.01) -> DataFrame:
    """(x_bin, y_bin, n, log10_n) of the cells that hold rows."""
    b = lambda z: F.width_bucket(z, F.lit(low), F.lit(high), F.lit(bins))
    return df.groupBy(b(x).alias("x_bin"), b(y).alias("y_bin")).agg(F.count("*").alias("n")).withColumn("log10_n", F.round(F.log10("n"), 6))


def truth_sources(anchors: DataFrame, truth: DataFrame) -> DataFrame:
    """Anchors and links by the sources their links come from: S2_only, S3_only, both, none or unexpected."""
    has = lambda s: F.coalesce(F.array_contains("sources", s), F.lit(False))
    of = truth.groupBy("s1").agg(F.collect_set(F.split_part("candidate", F.lit("-"), F.lit(1))).alias("sources"), F.count("*").alias("links"))
    odd = F.size(F.array_except("sources", F.array(F.lit("S2"), F.lit("S3")))) > 0
    kind = F.when(F.col("sources").isNull(), "none").when(odd, "unexpected").when(has("S2") & has("S3"), "both").when(has("S2"), "S2_only").otherwise("S3_only")
    return anchors.select("s1").join(of, "s1", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("anchors"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


def pair_features(both: DataFrame, cosines: dict[str, DataFrame] | None = None) -> DataFrame:
    """Exploratory features of pairs (s1, candidate, a, b: structs of name, address, country in normal form); a column for each of ``cosines``."""
    from ..functions import kernels as k
    from ..functions import text as t

    c = F.col
    ta, tb, da, db = t.tokens(c("a.name")), t.tokens(c("b.name")), t.tokens(c("a.address")), t.tokens(c("b.address"))
    na, nb = t.numbers(c("a.address")), t.numbers(c("b.address"))
    post = lambda x: F.filter(x, lambda v: F.length(v).between(5, 6))
    some = lambda x: F.size(x) > 0
    shared = F.size(F.array_intersect(da, db)) / F.least(F.size(da), F.size(db))
    out = both.select(
        "s1", "candidate", ((c("a.name") != "") & (c("a.name") == c("b.name"))).alias("name_exact"), t.levenshtein_similarity(c("a.name"), c("b.name")).alias("name_levenshtein"),
        k.jaro_winkler_similarity("a.name", "b.name").alias("name_jaro_winkler"), t.jaccard(ta, tb).alias("name_token_jaccard"), t.jaccard(da, db).alias("address_token_jaccard"), t.jaccard(na, nb).alias("numeric_overlap"),
        some(F.array_intersect(na, nb)).alias("numeric_any_agreement"), (some(na) & some(nb) & (F.array_sort(na) == F.array_sort(nb))).alias("numeric_all_agreement"), some(F.array_intersect(post(na), post(nb))).alias("postal_agreement"),
        t.length_ratio(c("a.address"), c("b.address")).alias("address_length_ratio"), F.when(some(da) & some(db), shared).otherwise(0.0).alias("address_containment"), (c("a.country") == c("b.country")).alias("country_agreement"),
    )
    for name, df in (cosines or {}).items():
        out = out.join(df.withColumnRenamed("cosine", name), ["s1", "candidate"])
    return out
