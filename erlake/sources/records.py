"""Record sources: tab-separated files with a fixed schema, ground truth, and the derived demonstration records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A headed TSV of records; empty fields are empty strings. A header that differs is an error."""
    df = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).schema(RECORD).csv(path)
    return df.na.fill("")


def head(spark: SparkSession, path: str, n: int = 3) -> tuple[list[str], DataFrame]:
    """A TSV's column names and its first n rows, as strings; reads one partition at most."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.columns, df.limit(n)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).schema(TRUTH).csv(path).na.fill("")


def parse_truth(truth: DataFrame) -> DataFrame:
    """(s1, candidate): one row per listed id, blanks dropped."""
    ids = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.select(F.col("source1_entity_id").alias("s1"), F.explode(ids).alias("candidate")).distinct()


def check_truth(truth: DataFrame, anchors: DataFrame) -> None:
    """Raises if an anchor has no truth row or an id has two."""
    if not truth.groupBy("source1_entity_id").count().where("count > 1").isEmpty():
        raise ValueError("duplicate truth rows")
    if not anchors.join(truth, anchors["entity_id"] == truth["source1_entity_id"], "left_anti").isEmpty():
        raise ValueError("anchors without truth")


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").option("compression", "zstd").parquet(path)


#: Demonstration records from ``documents``; {div} is integer division.
RECORDS_SQL = """WITH d AS (SELECT doc_id, replace(replace(text, chr(10), ' '), '  ', ' ') AS t FROM documents),
w AS (SELECT doc_id, split_part(t,' ',1) AS w1, split_part(t,' ',2) AS w2, split_part(t,' ',3) AS w3, split_part(t,' ',4) AS w4, split_part(t,' ',5) AS w5,
  CAST(10 + (doc_id * 37) % 9000 AS VARCHAR(20)) AS num, doc_id % 4 AS c FROM d),
b AS (SELECT *, CASE c WHEN 0 THEN 'US' WHEN 1 THEN 'India' WHEN 2 THEN 'France' ELSE 'Germany' END AS country,
  CASE c WHEN 0 THEN CAST(10001 + (doc_id * 13) % 80000 AS VARCHAR(20)) WHEN 1 THEN CAST(110001 + (doc_id * 13) % 700000 AS VARCHAR(20)) WHEN 2 THEN CAST(13001 + (doc_id * 13) % 80000 AS VARCHAR(20)) ELSE CAST(20001 + (doc_id * 13) % 70000 AS VARCHAR(20)) END AS pin,
  CASE c WHEN 0 THEN CASE (doc_id {div} 4) % 3 WHEN 0 THEN 'Fresno, CA' WHEN 1 THEN 'Austin, TX' ELSE 'Albany, NY' END WHEN 1 THEN 'Pune, Maharashtra' WHEN 2 THEN 'Lyon' ELSE 'Ulm, Bayern' END AS geo FROM w)
SELECT 'S1-' || CAST(doc_id AS VARCHAR(20)) AS entity_id, w1||' '||w2||' & '||w3||' Corp' AS business_name, num||' '||w4||' '||w5||' Rd, '||geo||', '||pin AS business_address, country FROM b
UNION ALL SELECT 'S2-' || CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 5 = 0 THEN upper(replace(w2||' '||w1||' and '||w3, 'ß', 'ss')) ELSE w1||' '||w2||' and '||w3||' Corporation' END,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 THEN num||' '||w4||' Road, '||geo ELSE num||' '||w4||' '||w5||' Road, '||geo||', '||pin END, country FROM b WHERE doc_id % 4 <> 3 OR doc_id % 8 = 3
UNION ALL SELECT 'S3-' || CAST(doc_id AS VARCHAR(20)), substring(w1,1,4)||' '||w2||' '||w3||' Ltd', w4||' '||num||', '||geo||' '||pin, CASE WHEN c = 0 AND doc_id % 3 = 0 THEN 'U.S.' ELSE country END FROM b WHERE doc_id % 3 <> 1"""


def demo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS_SQL.replace("{div}", "div").replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
