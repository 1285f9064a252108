"""Anchors as a stream: new files of anchors are matched against a static corpus, exactly once by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import RECORD


def match_stream(spark: SparkSession, folder: str, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 50) -> StreamingQuery:
    """Runs ``match`` on each micro-batch of at most ``files`` new TSV files and appends its rows to ``out``.

    Stateless, so no watermark is needed; a batch's rows go to a folder named by its id, so a repeated batch replaces itself.
    """
    stream = spark.readStream.option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files).schema(RECORD).csv(folder)

    def write(batch: DataFrame, n: int) -> None:
        match(batch.na.fill("")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
