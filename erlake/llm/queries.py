"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontamination, embedding_dedup, license_scan, minhash_dedup, quotes, sampled_pieces, secrets, substring_dedup, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_quote_linking": quotes.op1_quote_linking,
        "op2_sampled_pieces": sampled_pieces.op2_sampled_pieces,
        "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return sql | {
        "op6_license_scan": license_scan.op6_sql(),
        "op9_embedding_dedup": embedding_dedup.SQL,
    }
