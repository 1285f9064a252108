"""The block index as a stored table: built once for an input, found again by the input's and the code's signature."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CODE = Path(__file__).resolve().parents[1]


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of the machine where the session names none (tests, single machine)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/erlake").rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def file_signature(spark: SparkSession, paths: Iterable[str]) -> dict[str, dict[str, int]]:
    """Bytes and time of change of each file, by Hadoop's file system, so in any store that Spark reads."""
    out = {}
    for path in sorted(paths):
        p, fs = _path(spark, path)
        status = fs.getFileStatus(p)
        out[path] = {"bytes": status.getLen(), "modified_ms": status.getModificationTime()}
    return out


def code_signature(modules: Iterable[str]) -> dict[str, str]:
    """sha256 of modules of this package, by their path in it; read by the import system, so from a zip file too."""
    import importlib.resources

    root = importlib.resources.files("erlake")
    return {m: hashlib.sha256(root.joinpath(m).read_bytes()).hexdigest() for m in sorted(modules)}


def manifest(spark: SparkSession, inputs: Iterable[str], modules: Iterable[str], config: dict | None = None) -> dict:
    """What a stored result depends on: input files, code, library versions and settings."""
    import numpy
    import pandas
    import pyarrow

    versions = {"spark": spark.version, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
    return {"config": config or {}, "input_files": file_signature(spark, inputs), "code_sha256": code_signature(modules), "libraries": versions}


def resumed(spark: SparkSession, name: str, signature: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table of that name and signature; built and written first unless a finished one is there.

    A build that was broken off leaves no ``_SUCCESS`` and is written anew.
    """
    digest = hashlib.sha256(json.dumps(signature, sort_keys=True).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/{name}-{digest}"
    p, fs = _path(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, for tables that a query reads more than once."""
    path = f"{shared_folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
