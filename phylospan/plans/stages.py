"""Resumable stages: a result is written once for its parameters and read again afterwards."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stage_path(folder: str, name: str, parameters: dict[str, object]) -> str:
    """The folder of a stage's result: its name and a hash of everything it depends on."""
    text = json.dumps(parameters, sort_keys=True, default=str)
    return f"{folder}/{name}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def is_complete(spark: SparkSession, path: str) -> bool:
    """True where a stage has been written to its end (Spark's _SUCCESS mark), on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def stage(spark: SparkSession, folder: str, name: str, parameters: dict[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table: read when it is complete for these parameters, else built and written.

    Other parameters make another path, so a changed threshold never reuses an old result.
    """
    path = stage_path(folder, name, parameters)
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
