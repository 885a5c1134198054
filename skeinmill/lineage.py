"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset on a local master, as in tests, a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="skeinmill-"))
            current = context._jsc.sc().getCheckpointDir()
        named = current.get()
    return named.rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The same rows read from a checkpoint, which outlives executors."""
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return frame.checkpoint()
