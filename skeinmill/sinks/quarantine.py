"""Rows that fail checks are a side output: one pass writes good and bad rows apart and counts what each check failed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.operators.generation import violations


class Checked(NamedTuple):
    """The rows that pass, those that don't with the names of the checks they fail, and how many rows there were and each check failed."""

    passed: DataFrame
    quarantined: DataFrame
    n: int
    failures: dict[str, int]


def write_checked(rows: DataFrame, checks: dict[str, Column], path: str) -> Checked:
    """Writes rows to a folder each for those that pass and those that don't, and counts in the same pass.

    What a folder holds is replaced. The counts are those of the write itself, observed by it: no row is read or checked again.
    """
    marked = violations(rows.drop("violations"), checks).withColumn("passed", F.size("violations") == 0)
    seen = Observation()
    failed = [F.count_if(F.array_contains("violations", name)).alias(name) for name in checks]
    marked.observe(seen, F.count(F.lit(1)).alias("_n"), *failed).write.mode("overwrite").partitionBy("passed").parquet(path)
    counts = dict(seen.get)
    n = counts.pop("_n")
    written = rows.sparkSession.read.schema(T.StructType([*marked.schema.fields])).parquet(path)
    return Checked(written.where("passed").drop("passed", "violations"), written.where("not passed").drop("passed"), n, counts)
