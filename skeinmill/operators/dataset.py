"""Training examples: building, splitting, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinmill.functions.text import CANONICAL_REFUSAL, distilled_answer
from skeinmill.operators.generation import example_checks, violations
from skeinmill.operators.numbering import hash_cut


def examples(rows: DataFrame) -> DataFrame:
    """(…, ideal_answer, is_refusal, violations) from teachers' outputs (query, retrieved_chunks, response).

    Rows whose response can't be parsed have a violation too: they're skipped and counted, not fatal.
    """
    rows = rows.withColumn("ideal_answer", distilled_answer("response")).withColumn("is_refusal", F.coalesce(F.col("ideal_answer") == CANONICAL_REFUSAL, F.lit(False)))
    return violations(rows, example_checks())


def stratified_split(rows: DataFrame, fraction: float = 0.1, seed: int = 42, key: str = "example_id", stratum: str = "is_refusal") -> DataFrame:
    """Adds split: of each stratum, one row at least and else the rounded share is for validation."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    size = rows.groupBy(F.col(stratum).alias("_s")).agg(F.greatest(F.lit(1), F.bround(F.count("*") * fraction)).alias("_n"))
    sized = rows.join(F.broadcast(size), F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    return hash_cut(sized, [stratum], F.col("_n"), key, seed, "_val").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val", "_n")


def strata(rows: DataFrame, stratum: str = "is_refusal") -> DataFrame:
    return rows.groupBy(stratum).agg(F.count("*").alias("n"))


def cache_key(query: Column, chunks: Column) -> Column:
    """Query and chunk ids, in the order in which they were retrieved."""
    return F.sha2(F.concat_ws("\x1f", query, F.array_join(F.transform(chunks, lambda c: c["chunk_id"]), "\x1f")), 256)


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    newest = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(newest, [key, order], "left_semi")
