"""Ranks by score and then corpus order, and what may be sent to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are rounded before ranking, because sums of doubles depend on their order, which no cluster promises.
PLACES = 9
#: Rows of terms, and bytes, that are sent to every task at most; both are counted.
SENT_TERMS, SENT_BYTES = 100_000, 64 << 20


def few(rows: DataFrame, n: int, size: Column, sent_bytes: int) -> bool:
    """Whether there are n rows at most, of so many bytes at most; only the sizes of n + 1 rows are gathered."""
    got = rows.select(size.alias("size")).limit(n + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return got["n"] <= n and got["bytes"] <= sent_bytes


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "pos") -> DataFrame:
    """The k best rows of each group with their rank from 1."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
