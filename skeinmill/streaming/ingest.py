"""New documents as a stream: each batch is parsed, chunked and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinmill.operators.chunking import chunk


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, strategies: list[str] | None = None, size: int = 512, overlap: int = 64) -> StreamingQuery:
    """Chunks of (doc_id, content) Parquet files that arrive in a folder, to a table partitioned by batch.

    A batch that's run again after a failure replaces its own partition, so chunks aren't doubled.
    """
    rows = spark.readStream.schema("doc_id string, content string").parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        chunk(batch, strategies, size, overlap).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type, batch or streaming; a stream drops what comes later than allowed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
