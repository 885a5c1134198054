"""Tables that cut lineage, written to the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinmill.lineage import shared_dir


def keep(frame: DataFrame, label: str) -> DataFrame:
    """Writes the rows once and reads them from there: lost executors don't lose them."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/skeinmill/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    kept = spark.read.schema(frame.schema).parquet(path)
    kept._skeinmill_path = path
    return kept


def forget(*frames: DataFrame | None) -> None:
    """Deletes kept tables that no plan reads any more."""
    for frame in frames:
        path = getattr(frame, "_skeinmill_path", None)
        if path:
            spark = frame.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


#: Bytes of a counted table's texts that are sent to every task at most.
SENT_BYTES = 32 << 20


def is_small(frame: DataFrame, rows: int, *texts: Column | str) -> bool:
    """Whether a table has at most so many rows, with at most SENT_BYTES in these columns; only sizes of rows + 1 are gathered."""
    size = sum((F.coalesce(F.octet_length(text), F.lit(0)) for text in texts), F.lit(0).cast("long"))
    got = frame.select(size.alias("size")).limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return got["n"] <= rows and got["bytes"] <= SENT_BYTES


#: Rows of an Arrow batch at most where rows hold whole texts.
BATCH_ROWS = 1000


def map_batches(frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows at most, which bounds what the JVM and Python hold of them.

    Spark reads the limit when the plan runs, so it is set for the session, unless that has a lower one.
    mapInArrow can't take names with dots or backticks; a frame with such gets plain ones, so that functions go by place.
    """
    if any(c in name for name in frame.columns for c in ".`"):
        frame = frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return frame.mapInArrow(function, schema)
