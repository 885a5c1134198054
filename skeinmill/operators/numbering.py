"""Places within groups, without one task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinmill.functions.text import hash_order
from skeinmill.lineage import cut

def numbered(rows: DataFrame, by: str, *order: Column | str, out: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in its group's order; null is a group, and rows alike in order are placed in some order.

    Rows are sorted by ranges and numbered within each; only the sizes of groups by range meet in a window.
    """
    ranged = cut(rows.orderBy(by, *order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33))
    parts = ranged.groupBy("_range", F.col(by).alias("_by")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_range", "_by", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    met = ranged.alias("r").join(parts.alias("p"), (F.col("r._range") == F.col("p._range")) & F.col(f"r.{by}").eqNullSafe(F.col("p._by")))
    return met.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("r._id") + F.col("p._shift")).alias(out))


def hash_cut(rows: DataFrame, by: list[str], n: Column, key: str, seed: int, out: str | None = None) -> DataFrame:
    """The first n rows of each group in the order of the key's hash, n being an expression over the group; with `out`
    all rows, and whether each is among them.

    A histogram of ranges of the hash tells how far whole ranges go; of the range at the cut alone rows are put in order,
    by hash and key. Null is a group; keys are unique, and of rows that share one any may be the first.
    """
    hashed = rows.withColumns({"_hash": hash_order(seed, key), "_wanted": n})
    hashed = hashed.withColumn("_range", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counted = hashed.groupBy(*by, "_range").agg(F.count("*").alias("_c"), F.max("_wanted").alias("_wanted"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counted.withColumn("_before", before).where(F.col("_before") < F.col("_wanted"))
    cuts = reached.groupBy(*(F.col(c).alias(f"_of_{i}") for i, c in enumerate(by))).agg(F.max(F.struct("_range", (F.col("_wanted") - F.col("_before")).alias("left"))).alias("_cut"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    met = hashed.drop("_wanted").join(cuts, same, "left")
    edge = F.coalesce(F.col("_range") == F.col("_cut._range"), F.lit(False))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_hash", key))
    at_edge = met.where(edge).withColumn("_in", place <= F.col("_cut.left"))
    rest = met.where(~edge).withColumn("_in", F.coalesce(F.col("_range") < F.col("_cut._range"), F.lit(False)))
    if out is None:
        return rest.where("_in").unionByName(at_edge.where("_in")).select(*rows.columns)
    return rest.unionByName(at_edge).select(*rows.columns, F.col("_in").alias(out))
