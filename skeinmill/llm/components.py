"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinmill.llm.store import forget, keep

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) for every node that is not the least of its component; nodes without a row are their own root.

    Each round is a join and two aggregates on edges, combined before the shuffle; edges only ever
    shrink to one for each node, and two numbers come to the driver to see whether anything changed. Null nodes have no edges.
    """
    now = keep(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"), "edges"
    )
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one")
        large = keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u != v").groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one")
        new = keep(small, "small-star")
        forget(now)
        forget(large)
        now = new
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def extended(roots: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The (node, root) of components that have further edges: these are contracted to edges between roots, of which alone components are made anew."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return keep(roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")).unionByName(joined), "roots")
