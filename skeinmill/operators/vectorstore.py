"""Vectors stored as binary blocks that a search can leave out, and cells around pivots for joins of similar vectors.

Pivots are the vectors of least hash. A vector's cell is that of the pivot at the least angle; a cell's vectors are cut into
blocks of up to BLOCK, each a matrix with its centroid, its radius and its greatest length. An inner product with a vector
in a block is at most q.centroid + |q| radius and at most |q| times that length, so that a block whose bound can't reach a query's
k-th score so far is left out, and results are exact.

A store is a folder of immutable segments and manifests, as the lexical index is: batches that it has aren't added again.

For a join over a threshold, a vector goes to each cell in which the triangle inequality on angles allows it a partner: its angle
to the pivot less the cell's widest one must not be over the threshold's. Pairs are then made within cells alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.operators.ranking import PLACES, SENT_BYTES, few, top_k
from skeinmill.sinks import manifest as manifests

BLOCK, PIVOTS = 1024, 1024
#: Queries that are sent to every task at most, counted; blocks over which thresholds are found before blocks are read.
SENT_QUERIES, MANY_BLOCKS = 65_536, 64
SLACK = 1e-6


class Store(NamedTuple):
    spark: SparkSession
    path: str
    manifest: dict

    @property
    def n(self) -> int:
        return sum(s["n"] for s in self.manifest["segments"])


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def pivots_of(rows: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """Directions of the n vectors of least hash; at most PIVOTS vectors come to the driver."""
    some = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(max(1, min(n, PIVOTS))).toArrow()
    return unit(matrix(some.column("v").combine_chunks())) if some.num_rows else np.zeros((0, 0))


def load(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, manifests.latest(spark, f"{path}/manifest") or {"version": 0, "segments": []})


def append(spark: SparkSession, path: str, rows: DataFrame, batch: str, key: str = "chunk_id", block: int = BLOCK) -> Store:
    """Adds a batch of vectors (key, pos, embedding) as a segment, unless the store has it; rows without a vector are left out."""
    before = load(spark, path)
    if any(batch == s["batch"] for s in before.manifest["segments"]):
        return before
    own = rows.where("embedding is not null").select(key, F.col("pos").cast("long").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = own.count()
    pivots, kind, folder = pivots_of(own, key, "embedding", -(-n // block)), dict(own.dtypes)[key], uuid.uuid4().hex

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            near = unit(matrix(part.column(2))) @ pivots.T
            cell = near.argmax(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])], names=["key", "pos", "v", "cell", "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cells = np.asarray(part.column(3))
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), part.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                for i in range(low, high, block):
                    one = part.slice(i, min(block, high - i))
                    data = matrix(one.column(2))
                    centre = data.mean(0)
                    ends = pa.array([0, one.num_rows], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([one.num_rows], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([np.linalg.norm(data - centre, axis=1).max()]), pa.array([np.linalg.norm(data, axis=1).max()]),
                            *(pa.ListArray.from_arrays(ends, pa.concat_arrays([one.column(c)])) for c in (0, 1)), pa.array([data.tobytes()], pa.binary()),
                        ],
                        names=["n", "centroid", "radius", "length", "keys", "places", "data"],
                    )

    if n:
        cells = own.mapInArrow(placed, f"key {kind}, pos long, v array<double>, cell int, near double")
        # A cell's vectors go to several tasks, those at like angles together, which makes blocks small; no task takes a whole hot cell.
        dealt = cells.repartitionByRange("cell", "near", "pos").sortWithinPartitions("cell", "near", "pos")
        packed = dealt.mapInArrow(pack, f"n int, centroid array<double>, radius double, length double, keys array<{kind}>, places array<long>, data binary")
        packed.withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{path}/segments/{folder}")
    made = {"folder": folder, "batch": batch, "n": n, "blocks": spark.read.parquet(f"{path}/segments/{folder}").count() if n else 0}
    manifests.publish(spark, f"{path}/manifest", {"segments": [*before.manifest["segments"], made]}, before.manifest["version"] + 1)
    return load(spark, path)


def blocks(store: Store) -> DataFrame | None:
    out = None
    for k, s in enumerate(store.manifest["segments"]):
        if s["n"]:
            part = store.spark.read.parquet(f"{store.path}/segments/{s['folder']}").withColumn("segment", F.lit(k))
            out = part if out is None else out.unionByName(part)
    return out


class _Asked:
    """Queries as rows of a matrix, their lengths and thresholds."""

    def __init__(self, queries: pa.Table):
        self.ids = queries.column("query_id").combine_chunks()
        self.rows = matrix(queries.column("v").combine_chunks()) if queries.num_rows else np.zeros((0, 1))
        self.lengths = np.linalg.norm(self.rows, axis=1)
        self.bar = np.full(len(self.ids), -np.inf)

    def bounds(self, centroids: np.ndarray, radius: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The greatest inner product of each query, a row, with a vector of each block."""
        return np.minimum(self.rows @ centroids.T + self.lengths[:, None] * radius[None, :], self.lengths[:, None] * length[None, :])


_PARTS = ("n", "centroid", "radius", "length", "keys", "places", "data")


def _searched(batches: Iterator[pa.RecordBatch], asked: _Asked, k: int, counting: bool = False) -> Iterator[pa.RecordBatch]:
    """The k best of each block for each query whose threshold the block's bound reaches; thresholds rise with what is found."""
    bar, met = asked.bar.copy(), 0
    n_blocks = 0
    for batch in batches:
        if not batch.num_rows or not len(asked.ids):
            continue
        bounds = asked.bounds(matrix(batch.column(1)), *(np.asarray(batch.column(c)) for c in (2, 3)))
        # Blocks that promise most come first, so that thresholds rise soon.
        for b in np.argsort(-bounds.max(0, initial=-np.inf), kind="stable").tolist():
            n_blocks += 1
            some = np.flatnonzero(bounds[:, b] >= bar - SLACK)
            met += len(some)
            if not len(some):
                continue
            keys, places = batch.column(4)[b].values, np.asarray(batch.column(5)[b].values)
            data = np.frombuffer(batch.column(6)[b].as_buffer()).reshape(len(keys), -1)
            scores = np.round(asked.rows[some] @ data.T, PLACES)
            order = np.lexsort((np.broadcast_to(places, scores.shape), -scores), axis=1)[:, :k]
            if order.shape[1] == k:
                bar[some] = np.maximum(bar[some], scores[np.arange(len(some)), order[:, -1]])
            if not counting:
                of, at = np.repeat(np.arange(len(some)), order.shape[1]), order.ravel()
                good = scores[of, at] >= bar[some][of] - SLACK
                of, at = of[good], at[good]
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(some[of])), keys.take(pa.array(at)), pa.array(places[at]), pa.array(scores[of, at])], names=["query_id", "chunk_id", "pos", "score"])
    if counting:
        yield pa.RecordBatch.from_arrays([pa.array([n_blocks * len(asked.ids)], pa.int64()), pa.array([met], pa.int64())], names=["pairs", "met"])


def _asked(queries: DataFrame, store: Store, k: int) -> _Asked | None:
    """The queries with thresholds, or None if they are too many to send."""
    wide = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("v"))
    if not few(wide, SENT_QUERIES, 8 * F.size("v") + F.octet_length(F.col("query_id").cast("string")), SENT_BYTES):
        return None
    asked = _Asked(wide.toArrow())
    if sum(s["blocks"] for s in store.manifest["segments"]) > MANY_BLOCKS and len(asked.ids):
        # The block whose centroid is nearest to a query holds enough good rows for a first threshold.
        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = asked.rows @ matrix(batch.column(2)).T
                    best = near.argmax(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(best))), batch.column(0).take(pa.array(best)), batch.column(1).take(pa.array(best)), pa.array(near[np.arange(len(best)), best])], names=["q", "segment", "block", "near"])

        every = blocks(store)
        heads = every.select("segment", "block", "centroid").mapInArrow(nearest, "q long, segment int, block long, near double")
        heads = heads.groupBy("q").agg(F.max(F.struct("near", "segment", "block")).alias("top")).select("top.segment", "top.block").distinct()
        found = every.join(F.broadcast(heads), ["segment", "block"], "left_semi").select(*_PARTS).mapInArrow(lambda it: _searched(it, asked, k), _schema(queries, every))
        places = {q: i for i, q in enumerate(asked.ids.to_pylist())}
        for r in top_k(found, k).where(F.col("rank") == k).select("query_id", "score").collect():
            asked.bar[places[r["query_id"]]] = r["score"]
    return asked


def _schema(queries: DataFrame, every: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(every.dtypes)['keys'].removeprefix('array<').removesuffix('>')}, pos long, score double"


def search(queries: DataFrame, store: Store, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, pos, score, rank): the k greatest inner products of each query (query_id, embedding).

    Up to SENT_QUERIES queries of SENT_BYTES, which are counted, go to all tasks; more are crossed with the blocks in blocks of their own.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    every = blocks(store)
    if every is None:
        return queries.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    asked = _asked(queries, store, k)
    if asked is not None:
        return top_k(every.select(*_PARTS).mapInArrow(lambda it: _searched(it, asked, k), _schema(queries, every)), k)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)])), pa.array([matrix(part.column(1)).tobytes()], pa.binary())], names=["ids", "q"])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = one.column(7)[0].values
                rows = pa.table({"query_id": ids, "v": pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(one.column(8)[0].as_buffer())), len(one.column(1)[0])).cast(pa.list_(pa.float64()))})
                yield from _searched(iter([one]), _Asked(rows), k)

    wide = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("v"))
    met = every.select(*_PARTS).crossJoin(wide.mapInArrow(pack, f"ids array<{dict(wide.dtypes)['query_id']}>, q binary"))
    return top_k(met.mapInArrow(crossed, _schema(queries, every)), k)


def met_blocks(queries: DataFrame, store: Store, k: int = 20) -> DataFrame:
    """One row (pairs, met): pairs of a query and a block, and those that a search multiplies."""
    asked, every = _asked(queries, store, k), blocks(store)
    if asked is None or every is None:
        raise ValueError("no blocks, or too many queries to send")
    return every.select(*_PARTS).mapInArrow(lambda it: _searched(it, asked, k, True), "pairs long, met long").agg(F.sum("pairs").alias("pairs"), F.sum("met").alias("met"))


#: Right rows under which all blocks meet, because finding cells costs more; cells that are sent to every task at most.
PIVOT_ROWS, SENT_CELLS = 1 << 16, 100_000


def in_cells(left: DataFrame, right: DataFrame, threshold: float, key: str, vector: str, group: str | None, block: int = BLOCK) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with `cell`, a right row's own and those in which a left row may have a partner over the threshold; a pair meets in one cell.

    None where that isn't worth it: for few right rows, a threshold that isn't positive, or if, as counted, cells would
    make more than half the products of all blocks, as with vectors that point everywhere.
    """
    own = lambda x: x.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).alias("of")).where("of is not null")
    ours, theirs = own(left), own(right)
    n = theirs.count() if threshold > 0 else 0
    if n < max(1, PIVOT_ROWS):
        return None
    pivots = pivots_of(theirs, "key", "v", max(2, round(n**0.5)))
    kinds = dict(theirs.dtypes)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(1))
            near = np.clip(unit(rows) @ pivots.T, -1, 1)
            cell = near.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.arccos(near[np.arange(len(cell)), cell])), pa.array(np.linalg.norm(rows, axis=1))], names=["key", "v", "of", "cell", "angle", "length"])

    homes = theirs.mapInArrow(home, f"key {kinds['key']}, v array<double>, of {kinds['of']}, cell int, angle double, length double")
    cells = homes.groupBy("of", "cell").agg(F.max("angle").alias("angle"), F.max("length").alias("length"), F.count("*").alias("n")).limit(SENT_CELLS + 1).collect()
    if len(cells) > SENT_CELLS:
        return None
    by_group: dict = {}
    for r in cells:
        by_group.setdefault(r["of"], []).append((r["cell"], r["angle"], r["length"], r["n"]))
    known = {of: tuple(map(np.array, zip(*rows, strict=True))) for of, rows in by_group.items()}

    def reach(batches: Iterator[pa.RecordBatch], counting: bool) -> Iterator[pa.RecordBatch]:
        products = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, groups = matrix(batch.column(1)), batch.column(2).to_pylist()
            angles = np.arccos(np.clip(unit(rows) @ pivots.T, -1, 1))
            lengths = np.linalg.norm(rows, axis=1)
            found: list[np.ndarray] = []
            for i, of in enumerate(groups):
                if of not in known:
                    found.append(np.zeros(0, np.int32))
                    continue
                cell, widest, longest, size = known[of]
                bound = lengths[i] * longest * np.cos(np.maximum(0, angles[i, cell] - widest))
                may = bound > threshold - SLACK
                products += int(size[may].sum())
                found.append(cell[may].astype(np.int32))
            if not counting:
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))], names=["key", "v", "of", "cells"])
        if counting:
            yield pa.RecordBatch.from_arrays([pa.array([products], pa.int64())], names=["products"])

    products = ours.mapInArrow(lambda it: reach(it, True), "products long").agg(F.sum("products")).first()[0] or 0
    sizes = ours.groupBy("of").agg(F.count("*").alias("l")).join(theirs.groupBy("of").agg(F.count("*").alias("r")), "of").agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0
    if 2 * products > sizes:
        return None
    spread = ours.mapInArrow(lambda it: reach(it, False), f"key {kinds['key']}, v array<double>, of {kinds['of']}, cells array<int>")
    named = lambda x, cell: x.select(F.col("key").alias(key), F.col("v").alias(vector), F.struct("of", cell.alias("cell")).alias("cell"))
    return named(spread.withColumn("at", F.explode("cells")), F.col("at")), named(homes, F.col("cell"))
