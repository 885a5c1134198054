"""Dense and lexical retrieval for whole tables of queries.

Ranks are explicit: by score, then corpus order.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinmill.functions.text import words
from skeinmill.lineage import shared_dir
from skeinmill.operators import lexical, vectorstore
from skeinmill.operators.ranking import PLACES, SENT_BYTES, few, top_k

BLOCK = 1024


def hashing_encoder(dim: int = 64) -> Callable[[pd.Series], list[list[float]]]:
    """A deterministic stand-in for a sentence encoder: signed feature hashing of words, length 1."""

    def encode(texts: pd.Series) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                digest = hashlib.md5(word.encode()).digest()
                out[i, int.from_bytes(digest[:4], "big") % dim] += 1 if digest[4] & 1 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return encode


def embed(rows: DataFrame, text: str, out: str = "embedding", encoder: Callable[[pd.Series], list[list[float]]] | None = None, load: Callable[[], Callable[[pd.Series], list[list[float]]]] | None = None) -> DataFrame:
    """Adds vectors of a text column by a pluggable encoder, in Arrow batches.

    A model that's costly to load is given as `load`, which runs once in each task, on the executor.
    """
    make = load or (lambda: encoder or hashing_encoder())

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for batch in batches:
            yield pd.Series(encode(batch), index=batch.index)

    return rows.withColumn(out, vectors(text))


def _changes(column: pa.Array) -> np.ndarray:
    """Which rows but the last differ from the next one, a null from all that isn't null."""
    if pa.types.is_struct(column.type):
        return np.any([_changes(part) for part in column.flatten()], axis=0)
    codes = np.asarray(column.dictionary_encode("encode").indices)
    return codes[1:] != codes[:-1]


def _blocks(rows: DataFrame, key: str, pos: str, vector: str, block: int, group: str | None = None) -> DataFrame:
    """Rows of up to `block` keys, places and vectors each, all of one group if there is a group column, which says its parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [0, *(np.flatnonzero(_changes(batch.column(3))) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                for i in range(low, high, block):
                    part = batch.slice(i, min(block, high - i))
                    one = pa.array([0, part.num_rows], pa.int32())
                    data = vectorstore.matrix(part.column(2)).tobytes()
                    keys, places = (pa.ListArray.from_arrays(one, pa.concat_arrays([part.column(c)])) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([keys, places, pa.array([data]), part.column(3).slice(0, 1)], names=["keys", "places", "data", "grp"])

    wide = rows.where(F.col(vector).isNotNull()).select(F.col(key), F.col(pos).cast("long"), F.col(vector).cast("array<double>"), (F.col(group) if group else F.lit(0)).alias("grp"))
    if group:
        wide = wide.repartition("grp", F.pmod(F.xxhash64(key), F.col("grp.parts"))).sortWithinPartitions("grp", key)
    kinds = dict(wide.dtypes)
    return wide.mapInArrow(pack, f"keys array<{kinds[key]}>, places array<long>, data binary, grp {kinds['grp']}")


#: Blocks that are sent to every task at most; they are counted, and more are shuffled.
SENT_BLOCKS = 64


def _few(rows: DataFrame, n: int, size: Column) -> bool:
    return few(rows, n, size, SENT_BYTES)


def _block_bytes(keys: str, data: str) -> Column:
    return F.octet_length(data) + F.octet_length(F.concat_ws("", F.col(keys).cast("array<string>")))


#: Parts at most that the meetings of one group's blocks are dealt to, and left blocks that are worth a part.
MEETINGS, MEETING_BLOCKS = 64, 16


def _meet(left: DataFrame, right: DataFrame, key: str, vector: str, group: str | None, block: int, pick: Callable[[pa.Array, pa.Array, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """What `pick` makes of the keys and rounded inner products of each two blocks, of one group if there's a group column.

    A group's rows are packed by as many tasks as it fills blocks. Each left block goes to one of up to MEETINGS
    parts of its group, a part for every MEETING_BLOCKS, and the right ones to all of them, so that a hot group's
    meetings aren't one task's.
    Without groups the right side, or else the left, is sent to every task if it is small, which is counted.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ka, da, kb, db in zip(*(batch.column(n) for n in ("ka", "da", "kb", "db")), strict=True):
                sims = np.round(np.frombuffer(da.as_py()).reshape(len(ka.values), -1) @ np.frombuffer(db.as_py()).reshape(len(kb.values), -1).T, PLACES)
                yield pa.RecordBatch.from_arrays(pick(ka.values, kb.values, sims), names=names)

    left, right = left.withColumn("pos", F.lit(0)), right.withColumn("pos", F.lit(0))
    if group:
        both = left.select(F.col(group).alias("of")).union(right.select(F.col(group).alias("of"))).where("of is not null")
        large = both.groupBy("of").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
        left, right = (x.where(F.col(group).isNotNull()).join(large, F.col(group) == F.col("of"), "left").withColumn("grp", F.struct(F.col(group).alias("of"), F.coalesce("parts", F.lit(1)).alias("parts"))).drop("of", "parts") for x in (left, right))
    ours = _blocks(left, key, "pos", vector, block, group and "grp").select("grp", F.col("keys").alias("ka"), F.col("data").alias("da"))
    theirs = _blocks(right, key, "pos", vector, block, group and "grp").select("grp", F.col("keys").alias("kb"), F.col("data").alias("db"))
    if group:
        spread = F.least(F.ceil(F.col("grp.parts") / MEETING_BLOCKS).cast("int"), F.lit(MEETINGS))
        met = ours.withColumn("part", F.pmod(F.xxhash64("ka"), spread).cast("int")).join(theirs.withColumn("part", F.explode(F.sequence(F.lit(0), spread - 1))), ["grp", "part"])
    elif _few(theirs, SENT_BLOCKS, _block_bytes("kb", "db")):
        met = ours.crossJoin(F.broadcast(theirs))
    elif _few(ours, SENT_BLOCKS, _block_bytes("ka", "da")):
        met = theirs.crossJoin(F.broadcast(ours))
    else:
        met = ours.crossJoin(theirs)
    return met.select("ka", "da", "kb", "db").mapInArrow(multiply, schema)


def _dealt(left: DataFrame, right: DataFrame, threshold: float, key: str, vector: str, group: str | None) -> tuple[DataFrame, DataFrame, str | None]:
    """Both sides by cells, as groups, where that spares products; else as they are."""
    dealt = vectorstore.in_cells(left, right, threshold, key, vector, group)
    return (left, right, group) if dealt is None else (*dealt, "cell")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, key: str, vector: str, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, sim): pairs of rows, of one group if there's a group column, whose inner product is over the threshold.

    Blocks meet blocks, of many rows those in one cell around a pivot, and are multiplied as matrices; only pairs over the threshold become rows.
    """
    left, right, group = _dealt(left, right, threshold, key, vector, group)

    def pairs(ka: pa.Array, kb: pa.Array, sims: np.ndarray) -> list[pa.Array]:
        i, j = np.nonzero(sims > threshold)
        return [ka.take(pa.array(i)), kb.take(pa.array(j)), pa.array(sims[i, j])]

    kinds = [dict(x.dtypes)[key] for x in (left, right)]
    return _meet(left, right, key, vector, group, block, pairs, f"a {kinds[0]}, b {kinds[1]}, sim double")


def after_similar(left: DataFrame, right: DataFrame, threshold: float, key: str, vector: str, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """(b): the distinct keys, none of them null, of right rows that a left row with a smaller key has an inner product over the threshold with.

    Two blocks give a row for each such key at most, however many pairs there are.
    """

    def later(ka: pa.Array, kb: pa.Array, sims: np.ndarray) -> list[pa.Array]:
        places = np.asarray(pc.rank(pa.concat_arrays([ka, kb]), tiebreaker="dense"))
        found = (sims > threshold) & (places[: len(ka), None] < places[None, len(ka) :])
        return [kb.filter(pa.array(found.any(axis=0)))]

    left, right = (x.where(F.col(key).isNotNull()) for x in (left, right))
    left, right, group = _dealt(left, right, threshold, key, vector, group)
    return _meet(left, right, key, vector, group, block, later, f"b {dict(right.dtypes)[key]}").distinct()


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, chunk_id, pos, score, rank): the k greatest inner products of each query.

    Reads query_id and embedding, and chunk_id, pos and embedding. Blocks of queries meet blocks of the
    corpus, multiplied as matrices; each meeting keeps its k best, so only those are shuffled.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "chunk_id": dict(corpus.dtypes)["chunk_id"]}
    left = _blocks(queries.withColumn("pos", F.lit(0)), "query_id", "pos", "embedding", block).select(F.col("keys").alias("q"), F.col("data").alias("qd"))
    right = _blocks(corpus, "chunk_id", "pos", "embedding", block)
    few = _few(left, SENT_BLOCKS, _block_bytes("q", "qd"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, qd, c, p, cd in zip(*(batch.column(n) for n in ("q", "qd", "keys", "places", "data")), strict=True):
                n_q, n_c = len(q.values), len(c.values)
                if not n_q or not n_c:
                    continue
                scores = np.round(np.frombuffer(qd.as_py()).reshape(n_q, -1) @ np.frombuffer(cd.as_py()).reshape(n_c, -1).T, PLACES)
                places = np.asarray(p.values)
                order = np.lexsort((np.broadcast_to(places, scores.shape), -scores), axis=1)[:, :k]
                rows = np.repeat(np.arange(n_q), order.shape[1])
                cols = order.ravel()
                yield pa.RecordBatch.from_arrays([q.values.take(pa.array(rows)), c.values.take(pa.array(cols)), pa.array(places[cols]), pa.array(scores[rows, cols])], names=["query_id", "chunk_id", "pos", "score"])

    met = right.crossJoin(F.broadcast(left) if few else left)
    best = met.mapInArrow(multiply, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, pos long, score double")
    return top_k(best, k)


def index_size(corpus: DataFrame, vector: str | None = "embedding") -> DataFrame:
    """One row n: how many chunks a dense index holds, or, without a vector column, all chunks."""
    return corpus.agg(F.count("*" if vector is None else vector).alias("n"))


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, query_text: str = "query") -> DataFrame:
    """(query_id, chunk_id, pos, score, rank): the k best chunks with a positive score, without a stored index.

    Chunks (chunk_id, pos, text) are indexed in the shared folder first, which reads their texts once; searched is as in `lexical`.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = chunks.sparkSession
    index = lexical.append(spark, f"{shared_dir(spark)}/skeinmill/lexical-{uuid.uuid4().hex}", chunks, "all")
    return lexical.search(queries, index, k, query_text)


def reciprocal_rank_fusion(arms: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score, rank) from ranked tables and their weights; ties go to the earlier arm, then its rank."""
    if not arms:
        raise ValueError("no arms to fuse")
    rows = None
    for i, (arm, weight) in enumerate(arms):
        part = arm.select("query_id", "chunk_id", F.lit(i).alias("arm"), "rank", F.lit(float(weight)).alias("weight"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("arm", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first.arm", "first.rank")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", "score", "rank")


def overlap_scorer(query: str, text: str) -> float:
    """A stand-in for a cross-encoder: share of the query's words that the text has."""
    asked = set((query or "").lower().split())
    return len(asked & set((text or "").lower().split())) / len(asked) if asked else 0.0


def overlap_batch(pairs: list[tuple[str, str]]) -> list[float]:
    """The stand-in for a cross-encoder that scores many pairs at once."""
    cut = lambda text: {w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w}
    return [len(asked & cut(text)) / len(asked) if (asked := cut(query)) else 0.0 for query, text in pairs]


def batched_scores(score: Callable[[list[tuple[str, str]]], list[float]], queries: list[str], texts: list[str], batch: int) -> list[float]:
    """Scores of pairs, asked for in batches of pairs of like length, whatever their order and their queries."""
    out = [0.0] * len(queries)
    order = sorted(range(len(queries)), key=lambda i: len(queries[i] or "") + len(texts[i] or ""))
    for low in range(0, len(order), batch):
        own = order[low : low + batch]
        scores = score([(queries[i], texts[i]) for i in own])
        if len(scores) != len(own):
            raise ValueError(f"the scorer gave {len(scores)} scores for {len(own)} pairs")
        for i, x in zip(own, scores, strict=True):
            out[i] = float(x)
    return out


def rerank(candidates: DataFrame, k: int, scorer: Callable | None = None, load: Callable[[], Callable] | None = None, batch: int | None = None) -> DataFrame:
    """Candidates (query_id, query, chunk_id, text, rank) scored anew; equal scores keep their order; the k best stay.

    The default scorer is a column expression. Another one, loaded once in each task if it's given as `load`, is called with
    a query and a text, or with `batch` with lists of so many pairs at most: the pairs of all queries in an Arrow batch are
    put in order of length first, so that a model pads little. Its calls aren't deterministic for the optimizer.
    """
    if scorer is None and load is None:
        asked, have = F.array_distinct(words("query", lower=True)), words("text", lower=True)
        score = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, have)) / F.size(asked)).otherwise(0.0)
    else:

        @F.pandas_udf("double")
        def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            score_pairs = load() if load else scorer
            for queries, texts in batches:
                if batch:
                    yield pd.Series(batched_scores(score_pairs, queries.tolist(), texts.tolist(), batch), dtype="float64")
                else:
                    yield pd.Series([score_pairs(q, t) for q, t in zip(queries, texts, strict=True)], dtype="float64")

        score = scores.asNondeterministic()("query", "text")
    rows = candidates.withColumn("score", F.round(score.cast("double"), PLACES)).withColumnRenamed("rank", "before")
    return top_k(rows, k, tie="before").select("query_id", "chunk_id", "score", "rank")


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 5, candidates: int = 20, weights: tuple[float, float] = (0.6, 0.4), rrf_k: int = 60, reranked: bool = False, scorer: Callable | None = None, batch: int | None = None, vectors: DataFrame | None = None, index: lexical.Index | None = None, store: vectorstore.Store | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): both arms fused, and reranked if asked.

    Queries hold query_id, query and embedding, chunks chunk_id, pos and text, and embedding unless `vectors`
    has it with chunk_id and pos. The arms ask `index` and `store`, the chunks' stored terms and vectors, if they are given. Without a
    reranker each arm gives k rows; with one, the greater of k and `candidates`, which the scorer sees.
    """
    wide = max(k, candidates) if reranked else k
    sparse = bm25_top_k(queries, chunks, wide) if index is None else lexical.search(queries, index, wide)
    dense = dense_top_k(queries, chunks if vectors is None else vectors, wide) if store is None else vectorstore.search(queries, store, wide)
    fused = reciprocal_rank_fusion([(dense, weights[0]), (sparse, weights[1])], rrf_k)
    if not reranked:
        return fused.where(F.col("rank") <= k)
    pool = fused.where(F.col("rank") <= wide).join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    return rerank(pool, k, scorer, batch=batch)
