"""Queries over retrieval: lexical, dense, fused, reranked, and their metrics."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.functions.text import family
from skeinmill.functions.vectors import norm, normalize
from skeinmill.lineage import cut, shared_dir
from skeinmill.operators import generation, lexical, metrics, retrieval, vectorstore
from skeinmill.plans.registry import query, table
from skeinmill.sinks import manifest


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one chunk each."""
    return table(spark, sf_dir, "documents").selectExpr("concat_ws('/', lang, source) as doc_id", "cast(doc_id as string) as chunk_id", "doc_id as pos", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the chunks that have one of their number."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as string) as chunk_id", "vec_id as pos", "embedding")
    return rows.join(corpus(spark, sf_dir).select("pos"), "pos", "left_semi")


def lexicon(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored index of the documents, which all queries share; another one once a file of the table is written anew."""
    state = hashlib.md5(manifest.listing(spark, f"{sf_dir}/documents.parquet").encode()).hexdigest()
    return lexical.append(spark, f"{shared_dir(spark)}/skeinmill/lexicon-{state}", corpus(spark, sf_dir), state)


def gallery(spark: SparkSession, sf_dir: str) -> vectorstore.Store:
    """The stored vectors of the chunks, which all queries share; another one once a file of either table is written anew."""
    state = hashlib.md5("".join(manifest.listing(spark, f"{sf_dir}/{name}.parquet") for name in ("documents", "embeddings")).encode()).hexdigest()
    return vectorstore.append(spark, f"{shared_dir(spark)}/skeinmill/gallery-{state}", vectors(spark, sf_dir), state)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, each with the vector of its number if there is one, relevant to a family of documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    rows = items.join(table(spark, sf_dir, "embeddings").selectExpr("vec_id as item_id", "embedding"), "item_id", "left")
    return rows.selectExpr("item_id as query_id", "query", "embedding", "array(concat('en/src', cast(item_id % 20 as string)), concat('fr/src', cast(item_id % 20 as string))) as prefixes")


_ASKED = "SELECT b.item_id AS query_id, text AS query, e.embedding FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id"
_INDEX = r"""
tok AS (SELECT doc_id AS pos, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ts FROM documents),
post AS (SELECT pos, len(ts) AS dl, term, count(*) AS tf FROM (SELECT pos, ts, unnest(ts) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER () ELSE r END AS idf FROM raw)"""
_BM25 = rf"""
q AS ({_ASKED}), asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '\s+')) AS term FROM q) WHERE term <> '' GROUP BY ALL),
{_INDEX},
sc AS (SELECT query_id, pos, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM asked JOIN idf USING (term) JOIN post USING (term), st GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM sc) WHERE rank <= {{k}} AND score > 0)"""
_DENSE = """
dsc AS (SELECT q.query_id, e.vec_id AS pos, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM q, embeddings e WHERE q.embedding IS NOT NULL AND e.vec_id IN (SELECT doc_id FROM documents)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM dsc) WHERE rank <= {k})"""
_FUSED = """
arms AS (SELECT query_id, pos, rank, 0 AS arm, 0.6 AS w FROM dense UNION ALL SELECT query_id, pos, rank, 1, 0.4 FROM sparse),
fu AS (SELECT query_id, pos, round(sum(w::DOUBLE / (60 + rank)), 12) AS score, min(arm * 1000000 + rank) AS first FROM arms GROUP BY ALL),
fused AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM fu)"""


@query(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.terms(lexicon(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(rf"WITH {_BM25.format(k=10)} SELECT query_id, pos::VARCHAR AS chunk_id, rank, round(score, 6) AS score FROM sparse")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(asked(spark, sf_dir), lexicon(spark, sf_dir), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(rf"WITH {_BM25.format(k=10)} SELECT query_id, pos::VARCHAR AS chunk_id, rank, round(score, 6) AS score FROM sparse")
def bm25_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, one of them given twice and two of them compacted, answer as one does."""
    chunks, path = corpus(spark, sf_dir), f"{shared_dir(spark)}/skeinmill/lexical-{uuid.uuid4().hex}"
    for part in (0, 1, 1):
        lexical.append(spark, path, chunks.where(f"pos % 3 = {part}"))
    lexical.compact(spark, path)
    index = lexical.append(spark, path, chunks.where("pos % 3 = 2"))
    return lexical.search(asked(spark, sf_dir), index, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(rf"WITH q AS ({_ASKED}), {_DENSE.format(k=20)} SELECT query_id, pos::VARCHAR AS chunk_id, rank, round(score, 6) AS score FROM dense")
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorstore.search(asked(spark, sf_dir), gallery(spark, sf_dir), 20).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(rf"WITH {_BM25.format(k=5)}, {_DENSE.format(k=5)}, {_FUSED} SELECT query_id, pos::VARCHAR AS chunk_id, rank, round(score, 9) AS score FROM fused WHERE rank <= 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(asked(spark, sf_dir), corpus(spark, sf_dir), 5, index=lexicon(spark, sf_dir), store=gallery(spark, sf_dir)).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


_RERANKED = r"""
pool AS (SELECT f.query_id, f.pos, f.rank AS before, list_distinct(list_filter(regexp_split_to_array(lower(q.query), '\s+'), lambda x: x <> '')) AS a, list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda x: x <> '') AS h
  FROM fused f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.pos WHERE f.rank <= 20),
rr AS (SELECT query_id, pos, before, round(len(list_intersect(a, h))::DOUBLE / len(a), 9) AS score FROM pool),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM rr) WHERE rank <= 10)"""


@query(rf"WITH {_BM25.format(k=20)}, {_DENSE.format(k=20)}, {_FUSED}, {_RERANKED} SELECT query_id, pos::VARCHAR AS chunk_id, rank, round(score, 6) AS score FROM best")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(asked(spark, sf_dir), corpus(spark, sf_dir), 10, 20, reranked=True, scorer=retrieval.overlap_batch, batch=16, index=lexicon(spark, sf_dir), store=gallery(spark, sf_dir)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_METRICS = """
res AS (SELECT s.query_id, concat_ws('/', d.lang, d.source) AS doc_id, min(s.rank) AS f FROM {arm} s JOIN documents d ON d.doc_id = s.pos GROUP BY ALL),
rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY f, doc_id) AS rank FROM res),
rel AS (SELECT DISTINCT q.query_id, d.id AS doc_id FROM q, (SELECT DISTINCT concat_ws('/', lang, source) AS id FROM documents) d WHERE starts_with(d.id, concat('en/src', q.query_id % 20)) OR starts_with(d.id, concat('fr/src', q.query_id % 20))),
hit AS (SELECT rk.* FROM rk JOIN rel USING (query_id, doc_id)), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
per AS (SELECT q.query_id, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr, coalesce((min(rank) <= 5)::INT::DOUBLE, 0) AS hit_rate_top_5, {ks} FROM q LEFT JOIN hit USING (query_id) LEFT JOIN nr USING (query_id) GROUP BY q.query_id)"""
_KS = ", ".join(
    f"(count(*) FILTER (rank <= {k}))::DOUBLE / {k} AS precision_at_{k}, coalesce((count(*) FILTER (rank <= {k}))::DOUBLE / max(n), 0) AS recall_at_{k}, "
    f"coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}) / list_sum(list_transform(range(1, least(max(n), {k}) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg_at_{k}"
    for k in metrics.KS
)
_NAMES = ["mrr", "hit_rate_top_5", *(f"{m}_at_{k}" for k in metrics.KS for m in ("precision", "recall", "ndcg"))]
_TIDY = " UNION ALL ".join(f"SELECT '{{p}}' AS pipeline, '{n}' AS metric, round(avg({n}), 6) AS value, count(*) AS n FROM per" for n in _NAMES)


def _judged(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    queries, chunks = asked(spark, sf_dir), corpus(spark, sf_dir).select("chunk_id", "doc_id")
    ranked = metrics.dedupe(results.join(chunks, "chunk_id"))
    return metrics.per_query(queries, ranked, metrics.relevant_by_prefix(queries, chunks))


@query(rf"WITH {_BM25.format(k=40)}, {_METRICS.format(arm='sparse', ks=_KS)} SELECT query_id, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM per")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir, lexical.search(asked(spark, sf_dir), lexicon(spark, sf_dir), 40))
    return rows.select("query_id", *(F.round(n, 6).alias(n) for n in _NAMES))


def bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of the dense, the lexical and the fused pipeline in one tidy table."""
    queries, chunks = asked(spark, sf_dir), corpus(spark, sf_dir)
    arms = {"dense": cut(vectorstore.search(queries, gallery(spark, sf_dir), 40)), "sparse": cut(lexical.search(queries, lexicon(spark, sf_dir), 40))}
    arms["hybrid"] = retrieval.reciprocal_rank_fusion([(arms["dense"], 0.6), (arms["sparse"], 0.4)]).where("rank <= 40")
    out = None
    for name, results in arms.items():
        rows = _judged(spark, sf_dir, results).withColumn("pipeline", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return metrics.means(out, ["pipeline"])


_BAKEOFF = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_BM25.format(k=40)}, {_DENSE.format(k=40)}, {_FUSED}, top AS (SELECT * FROM {arm} WHERE rank <= 40), {_METRICS.format(arm='top', ks=_KS)} {_TIDY.format(p=name)})"
    for name, arm in (("dense", "dense"), ("sparse", "sparse"), ("hybrid", "fused"))
)


@query(_BAKEOFF)
def bakeoff_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bakeoff(spark, sf_dir)


@query(
    f"""WITH g AS ({_BAKEOFF}), a AS (SELECT * FROM g WHERE pipeline = 'hybrid'), b AS (SELECT * FROM g WHERE pipeline = 'dense' AND metric <> 'mrr')
SELECT metric, a.value, b.value AS base, round(a.value - b.value, 6) AS delta FROM a JOIN b USING (metric)"""
)
def bakeoff_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = bakeoff(spark, sf_dir)
    return metrics.delta(grid.where("pipeline = 'hybrid'"), grid.where("pipeline = 'dense' and metric <> 'mrr'"), ["metric"])


@query("SELECT vec_id, label, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("u", normalize(F.transform("embedding", lambda x: x * 3)))
    return rows.select("vec_id", "label", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(norm(F.col("u")), 6).alias("unit"))


#: Similarity over which a pair of a type counts; test tables have such pairs.
SIMILAR = 0.35


@query(f"SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE sim > {SIMILAR}")
def cosine_within_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a label over the threshold, with their similarity."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", normalize(F.col("embedding")).alias("v"))
    return retrieval.similar_pairs(rows, rows, SIMILAR, "vec_id", "v", "label").where("a < b")


@query(
    rf"""WITH {_BM25.format(k=10)}, r AS (SELECT s.query_id, s.rank, concat('[', s.rank, '] (source: ', concat_ws('/', d.lang, d.source), ')', chr(10), d.text) AS block FROM sparse s JOIN documents d ON d.doc_id = s.pos),
c AS (SELECT *, floor((sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) + 2 * (rank - 1)) / 4) AS tokens FROM r), keep AS (SELECT * FROM c WHERE tokens <= 6000),
x AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM keep GROUP BY query_id)
SELECT query_id, coalesce(context, '') AS context, coalesce(n, 0)::INT AS n_chunks, concat('Context:', chr(10), coalesce(context, ''), chr(10), chr(10), 'Question: ', q.query) AS message FROM (SELECT DISTINCT query_id FROM sparse) LEFT JOIN x USING (query_id) JOIN q USING (query_id)"""
)
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: questions, lexical retrieval, a context within its budget, and the message that asks."""
    queries, chunks = asked(spark, sf_dir), corpus(spark, sf_dir)
    ranked = lexical.search(queries, lexicon(spark, sf_dir), 10).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    contexts = generation.assemble(ranked, 6000).join(queries.select("query_id", "query"), "query_id")
    return contexts.select("query_id", "context", F.size("chunks").alias("n_chunks"), generation.user_message(F.col("query"), F.col("context")).alias("message"))


@query("SELECT lang AS family, count(*) AS n FROM documents GROUP BY lang")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy(family("doc_id").alias("family")).agg(F.count("*").alias("n"))


@query("SELECT 'vectors' AS part, count(*) AS n FROM embeddings e SEMI JOIN documents d ON d.doc_id = e.vec_id UNION ALL SELECT 'chunks', count(*) FROM documents")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors and chunks an index holds."""
    return retrieval.index_size(vectors(spark, sf_dir)).select(F.lit("vectors").alias("part"), "n").unionByName(retrieval.index_size(corpus(spark, sf_dir), None).select(F.lit("chunks").alias("part"), "n"))


@query(rf"WITH q AS (SELECT * FROM ({_ASKED}) ORDER BY query_id LIMIT 7), {_DENSE.format(k=20)} SELECT query_id, pos::VARCHAR AS chunk_id, rank, round(score, 6) AS score FROM dense")
def limited_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval for the first queries of a set alone, as a trial run asks for."""
    few = metrics.first_queries(asked(spark, sf_dir), 7)
    return vectorstore.search(few, gallery(spark, sf_dir), 20).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))
