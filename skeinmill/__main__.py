"""Command line: index a markdown tree, search it, evaluate it.

python -m skeinmill index DOCS INDEX [--strategy recursive --size 512 --overlap 64]
python -m skeinmill search INDEX QUERY [--k 5 --pipeline hybrid]
python -m skeinmill evaluate INDEX EVAL.json [--pipeline hybrid --baseline REPORT.json --report OUT.json]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.operators import chunking, generation, lexical, metrics, retrieval, vectorstore
from skeinmill.session import session
from skeinmill.sinks import files as sinks
from skeinmill.sinks import manifest
from skeinmill.sources import files as sources

PIPELINES = ["dense", "sparse", "hybrid", "hybrid-rerank"]


def index(spark: SparkSession, docs: str, target: str, strategies: list[str], size: int, overlap: int) -> None:
    """Chunks with their vectors and places, a partition for each strategy, and beside them each strategy's stored terms and vectors."""
    chunks = sources.with_positions(chunking.chunk(sources.read_markdown(spark, docs), strategies, size, overlap))
    sinks.write_chunks(retrieval.embed(chunks, "text"), target)
    for strategy in strategies:
        written = sources.read_chunks(spark, target, strategy)
        for part in ("terms", "vectors"):
            manifest.remove(spark, _stored(target, strategy, part))
        lexical.append(spark, _stored(target, strategy, "terms"), written)
        vectorstore.append(spark, _stored(target, strategy, "vectors"), written, "all")


def _stored(target: str, strategy: str, part: str) -> str:
    return f"{target.rstrip('/')}-stored/{strategy}/{part}"


def retrieve(queries: DataFrame, chunks: DataFrame, target: str, strategy: str, pipeline: str, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) by the pipeline named, from an index's stored terms and vectors."""
    if pipeline not in PIPELINES:
        raise ValueError(f"unknown pipeline {pipeline!r}")
    spark, asked = chunks.sparkSession, retrieval.embed(queries, "query")
    terms, store = lexical.load(spark, _stored(target, strategy, "terms")), vectorstore.load(spark, _stored(target, strategy, "vectors"))
    if pipeline == "dense":
        return vectorstore.search(asked, store, k).drop("pos")
    if pipeline == "sparse":
        return lexical.search(asked, terms, k).drop("pos")
    return retrieval.hybrid(asked, chunks, k, reranked=pipeline == "hybrid-rerank", index=terms, store=store)


def evaluate(queries: DataFrame, chunks: DataFrame, target: str, strategy: str, pipeline: str, eval_k: int = 10) -> DataFrame:
    """(metric, value, n): means over the queries, on documents found among 4 x eval_k chunks."""
    found = retrieve(queries.select("query_id", "query"), chunks, target, strategy, pipeline, 4 * eval_k).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    relevant = metrics.relevant_by_prefix(queries, chunks)
    return metrics.means(metrics.per_query(queries, metrics.dedupe(found), relevant, [k for k in metrics.KS if k <= eval_k]))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skeinmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    sub = commands.add_parser("index")
    sub.add_argument("docs")
    sub.add_argument("index")
    sub.add_argument("--size", type=int, default=512)
    sub.add_argument("--overlap", type=int, default=64)
    sub.add_argument("--strategy", action="append", choices=list(chunking.CHUNKERS))
    sub = commands.add_parser("search")
    sub.add_argument("index")
    sub.add_argument("query")
    sub.add_argument("--k", type=int, default=5)
    sub = commands.add_parser("evaluate")
    sub.add_argument("index")
    sub.add_argument("eval_set")
    sub.add_argument("--eval-k", type=int, default=10)
    sub.add_argument("--baseline")
    sub.add_argument("--report")
    for name in ("search", "evaluate"):
        commands.choices[name].add_argument("--pipeline", choices=PIPELINES, default="hybrid")
        commands.choices[name].add_argument("--strategy", choices=list(chunking.CHUNKERS), default="recursive")
    given = parser.parse_args(args)
    spark = SparkSession.getActiveSession() or session()
    if given.command == "index":
        index(spark, given.docs, given.index, given.strategy or list(chunking.CHUNKERS), given.size, given.overlap)
        return
    chunks = sources.read_chunks(spark, given.index, given.strategy)
    if given.command == "search":
        asked = spark.createDataFrame([(0, given.query)], "query_id int, query string")
        ranked = retrieve(asked, chunks, given.index, given.strategy, given.pipeline, given.k).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
        for r in ranked.orderBy("rank").collect():
            print(f"{r['rank']}. {r.chunk_id} ({r.score:.4f})\n   {r.text[:200]!r}")
        row = generation.assemble(ranked).first()
        print(f"\n{len(row.context) if row else 0} characters of context")
        return
    if given.eval_k <= 0:
        parser.error("--eval-k must be positive")
    queries = sources.read_eval_set(spark, given.eval_set, "eval")
    means = evaluate(queries, chunks, given.index, given.strategy, given.pipeline, given.eval_k).withColumn("strategy", F.lit(given.strategy))
    if given.baseline:
        old = json.load(open(given.baseline, encoding="utf-8"))["strategies"]
        base = spark.createDataFrame([(s, m, float(v)) for s, ms in old.items() for m, v in ms.items()], "strategy string, metric string, value double")
        keys = ["strategy", "metric"]
        print("| strategy | metric | value | delta |\n|---|---|---:|---:|")
        for r in metrics.delta_lines(metrics.delta(means, base, keys), keys).orderBy(*keys).collect():
            print(r.line)
    report = sinks.render_report(means, {"eval_k": given.eval_k, "pipeline": given.pipeline, "eval_set": given.eval_set})
    if given.report:
        sinks.write_report(report, given.report)
    else:
        print(json.dumps(report, indent=2))


if __name__ == "__main__":
    main(sys.argv[1:])
