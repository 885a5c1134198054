"""Context, prompts, answers, citations and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinmill.functions.text import CANONICAL_REFUSAL, chunk_block, markers, refusal_pattern, strip

#: Fixed value: what the assistant is told.
SYSTEM_PROMPT = (
    "You are a technical documentation assistant. Answer the user's question using only the provided context. Cite sources using [N] notation that matches the numbered context items below.\n\n"
    "If the context does not contain enough information to answer the question, reply with: \"I don't have enough context to answer that.\" Do not invent information that is not in the context."
)


def assemble(ranked: DataFrame, max_tokens: int = 3500, tokens: Callable[[str], int] | None = None) -> DataFrame:
    """(query_id, context, chunks): the longest prefix of each query's chunks that fits the budget.

    Reads query_id, rank, doc_id, chunk_id, score, text. A chunk that doesn't fit ends the context, the
    first one too. A quarter of the characters counts as tokens; another counter sees the joined text.
    """
    if max_tokens <= 0:
        raise ValueError(f"max_tokens must be positive, got {max_tokens}")
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = ranked.withColumn("place", F.row_number().over(order))
    block = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] (source: "), F.col("doc_id").cast("string"), F.lit(")\n"), F.col("text"))
    rows = rows.withColumn("block", block)
    chunk = F.struct("doc_id", "chunk_id", "score", "text")
    if tokens is None:
        length = F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 2 * (F.col("place") - 1)
        fits = rows.withColumn("fits", F.floor(length / 4) <= max_tokens)
        inside = F.col("fits")
        gathered = fits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(inside, F.struct("place", "block", chunk.alias("chunk"))))).alias("parts"))
    else:
        # A counter that isn't additive is asked about each prefix.
        @F.pandas_udf("int")
        def prefix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda blocks: next((i for i in range(len(blocks)) if tokens("\n\n".join(blocks[: i + 1])) > max_tokens), len(blocks))).astype("int32")

        gathered = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "block", chunk.alias("chunk")))).alias("parts"))
        gathered = gathered.withColumn("n", prefix(F.transform("parts", lambda p: p["block"]))).withColumn("parts", F.slice("parts", F.lit(1), F.col("n")))
    return gathered.select("query_id", F.array_join(F.transform("parts", lambda p: p["block"]), "\n\n").alias("context"), F.transform("parts", lambda p: p["chunk"]).alias("chunks"))


def user_message(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query)


def messages(query: Column, context: Column, answer: Column | None = None, system: str = SYSTEM_PROMPT) -> Column:
    """System and user message, and the assistant's if there is an answer."""
    turns = [("system", F.lit(system)), ("user", user_message(query, context))] + ([("assistant", answer)] if answer is not None else [])
    return F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns))


def training_messages(examples: DataFrame) -> DataFrame:
    """Adds three-turn messages to (query, retrieved_chunks, ideal_answer)."""
    return examples.withColumn("messages", messages(F.col("query"), chunk_block("retrieved_chunks"), F.col("ideal_answer")))


def distill_message(query: Column, chunks: Column) -> Column:
    return F.concat(F.lit("CHUNKS:\n"), chunk_block(chunks, empty="(no chunks retrieved)"), F.lit("\n\nQUESTION: "), query)


def citations(text: Column | str, chunks: Column | str) -> Column:
    """The chunks that [N] markers in a text stand for, each (doc_id, chunk_id) once, in order of first mention."""
    chunks = F.col(chunks) if isinstance(chunks, str) else chunks
    valid = F.filter(markers(text), lambda n: n.isNotNull() & (n >= 1) & (n <= F.size(chunks)))
    return F.array_distinct(F.transform(valid, lambda n: F.struct(F.get(chunks, n - 1)["doc_id"].alias("doc_id"), F.get(chunks, n - 1)["chunk_id"].alias("chunk_id"))))


def answers(rows: DataFrame) -> DataFrame:
    """Adds citations, from the raw text, and answer, stripped, to (raw_text, chunks)."""
    return rows.withColumn("citations", citations("raw_text", "chunks")).withColumn("answer", strip("raw_text"))


def generate(prompts: DataFrame, model: Callable[[str, str], str] | None = None) -> DataFrame:
    """Adds raw_text to (query, chunks) by a pluggable model, called in Arrow batches with query and context.

    The default is extractive: the first sentence of the first chunk with its marker, or the canonical refusal.
    """
    if model is None:
        first = F.substring_index(F.get("chunks", F.lit(0))["text"], ". ", 1)
        return prompts.withColumn("raw_text", F.when(F.size("chunks") > 0, F.concat(first, F.lit(" [1]"))).otherwise(F.lit(CANONICAL_REFUSAL)))

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, contexts in batches:
            yield pd.Series([model(q, c) for q, c in zip(queries, contexts, strict=True)], dtype="object")

    return prompts.withColumn("raw_text", run("query", "context"))


def citation_check(rows: DataFrame, text: str = "answer", chunks: str = "chunks", cited: str = "citations") -> DataFrame:
    """Adds n_markers, n_resolved, all_in_range and any_marker."""
    found = markers(text)
    in_range = F.forall(found, lambda n: F.coalesce((n >= 1) & (n <= F.size(chunks)), F.lit(False)))
    return rows.withColumns({"n_markers": F.size(found), "n_resolved": F.size(cited), "all_in_range": (F.size(found) > 0) & in_range, "any_marker": F.size(found) > 0})


def refusal_check(rows: DataFrame, expected: Column, text: str = "answer") -> DataFrame:
    """Adds refused, expected_refusal, correct and matched_pattern."""
    pattern = refusal_pattern(text)
    return rows.withColumns({"matched_pattern": pattern, "refused": pattern.isNotNull(), "expected_refusal": expected, "correct": pattern.isNotNull() == expected})


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds the names of the checks that a row fails; a check that can't be decided fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items())))
    return rows.withColumn("violations", failed)


def answer_checks() -> dict[str, Column]:
    """Citations point at retrieved chunks."""
    have = F.transform("chunks", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["chunk_id"].alias("chunk_id")))
    return {"citations_retrieved": F.size(F.array_except("citations", have)) == 0}


def example_checks() -> dict[str, Column]:
    """Training examples: something to ask and answer, chunks and markers in range unless it's a refusal."""
    chunks = F.col("retrieved_chunks")
    in_range = F.forall(markers("ideal_answer"), lambda n: F.coalesce((n >= 1) & (n <= F.size(chunks)), F.lit(False)))
    refusal = F.coalesce("is_refusal", F.lit(False))
    return {"query": F.length("query") >= 1, "ideal_answer": F.length("ideal_answer") >= 1, "chunks": refusal | (F.size(chunks) > 0), "markers": refusal | in_range}


def judge_checks() -> dict[str, Column]:
    """Scores between 0 and 1, claim numbers from 1 and no number twice."""
    numbers = F.transform("attributions", lambda a: a["claim_idx"])
    return {"score": F.col("score").between(0, 1), "claim_idx": F.forall(numbers, lambda i: i >= 1), "claim_idx_unique": F.size(F.array_distinct(numbers)) == F.size(numbers)}
