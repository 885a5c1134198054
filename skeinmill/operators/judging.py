"""Judges' outputs: parsing with schema and bounds, and what becomes of what can't be parsed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinmill.functions.text import col, json_block, let, strip
from skeinmill.operators.metrics import ANCHORS

NO_JSON = "PARSE_FAILED: judge response did not produce valid JSON"
ATTRIBUTIONS = "array<struct<claim_idx:int,supporting_chunk_idx:int,rationale:string>>"


def parsed(text: Column | str) -> Column:
    return F.try_parse_json(json_block(text))


def json_field(value: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", kind)


class Judge(Protocol):
    """What a loaded judge is: replies to a list of prompts, in order; null for a prompt that it couldn't answer."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def ask(rows: DataFrame, judge: Callable[[str], str] | None, valid: Column, prompt: str = "prompt", out: str = "response", attempts: int = 2, load: Callable[[], Judge] | None = None) -> DataFrame:
    """Adds a judge's response, asked again where it isn't valid, by Arrow batches of a pluggable backend.

    A judge answers a prompt at a time; one given as `load` is loaded once in each task, and answers all prompts of a batch at once.
    """
    if (judge is None) == (load is None):
        raise ValueError("either a judge or how to load one")

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = load() if load else None
        for batch in batches:
            if loaded is None:
                yield batch.map(judge, na_action="ignore").astype("object")
                continue
            asked = batch[batch.notna()]
            replies = pd.Series([None] * len(batch), index=batch.index, dtype="object")
            replies[asked.index] = loaded(asked.tolist()) if len(asked) else []
            yield replies

    # A model may answer the same prompt differently, so that a reply must not be worked out twice.
    call = call.asNondeterministic()
    rows = rows.withColumn(out, call(prompt))
    for _ in range(attempts - 1):
        rows = rows.withColumn("_again", F.when(valid, F.lit(None)).otherwise(F.col(prompt))).withColumn(out, F.when(valid, F.col(out)).otherwise(call("_again"))).drop("_again")
    return rows


def claims(text: Column | str) -> Column:
    """Claims of a response, stripped, without empty ones; none if it can't be parsed."""
    found = json_field(parsed(text), "claims", "array<string>")
    return F.coalesce(F.filter(F.transform(found, strip), lambda c: c != ""), F.expr("cast(array() as array<string>)"))


def attributions(text: Column | str) -> Column:
    """Attributions of a response as (claim_idx, supporting_chunk_idx, rationale), else null; null as a whole if a claim's number is missing or under 1."""
    return let(json_field(parsed(text), "attributions", ATTRIBUTIONS), lambda found: F.when(F.forall(found, lambda a: F.coalesce(a["claim_idx"] >= 1, F.lit(False))), found))


def attribute(given: Column | str, claims_: Column | str, n_chunks: Column) -> Column:
    """An attribution for each claim: the last one given for its number, checked against the number of chunks.

    Claims without one are marked, as are all of them if nothing could be parsed; a chunk that doesn't
    exist is taken away and noted; numbers nobody asked about are ignored.
    """
    given = col(given)

    def one(claim: Column, i: Column) -> Column:
        number = i + 1
        entry = F.element_at(F.filter(given, lambda a: a["claim_idx"] == number), -1)
        entry = F.when(F.size(F.filter(given, lambda a: a["claim_idx"] == number)) > 0, entry)
        chunk, why = entry["supporting_chunk_idx"], entry["rationale"]
        out = chunk.isNotNull() & ~chunk.between(1, n_chunks)
        note = F.concat(F.lit("OUT_OF_RANGE: chunk "), chunk.cast("string"), F.lit(" not in [1, "), n_chunks.cast("string"), F.lit("]"))
        text = (
            F.when(given.isNull(), F.lit(NO_JSON)).when(entry.isNull(), F.concat(F.lit("PARSE_FAILED: no attribution for claim "), number.cast("string")))
            .when(out, F.when(F.coalesce(why, F.lit("")) != "", F.concat(note, F.lit(". "), why)).otherwise(note)).otherwise(why)
        )
        return F.struct(number.alias("claim_idx"), claim.alias("claim_text"), F.when(~out, chunk).alias("supporting_chunk_idx"), text.alias("rationale"))

    return F.transform(col(claims_), one)


def supported_share(attributed: Column | str) -> Column:
    """Share of claims with a chunk; 0 without claims."""
    x = col(attributed)
    return F.when(F.size(x) > 0, F.size(F.filter(x, lambda a: a["supporting_chunk_idx"].isNotNull())) / F.size(x)).otherwise(0.0)


def snap(x: Column) -> Column:
    """The nearest anchor; of two equally near ones the lower."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.array_min(F.array(*(F.struct(F.abs(bounded - a).alias("off"), F.lit(a).alias("anchor")) for a in ANCHORS)))["anchor"]


def relevance(text: Column | str) -> Column:
    """(score, rationale): snapped, and 0 with a mark if it can't be parsed or the score isn't between 0 and 1."""

    def read(v: Column) -> Column:
        score, why = json_field(v, "score", "double"), json_field(v, "rationale", "string")
        ok = F.coalesce(score.between(0, 1), F.lit(False)) & why.isNotNull()
        return F.struct(F.when(ok, snap(score)).otherwise(0.0).alias("score"), F.when(ok, why).otherwise(F.lit(NO_JSON)).alias("rationale"))

    return let(parsed(text), read)


def refusal(text: Column | str) -> Column:
    """(refused, rationale): not refused, with a mark, if it can't be parsed."""

    def read(v: Column) -> Column:
        said, why = json_field(v, "refused", "boolean"), json_field(v, "rationale", "string")
        ok = said.isNotNull() & why.isNotNull()
        return F.struct(F.when(ok, said).otherwise(F.lit(False)).alias("refused"), F.when(ok, why).otherwise(F.lit(NO_JSON)).alias("rationale"))

    return let(parsed(text), read)
