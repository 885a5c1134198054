"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return a DataFrame.

Defined results, for all stages: columns of any name are kept as they are; an empty table gives an empty one; a null text
is as one without words, which is never rejected, linked, hit or changed; documents of any length are read whole.
What each stage makes of null or repeated doc_ids and of ties is said with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinmill.llm import decontaminate, mixing, neardup, pii, toxicity
from skeinmill.llm.store import keep, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    Rows are judged by their texts alone, so that repeated rows stay or go together, and a score equal to the threshold goes;
    a label of a null doc_id isn't learned from; without labels of both kinds nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the least doc_id, of several texts of that doc_id the one of least digest.

    No text is lost with a doc_id that it shares; rows without words or doc_id all stay; of rows alike in doc_id and text one stays.
    """
    return neardup.one_of_each(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window, each row judged by its own text; null and wordless items have no window."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every row of them, with personal data replaced by its kind; overlapping spans are replaced as one."""
    return pii.redact(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn so that all sources have equal shares, in shuffled order; null is a source, and rows that share a doc_id are drawn alike."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity), ("neardup", _neardup), ("decontaminate", _decontaminate), ("pii", _pii), ("mix", _mix),
]

#: SQL has no form of a trained classifier, so that run() is tested against brute force by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
