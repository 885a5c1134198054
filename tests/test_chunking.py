"""Chunkers against SQL on random and on chosen texts."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from skeinmill.operators import chunking
from skeinmill.plans import ingestion

CHOSEN = [
    "", "   ", "Short text.", "one two three four five six seven eight", "a" * 700, "word " * 80 + "b" * 300 + " tail", "x\n\ny\n\nz", "## A\n\nbody", "intro\n\n# T\n\n## Big Section\n\n" + "\n\n".join("para %d " % i + "w " * 40 for i in range(5)),
    "##\n\nfoo\n\nbar", "# only", "Preamble. " * 30 + "\n# H\n" + "y" * 500, "é😀 " * 100, "p1. p2. p3\n" * 30, "   lead\n\n\n\n\ntrail   ", "a b" + " " * 300 + "c",
]


def texts():
    rng = random.Random(1)
    parts = ["word", " ", "  ", "\n", "\n\n", ". ", "# Head", "\n## Sub two\n", "longer-token-without-end" * 3, "é", "\n\n\n", "###### six\n", "x", "```\n# code\n```"]
    return CHOSEN + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(60)]


@pytest.mark.parametrize(("size", "overlap"), [(100, 20), (50, 0), (20, 19), (512, 64)])
def test_all_chunkers_equal_sql(spark, size, overlap):
    rows = [(str(i), t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id string, content string").repartition(3)
    got: dict[str, list] = {name: [] for name in chunking.CHUNKERS}
    for r in chunking.chunk(docs, size=size, overlap=overlap).collect():
        assert r.chunk_id == f"{r.doc_id}::chunk_{r.chunk_index}"
        got[r.strategy].append((r.doc_id, r.chunk_index, r.text, *([r.char_start] if r.strategy == "fixed" else [])))
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "content"]))
    sql = {"fixed": ingestion.fixed_sql("SELECT * FROM given", size, overlap), "recursive": ingestion.recursive_sql("SELECT * FROM given", size, overlap), "header": ingestion.header_sql("SELECT * FROM given", size)}
    for name, text in sql.items():
        assert sorted(got[name]) == sorted(con.execute(text).fetchall()), name


@pytest.mark.parametrize("strategy", ["fixed", "recursive"])
def test_windows(spark, strategy):
    docs = spark.createDataFrame([("a", "one two three four five six seven eight"), ("b", "Short text.")], "doc_id string, content string")
    rows = chunking.chunk(docs, [strategy], 20, 0).orderBy("doc_id", "chunk_index").collect()
    assert [r.text for r in rows if r.doc_id == "b"] == ["Short text."]
    assert all(len(r.text) <= 20 and r.text == r.text.strip() for r in rows)
    assert " ".join(r.text for r in rows if r.doc_id == "a").split() == "one two three four five six seven eight".split()


def test_null_content_and_unknown_strategy(spark):
    docs = spark.createDataFrame([("1", None)], "doc_id string, content string")
    assert chunking.chunk(docs).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        chunking.chunk(docs, ["none"])


def test_the_fixed_chunker_as_a_table_function(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts())] + [("none", None)], "doc_id string, content string").repartition(3)
    docs.createOrReplaceTempView("given_docs")
    chunking.register(spark)
    got = spark.sql("SELECT doc_id, chunk_index, text, char_start FROM chunk_fixed(TABLE(SELECT doc_id, content FROM given_docs), 50, 10)")
    want = chunking.fixed(docs, 50, 10).select("doc_id", "chunk_index", "text", "char_start")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 200
