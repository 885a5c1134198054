"""Requests to models, judging with one retry, and the preview of a pool."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skeinmill.functions import text as t
from skeinmill.operators import judging, prompting
from skeinmill.sinks.files import preview_markdown

ANSWERS = "id int, question string, answer string, chunks array<struct<doc_id:string,chunk_id:string,score:double,text:string>>"


def chunk(text):
    return ("d", "c", 0.0, text)


def test_chunks_are_never_asked_for_refusals(spark):
    rows = [("procedural", "a.md", "Text {x}"), ("refusal", "a.md", "t"), ("pointer", None, "t"), (None, "a", "t")]
    got = [(r.prompt, r.temperature) for r in prompting.chunk_requests(spark.createDataFrame(rows, "question_type string, doc_id string, text string").coalesce(1)).collect()]
    assert "beginning with How" in got[0][0] and got[0][0].endswith('Reply with JSON only: {"query": "..."}\n\nSource: a.md\nPassage:\nText {x}')
    assert [p for p, _ in got[1:]] == [None, None, None] and {x for _, x in got} == {0.0}
    row = prompting.topic_requests(spark.createDataFrame([("s::1", "cats")], "task_key string, topic string")).first()
    assert row.prompt.endswith("Topic: cats") and (row.temperature, row.question_type) == (0.7, "refusal")


def test_answers_are_judged(spark):
    rows = [
        (1, "what is a cat", "A cat purrs. It flies", [chunk("nothing"), chunk("A cat purrs. It sleeps")]), (2, "q", t.CANONICAL_REFUSAL, []),
        (3, None, None, None), (4, "a b", "", [chunk("x")]), (5, "one two three four", "one two", [chunk(None)]),
    ]
    got = {r.id: r for r in prompting.judged(spark.createDataFrame(rows, ANSWERS), prompting.overlap_judge).collect()}
    assert [a.supporting_chunk_idx for a in got[1].faithfulness.attributions] == [2, None] and got[1].faithfulness.score == 0.5 and got[1].faithfulness.rationale == "1 of 2 claims supported"
    assert {i: r.refusal.refused for i, r in got.items()} == {1: False, 2: True, 3: False, 4: False, 5: False}
    assert got[3].faithfulness.rationale.startswith("NO_CLAIMS_EXTRACTED") and got[4].faithfulness.score == 0.0 and got[4].faithfulness.attributions == []
    assert {i: r.relevance.score for i, r in got.items()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5}
    assert got[1].asDict().keys() == {"id", "question", "answer", "chunks", "faithfulness", "relevance", "refusal"}


def test_an_unreadable_reply_goes_back_once_with_a_reminder(spark):
    calls, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def forgetful(prompt):
        calls.add(1)
        turns = json.loads(prompt)
        if len(turns) == 2:
            return "let me think"
        assert [x["role"] for x in turns] == ["system", "user", "assistant", "user"] and turns[2]["content"] == "let me think" and turns[3]["content"] == prompting.REMINDER
        seen.add(1)
        return prompting.overlap_judge(prompt)

    rows = spark.createDataFrame([(1, "a b", "a b", [chunk("a b")])], ANSWERS)
    row = prompting.judged(rows, forgetful).collect()[0]
    assert (row.faithfulness.score, row.relevance.score, row.refusal.refused) == (1.0, 1.0, False)
    assert (calls.value, seen.value) == (8, 4)


def test_a_judge_that_never_answers_gives_marks(spark):
    calls = spark.sparkContext.accumulator(0)

    def silent(prompt):
        calls.add(1)
        return "no"

    row = prompting.judged(spark.createDataFrame([(1, "q", "a", [chunk("a")])], ANSWERS), silent).collect()[0]
    assert row.relevance.rationale == judging.NO_JSON and row.refusal.rationale == judging.NO_JSON and row.faithfulness.score == 0.0
    # Without claims nothing is asked about chunks.
    assert calls.value == 6


def test_pool_preview(spark):
    rows = [(i, f"Question {i}?", "procedural" if i < 8 else "pointer", [("a.md",), ("b.md",)], None, [("a.md",)]) for i in range(10)] + [(10, "Why?", "refusal", [], "cats", [])]
    pool = spark.createDataFrame(rows, "row_id int, query string, question_type string, retrieved_chunks array<struct<doc_id:string>>, seed_topic string, seed_chunks array<struct<doc_id:string>>")
    text = preview_markdown(pool, 5)
    heads = [x for x in text.splitlines() if x.startswith("## ")]
    assert [x.split(":")[0] for x in heads] == ["## procedural", "## pointer", "## refusal"] and heads[2] == "## refusal: 1 of 1"
    assert "* Why?\n  - retrieved: nothing\n  - seed: topic cats" in text and "- retrieved: a.md, b.md\n  - seed: chunk of a.md" in text
    assert preview_markdown(pool.limit(0)) == "# Pool preview: 0 of 0\n"
    assert preview_markdown(pool.drop("seed_topic", "seed_chunks").withColumn("retrieved_chunks", F.lit(None).cast("array<struct<doc_id:string>>")), 5).count("- seed: none") >= 5
