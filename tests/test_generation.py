"""Contexts, prompts, citations, rules, judges' outputs and constraints."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skeinmill.functions import text as t
from skeinmill.operators import generation, judging, metrics

CHUNK = "doc_id string, chunk_id string, score double, text string"


def ranked(spark, texts):
    return spark.createDataFrame([(1, i + 1, "d.md", f"c{i}", 1.0, x) for i, x in enumerate(texts)], f"query_id int, rank int, {CHUNK}")


@pytest.mark.parametrize("budget", [5, 50, 200])
@pytest.mark.parametrize("counter", [None, lambda x: len(x) // 4, lambda x: len(x.split())])
def test_contexts_stay_within_budget(spark, budget, counter):
    count = counter or (lambda x: len(x) // 4)
    row = generation.assemble(ranked(spark, ["word " * 20] * 8), budget, counter).first()
    blocks = [f"[{i + 1}] (source: d.md)\n{'word ' * 20}" for i in range(8)]
    n = next((i for i in range(8) if count("\n\n".join(blocks[: i + 1])) > budget), 8)
    assert row.context == "\n\n".join(blocks[:n]) and len(row.chunks) == n


def test_an_oversized_first_chunk_gives_an_empty_context(spark):
    row = generation.assemble(ranked(spark, ["x" * 1000, "y"]), 50).first()
    assert row.context == "" and row.chunks == []
    with pytest.raises(ValueError, match="positive"):
        generation.assemble(ranked(spark, ["x"]), 0)


def test_prompt(spark):
    row = spark.range(1).select(generation.messages(F.lit("How do I install it?"), F.lit("[1] (source: a.md)\nRun it.")).alias("m")).first()
    assert [m.role for m in row.m] == ["system", "user"] and row.m[0].content.startswith("You are a technical documentation assistant.")
    assert row.m[1].content == "Context:\n[1] (source: a.md)\nRun it.\n\nQuestion: How do I install it?"


@pytest.mark.parametrize(
    ("text", "want"),
    [("[1] and [2]", ["c1", "c2"]), ("[2][1][2]", ["c2", "c1"]), ("[0] [9] [99999999999999999999]", []), ("at [2026-05-06 10:00]", []), ("none", []), ("[3]", ["c1"]), ("[1][3]", ["c1"])],
)
def test_citations(spark, text, want):
    chunks = F.array(*(F.struct(F.lit("d").alias("doc_id"), F.lit(c).alias("chunk_id"), F.lit(0.0).alias("score"), F.lit("t").alias("text")) for c in ("c1", "c2", "c1")))
    row = generation.citation_check(generation.answers(spark.range(1).select(F.lit(f" {text} ").alias("raw_text"), chunks.alias("chunks")))).first()
    assert [c.chunk_id for c in row.citations] == want and row.answer == text and row.n_resolved == len(want)


@pytest.mark.parametrize("phrase", ["I don't know.", "There is not enough information.", "I do not have enough context to answer that.", "This is not covered in the provided context.", "The context doesn't mention it.", "No relevant content found.", "I apologise, but I am unable to say."])
def test_refusals_are_recognised(spark, phrase):
    row = generation.refusal_check(spark.createDataFrame([(phrase,), ("Install it with pip.",)], "answer string"), F.lit(True)).collect()
    assert row[0].refused and row[0].matched_pattern and row[0].correct and not row[1].refused and not row[1].correct


@pytest.mark.parametrize(("raw", "anchor"), [(0.05, 0.0), (0.13, 0.25), (0.4, 0.5), (0.7, 0.75), (0.8, 0.75), (0.9, 1.0), (-3.0, 0.0), (7.0, 1.0), (0.125, 0.0), (0.375, 0.25)])
def test_snapping(spark, raw, anchor):
    assert spark.range(1).select(judging.snap(F.lit(raw)).alias("a")).first().a == anchor


def test_json_blocks(spark):
    texts = ['{"claims": [" a ", "", "b"]}', '```json\n{"claims": ["x"]}\n```', 'so {"claims": ["y"]} there', "broken {", None, '{"other": 1}']
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", judging.claims("x").alias("c")).orderBy("i").collect()]
    assert got == [["a", "b"], ["x"], ["y"], [], [], []]
    answers = ['"' + t.CANONICAL_REFUSAL + '"', " " + t.CANONICAL_REFUSAL, '{"answer": " x "}', '{"answer": 3}', '{"answer": " "}', "no", '```\n{"answer": "y"}\n```']
    got = [r.a for r in spark.createDataFrame([(i, x) for i, x in enumerate(answers)], "i int, x string").select("i", t.distilled_answer("x").alias("a")).orderBy("i").collect()]
    assert got == [t.CANONICAL_REFUSAL, t.CANONICAL_REFUSAL, "x", None, None, None, "y"]


def test_a_judge_is_asked_again(spark):
    calls = spark.sparkContext.accumulator(0)

    def judge(prompt):
        calls.add(1)
        return '{"refused": true, "rationale": "r"}' if prompt.startswith("good") else "junk"

    rows = judging.ask(spark.createDataFrame([("good",), ("bad",)], "prompt string").coalesce(1), judge, F.coalesce(F.col("response").contains("refused"), F.lit(False)))
    got = {r.prompt: r.v for r in rows.select("prompt", judging.refusal("response").alias("v")).collect()}
    assert got["good"].refused and got["bad"].rationale == judging.NO_JSON and not got["bad"].refused


def test_reports_without_rows(spark):
    none = spark.createDataFrame([], "score double, rationale string, attributions array<struct<claim_idx:int,claim_text:string,supporting_chunk_idx:int,rationale:string>>")
    assert metrics.faithfulness_report(none).first().n == 0 and metrics.relevance_report(none).first().n == 0 and metrics.chunk_usage(none).count() == 0


def test_example_checks(spark):
    schema = f"query string, retrieved_chunks array<struct<{', '.join(c.replace(' ', ': ') for c in CHUNK.split(', '))}>>, ideal_answer string, is_refusal boolean"
    one = [("d", "c", 0.0, "t")]
    rows = [("q", one, "a [1]", False), ("q", one, "a [2]", False), ("q", [], "a", False), ("q", [], "no", True), ("", one, "a", False), ("q", one, None, False), ("q", one, "[5]", True)]
    got = [sorted(r.violations) for r in generation.violations(spark.createDataFrame(rows, schema).coalesce(1), generation.example_checks()).collect()]
    assert got == [[], ["markers"], ["chunks"], [], ["query"], ["ideal_answer", "markers"], []]


def test_generation_stub_and_model(spark):
    rows = spark.createDataFrame([("q", "ctx", [("d", "c", 0.0, "First. Second.")]), ("q2", "", [])], "query string, context string, chunks array<struct<doc_id:string,chunk_id:string,score:double,text:string>>")
    assert [r.raw_text for r in generation.generate(rows).orderBy("query").collect()] == ["First [1]", t.CANONICAL_REFUSAL]
    assert [r.raw_text for r in generation.generate(rows, lambda q, c: q + c).orderBy("query").collect()] == ["qctx", "q2"]


def test_replies_out_of_bounds_fail(spark):
    """A score over 1 or under 0, and a claim's number under 1 or missing, are no valid reply."""
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(['{"score": 1.2, "rationale": "x"}', '{"score": -0.1, "rationale": "x"}', '{"score": 0.9, "rationale": "x"}', '{"score": 1, "rationale": "x"}'])], "i int, r string")
    assert [(x.s.score, x.s.rationale == judging.NO_JSON) for x in rows.select("i", judging.relevance("r").alias("s")).orderBy("i").collect()] == [(0.0, True), (0.0, True), (1.0, False), (1.0, False)]
    given = ['{"attributions": [{"claim_idx": 1}, {"claim_idx": 0}]}', '{"attributions": [{"supporting_chunk_idx": 2}]}', '{"attributions": [{"claim_idx": 2, "supporting_chunk_idx": 1}]}', '{"attributions": []}', "none"]
    got = [x.a for x in spark.createDataFrame(list(enumerate(given)), "i int, r string").select("i", judging.attributions("r").alias("a")).orderBy("i").collect()]
    assert got[0] is None and got[1] is None and got[2][0].claim_idx == 2 and got[3] == [] and got[4] is None


def test_a_loaded_judge_answers_batches_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}" if i % 5 else None) for i in range(40)], "i int, prompt string").coalesce(1)

    def load():
        (tmp_path / "loaded").open("a").write("x")
        return lambda prompts: [f"re {p}" if not p.endswith("7") else None for p in prompts]

    got = {r.i: r.response for r in judging.ask(rows, None, F.col("response").isNotNull(), load=load, attempts=1).collect()}
    assert got == {i: f"re p{i}" if i % 5 and i % 10 != 7 else None for i in range(40)} and (tmp_path / "loaded").read_text() == "x"
    with pytest.raises(ValueError, match="either"):
        judging.ask(rows, None, F.lit(True))


def test_runs_are_stamped_in_utc_and_keep_their_report(spark, tmp_path):
    from skeinmill.sinks import files as sinks

    report = spark.createDataFrame([("refusal", "n", 3.0)], "section string, metric string, value double")
    run, written = sinks.write_run(report, spark.createDataFrame([("q1", "yes")], "query_id string, answer string"), str(tmp_path))
    kept = spark.read.json(f"{tmp_path}/run={run}/report").first()
    assert written and len(run) == 16 and kept.captured_at.endswith("+00:00") and kept.run_day == run[:8] and spark.read.json(f"{tmp_path}/run={run}/answers").first().answer == "yes"
    broken = spark.range(1).select(F.raise_error(F.lit("disk")).alias("answer"))
    assert sinks.write_run(report, broken, str(tmp_path / "b"))[1] is False
    rows = spark.createDataFrame([("a", True, False), ("b", True, True), ("c", False, None)], "query_id string, rule_refused boolean, judge_refused boolean")
    from skeinmill.operators import metrics

    assert [tuple(r) for r in metrics.disagreements(rows).collect()] == [("a", True, False)]


def test_a_refusal_summary_names_every_disagreement(spark):
    """All of them, in order, whatever the partitions: those without a verdict aside."""
    rows = [(f"{i % 700}:{i}", i % 3 == 0, None if i % 10 == 9 else i % 2 == 0, "r") for i in range(5000)]
    frame = spark.createDataFrame(rows, "query_id string, rule_refused boolean, judge_refused boolean, judge_rationale string")
    want = sorted(q for q, rule, judge, _ in rows if judge is not None and judge != rule)
    for n in (1, 13):
        got = metrics.refusal_report(frame.repartition(n)).collect()
        assert len(got) == 1 and got[0].disagreement_ids.split(",") == want
        assert got[0].n == 5000 and got[0].n_disagreements == sum(bool(judge) != rule for _, rule, judge, _ in rows)
    assert metrics.refusal_report(frame.limit(0)).select("n", "disagreement_ids").collect() == [(0, "")]
