"""Queries over answers, judgments and training data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.functions import text as t
from skeinmill.lineage import shared_dir
from skeinmill.operators import dataset, generation, judging, metrics, prompting, seeding
from skeinmill.operators.numbering import numbered
from skeinmill.plans.registry import SQL, query, table
from skeinmill.sinks.files import append_text
from skeinmill.sinks.quarantine import write_checked
from skeinmill.sources.files import read_checkpoint
from skeinmill.streaming.calls import answer_tasks, replies
from skeinmill.streaming.ingest import windowed_counts

#: Five chunks of every conversation turn: its text under made-up ids.
_CHUNKS = "transform(sequence(1, 5), i -> named_struct('doc_id', concat('d', cast(i % 4 as string)), 'chunk_id', concat('c', cast(i % 4 as string)), 'score', cast(i as double), 'text', text))"
_REFUSALS = [
    "I don't know the answer.", "There is not enough information here.", "I do not have enough context to say.", "That is not covered in the provided context.", "The context does not mention it.",
    "No relevant details were found.", "I apologize, but I am unable to comment.", "It cannot determine that.", "You should install it first.", "Context is everything.",
]


def _quoted(xs: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


_SPARK_QUOTED = ", ".join('"' + x + '"' for x in _REFUSALS)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with markers put into them, and chunks to cite."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    marked = "concat('  ', text, ' [1] see [', cast(turn % 8 as string), '][2], [99999999999] [0] and [', cast(conv_id % 7 as string), '] at [2026-05-06 x]. ')"
    return rows.selectExpr("conv_id", "turn", f"{_CHUNKS} as chunks", f"{marked} as raw_text")


_TURNS = "SELECT conv_id, turn, concat('  ', text, ' [1] see [', turn % 8, '][2], [99999999999] [0] and [', conv_id % 7, '] at [2026-05-06 x]. ') AS raw FROM conversations WHERE role = 'assistant'"


@query(
    rf"""WITH t AS ({_TURNS}), m AS (SELECT conv_id, turn, raw, unnest(regexp_extract_all(raw, '\[(\d+)\]', 1)) AS x, generate_subscripts(regexp_extract_all(raw, '\[(\d+)\]', 1), 1) AS i FROM t),
v AS (SELECT conv_id, turn, x::BIGINT % 4 AS c, min(i) AS i FROM m WHERE x::BIGINT BETWEEN 1 AND 5 GROUP BY ALL),
g AS (SELECT conv_id, turn, string_agg(concat('d', c, ':c', c), ',' ORDER BY i) AS cited, count(*) AS n FROM v GROUP BY ALL),
k AS (SELECT conv_id, turn, count(*) AS n_markers, bool_and(x::BIGINT BETWEEN 1 AND 5) AS ok FROM m GROUP BY ALL)
SELECT t.conv_id, t.turn, regexp_replace(regexp_replace(t.raw, '^\s+', ''), '\s+$', '') AS answer, coalesce(cited, '') AS cited, n_markers::INT AS n_markers, coalesce(n, 0)::INT AS n_resolved, ok AS all_in_range, n_markers > 0 AS any_marker FROM t JOIN k USING (conv_id, turn) LEFT JOIN g USING (conv_id, turn)"""
)
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generation.citation_check(generation.answers(turns(spark, sf_dir)))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["doc_id"], F.lit(":"), c["chunk_id"])), ",")
    return rows.select("conv_id", "turn", "answer", cited.alias("cited"), "n_markers", "n_resolved", "all_in_range", "any_marker")


#: Answers of which some cite a chunk that wasn't retrieved, as a stored answer may.
_STRAY = "if(conv_id % 3 = 0, concat(citations, array(named_struct('doc_id', 'd9', 'chunk_id', concat('c', cast(turn % 5 as string))))), citations)"


@query(
    f"""WITH a AS ({SQL["answer_citations"]}), c AS (SELECT conv_id, turn, list_filter(string_split(cited, ','), lambda x: x <> '') AS own FROM a),
s AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN list_append(own, concat('d9:c', turn % 5)) ELSE own END AS cited FROM c)
SELECT conv_id, turn, CASE WHEN len(list_filter(cited, lambda x: x NOT IN ('d0:c0', 'd1:c1', 'd2:c2', 'd3:c3'))) > 0 THEN 'citations_retrieved' ELSE '' END AS violations FROM s"""
)
def answer_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generation.answers(turns(spark, sf_dir)).withColumn("citations", F.expr(_STRAY))
    return generation.violations(rows, generation.answer_checks()).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@query(f"SELECT count(*) AS n, round(avg(any_marker::INT), 3) AS frac_with_any_marker, round(avg(all_in_range::INT), 3) AS frac_all_in_range, round(avg(n_markers), 3) AS mean_n_markers FROM ({SQL['answer_citations']})")
def citation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.citation_report(answer_citations(spark, sf_dir))


@query(
    """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN (conv_id % 7) / 5.0 > 1 THEN 'score' END, CASE WHEN turn % 3 = 0 THEN 'claim_idx' END, CASE WHEN conv_id % 2 = 0 OR turn % 3 + conv_id % 2 = 3 OR turn % 3 = 3 THEN 'claim_idx_unique' END], lambda x: x IS NOT NULL), ',') AS violations
FROM conversations WHERE role = 'assistant'"""
)
def judge_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged answers of which some have a score over 1, a claim 0 or a claim twice."""
    claims = "transform(array(turn % 3, turn % 3 + conv_id % 2, 3L), i -> named_struct('claim_idx', i))"
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", "cast(conv_id % 7 as double) / 5 as score", f"{claims} as attributions")
    return generation.violations(rows, generation.judge_checks()).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


_RULES = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(x), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in t.REFUSALS) + ")"
_ANSWERED = f"SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN [{_quoted(_REFUSALS)}][1 + (conv_id + turn) % 10] ELSE 'Plain answer [1].' END AS x, conv_id % 4 = 0 AS expected FROM conversations WHERE role = 'assistant'"


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = f"if(conv_id % 2 = 0, array({_SPARK_QUOTED})[cast((conv_id + turn) % 10 as int)], 'Plain answer [1].')"
    return generation.refusal_check(table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", f"{answer} as answer"), F.col("conv_id") % 4 == 0)


@query(f"WITH a AS ({_ANSWERED}), r AS (SELECT *, {_RULES} AS m FROM a) SELECT conv_id, turn, m AS matched_pattern, m IS NOT NULL AS refused, expected AS expected_refusal, (m IS NOT NULL) = expected AS correct FROM r")
def refusal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("conv_id", "turn", "matched_pattern", "refused", "expected_refusal", "correct")


@query(f"WITH a AS ({_ANSWERED}), r AS (SELECT {_RULES} AS m FROM a) SELECT m AS matched_pattern, count(*) AS n FROM r WHERE m IS NOT NULL GROUP BY m")
def refusal_pattern_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_answered(spark, sf_dir), "matched_pattern")


#: Judges' outputs: bare, fenced, within prose, broken.
_OUT = """case conv_id % 5 when 0 then concat('{{"{k}": ', {v}, ', "rationale": "r', cast(turn as {s}), '"}}') when 1 then concat('```json', chr(10), '{{"{k}": ', {v}, ', "rationale": "fenced"}}', chr(10), '```')
 when 2 then concat('Here it is: {{"{k}": ', {v}, ', "rationale": "prose {{}}"}} so.') when 3 then concat('{{"{k}": ', {v}, ', broken') else '["no object"]' end"""
_SCORE = "cast(cast(((conv_id * 7 + turn * 13) % 120) as double) / 100 as {s})"
_VERDICT = "if((conv_id + turn) % 3 = 0, 'true', 'false')"


def _spark_out(key: str, value: str) -> str:
    return _OUT.format(k=key, v=value, s="string")


@query(
    f"""WITH j AS (SELECT conv_id, turn, ((conv_id * 7 + turn * 13) % 120)::DOUBLE / 100 AS s, conv_id % 5 < 3 AND (conv_id * 7 + turn * 13) % 120 <= 100 AS ok FROM conversations WHERE role = 'assistant'),
a AS (SELECT conv_id, turn, ok, s, least(1, s) AS c, CASE WHEN NOT ok THEN '{judging.NO_JSON}' WHEN conv_id % 5 = 0 THEN concat('r', turn) WHEN conv_id % 5 = 1 THEN 'fenced' ELSE 'prose {{}}' END AS rationale FROM j)
SELECT conv_id, turn, CASE WHEN ok THEN list_sort(list_transform([0, 0.25, 0.5, 0.75, 1.0], lambda x: {{'d': abs(c - x::DOUBLE), 'a': x::DOUBLE}}))[1].a ELSE 0 END AS score, rationale FROM a"""
)
def judge_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", f"{_spark_out('score', _SCORE.format(s='string'))} as response")
    return rows.select("conv_id", "turn", judging.relevance("response").alias("r")).select("conv_id", "turn", "r.*")


@query(
    f"""WITH j AS (SELECT conv_id, turn, ((conv_id * 7 + turn * 13) % 120)::DOUBLE / 100 AS s, conv_id % 5 < 3 AND (conv_id * 7 + turn * 13) % 120 <= 100 AS ok FROM conversations WHERE role = 'assistant'),
a AS (SELECT ok, CASE WHEN ok THEN list_sort(list_transform([0, 0.25, 0.5, 0.75, 1.0], lambda x: {{'d': abs(least(1, s) - x::DOUBLE), 'a': x::DOUBLE}}))[1].a ELSE 0 END AS score FROM j)
SELECT count(*) AS n, round(avg(score), 3) AS mean, round(median(score), 3) AS median, {", ".join(f"count(*) FILTER (score = {a}) AS anchor_{int(a * 100):03d}" for a in metrics.ANCHORS)}, count(*) FILTER (NOT ok) AS n_parse_failures FROM a"""
)
def relevance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.relevance_report(judge_relevance(spark, sf_dir))


#: Each answer with the rules' verdict and a judge's, if it gave one.
_VERDICTS = f"""WITH a AS ({_ANSWERED}), r AS (SELECT concat(conv_id, ':', turn) AS id, {_RULES} IS NOT NULL AS rule, CASE WHEN conv_id % 10 = 9 THEN NULL ELSE conv_id % 5 < 3 AND (conv_id + turn) % 3 = 0 END AS judge, conv_id % 10 <> 9 AND conv_id % 5 >= 3 AS failed FROM a)"""


_REFUSAL_NUMBERS = f"""{_VERDICTS}
SELECT count(*) AS n, round(avg(coalesce(judge, false)::INT), 3) AS frac_refused_judge, round(avg(rule::INT), 3) AS frac_refused_rule, round(avg((coalesce(judge, false) = rule)::INT), 3) AS agreement_rate,
  count(*) FILTER (coalesce(judge, false) <> rule) AS n_disagreements, count(*) FILTER (failed) AS n_judge_failures FROM r"""


@query(
    f"""{_VERDICTS}
SELECT count(*) AS n, round(avg(coalesce(judge, false)::INT), 3) AS frac_refused_judge, round(avg(rule::INT), 3) AS frac_refused_rule, round(avg((coalesce(judge, false) = rule)::INT), 3) AS agreement_rate,
  count(*) FILTER (coalesce(judge, false) <> rule) AS n_disagreements, coalesce(string_agg(id, ',' ORDER BY id) FILTER (judge IS NOT NULL AND judge <> rule), '') AS disagreement_ids, count(*) FILTER (failed) AS n_judge_failures FROM r"""
)
def refusal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.refusal_report(_verdicts(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answered(spark, sf_dir).withColumn("response", F.expr(_spark_out("refused", _VERDICT)))
    rows = rows.withColumn("j", F.when(F.col("conv_id") % 10 != 9, judging.refusal("response")))
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("refused").alias("rule_refused"), F.col("j.refused").alias("judge_refused"), F.col("j.rationale").alias("judge_rationale"))


#: Claims of a turn and what a judge attributes them to: numbers repeated, missing, out of range, or no list at all.


@query(f"{_VERDICTS} SELECT id AS query_id, rule AS rule_refused, judge AS judge_refused FROM r WHERE judge IS NOT NULL AND judge <> rule")
def refusal_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.disagreements(_verdicts(spark, sf_dir))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS captured_at, strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id, strftime(ts, '%Y%m%d') AS run_day FROM events")
def run_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stamps that a report made at each event's time carries."""
    return table(spark, sf_dir, "events").select("event_id", *(column.alias(name) for name, column in t.utc_stamps("ts").items()))


_GIVEN = """if(conv_id % 6 = 5, null, array(named_struct('claim_idx', 1, 'supporting_chunk_idx', cast(turn % 7 as int), 'rationale', 'first'), named_struct('claim_idx', 1, 'supporting_chunk_idx', cast((turn + conv_id) % 7 as int), 'rationale', 'second'),
 named_struct('claim_idx', 3, 'supporting_chunk_idx', cast(null as int), 'rationale', ''), named_struct('claim_idx', 9, 'supporting_chunk_idx', 1, 'rationale', 'extra')))"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", f"{_GIVEN} as given", "if(conv_id % 6 = 4, cast(array() as array<string>), array('a', 'b', 'c')) as claims")
    rows = rows.withColumn("attributions", judging.attribute("given", "claims", F.lit(5)))
    rationale = F.when(F.size("claims") == 0, "NO_CLAIMS_EXTRACTED").otherwise("ok")
    return rows.select("conv_id", "turn", "attributions", judging.supported_share("attributions").alias("score"), rationale.alias("rationale"))


_CLAIMS = f"""SELECT conv_id, turn, i, CASE WHEN conv_id % 6 = 5 THEN NULL WHEN i = 1 AND (turn + conv_id) % 7 BETWEEN 1 AND 5 THEN (turn + conv_id) % 7 END::INT AS chunk,
  CASE WHEN conv_id % 6 = 5 THEN '{judging.NO_JSON}' WHEN i = 2 THEN 'PARSE_FAILED: no attribution for claim 2' WHEN i = 3 THEN '' WHEN (turn + conv_id) % 7 BETWEEN 1 AND 5 THEN 'second'
    ELSE concat('OUT_OF_RANGE: chunk ', (turn + conv_id) % 7, ' not in [1, 5]. second') END AS why
FROM (SELECT conv_id, turn, unnest(range(1, 4)) AS i FROM conversations WHERE role = 'assistant' AND conv_id % 6 <> 4)"""


@query(f"SELECT conv_id, turn, i::INT AS claim_idx, ['a', 'b', 'c'][i] AS claim_text, chunk AS supporting_chunk_idx, why AS rationale FROM ({_CLAIMS})")
def claim_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("conv_id", "turn", F.explode("attributions").alias("a")).select("conv_id", "turn", "a.*")


@query(f"SELECT coalesce(chunk::VARCHAR, 'none') AS chunk, count(*) AS n FROM ({_CLAIMS}) GROUP BY 1")
def claim_chunk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chunk_usage(_attributed(spark, sf_dir))


@query(
    f"""WITH c AS ({_CLAIMS}), p AS (SELECT x.conv_id, x.turn, count(c.i) AS k, count(c.chunk) AS s, count(*) FILTER (why LIKE '%PARSE_FAILED%') AS f, count(*) FILTER (why LIKE '%OUT_OF_RANGE%') AS o FROM (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') x LEFT JOIN c USING (conv_id, turn) GROUP BY ALL),
r AS (SELECT *, CASE WHEN k > 0 THEN s::DOUBLE / k ELSE 0 END AS score FROM p)
SELECT count(*) AS n, round(avg(score), 3) AS mean, round(median(score), 3) AS median, round(coalesce(stddev_samp(score), 0), 3) AS stdev, round(min(score), 3) AS min, round(max(score), 3) AS max,
  count(*) FILTER (score = 0) AS b_0, count(*) FILTER (score > 0 AND score < 0.25) AS b_0_25, count(*) FILTER (score >= 0.25 AND score < 0.5) AS b_25_50, count(*) FILTER (score >= 0.5 AND score < 0.75) AS b_50_75, count(*) FILTER (score >= 0.75 AND score < 1) AS b_75_100, count(*) FILTER (score = 1) AS b_1,
  sum(k)::BIGINT AS total_claims, sum(s)::BIGINT AS total_supported, round(sum(s)::DOUBLE / sum(k), 3) AS support_rate, round(avg(k), 2) AS claims_per_answer, max(k)::INT AS max_claims, count(*) FILTER (k = 0) AS n_no_claims, 0::BIGINT AS n_score_failures, sum(f)::BIGINT AS n_claim_failures, sum(o)::BIGINT AS n_out_of_range FROM r"""
)
def faithfulness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.faithfulness_report(_attributed(spark, sf_dir))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99, round(avg(value), 2) AS mean, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


_RAW_QUERY = """case doc_id % 6 when 0 then concat('{"query": "How do I use ', source, '?", "x": 1}') when 1 then concat('```json', chr(10), '{"query": " padded "}', chr(10), '```') when 2 then concat('Sure. {"query": "a ', lang, '"} and {"query": "b"}')
 when 3 then '{"query": 5}' when 4 then 'nothing here' else '{"query": "  "}' end"""


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('How do I use ', source, '?') WHEN 1 THEN 'padded' WHEN 2 THEN concat('a ', lang) END AS query FROM documents")
def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_RAW_QUERY} as response").select("doc_id", t.query_of("response").alias("query"))


#: Teachers' outputs: canonical refusals bare and quoted, objects bare and within prose, broken ones.
_TAUGHT = f"""case doc_id % 6 when 0 then ' {t.CANONICAL_REFUSAL.replace("'", "{q}")} ' when 1 then concat('"', '{t.CANONICAL_REFUSAL.replace("'", "{q}")}', '"') when 2 then concat('{{"answer": " Use ', source, ' [1] "}}') when 3 then concat('Well: {{"answer": "See [', cast(doc_id % 4 as {{s}}), ']"}}.')
 when 4 then '{{"answer": 3}}' else 'broken {{' end"""
_TAUGHT_SPARK = _TAUGHT.replace("{{", "{").replace("}}", "}").replace("{s}", "string").replace("{q}", "\\'")
_EXAMPLES_SQL = f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{t.CANONICAL_REFUSAL.replace("'", "''")}' WHEN 1 THEN '{t.CANONICAL_REFUSAL.replace("'", "''")}' WHEN 2 THEN concat('Use ', source, ' [1]') WHEN 3 THEN concat('See [', doc_id % 4, ']') END AS ideal_answer, doc_id % 6 < 2 AS is_refusal, doc_id % 3 AS n_chunks FROM documents"""


def taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = "transform(slice(array(1, 2), 1, cast(doc_id % 3 as int)), i -> named_struct('doc_id', source, 'chunk_id', concat(source, '::chunk_', cast(i as string)), 'score', 0.0D, 'text', text))"
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('Question ', cast(doc_id as string), '?') as query", f"{chunks} as retrieved_chunks", f"{_TAUGHT_SPARK} as response")
    return dataset.examples(rows)


@query(
    f"""SELECT doc_id, ideal_answer, is_refusal, array_to_string(list_filter([CASE WHEN ideal_answer IS NULL THEN 'ideal_answer' END, CASE WHEN NOT is_refusal AND n_chunks = 0 THEN 'chunks' END,
  CASE WHEN NOT is_refusal AND (ideal_answer IS NULL OR regexp_extract(ideal_answer, '\\[(\\d+)\\]', 1)::INT NOT BETWEEN 1 AND n_chunks) THEN 'markers' END], lambda x: x IS NOT NULL), ',') AS violations FROM ({_EXAMPLES_SQL})""".replace("\\\\", "\\")
)
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taught(spark, sf_dir).select("doc_id", "ideal_answer", "is_refusal", F.array_join("violations", ",").alias("violations"))


@query(
    f"""WITH v AS (SELECT unnest(string_split(violations, ',')) AS rule FROM ({SQL["training_examples"]}) WHERE violations <> '')
SELECT rule, (SELECT count(*) FROM v WHERE v.rule = r.rule) AS n FROM (SELECT unnest(['query', 'ideal_answer', 'chunks', 'markers']) AS rule) r
UNION ALL SELECT 'passed', count(*) FILTER (violations = '') FROM ({SQL["training_examples"]}) UNION ALL SELECT 'quarantined', count(*) FILTER (violations <> '') FROM ({SQL["training_examples"]})"""
)
def quarantined_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a write of good examples and of bad ones apart has seen: failures by check, and how many rows each folder holds."""
    path = f"{shared_dir(spark)}/skeinmill/examples-{uuid.uuid4().hex}"
    out = write_checked(taught(spark, sf_dir), generation.example_checks(), path)
    seen = spark.createDataFrame(list(out.failures.items()), "rule string, n long")
    sizes = [rows.agg(F.lit(name).alias("rule"), F.count("*").alias("n")) for name, rows in (("passed", out.passed), ("quarantined", out.quarantined))]
    return seen.unionByName(sizes[0]).unionByName(sizes[1])


@query("SELECT concat('item::', item_id) AS task_key, concat(len(string_split(text, ' ')), ' parts: ', text) AS response FROM benchmark")
def resumed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model to tasks of two runs, of which the second reads all tasks and asks the open ones."""
    folder = f"{shared_dir(spark)}/skeinmill/tasks-{uuid.uuid4().hex}"
    tasks = table(spark, sf_dir, "benchmark").selectExpr("concat('item::', cast(item_id as string)) as task_key", "text as prompt", "item_id")
    load = lambda: lambda prompts: [f"{len(p.split(' '))} parts: {p}" for p in prompts]
    for run, some in enumerate(("item_id % 2 = 0", "item_id % 2 = 1")):
        tasks.where(some).drop("item_id").write.mode("append").parquet(f"{folder}/tasks")
        answer_tasks(spark, f"{folder}/tasks", f"{folder}/replies", f"{folder}/run-{run}", load, 64).awaitTermination()
    return replies(spark, f"{folder}/replies")


@query(
    """WITH e AS (SELECT doc_id, toxic = 1 AS is_refusal FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY is_refusal ORDER BY md5('42:' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY is_refusal) AS c FROM e)
SELECT doc_id, is_refusal, CASE WHEN p <= greatest(1, round_even(c * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.stratified_split(table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic = 1 as is_refusal"), 0.1, 42, "doc_id").select("doc_id", "is_refusal", "split")


@query("SELECT toxic = 1 AS is_refusal, count(*) AS n FROM labels GROUP BY 1")
def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.strata(table(spark, sf_dir, "labels").selectExpr("toxic = 1 as is_refusal"))


_SYSTEM = generation.SYSTEM_PROMPT.replace("'", "''")


@query(
    f"""SELECT doc_id, 3 AS n_turns, '{_SYSTEM}' AS system, concat('Context:', chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('[1] (source: ', source, ')', chr(10), text) END, CASE WHEN doc_id % 3 = 2 THEN concat(chr(10), chr(10), '[2] (source: ', source, ')', chr(10), text) ELSE '' END,
  chr(10), chr(10), 'Question: Question ', doc_id, '?') AS user, CASE doc_id % 6 WHEN 0 THEN '{t.CANONICAL_REFUSAL.replace("'", "''")}' WHEN 1 THEN '{t.CANONICAL_REFUSAL.replace("'", "''")}' WHEN 2 THEN concat('Use ', source, ' [1]') WHEN 3 THEN concat('See [', doc_id % 4, ']') END AS assistant FROM documents"""
)
def training_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generation.training_messages(taught(spark, sf_dir))
    return rows.select("doc_id", F.size("messages").alias("n_turns"), *(F.get("messages", F.lit(i))["content"].alias(n) for i, n in enumerate(("system", "user", "assistant"))))


@query(
    """SELECT doc_id, concat('CHUNKS:', chr(10), CASE doc_id % 3 WHEN 0 THEN '(no chunks retrieved)' ELSE concat('[1] (source: ', source, ')', chr(10), text, CASE WHEN doc_id % 3 = 2 THEN concat(chr(10), chr(10), '[2] (source: ', source, ')', chr(10), text) ELSE '' END) END,
  chr(10), chr(10), 'QUESTION: Question ', doc_id, '?') AS message, sha256(concat_ws(chr(31), concat('Question ', doc_id, '?'), array_to_string(list_slice([source || '::chunk_1', source || '::chunk_2'], 1, doc_id % 3), chr(31)))) AS cache_key FROM documents"""
)
def distill_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taught(spark, sf_dir)
    return rows.select("doc_id", generation.distill_message(F.col("query"), F.col("retrieved_chunks")).alias("message"), dataset.cache_key(F.col("query"), F.col("retrieved_chunks")).alias("cache_key"))


_KINDS = "array('procedural', 'comparison', 'best_practice', 'pointer', 'refusal')[cast(doc_id % 5 as int)]"
_LEADS = "array('How do I ', 'What is the difference between ', 'What is the best way to ', 'Where can I ', 'Is ', 'How should I ', 'unlike ')[cast(doc_id % 7 as int)]"
_SQL_KINDS = "['procedural', 'comparison', 'best_practice', 'pointer', 'refusal'][1 + doc_id % 5]"
_SQL_LEADS = "['How do I ', 'What is the difference between ', 'What is the best way to ', 'Where can I ', 'Is ', 'How should I ', 'unlike '][1 + doc_id % 7]"
_POOL = rf"SELECT doc_id, {_SQL_KINDS} AS question_type, concat({_SQL_LEADS}, CASE WHEN doc_id % 6 > 1 THEN text ELSE source END) AS query FROM documents"
_SHAPE_SQL = "CASE question_type " + " ".join(f"WHEN '{k}' THEN regexp_matches(query, '{p}')" for k, p in t.SHAPES.items()) + " ELSE true END"
_REASON = f"CASE WHEN len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '')) < 5 THEN 'length<5_words' WHEN NOT ({_SHAPE_SQL}) THEN concat('type_mismatch_', question_type) END"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about whole texts, and of a third of the documents about their source alone, which is short."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id as row_id", f"{_KINDS} as question_type", f"concat({_LEADS}, if(doc_id % 6 > 1, text, source)) as query")


@query(f"WITH p AS ({_POOL}) SELECT doc_id, {_REASON} AS drop_reason FROM p")
def pool_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.filter_shape(seeding.filter_length(pool(spark, sf_dir))).select("doc_id", "drop_reason")


@query(f"WITH p AS ({_POOL}), r AS (SELECT {_REASON} AS drop_reason FROM p) SELECT drop_reason, count(*) AS n FROM r WHERE drop_reason IS NOT NULL GROUP BY 1")
def pool_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.reasons(pool_filters(spark, sf_dir))


@query(f"WITH p AS ({_POOL}), r AS (SELECT {_REASON} AS d FROM p) SELECT count(*) AS total, count(*) - count(d) AS kept, count(d) AS dropped FROM r")
def pool_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.funnel(pool_filters(spark, sf_dir))


@query(
    """WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) > 0.85),
n AS (SELECT row_number() OVER (ORDER BY b) AS i, b FROM (SELECT DISTINCT b FROM e)),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL
  SELECT g.i + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = n.b AND NOT list_contains(g.gone, e.a)) THEN list_append(g.gone, n.b) ELSE g.gone END FROM g JOIN n ON n.i = g.i + 1),
d AS (SELECT unnest(gone) AS vec_id FROM (SELECT gone FROM g ORDER BY i DESC LIMIT 1))
SELECT m.vec_id AS row_id, CASE WHEN d.vec_id IS NOT NULL THEN concat('duplicate_within_', m.label) END AS drop_reason FROM embeddings m LEFT JOIN d USING (vec_id)"""
)
def pool_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id as row_id", "label as question_type", "embedding")
    return seeding.filter_duplicates(rows).select("row_id", "drop_reason")


@query(
    """WITH s AS (SELECT e.vec_id, max(round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)) AS s FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id NOT IN (SELECT item_id FROM benchmark) GROUP BY 1)
SELECT vec_id AS row_id, CASE WHEN s > 0.5 THEN printf('eval_contamination_sim=%.3f', s) END AS drop_reason FROM s"""
)
def pool_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors too similar to one of a benchmark item's number."""
    rows, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark").selectExpr("item_id as vec_id")
    evals, own = rows.join(items, "vec_id", "left_semi"), rows.join(items, "vec_id", "left_anti")
    return seeding.filter_contamination(own.selectExpr("vec_id as row_id", "embedding"), evals, 0.5).select("row_id", "drop_reason")


@query(
    f"""WITH p AS (SELECT doc_id::VARCHAR AS chunk_id, {_SQL_KINDS} AS question_type FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY md5('42:' || chunk_id), chunk_id) AS i FROM p)
SELECT chunk_id, question_type FROM r WHERE i <= CASE question_type WHEN 'procedural' THEN 30 WHEN 'comparison' THEN 20 WHEN 'pointer' THEN 5000 ELSE 0 END"""
)
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as chunk_id", f"{_KINDS} as question_type")
    return seeding.quota_sample(rows, {"procedural": 30, "comparison": 20, "pointer": 5000}).select("chunk_id", "question_type")


@query(
    """WITH p AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS c, count(*) OVER () AS total, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS i FROM documents)
SELECT doc_id, lang FROM p WHERE i <= least(c, greatest(1, round_even(25 * c::DOUBLE / total, 0)))"""
)
def pool_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.preview(table(spark, sf_dir, "documents"), 25, "lang", "doc_id").select("doc_id", "lang")


@query(
    """WITH q AS (SELECT item_id AS query_id, concat(['en', 'fr', 'de', 'xx'][1 + item_id % 4], '/s') AS seed, ['en', 'fr', 'de', 'xx'][1 + item_id % 4] AS own FROM benchmark),
c AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || query_id), query_id) AS i FROM q) WHERE i <= 20),
pool AS (SELECT doc_id::VARCHAR AS chunk_id, lang AS fam, row_number() OVER (PARTITION BY lang ORDER BY doc_id::VARCHAR) - 1 AS place FROM documents),
f AS (SELECT fam, count(*) AS size, row_number() OVER (ORDER BY fam) - 1 AS f FROM pool GROUP BY fam), s AS (SELECT *, unnest(range(0, 5)) AS slot FROM c),
h AS (SELECT s.*, o.f AS own_f, ('0x' || substr(md5(concat_ws(':', '42f', query_id::VARCHAR, slot::VARCHAR)), 1, 12))::BIGINT % CASE WHEN o.f IS NULL THEN (SELECT count(*) FROM f) ELSE (SELECT count(*) FROM f) - 1 END AS p,
  ('0x' || substr(md5(concat_ws(':', '42c', query_id::VARCHAR, slot::VARCHAR)), 1, 12))::BIGINT AS c FROM s LEFT JOIN f o ON o.fam = s.own),
g AS (SELECT h.*, f.fam, h.c % f.size AS place FROM h JOIN f ON f.f = CASE WHEN own_f IS NOT NULL AND p >= own_f THEN p + 1 ELSE p END)
SELECT query_id, string_agg(pool.chunk_id, ',' ORDER BY slot) AS chunks FROM g JOIN pool USING (fam, place) GROUP BY query_id"""
)
def mismatched_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "text as query", "concat(array('en', 'fr', 'de', 'xx')[cast(item_id % 4 as int)], '/s') as seed_doc_id")
    chunks = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as chunk_id", "concat(lang, '/', source) as doc_id", "text")
    rows = seeding.mismatched_refusals(queries, chunks, 20)
    return rows.select("query_id", F.array_join(F.transform("retrieved_chunks", lambda c: c["chunk_id"]), ",").alias("chunks"))


@query("SELECT concat('refusal::s', item_id, '::', i) AS task_key, concat('s', item_id) AS id FROM (SELECT item_id, unnest(range(0, 3)) AS i FROM benchmark) WHERE item_id % 4 <> i")
def open_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = seeding.refusal_tasks(table(spark, sf_dir, "benchmark").selectExpr("concat('s', cast(item_id as string)) as id", "text as topic"))
    done = table(spark, sf_dir, "benchmark").selectExpr("concat('refusal::s', cast(item_id as string), '::', cast(item_id % 4 as string)) as task_key")
    return seeding.open_tasks(tasks, done).select("task_key", "id")


@query("SELECT user_id AS key, max(event_id) AS event_id FROM events GROUP BY user_id")
def resume_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.last_of_each(table(spark, sf_dir, "events").selectExpr("user_id as key", "event_id"), "key", "event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (n_chars * 3.0::DOUBLE + 100 * 15.0::DOUBLE) / 1e6 WHEN doc_id % 3 = 1 THEN (n_chars * 1.0::DOUBLE + 100 * 5.0::DOUBLE) / 1e6 END AS cost FROM documents")
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("model", F.expr("array('large', 'small', 'other')[cast(doc_id % 3 as int)]"))
    return rows.select("doc_id", seeding.cost(F.col("n_chars"), F.lit(100), F.col("model"), {"large": (3.0, 15.0), "small": (1.0, 5.0)}).alias("cost"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windowed_counts(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 3).alias("total"))


@query(
    """WITH e AS (SELECT 'curated' AS eval_set, text AS query, item_id AS k FROM benchmark UNION ALL SELECT 'no_answer', text, conv_id * 1000 + turn FROM conversations WHERE role = 'user')
SELECT printf('%s_%03d', eval_set, row_number() OVER (PARTITION BY eval_set ORDER BY k) - 1) AS query_id, query, eval_set = 'no_answer' AS is_no_answer FROM e"""
)
def eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evaluation sets in one table, each numbered in its own order."""
    curated = table(spark, sf_dir, "benchmark").selectExpr("'curated' as eval_set", "text as query", "item_id as k")
    others = table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("'no_answer' as eval_set", "text as query", "conv_id * 1000 + turn as k")
    rows = numbered(curated.unionByName(others), "eval_set", "k")
    return rows.select(F.format_string("%s_%03d", "eval_set", F.col("place") - 1).alias("query_id"), "query", (F.col("eval_set") == "no_answer").alias("is_no_answer"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('seed', doc_id) ELSE concat('found', doc_id) END AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END AS score FROM documents")
def refusal_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesised refusals keep their seed chunks; all other queries take what was retrieved."""
    ref = "array(named_struct('doc_id', source, 'chunk_id', concat('{0}', cast(doc_id as string)), 'score', {1}, 'text', lang))"
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "if(doc_id % 4 = 0, map('synthesis_method', 'retrieval_failure_pairing'), map('model', 'm')) as metadata", ref.format("seed", "0.0D") + " as seed_chunks", ref.format("found", "1.5D") + " as retrieved")
    chosen = seeding.retrieved_or_seeds(rows).select("doc_id", F.explode("retrieved_chunks").alias("c"))
    return chosen.select("doc_id", "c.chunk_id", "c.score")


@query(f"WITH p AS ({_POOL}), r AS (SELECT question_type, {_REASON} AS d FROM p) SELECT question_type, count(*) AS n FROM r WHERE d IS NULL GROUP BY 1")
def pool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = seeding.filter_shape(seeding.filter_length(pool(spark, sf_dir))).where("drop_reason is null")
    return metrics.histogram(kept, "question_type")


@query("SELECT sum(n_chars)::BIGINT AS input_tokens, sum(n_chars // 4)::BIGINT AS output_tokens, count(*) AS n FROM documents")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("named_struct('input_tokens', n_chars, 'output_tokens', n_chars div 4) as metadata")
    return rows.agg(F.sum("metadata.input_tokens").alias("input_tokens"), F.sum("metadata.output_tokens").alias("output_tokens"), F.count("*").alias("n"))


def _melted(section: str) -> str:
    summary = _REFUSAL_NUMBERS if section == "refusal" else SQL[f"{section}_summary"]
    return f"SELECT '{section}' AS section, metric, value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM ({summary})) ON COLUMNS(*) INTO NAME metric VALUE value)"


@query(" UNION ALL ".join(map(_melted, ("faithfulness", "relevance", "citation", "refusal"))))
def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run: judged answers, citations and refusals in one tidy table."""
    return metrics.generation_report({"faithfulness": faithfulness_summary(spark, sf_dir), "relevance": relevance_summary(spark, sf_dir), "citation": citation_summary(spark, sf_dir), "refusal": refusal_summary(spark, sf_dir)})


@query(f"SELECT concat(question_type, '::', chunk_id) AS task_key, chunk_id, question_type FROM ({SQL['quota_sample']})")
def corpus_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as chunk_id", f"{_KINDS} as question_type")
    return seeding.corpus_tasks(rows, {"procedural": 30, "comparison": 20, "pointer": 5000})


@query(
    f"""SELECT doc_id, CASE WHEN k = 'refusal' THEN NULL ELSE query END AS query, k = 'refusal' AS expected_refusal, query IS NULL OR k = 'refusal' AS failed
FROM (SELECT doc_id, query, {_SQL_KINDS} AS k FROM ({SQL["query_parse"]}))"""
)
def generated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models' outputs for sampled chunks; a refusal asked of a chunk is a failure."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(doc_id as string) as chunk_id", f"{_KINDS} as question_type", f"{_RAW_QUERY} as response")
    return seeding.parsed_queries(rows).select("doc_id", "query", "expected_refusal", "failed")


@query(
    f"""WITH p AS ({_POOL}), g AS (SELECT query, question_type FROM (SELECT *, {_REASON} AS d FROM p) WHERE d IS NULL),
u AS (SELECT query, question_type, 1 AS n_chunks FROM g UNION ALL SELECT b.text, 'refusal', 5 FROM ({SQL["mismatched_refusals"]}) m JOIN benchmark b ON b.item_id = m.query_id)
SELECT query, question_type, question_type = 'refusal' AS expected_refusal, n_chunks, count(*) AS n FROM u GROUP BY ALL"""
)
def pool_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated queries that pass the filters, and synthesized refusals, in one pool."""
    chunk = "array(named_struct('doc_id', 'd', 'chunk_id', cast(doc_id as string), 'score', 1.0D, 'text', query)) as retrieved_chunks"
    made = seeding.filter_shape(seeding.filter_length(pool(spark, sf_dir))).selectExpr("query", "question_type", "drop_reason", chunk)
    queries = table(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "text as query", "concat(array('en', 'fr', 'de', 'xx')[cast(item_id % 4 as int)], '/s') as seed_doc_id")
    chunks = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) as chunk_id", "concat(lang, '/', source) as doc_id", "text")
    rows = seeding.pool_of(made, seeding.mismatched_refusals(queries, chunks, 20))
    return rows.groupBy("query", "question_type", "expected_refusal", F.size("retrieved_chunks").alias("n_chunks")).agg(F.count("*").alias("n"))


@query("SELECT conv_id AS key, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations WHERE turn % 5 <> 3 GROUP BY conv_id")
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a run written line by line in several appends, some lines broken off: of each key the last whole one counts."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "to_json(named_struct('key', conv_id, 'turn', turn, 'role', role)) as line")
    path = f"{shared_dir(spark)}/skeinmill/checkpoint-{uuid.uuid4().hex}"
    for part in ("turn < 2", "turn between 2 and 3", "turn >= 4"):
        lines = rows.where(part).selectExpr("conv_id", "turn", "explode(if(turn % 5 = 3, array(left(line, 9), ''), array(line))) as line")
        append_text(lines.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("line"), path)
    return read_checkpoint(spark, path, "key bigint, turn bigint, role string", "key")


def _sql_filled(template: str, **values: str) -> str:
    """SQL that concatenates a template's pieces and the expressions in its places; null if one of them is."""
    text = template.format(**{name: f"\x00{value}\x00" for name, value in values.items()})
    return " || ".join(piece if i % 2 else "'" + piece.replace("'", "''") + "'" for i, piece in enumerate(text.split("\x00")) if piece)


_WISHES = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(prompting.KINDS.values())) + " END"


@query(
    f"""SELECT 'chunk' AS kind, doc_id AS id, {_SQL_KINDS} AS question_type, {_sql_filled(prompting.QUERY_REQUEST, kind=_WISHES, doc_id="source", text="text")} AS prompt, 0.0::DOUBLE AS temperature FROM documents
UNION ALL SELECT 'topic', item_id, 'refusal', {_sql_filled(prompting.TOPIC_REQUEST, topic="text")}, 0.7::DOUBLE FROM benchmark"""
)
def query_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a generator is asked for chunks and for topics; no refusal is asked of a chunk."""
    names = ["kind", "id", "question_type", "prompt", "temperature"]
    chunks = table(spark, sf_dir, "documents").selectExpr("'chunk' as kind", "doc_id as id", "source as doc_id", f"{_KINDS} as question_type", "text")
    topics = table(spark, sf_dir, "benchmark").selectExpr("'topic' as kind", "item_id as id", "text as topic")
    return prompting.chunk_requests(chunks).select(*names).unionByName(prompting.topic_requests(topics).select(*names))


_REFUSED = t.CANONICAL_REFUSAL.replace("'", "''")
#: Answers that repeat the question's text, add to it, refuse or are empty.
_REPLIES = "CASE conv_id % 4 WHEN 0 THEN '{r}' WHEN 1 THEN concat(text, '. A claim made up') WHEN 2 THEN text ELSE '' END"


def _cut(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\. |\n'), lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), lambda s: s <> '')"


def _bag(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda s: s <> ''))"


@query(
    f"""WITH a AS (SELECT conv_id, turn, text, concat('whether ', text) AS question, {_REPLIES.format(r=_REFUSED)} AS answer FROM conversations WHERE role = 'assistant'),
c AS (SELECT *, {_cut("answer")} AS claims, {_cut("text")} AS have, {_bag("question")} AS qw, {_bag("answer")} AS aw FROM a),
n AS (SELECT *, len(claims) AS k, len(list_filter(claims, lambda x: list_contains(have, x))) AS s, len(list_intersect(qw, aw))::DOUBLE / len(qw) AS r FROM c)
SELECT conv_id, turn, k::INT AS n_claims, CASE WHEN k = 0 THEN 0 ELSE round(s::DOUBLE / k, 9) END AS faithfulness, starts_with(answer, '{_REFUSED}') AS refused,
  list_sort(list_transform([0, 0.25, 0.5, 0.75, 1.0], lambda x: {{'d': abs(r - x::DOUBLE), 'a': x::DOUBLE}}))[1].a AS relevance FROM n"""
)
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers judged by the stand-in: claims, what supports them, relevance and refusal."""
    chunks = "transform(array('Nothing of it', text), x -> named_struct('doc_id', 'd', 'chunk_id', 'c', 'score', 0.0D, 'text', x)) as chunks"
    answer = _REPLIES.format(r=t.CANONICAL_REFUSAL.replace("'", "\\'"))
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", "concat('whether ', text) as question", f"{answer} as answer", chunks)
    out = prompting.judged(rows, prompting.overlap_judge)
    return out.select("conv_id", "turn", F.size("faithfulness.attributions").alias("n_claims"), F.round("faithfulness.score", 9).alias("faithfulness"), F.col("refusal.refused").alias("refused"), F.col("relevance.score").alias("relevance"))
