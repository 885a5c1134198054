"""Ingestion, query pools, datasets, readers, writers, settings, streaming."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from skeinmill import config
from skeinmill.functions import text as t
from skeinmill.operators import dataset, metrics, seeding
from skeinmill.operators.numbering import hash_cut, numbered
from skeinmill.sinks import files as sinks
from skeinmill.sources import files
from skeinmill.streaming.ingest import ingest
from tests import plain


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: Front\nx: 1:2\nx: 3\n---\n# Head\nbody")
    (tmp_path / "sub/b.md").write_text("text\n  # Second  \n")
    (tmp_path / "empty.md").write_text("---\na: b\n---\n  \n")
    (tmp_path / "c.md").write_text("---\ntitle:\ndoc_id: own\n---\nno heading")
    (tmp_path / "skip.txt").write_text("no")
    rows = {r.source: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "sub/b.md", "c.md"}
    assert rows["a.md"].title == "Front" and rows["a.md"].metadata["x"] == "3" and rows["a.md"].content == "# Head\nbody"
    assert rows["sub/b.md"].title == "Second" and rows["sub/b.md"].doc_id == "sub/b.md"
    assert rows["c.md"].doc_id == "own" and rows["c.md"].title == ""
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND"):
        files.read_markdown(spark, str(tmp_path / "none")).count()


def test_headings(spark):
    text = "## Overview\n## Loading models fast [[anchor]]\n## Note: careful here\n### Third level one\n## Short\n##   Padded heading two  \n## two w"
    row = spark.createDataFrame([(text,)], "content string").select(t.headings("content").alias("h")).first()
    assert row.h == ["Loading models fast", "Padded heading two"]


def test_structural_queries_follow_the_seed(spark):
    docs = spark.createDataFrame([(f"d{i}", f"## Heading number {i} here\n## Longer heading number {i} here\n## Longer heading number {i} hare") for i in range(20)], "doc_id string, content string")
    one, two = ([tuple(r) for r in seeding.structural_queries(docs, 5, s).orderBy("query_id").collect()] for s in (1, 2))
    assert len(one) == 5 and one != two and all(r[1].startswith("Longer") and r[1].endswith("here") for r in one)
    assert one == [tuple(r) for r in seeding.structural_queries(docs.repartition(3), 5, 1).orderBy("query_id").collect()]
    assert seeding.structural_queries(docs, 100).count() == 20


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("```\na\n```", {"procedural"}), ("tail\n```", set()), ("```python\nx", {"procedural"}), (">>> run()", {"procedural"}), ("A vs. B", {"comparison"}), ("this is unlike that", {"comparison"}),
        ("You should use it", {"best_practice"}), ("## Usage tips\n", {"best_practice"}), ("this should not happen", set()), ("see the training script", {"pointer"}), ("plain", set()), ("refer to the docs; prefer it", {"pointer", "best_practice"}),
    ],
)
def test_classification(spark, text, kinds):
    assert set(spark.createDataFrame([(text,)], "text string").select(t.question_types("text").alias("k")).first().k) == kinds


def test_filters_give_the_first_reason(spark):
    rows = spark.createDataFrame([(1, "How do I", "procedural"), (2, "How do I do this thing", "procedural"), (3, "What is the thing called here", "procedural"), (4, "anything goes in this refusal query", "refusal")], "row_id int, query string, question_type string")
    got = {r.row_id: r.drop_reason for r in seeding.filter_shape(seeding.filter_length(rows)).collect()}
    assert got == {1: "length<5_words", 2: None, 3: "type_mismatch_procedural", 4: None}
    assert seeding.filter_shape(rows.limit(0)).count() == 0


def test_duplicates_equal_the_greedy_rule(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(60)] + [[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]]
    kinds = [rng.choice("ab") for _ in vectors]
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(zip(kinds, vectors, strict=True))], "row_id int, question_type string, embedding array<double>")
    for threshold in (0.5, 0.9, 0.999):
        got = sorted(r.row_id for r in seeding.filter_duplicates(rows, threshold).where("drop_reason is null").collect())
        assert got == plain.keep_first(vectors, kinds, threshold)


@pytest.mark.parametrize(("n", "driver_pairs"), [(240, seeding.DRIVER_PAIRS), (120, 100)])
def test_duplicates_along_a_chain(spark, n, driver_pairs):
    vectors = [[math.cos(math.radians(1.4 * i)), math.sin(math.radians(1.4 * i))] for i in range(n)]
    rows = spark.createDataFrame([(i, "a", v) for i, v in enumerate(vectors)], "row_id int, question_type string, embedding array<double>")
    got = seeding.filter_duplicates(rows, math.cos(math.radians(2)), driver_pairs=driver_pairs).where("drop_reason is null").collect()
    assert sorted(r.row_id for r in got) == list(range(0, n, 2)) == plain.keep_first(vectors, "a" * n, math.cos(math.radians(2)))


def test_duplicates_by_rounds_alone(spark):
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(50)]
    rows = spark.createDataFrame([(i, "a", v) for i, v in enumerate(vectors)], "row_id int, question_type string, embedding array<double>")
    got = seeding.filter_duplicates(rows, 0.95, driver_pairs=0).where("drop_reason is null").collect()
    assert sorted(r.row_id for r in got) == plain.keep_first(vectors, "a" * 50, 0.95)


def test_duplicates_of_copies_and_rows_without_parts(spark):
    schema = "row_id string, question_type string, embedding array<double>"
    copies = [(f"k{i:03d}", "a" if i % 3 else "b", [1.0, 0.0]) for i in range(150)]
    rows = spark.createDataFrame([*copies, (None, "a", [1.0, 0.0]), ("x", None, [1.0, 0.0]), ("y", "a", None), ("z", "a", [0.0, 1.0]), ("z", "a", [0.0, 1.0])], schema)
    kept = [r.row_id for r in seeding.filter_duplicates(rows).where("drop_reason is null").collect()]
    assert sorted(map(str, kept)) == ["None", "k000", "k001", "x", "y", "z", "z"]
    assert seeding.filter_duplicates(rows.limit(0)).count() == 0


def test_contamination(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "row_id int, embedding array<double>")
    evals = spark.createDataFrame([([2.0, 0.0],)], "embedding array<double>")
    got = {r.row_id: r.drop_reason for r in seeding.filter_contamination(rows, evals).collect()}
    assert got == {1: "eval_contamination_sim=1.000", 2: None, 3: "eval_contamination_sim=0.707"}
    assert seeding.filter_contamination(rows, evals.limit(0)).where("drop_reason is not null").count() == 0


def test_quota_and_plain_samples(spark):
    rows = spark.range(100).selectExpr("cast(id as string) as chunk_id", "if(id % 2 = 0, 'procedural', 'pointer') as question_type")
    got = seeding.quota_sample(rows, {"procedural": 7, "pointer": 500}).groupBy("question_type").count().collect()
    assert {r.question_type: r["count"] for r in got} == {"procedural": 7, "pointer": 50}
    assert seeding.sample(rows, 3, 1, "chunk_id").count() == 3 and seeding.sample(rows, 2, 1, "chunk_id", ["question_type"]).count() == 4


@pytest.mark.parametrize("fraction", [0.1, 0.5])
def test_split(spark, fraction):
    rows = spark.range(95).selectExpr("id as example_id", "id % 19 = 0 as is_refusal")
    got = {(r.is_refusal, r.split): r["count"] for r in dataset.stratified_split(rows, fraction).groupBy("is_refusal", "split").count().collect()}
    assert got[True, "val"] == max(1, round(5 * fraction)) and got[False, "val"] == round(90 * fraction) and sum(got.values()) == 95
    for bad in (0, 1, -0.5):
        with pytest.raises(ValueError, match="fraction"):
            dataset.stratified_split(rows, bad)


def test_cache_keys_depend_on_order(spark):
    keys = spark.sql("select array(named_struct('chunk_id', 'a'), named_struct('chunk_id', 'b')) as x, array(named_struct('chunk_id', 'b'), named_struct('chunk_id', 'a')) as y").select(*(dataset.cache_key(F.lit("q"), F.col(c)).alias(c) for c in "xy")).first()
    assert keys.x != keys.y


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"task_key": "pointer::a::b", "query": "q1"}\n\nbroken {\n{"task_key": "refusal", "query": "q2"}\n')
    rows = files.read_task_lines(spark, str(tmp_path / "raw.jsonl"), "task_key string, query string").orderBy("line").collect()
    assert [(r.task_type, r.identifier, r["query"]) for r in rows] == [("pointer", "a::b", "q1"), ("refusal", None, "q2")]
    (tmp_path / "seeds.json").write_text(json.dumps({"version": "1", "seeds": [{"id": "a", "category": "unrelated", "topic": "t", "notes": ""}, {"id": "", "category": "x", "topic": "t"}]}))
    assert [r.valid for r in files.read_seeds(spark, str(tmp_path / "seeds.json")).orderBy("id").collect()] == [False, True]
    (tmp_path / "set.json").write_text(json.dumps([{"query": "q", "relevant": ["d"]}, {"query": "r"}]))
    got = files.read_eval_set(spark, str(tmp_path / "set.json"), "curated").orderBy("query_id").collect()
    assert [(r.query_id, r.prefixes) for r in got] == [("curated_000", ["d"]), ("curated_001", [])]
    (tmp_path / "in.json").write_text(json.dumps([{"query": "q", "retrieved_chunks": []}]))
    assert files.read_inputs(spark, str(tmp_path / "in.json")).first().expected_refusal is False
    examples = spark.createDataFrame([("q", [], "a", False), ("q2", [], t.CANONICAL_REFUSAL, True)], "query string, retrieved_chunks array<struct<doc_id:string,chunk_id:string,score:double,text:string>>, ideal_answer string, is_refusal boolean")
    sinks.write_dataset(examples, str(tmp_path / "set"), "2")
    assert spark.read.json(str(tmp_path / "set/manifest")).first().n_refusals == 1
    (tmp_path / "ds.json").write_text(json.dumps({"version": "3", "examples": [{"query": "q", "retrieved_chunks": [], "ideal_answer": "a", "is_refusal": False}]}))
    assert files.read_examples(spark, str(tmp_path / "ds.json")).first().version == "3"
    chunks = spark.createDataFrame([("d", "c", "t", "fixed"), ("d", "c2", "t", "header")], "doc_id string, chunk_id string, text string, strategy string")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    assert files.read_chunks(spark, str(tmp_path / "chunks"), "fixed").count() == 1
    sinks.append_lines(chunks, str(tmp_path / "lines"))
    sinks.append_lines(chunks, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    sinks.write_lines(sinks.pool_lines(spark.createDataFrame([("q", "pointer", None)], "query string, question_type string, seed_topic string")), str(tmp_path / "pool"))
    assert list(json.loads(spark.read.text(str(tmp_path / "pool")).first().value)) == ["query", "question_type", "seed_topic"]
    report = sinks.render_report(spark.createDataFrame([("fixed", "mrr", 0.5)], "strategy string, metric string, value double"), {"eval_k": 10})
    assert report == {"eval_k": 10, "strategies": {"fixed": {"mrr": 0.5}}}
    sinks.write_report(report, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == report
    assert "| a | 2 |" in sinks.filter_markdown(spark.createDataFrame([("a", 2)], "drop_reason string, n int"), {"total": 2})


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"retrieval": {"top_k": 9}}')
    got = config.load(tmp_path / "s.json")
    assert got.retrieval.top_k == 9 and got.chunking.chunk_size == 512
    for bad, error in (('{"nothing": 1}', KeyError), ("[1]", TypeError), ('{"retrieval": 3}', TypeError)):
        (tmp_path / "s.json").write_text(bad)
        with pytest.raises(error):
            config.load(tmp_path / "s.json")


def test_stream_ingest_is_incremental(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("in", "out", "check")}
    make = lambda ids: spark.createDataFrame([(str(i), f"text number {i}") for i in ids], "doc_id string, content string")
    for ids, total in (([1, 2], 2), ([3], 3), ([], 3)):
        if ids:
            make(ids).coalesce(1).write.mode("append").parquet(paths["in"])
        query = ingest(spark, paths["in"], paths["out"], paths["check"], ["recursive"])
        assert query.awaitTermination(60)
        assert spark.read.parquet(paths["out"]).count() == total


def test_open_tasks_and_cost(spark):
    tasks = seeding.refusal_tasks(spark.createDataFrame([("a", "t"), ("b", "t")], "id string, topic string"), 2)
    done = spark.createDataFrame([("refusal::a::0",), (None,)], "task_key string")
    assert sorted(r.task_key for r in seeding.open_tasks(tasks, done).collect()) == ["refusal::a::1", "refusal::b::0", "refusal::b::1"]
    row = spark.range(1).select(*(seeding.cost(F.lit(10), F.lit(2), F.lit(m), {"x": (1.0, 5.0)}).alias(m) for m in ("x", "y"))).first()
    assert row.x == pytest.approx(2e-5) and row.y is None


def test_places_in_groups_equal_a_window(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(40)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, grp string, v int").repartition(5)
    want = {}
    for g in {r[1] for r in rows}:
        want |= {r[0]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])))}
    assert {r.id: r.place for r in numbered(frame, "grp", "v", "id").collect()} == want
    assert numbered(frame.limit(0), "grp", "v").count() == 0
    md5 = lambda r: (hashlib.md5(f"5:{r[0]}".encode()).hexdigest(), r[0])
    for n in (0, 1, 7, 1000):
        want = {r[0] for g in {r[1] for r in rows} for r in sorted((r for r in rows if r[1] == g), key=md5)[:n]}
        got = hash_cut(frame, ["grp"], F.lit(n), "id", 5)
        assert got.columns == frame.columns and {r.id for r in got.collect()} == want and got.count() == len(want)
        marked = hash_cut(frame, ["grp"], F.lit(n), "id", 5, "chosen").collect()
        assert {r.id for r in marked if r.chosen} == want and len(marked) == len(rows)


def test_a_cut_orders_its_border_alone(spark):
    """The plan has no sort of the whole table: what is sorted has passed the border's filter or the histogram."""
    rows = spark.range(5000).selectExpr("id", "id % 3 as grp")
    plan = hash_cut(rows, ["grp"], F.lit(100), "id", 1)._jdf.queryExecution().optimizedPlan().toString()
    before = [plan[: m.start()].count("\n") for m in re.finditer("Window ", plan)]
    assert len(before) >= 2 and "Sort" not in plan
    want = sorted(range(5000), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), i))
    for g in range(3):
        assert sorted(r.id for r in hash_cut(rows, ["grp"], F.lit(100), "id", 1).where(f"grp = {g}").collect()) == sorted([i for i in want if i % 3 == g][:100])


def test_checkpoints_with_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "old"}\n\n{"k": 2, "v": "x"\nnot json\n{"k": 1, "v": "new"}\n{"v": "no key"}\n{"k": 3, "v": null}\n')
    (tmp_path / "b.jsonl").write_text('{"k": 1, "v": "newest"}\n{"k": 4}\n')
    got = files.read_checkpoint(spark, str(tmp_path), "k int, v string", "k").collect()
    assert sorted(map(tuple, got)) == [(1, "newest"), (3, None), (4, None)]


def test_an_evaluation_set_is_written_as_it_is_read(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"## Loading \"quoted\" files of kind {i}\n\ntext") for i in range(9)], "doc_id string, content string")
    made = seeding.structural_queries(docs, 5)
    sinks.write_eval_set(made, str(tmp_path / "set"))
    whole = json.loads("".join(p.read_text() for p in (tmp_path / "set").glob("part-*")))
    want = [(r.query, r.prefixes) for r in made.orderBy("query_id").collect()]
    assert [(r["query"], r["relevant"]) for r in whole] == want and len(want) == 5
    read = files.read_eval_set(spark, str(tmp_path / "set"), "structural").orderBy("query_id").collect()
    assert [(r.query, r.prefixes) for r in read] == want and read[0].query_id == "structural_000"
    sinks.write_eval_set(made.limit(0), str(tmp_path / "none"))
    assert files.read_eval_set(spark, str(tmp_path / "none"), "x").count() == 0


def test_the_last_append_of_a_key_wins(spark, tmp_path):
    """Whatever the names of its files: of two and of ten appends, over twenty runs, the last one counts; broken lines don't."""
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string")
    for run in range(20):
        path = str(tmp_path / f"run{run}")
        appends = 10 if run == 0 else 2
        numbers = [sinks.append_lines(row(1, f"v{i}").unionByName(row(2 + i, "own")).repartition(1 + i % 3), path) for i in range(appends)]
        assert numbers == list(range(appends))
        got = {r.k: r.v for r in files.read_checkpoint(spark, path, "k int, v string", "k").collect()}
        assert got == {1: f"v{appends - 1}"} | {2 + i: "own" for i in range(appends)}
    sinks.append_text(spark.createDataFrame([('{"k": 1, "v": "las',), ("",)], "value string"), path)
    (tmp_path / "run19/old.json").write_text('{"k": 1, "v": "before all"}\n{"k": 99, "v": "kept"}\n')
    got = {r.k: r.v for r in files.read_checkpoint(spark, path, "k int, v string", "k").collect()}
    assert got[1] == "v1" and got[99] == "kept"
    # A batch that is written again takes its own place, not the last one.
    sinks.append_lines(row(1, "late"), path, batch=0)
    assert {r.k: r.v for r in files.read_checkpoint(spark, path, "k int, v string", "k").collect()}[1] == "v1"


def test_reports_and_assembled_pools(spark):
    checked = spark.createDataFrame([(True, True, 2), (True, False, 1), (False, False, 0)], "any_marker boolean, all_in_range boolean, n_markers int")
    report = metrics.citation_report(checked)
    assert tuple(report.first()) == (3, 0.667, 0.333, 1.0)
    assert {(r.section, r.metric): r.value for r in metrics.generation_report({"citation": report}).collect()}["citation", "mean_n_markers"] == 1.0
    with pytest.raises(ValueError, match="no sections"):
        metrics.generation_report({})
    chunk = "array(named_struct('doc_id', 'd', 'chunk_id', 'c', 'score', 0.0D, 'text', 't')) as retrieved_chunks"
    made = spark.sql(f"select 'How do I?' as query, 'procedural' as question_type, if(id = 0, 'length', null) as drop_reason, {chunk} from range(2)")
    pool = seeding.pool_of(made, spark.sql(f"select 'q' as query, 'refusal' as question_type, {chunk}")).collect()
    assert sorted((r.question_type, r.expected_refusal) for r in pool) == [("procedural", False), ("refusal", True)]
    raw = spark.createDataFrame([('{"query": "a b"}', "procedural", "c1"), ("none", "procedural", "c1"), ('{"query": "x"}', "refusal", "c1"), ('{"query": "x"}', "refusal", None)], "response string, question_type string, chunk_id string")
    assert [r.failed for r in seeding.parsed_queries(raw).collect()] == [False, True, True, False]
