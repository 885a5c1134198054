"""Runs that break off, and what they have paid for; rows that fail checks."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinmill.sinks import files as sinks
from skeinmill.sinks.quarantine import write_checked
from skeinmill.streaming.calls import answer_tasks, replies


def test_a_killed_run_calls_no_model_twice_for_committed_tasks(spark, tmp_path):
    tasks, target, calls, broken = (str(tmp_path / n) for n in ("tasks", "replies", "calls", "broken"))
    os.makedirs(calls)
    open(broken, "w").close()

    def add(keys, when):
        spark.createDataFrame([(k, f"prompt {k}") for k in keys], "task_key string, prompt string").coalesce(1).write.mode("append").parquet(tasks)
        new = [f"{tasks}/{f}" for f in os.listdir(tasks) if f.endswith(".parquet") and os.path.getmtime(f"{tasks}/{f}") > 10**9]
        for f in new:
            os.utime(f, (when, when))

    add(["a", "b", "c"], 1000)
    add(["d", "bad", "e", "a"], 2000)
    add(["f", "b", None, "mute"], 3000)

    def load():
        def model(prompts):
            import uuid

            with open(f"{calls}/{uuid.uuid4().hex}", "w") as log:
                log.write("\n".join(prompts))
            if os.path.exists(broken) and "prompt bad" in prompts:
                raise OSError("the model is down")
            return [None if "mute" in p else p.upper() for p in prompts]

        return model

    def run(checkpoint):
        answer_tasks(spark, tasks, target, str(tmp_path / checkpoint), load).awaitTermination()

    def called():
        return Counter(line for f in os.listdir(calls) for line in open(f"{calls}/{f}").read().split("\n") if line)

    with pytest.raises(Exception, match="the model is down"):
        run("first")
    assert sorted(r.task_key for r in replies(spark, target).collect()) == ["a", "b", "c"]
    committed = called()
    os.remove(broken)
    run("first")
    got = {r.task_key: r.response for r in replies(spark, target).collect()}
    assert got == {k: f"PROMPT {k.upper()}" for k in ["a", "b", "c", "d", "bad", "e", "f"]}
    after = called()
    assert all(after[f"prompt {k}"] == committed[f"prompt {k}"] == 1 for k in "abc") and after["prompt f"] == 1
    # With another checkpoint all files are read again, and only what has no reply is asked.
    run("second")
    again = called()
    assert again == after + Counter({"prompt mute": 1})
    sinks.append_text(spark.createDataFrame([('{"task_key": "mute", "resp',)], "value string"), target)
    assert {r.task_key: r.response for r in replies(spark, target).collect()} == got


def test_rows_that_fail_are_written_apart_and_counted_in_one_pass(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        reads.add(1)
        return x

    rows = spark.range(100).withColumn("v", counted.asNondeterministic()(F.col("id").cast("int"))).withColumn("name", F.when(F.col("id") % 10 != 0, F.lit("n")))
    checks = {"small": F.col("v") < 90, "named": F.length("name") >= 1, "even": F.col("v") % 2 == 0}
    out = write_checked(rows, checks, str(tmp_path / "out"))
    assert (out.n, out.failures) == (100, {"small": 10, "named": 10, "even": 50}) and reads.value == 100
    assert sorted(r.id for r in out.passed.collect()) == [i for i in range(90) if i % 2 == 0 and i % 10]
    bad = {r.id: r.violations for r in out.quarantined.collect()}
    assert bad[90] == ["small", "named"] and bad[1] == ["even"] and len(bad) == 64 and out.passed.columns == rows.columns
    none = write_checked(rows.limit(0), checks, str(tmp_path / "none"))
    assert (none.n, none.failures) == (0, {"small": 0, "named": 0, "even": 0}) and none.passed.count() == none.quarantined.count() == 0
    whole = write_checked(rows, {"all": F.lit(True)}, str(tmp_path / "out"))
    assert whole.quarantined.count() == 0 and whole.passed.count() == 100
