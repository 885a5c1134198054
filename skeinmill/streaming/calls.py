"""Calls of a model for a table of tasks, that a run which breaks off doesn't pay for twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinmill.operators.seeding import open_tasks
from skeinmill.sinks import manifest
from skeinmill.sinks.files import append_lines
from skeinmill.sources.files import read_checkpoint

TASK, REPLY = "task_key string, prompt string", "task_key string, response string"


def replies(spark: SparkSession, target: str) -> DataFrame:
    """(task_key, response): the last reply to each task."""
    return read_checkpoint(spark, target, REPLY, "task_key") if manifest.exists(spark, target) else spark.createDataFrame([], REPLY)


def call(tasks: DataFrame, load: Callable[[], Callable[[list[str]], list[str | None]]]) -> DataFrame:
    """(task_key, response): replies of a model, which `load` gives once in a task, to an Arrow batch of prompts at a time."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.tolist()), index=batch.index, dtype="object")

    # Replies differ from call to call, so that none may be worked out twice.
    return tasks.select("task_key", ask.asNondeterministic()("prompt").alias("response"))


def answer_tasks(spark: SparkSession, tasks: str, target: str, checkpoint: str, load: Callable[[], Callable[[list[str]], list[str | None]]], files: int = 1) -> StreamingQuery:
    """Asks a model for each task (task_key, prompt) in Parquet files of a folder, `files` of them at a time, and appends its replies.

    Each batch leaves out, by key, tasks that have a reply, and commits its own as one numbered batch of lines. A run that
    breaks off is started anew, with its checkpoint or, to try open tasks of files that it has read, with another
    one: committed tasks aren't asked again, and at most one batch's calls are lost. A task that occurs more than once is asked once.
    A null reply is none: its task stays open.
    """
    rows = spark.readStream.schema(TASK).option("maxFilesPerTrigger", files).parquet(tasks)

    def answer(batch: DataFrame, _: int) -> None:
        # What the plan reads is what was committed before this batch began.
        todo = open_tasks(batch.where("task_key is not null").dropDuplicates(["task_key"]), replies(batch.sparkSession, target))
        append_lines(call(todo, load).where("response is not null"), target)

    return rows.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
