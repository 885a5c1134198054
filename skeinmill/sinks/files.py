"""Writers: chunk tables by strategy, JSON lines, datasets, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinmill.functions.text import utc_stamps
from skeinmill.operators.seeding import preview
from skeinmill.sinks import manifest


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A partition for each strategy, so that a reader of one prunes the rest."""
    chunks.write.mode(mode).partitionBy("strategy").parquet(path)


def append_text(lines: DataFrame, path: str, batch: int | None = None) -> int:
    """Lines of a text column, as a batch after those that are there, and its number, by which readers order lines.

    A number is claimed before the batch is written, so that two writers don't share one, and a batch whose write broke off
    leaves a gap. A caller that numbers batches itself, as a stream does, replaces a batch by giving its number again.
    """
    batch = manifest.claim(lines.sparkSession, path) if batch is None else batch
    lines.write.mode("overwrite").text(f"{path}/batch={batch:08d}")
    return batch


def append_lines(rows: DataFrame, path: str, batch: int | None = None) -> int:
    """Rows as JSON objects, one a line, appended as a batch."""
    return append_text(rows.select(F.to_json(F.struct("*")).alias("value")), path, batch)


def pool_lines(pool: DataFrame) -> DataFrame:
    """The pool as JSON text, keys in a fixed order."""
    names = ["query", "question_type", "expected_refusal", "retrieved_chunks", "seed_chunks", "seed_topic", "metadata"]
    have = [n for n in names if n in pool.columns]
    return pool.select(F.to_json(F.struct(*have), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).text(path)


def write_eval_set(queries: DataFrame, path: str) -> None:
    """An evaluation set (query_id, query, prefixes) as one JSON array of {query, relevant}, in order of id, which read_eval_set reads.

    A set is small by nature: it is one value of one row.
    """
    rows = F.sort_array(F.collect_list(F.struct("query_id", "query", F.col("prefixes").alias("relevant"))))
    whole = queries.agg(F.to_json(F.transform(rows, lambda r: F.struct(r["query"].alias("query"), r["relevant"].alias("relevant")))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_dataset(examples: DataFrame, path: str, version: str = "1", description: str = "") -> None:
    """Examples as JSON lines, and a manifest of one row beside them."""
    examples.write.mode("overwrite").json(f"{path}/examples")
    manifest = examples.agg(F.count("*").alias("n_examples"), F.count_if("is_refusal").alias("n_refusals"))
    manifest.withColumns({"version": F.lit(version), "description": F.lit(description)}).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def render_report(metrics: DataFrame, manifest: dict) -> dict:
    """A nested report of a tidy metric table (strategy, metric, value): small by nature, so made on the driver."""
    out: dict = dict(manifest) | {"strategies": {}}
    for row in metrics.orderBy("strategy", "metric").collect():
        out["strategies"].setdefault(row["strategy"], {})[row["metric"]] = row["value"]
    return out


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_run(report: DataFrame, answers: DataFrame, path: str) -> tuple[str, bool]:
    """A generation run's report, and beside it its answers, a row for each query: the run's id, and whether the answers could be written.

    The report carries the run's stamps in UTC. Answers are a help to readers: if their write fails, the report stays.
    """
    spark = report.sparkSession
    stamps = spark.range(1).select(*(c.alias(n) for n, c in utc_stamps(F.current_timestamp()).items())).first()
    folder = f"{path}/run={stamps['run_id']}"
    report.withColumns({n: F.lit(stamps[n]) for n in ("captured_at", "run_day")}).write.mode("overwrite").json(f"{folder}/report")
    try:
        answers.write.mode("overwrite").json(f"{folder}/answers")
    except Exception as error:  # noqa: BLE001
        print(f"the answers of {folder} were not written: {error}")
        return stamps["run_id"], False
    return stamps["run_id"], True


def filter_markdown(reasons: DataFrame, totals: dict[str, int]) -> str:
    """What filters kept and why they dropped the rest, reasons in alphabetical order."""
    lines = ["# Filter report", ""] + [f"- {name}: {n}" for name, n in totals.items()] + ["", "| reason | n |", "|---|---:|"]
    return "\n".join([*lines, *(f"| {r['drop_reason']} | {r['n']} |" for r in reasons.orderBy("drop_reason").collect())]) + "\n"


def preview_markdown(pool: DataFrame, n: int = 30, key: str = "row_id") -> str:
    """About n queries of a pool for review, kinds by falling count; each with the three documents first retrieved and its seed.

    Reads `key`, query, question_type, retrieved_chunks, and seed_topic and seed_chunks if there are any.
    """
    sizes = {r["question_type"]: r["count"] for r in pool.groupBy("question_type").count().collect()}
    if not sizes:
        return "# Pool preview: 0 of 0\n"
    topic = F.col("seed_topic") if "seed_topic" in pool.columns else F.lit(None).cast("string")
    chunk = F.get("seed_chunks", F.lit(0))["doc_id"] if "seed_chunks" in pool.columns else F.lit(None).cast("string")
    shown = preview(pool.where(F.col("question_type").isNotNull()), n, "question_type", key).orderBy(key)
    rows = shown.select("question_type", "query", F.transform(F.slice("retrieved_chunks", 1, 3), lambda c: c["doc_id"]).alias("docs"), topic.alias("topic"), chunk.alias("chunk")).collect()
    lines = [f"# Pool preview: {len(rows)} of {sum(sizes.values())}"]
    for kind in sorted((k for k in sizes if k is not None), key=lambda k: (-sizes[k], k)):
        of_kind = [r for r in rows if r["question_type"] == kind]
        lines += ["", f"## {kind}: {len(of_kind)} of {sizes[kind]}"]
        for r in of_kind:
            seed = f"topic {r['topic']}" if r["topic"] else f"chunk of {r['chunk']}" if r["chunk"] else "none"
            lines += ["", f"* {r['query']}", f"  - retrieved: {', '.join(map(str, r['docs'] or [])) or 'nothing'}", f"  - seed: {seed}"]
    return "\n".join(lines) + "\n"
