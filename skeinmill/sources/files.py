"""Readers: markdown trees, JSON and JSON lines with explicit schemas, persisted chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinmill.functions.text import strip
from skeinmill.lineage import cut

_FRONT = r"(?s)\A---\s*\n(.*?\n)---\s*\n"


def frontmatter(raw: Column) -> tuple[Column, Column]:
    """(rest of the text, map of the keys): lines with a colon between two --- lines; a later key wins."""
    block = F.regexp_extract(raw, _FRONT, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    keys = F.transform(lines, lambda x: strip(F.substring_index(x, ":", 1)))
    values = F.transform(lines, lambda x: strip(F.substr(x, F.locate(":", x) + 1)))
    # Of equal keys the last one stays, whatever the session says of duplicate map keys.
    last = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i)))
    pairs = F.transform(last, lambda i: F.struct(F.get(keys, i).alias("k"), F.get(values, i).alias("v")))
    meta = F.when(F.size(lines) > 0, F.map_from_entries(pairs)).otherwise(F.expr("cast(map() as map<string,string>)"))
    return F.regexp_replace(raw, _FRONT, ""), meta


def title_of(content: Column) -> Column:
    """The first line that is a first-level heading, else null."""
    lines = F.filter(F.transform(F.split(content, r"\r\n|\n|\r"), strip), lambda x: x.startswith("# "))
    return F.when(F.size(lines) > 0, strip(F.regexp_replace(F.get(lines, F.lit(0)), "^[# ]+", "")))


def parse_documents(raw: DataFrame) -> DataFrame:
    """(doc_id, source, title, content, metadata) of (source, raw); empty contents go; the frontmatter overrides."""
    rest, meta = frontmatter(F.col("raw"))
    rows = raw.select("source", strip(rest).alias("content"), meta.alias("front")).where("content != ''")
    title = F.coalesce(F.nullif(F.try_element_at("front", F.lit("title")), F.lit("")), F.nullif(title_of(F.col("content")), F.lit("")), F.col("source"))
    rows = rows.withColumn("base", F.create_map(F.lit("doc_id"), F.col("source"), F.lit("title"), title))
    merged = F.map_concat(F.map_filter("base", lambda k, v: ~F.map_contains_key(F.col("front"), k)), F.col("front"))
    return rows.select(F.try_element_at(merged, F.lit("doc_id")).alias("doc_id"), "source", F.try_element_at(merged, F.lit("title")).alias("title"), "content", merged.alias("metadata"))


def read_markdown(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of all *.md files under a directory; a missing directory is Spark's own error."""
    files = spark.read.text(directory, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    base = F.lit(directory.rstrip("/") + "/")
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    return parse_documents(files.select(F.replace(path, base, F.lit("")).alias("source"), F.col("value").alias("raw")))


def with_positions(chunks: DataFrame) -> DataFrame:
    """Adds pos: corpus order, by path components and then chunk index.

    Rows are sorted by ranges and numbered within each; only the size of each range is summed up in one place.
    """
    ranged = chunks.withColumn("_path", F.split("doc_id", "/")).orderBy("_path", "chunk_index").drop("_path")
    ranged = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))
    low = F.lit(1 << 33)
    ranged = ranged.withColumns({"_range": F.floor(F.col("_id") / low), "_at": F.col("_id") % low})
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(starts), "_range").withColumn("pos", F.col("_start") + F.col("_at")).drop("_range", "_start", "_at", "_id")


CHUNK_REF = "array<struct<doc_id:string,chunk_id:string,score:double,text:string>>"
EXAMPLE = f"struct<query:string,retrieved_chunks:{CHUNK_REF},ideal_answer:string,is_refusal:boolean>"
INPUT = f"query string, expected_refusal boolean, note string, retrieved_chunks {CHUNK_REF}"
SEED_CATEGORIES = ["general_cs", "adjacent_ml", "unrelated"]


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with line, their number within a file; blank and broken lines are skipped."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).where(strip("value") != "").withColumn("line", F.monotonically_increasing_id())
    parsed = raw.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.try_parse_json("value").isNotNull())
    return parsed.select("row.*", "line")


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: Column | str) -> DataFrame:
    """The last whole row of each key in files of JSON lines; blank and broken lines and rows without a key are skipped.

    Later is what has the greater batch number in its path, then the later file by name, then the later line;
    files outside of a batch come first.
    """
    batch = F.coalesce(F.regexp_extract("_metadata.file_path", r"/batch=([0-9]+)/", 1).try_cast("long"), F.lit(-1).cast("long")).alias("batch")
    at = F.struct(batch, F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")).alias("at")
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", at).where(F.try_parse_json("value").isNotNull())
    rows = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"), "at").select("row", "at", "row.*")
    rows = rows.select("row", "at", (F.col(key) if isinstance(key, str) else key).alias("key")).where("key is not null")
    return rows.groupBy("key").agg(F.max_by("row", "at").alias("row")).select("row.*")


def read_task_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of (task_key, …) with the kind and the identifier that a key holds, parted at the first '::'."""
    rows = read_lines(spark, path, schema)
    return rows.withColumns({"task_type": F.substring_index("task_key", "::", 1), "identifier": F.when(F.locate("::", F.col("task_key")) > 0, F.substr("task_key", F.locate("::", F.col("task_key")) + 2))})


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Inputs to distil, from a JSON array or, if the name says so, JSON lines; absent fields get defaults."""
    rows = spark.read.schema(INPUT).json(path) if path.endswith(".jsonl") else spark.read.schema(INPUT).option("multiLine", True).json(path)
    return rows.fillna({"expected_refusal": False, "note": ""})


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """The examples of a dataset file."""
    whole = spark.read.schema(f"examples array<{EXAMPLE}>, version string").option("multiLine", True).json(path)
    return whole.select("version", F.explode("examples").alias("e")).select("e.*", "version")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Refusal seeds (id, category, topic, notes, valid)."""
    whole = spark.read.schema("version string, seeds array<struct<id:string,category:string,topic:string,notes:string>>").option("multiLine", True).json(path)
    rows = whole.select(F.explode("seeds").alias("s")).select("s.*")
    return rows.withColumn("valid", F.coalesce((F.length("id") > 0) & (F.length("topic") > 0) & F.col("category").isin(SEED_CATEGORIES), F.lit(False)))


def read_eval_set(spark: SparkSession, path: str, name: str, no_answer: bool = False) -> DataFrame:
    """(query_id, query, prefixes, is_no_answer) of a JSON array of {query, relevant}."""
    rows = spark.read.schema("query string, relevant array<string>").option("multiLine", True).json(path).withColumn("_at", F.monotonically_increasing_id())
    number = F.row_number().over(Window.orderBy("_at")) - 1
    return rows.select(F.format_string(f"{name}_%03d", number).alias("query_id"), "query", F.coalesce("relevant", F.expr("cast(array() as array<string>)")).alias("prefixes"), F.lit(no_answer).alias("is_no_answer"))


def read_chunks(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """Persisted chunks; a strategy reads its own partition only."""
    rows = spark.read.parquet(path)
    return rows if strategy is None else rows.where(F.col("strategy") == strategy)
