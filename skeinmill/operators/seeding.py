"""Query pools: classification of chunks, quota samples, filters, duplicates, contamination, refusals.

Samples are ordered by md5 of seed and key, so that they're the same on any cluster and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinmill.functions.text import family, has_shape, hash_order, headings, query_of, question_types, words
from skeinmill.functions.vectors import normalize
from skeinmill.lineage import cut
from skeinmill.operators.numbering import hash_cut, numbered
from skeinmill.operators.retrieval import after_similar, similar_pairs

QUOTAS = {"procedural": 240, "comparison": 160, "best_practice": 160, "pointer": 120}
MIN_WORDS, DUPLICATE, CONTAMINATED = 5, 0.85, 0.7
#: Undecided pairs that the driver decides at most; more go by rounds over tables.
DRIVER_PAIRS = 200_000


def classify(chunks: DataFrame) -> DataFrame:
    """A row for each chunk and kind of question it has affinity for."""
    return chunks.withColumn("question_type", F.explode(question_types("text")))


def sample(rows: DataFrame, n: int, seed: int, key: str, by: list[str] | None = None) -> DataFrame:
    """n rows of each group without replacement, all of them if there are no more."""
    if not by:
        return rows.orderBy(hash_order(seed, key), key).limit(n)
    return hash_cut(rows, by, F.lit(n), key, seed)


def quota_sample(rows: DataFrame, quotas: dict[str, int] | None = None, seed: int = 42, key: str = "chunk_id", by: str = "question_type") -> DataFrame:
    """As many rows of each kind as its quota says; kinds without one give none."""
    quotas = QUOTAS if quotas is None else quotas
    quota = F.lit(0)
    for kind, n in quotas.items():
        quota = F.when(F.col(by) == kind, F.lit(n)).otherwise(quota)
    return hash_cut(rows.where(F.col(by).isin(list(quotas))), [by], quota, key, seed)


def preview(rows: DataFrame, n: int, by: str, key: str, seed: int = 42) -> DataFrame:
    """About n rows, each kind by its share, one of each at least."""
    counts = rows.groupBy(by).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_total"))
    quota = F.least(F.col("_c"), F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_c") / F.col("_total"))))
    quotas = counts.withColumn("_total", F.lit(total.first()[0])).select(by, quota.alias("_quota"))
    return hash_cut(rows.join(quotas, by), [by], F.col("_quota"), key, seed).select(*rows.columns)


def structural_queries(docs: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """(query_id, query, prefixes): the longest meaningful heading of n sampled documents, each relevant to its own."""
    found = docs.select("doc_id", F.posexplode(headings("content")).alias("at", "heading"))
    longest = found.groupBy("doc_id").agg(F.min(F.struct((-F.length("heading")).alias("size"), "at", "heading")).alias("h"))
    chosen = sample(longest.select("doc_id", F.col("h.heading").alias("query")), n, seed, "doc_id")
    number = F.row_number().over(Window.orderBy(hash_order(seed, "doc_id"), "doc_id"))
    return chosen.select(F.format_string("structural_%03d", number).alias("query_id"), "query", F.array("doc_id").alias("prefixes"))


def drop_reason(rows: DataFrame, reason: Column) -> DataFrame:
    """The first reason that's given for a row stays."""
    return rows.withColumn("drop_reason", F.coalesce("drop_reason", reason) if "drop_reason" in rows.columns else reason)


def filter_length(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return drop_reason(rows, F.when(F.size(words("query")) < min_words, F.lit(f"length<{min_words}_words")))


def filter_shape(rows: DataFrame) -> DataFrame:
    return drop_reason(rows, F.when(~has_shape("query", "question_type"), F.concat(F.lit("type_mismatch_"), F.col("question_type"))))


def filter_duplicates(rows: DataFrame, threshold: float = DUPLICATE, key: str = "row_id", vector: str = "embedding", kind: str = "question_type", driver_pairs: int = DRIVER_PAIRS) -> DataFrame:
    """Marks rows too similar to an earlier kept one of their kind, in order of key.

    Keeping goes by rounds: an undecided row without undecided earlier neighbours is kept and its later
    neighbours are dropped. While a round decides half of the undecided rows at least, rounds find rows alone
    and make no pairs, so that a large group of copies costs a row each. Of what is left then pairs are made, and
    further rounds go over these, until no pair is undecided. Each round decides the first row of every chain at
    least, so rounds end. Once `driver_pairs` pairs or fewer are undecided the driver decides them in one pass.
    Rows without a key, a kind or a vector stay.
    """
    live = rows.where("drop_reason is null") if "drop_reason" in rows.columns else rows
    unit = live.where(F.col(key).isNotNull()).select(key, kind, normalize(F.col(vector)).alias("v"))
    dropped = unit.sparkSession.createDataFrame([], unit.select(F.col(key).alias("b")).schema)
    while True:
        later = cut(after_similar(unit, unit, threshold, key, "v", kind).withColumnRenamed("b", key))
        n_later = later.count()
        if not n_later:
            break
        gone = cut(after_similar(unit.join(later, key, "left_anti"), unit.join(later, key, "left_semi"), threshold, key, "v", kind))
        dropped = dropped.union(gone)
        left = later.join(gone.withColumnRenamed("b", key), key, "left_anti")
        n_left = left.count()
        unit = unit.join(left, key, "left_semi")
        if not n_left or 2 * n_left > n_later:
            break
        unit = cut(unit)
    open_ = cut(similar_pairs(unit, unit, threshold, key, "v", kind).where("a < b").select("a", "b")) if n_later and n_left else dropped.selectExpr("b as a", "b").limit(0)
    while n_open := open_.count():
        if n_open <= driver_pairs:
            dropped = dropped.union(open_.sparkSession.createDataFrame(_later_copies(open_), dropped.schema))
            break
        first = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        gone = cut(open_.join(first, "a", "left_semi").select("b").distinct())
        dropped = cut(dropped.union(gone))
        open_ = cut(open_.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"))
    marked = rows.join(dropped.withColumnRenamed("b", key).withColumn("_dup", F.lit(True)), key, "left")
    return drop_reason(marked, F.when(F.col("_dup"), F.concat(F.lit("duplicate_within_"), F.col(kind).cast("string")))).drop("_dup")


def _later_copies(pairs: DataFrame) -> list[tuple]:
    """The rows that the greedy rule drops, of few pairs; each pair's first row is decided before its second one's turn."""
    gone, copy = set(), False
    ordered = pairs.orderBy("b").collect()
    for i, (a, b) in enumerate(ordered):
        copy = copy or a not in gone
        if i + 1 == len(ordered) or ordered[i + 1].b != b:
            if copy:
                gone.add(b)
            copy = False
    return [(b,) for b in gone]


def filter_contamination(rows: DataFrame, evals: DataFrame, threshold: float = CONTAMINATED, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """Marks rows whose greatest similarity to an evaluation query is over the threshold; without queries all stay."""
    left = rows.select(key, normalize(F.col(vector)).alias("v"))
    right = evals.select(F.lit(0).alias(key), normalize(F.col(vector)).alias("v"))
    worst = similar_pairs(left, right, threshold, key, "v").groupBy("a").agg(F.max("sim").alias("sim"))
    marked = rows.join(worst.withColumnRenamed("a", key), key, "left")
    return drop_reason(marked, F.when(F.col("sim").isNotNull(), F.concat(F.lit("eval_contamination_sim="), F.format_string("%.3f", "sim")))).drop("sim")


def reasons(rows: DataFrame) -> DataFrame:
    """How many rows each reason dropped."""
    return rows.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


def funnel(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.count("drop_reason").alias("dropped"))


def mismatched_refusals(queries: DataFrame, chunks: DataFrame, n: int = 40, n_chunks: int = 5, seed: int = 42) -> DataFrame:
    """n sampled queries with chunks of other document families each, as refusals to be learned.

    Reads (query_id, query, seed_doc_id) and (chunk_id, doc_id, text). For each query families are drawn
    by hash, evenly whatever their size, and a chunk of each by another; duplicates may occur.
    """
    chosen = sample(queries.where("seed_doc_id is not null"), n, seed, "query_id").withColumn("own", family("seed_doc_id"))
    pool = numbered(chunks.select(family("doc_id").alias("fam"), "chunk_id"), "fam", "chunk_id").withColumn("at", F.col("place") - 1)
    families = pool.groupBy("fam").agg(F.count("*").alias("size")).withColumn("f", F.row_number().over(Window.orderBy("fam")) - 1)
    n_families = families.agg(F.count("*").alias("nf"))
    draw = lambda tag, m: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), F.col("query_id").cast("string"), F.col("slot").cast("string"))), 1, 12), 16, 10).cast("long"), m)
    slots = chosen.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).join(F.broadcast(n_families)).join(families.select(F.col("fam").alias("own"), F.col("f").alias("own_f")), "own", "left")
    # One of the other families: places from the own one on move up by one.
    others = F.when(F.col("own_f").isNull(), F.col("nf")).otherwise(F.col("nf") - 1)
    picked = draw("f", F.nullif(others, F.lit(0)))
    slots = slots.withColumn("f", F.when(F.col("own_f").isNotNull() & (picked >= F.col("own_f")), picked + 1).otherwise(picked))
    drawn = slots.join(families, "f").withColumn("at", draw("c", F.col("size"))).select("query_id", "query", "slot", "fam", "at")
    got = drawn.join(pool.select("fam", "at", "chunk_id"), ["fam", "at"]).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    chunk = F.struct("slot", F.col("doc_id").alias("doc_id"), F.col("chunk_id").alias("chunk_id"), F.lit(0.0).alias("score"), "text")
    gathered = got.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(chunk)).alias("cs"))
    return gathered.select("query_id", "query", F.transform("cs", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["chunk_id"].alias("chunk_id"), c["score"].alias("score"), c["text"].alias("text"))).alias("retrieved_chunks"), F.lit("refusal").alias("question_type"))


def open_tasks(tasks: DataFrame, done: DataFrame, key: str = "task_key") -> DataFrame:
    """Tasks that aren't done yet."""
    return tasks.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def refusal_tasks(seeds: DataFrame, per_seed: int = 3) -> DataFrame:
    """(task_key, id, topic): a task for each seed and repetition."""
    rows = seeds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_seed - 1))))
    return rows.select(F.concat(F.lit("refusal::"), F.col("id"), F.lit("::"), F.col("i").cast("string")).alias("task_key"), "id", "topic")


def corpus_tasks(chunks: DataFrame, quotas: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """(task_key, chunk_id, question_type): a task for each chunk that is sampled for a kind of question it has affinity for."""
    chosen = quota_sample(chunks, quotas, seed)
    return chosen.select(F.concat_ws("::", "question_type", "chunk_id").alias("task_key"), "chunk_id", "question_type")


def parsed_queries(rows: DataFrame) -> DataFrame:
    """Adds query, expected_refusal and failed to models' outputs (response, question_type): outputs without a query
    fail, and so does a query made for a chunk as a refusal, because refusals are made for topics; failures are kept to be counted."""
    parsed = query_of("response")
    misplaced = (F.col("question_type") == "refusal") & F.col("chunk_id").isNotNull()
    return rows.withColumns({"query": F.when(~misplaced, parsed), "expected_refusal": F.col("question_type") == "refusal", "failed": parsed.isNull() | misplaced})


def pool_of(generated: DataFrame, synthesized: DataFrame) -> DataFrame:
    """(query, question_type, expected_refusal, retrieved_chunks) of kept generated queries and of synthesized refusals."""
    live = generated.where("drop_reason is null") if "drop_reason" in generated.columns else generated
    rows = [x.select("query", "question_type", (F.col("question_type") == "refusal").alias("expected_refusal"), "retrieved_chunks") for x in (live, synthesized)]
    return rows[0].unionByName(rows[1])


def cost(input_tokens: Column, output_tokens: Column, model: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Price of a call by tokens in millions; null for a model without one."""
    out = F.lit(None).cast("double")
    for name, (read, written) in prices.items():
        out = F.when(model == name, (input_tokens * read + output_tokens * written) / 1e6).otherwise(out)
    return out


def retrieved_or_seeds(rows: DataFrame) -> DataFrame:
    """Adds retrieved_chunks: what was retrieved, but the seeds of refusals made by pairing with chunks that don't fit."""
    paired = F.coalesce(F.try_element_at("metadata", F.lit("synthesis_method")) == "retrieval_failure_pairing", F.lit(False))
    return rows.withColumn("retrieved_chunks", F.when(paired, F.col("seed_chunks")).otherwise(F.col("retrieved")))
