"""Retrieval metrics, their means, deltas against a baseline, and report aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KS = [1, 3, 5, 10]
ANCHORS = [0.0, 0.25, 0.5, 0.75, 1.0]


def dedupe(results: DataFrame, item: str = "doc_id") -> DataFrame:
    """(query_id, item, rank): each item once, where it stood first, ranked anew."""
    first = results.groupBy("query_id", item).agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", item))).drop("first")


def relevant_by_prefix(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose id begins with one of the query's prefixes; all beginnings of an id are joined by equality."""
    ids = docs.select("doc_id").distinct().withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.length("doc_id")), lambda n: F.left("doc_id", n))))
    return ids.join(queries.select("query_id", F.explode("prefixes").alias("start")), "start").select("query_id", "doc_id").distinct()


def first_queries(queries: DataFrame, limit: int | None, order: str = "query_id") -> DataFrame:
    """The first queries of an evaluation set for a trial run, or all of them without a limit."""
    return queries if limit is None else queries.orderBy(order).limit(limit)


def per_query(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """One row for each query, with results or not: mrr, hit_rate_top_5 and, for each k, precision, recall and nDCG.

    Precision divides by k even if fewer were found; recall and nDCG without relevant documents are 0.
    """
    ks = KS if ks is None else ks
    judged = ranked.join(relevant.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left").where("hit")
    sums = [F.min("rank").alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        sums += [F.count_if(inside).alias(f"hits_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}")]
    hits = judged.groupBy("query_id").agg(*sums)
    counts = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    rows = queries.select("query_id").distinct().join(hits, "query_id", "left").join(counts, "query_id", "left")
    out = [F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce((F.col("first") <= 5).cast("double"), F.lit(0.0)).alias("hit_rate_top_5")]
    for k in ks:
        if k <= 0:
            out += [F.lit(0.0).alias(f"{m}_at_{k}") for m in ("precision", "recall", "ndcg")]
            continue
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [
            (F.coalesce(f"hits_{k}", F.lit(0)) / k).cast("double").alias(f"precision_at_{k}"),
            F.coalesce(F.col(f"hits_{k}") / F.col("n_relevant"), F.lit(0.0)).alias(f"recall_at_{k}"),
            F.coalesce(F.col(f"dcg_{k}") / ideal, F.lit(0.0)).alias(f"ndcg_at_{k}"),
        ]
    return rows.select("query_id", *out)


def means(by_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every metric over queries, in one tidy table (by..., metric, value, n)."""
    keys = [*(by or []), "query_id"]
    names = [c for c in by_query.columns if c not in keys]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))).alias("m")
    return by_query.select(*(by or []), pairs).groupBy(*(by or []), "m.metric").agg(F.round(F.avg("m.value"), 6).alias("value"), F.count("*").alias("n"))


def delta(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Current value, baseline and difference of the metrics that both have."""
    return current.join(baseline.select(*keys, F.col("value").alias("base")), keys).select(*keys, "value", "base", F.round(F.col("value") - F.col("base"), 6).alias("delta"))


def delta_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Markdown table lines of a delta table: value and signed difference to three places."""
    cells = [F.concat(F.lit("| "), F.concat_ws(" | ", *keys), F.lit(" | "), F.format_string("%.3f", "value"), F.lit(" | "), F.format_string("%+.3f", "delta"), F.lit(" |")).alias("line")]
    return rows.select(*keys, *cells)


#: Values of a group that one aggregate sorts at most; larger groups are narrowed first, by so many quantiles of a sketch.
GROUP_VALUES, SPLITS = 100_000, 1000
_POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def percentiles(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p50, p95, p99 and mean to two places, and n; a group without values has zeros.

    Percentiles are exact, between the two values around their place. Groups of up to GROUP_VALUES values are sorted in
    one aggregate each; of larger ones, which are few as counted, the values at the places asked for are selected.
    """
    by = by or []
    of = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.lit(0).alias("all"))
    own = rows.select(*by, F.col(value).cast("double").alias("_v"), of.alias("_of"))
    sizes = own.groupBy("_of").agg(F.count("_v").alias("_n")).where(F.col("_n") > GROUP_VALUES)
    large = {r["_of"]: r["_n"] for r in sizes.collect()}
    schema = T.StructType([sizes.schema["_of"], *(T.StructField(f"_{name}", T.DoubleType()) for name in _POINTS)])
    places = {(key, p * (n - 1)) for key, n in large.items() for p in _POINTS.values()}
    found = _selected(own, {(key, at) for key, place in places for at in (int(place), min(int(place) + 1, large[key] - 1))}, large, sizes.schema["_of"])

    def between(key: Row, p: float) -> float:
        place = p * (large[key] - 1)
        a, b = found[key, int(place)], found[key, min(int(place) + 1, large[key] - 1)]
        return a + (b - a) * (place - int(place)) if a != b else a

    known = F.broadcast(rows.sparkSession.createDataFrame([(key, *(between(key, p) for p in _POINTS.values())) for key in large], schema))
    # Values of large groups aren't gathered: theirs are known.
    marked = own.join(known, "_of", "left").withColumn("_few", F.when(F.col("_p50").isNull(), F.col("_v")))
    points = [F.coalesce(F.round(F.coalesce(F.first(f"_{name}"), F.percentile("_few", F.lit(p))), 2), F.lit(0.0)).alias(name) for name, p in _POINTS.items()]
    return marked.groupBy(*by).agg(*points, F.coalesce(F.round(F.avg("_v"), 2), F.lit(0.0)).alias("mean"), F.count("_v").alias("n"))


def _selected(rows: DataFrame, asked: set[tuple[Row, int]], sizes: dict[Row, int], of: T.StructField) -> dict[tuple[Row, int], float]:
    """{(group, place): value} for places, from 0, in the order of the groups' values, nulls left out; rows are (_of, _v).

    What is known of a place is an open range that holds it, with how many values lie before and in it. Each pass takes
    quantiles of the range's values from a sketch, and counts the values before, at and between the two around the place: the
    place's value is one of these two, or lies in a range of about one in SPLITS. What is right doesn't rest on the sketch.
    """
    spark, number = rows.sparkSession, T.DoubleType()
    state: dict[tuple[Row, int], tuple] = {(key, at): (None, None, 0, sizes[key]) for key, at in asked}
    out: dict[tuple[Row, int], float] = {}
    within = (F.col("low").isNull() | (F.col("_v") > F.col("low"))) & (F.col("high").isNull() | (F.col("_v") < F.col("high")))

    def held(given: list[tuple], *names: str) -> DataFrame:
        """Values in ranges (group, low, high, and columns named)."""
        ranges = spark.createDataFrame(given, T.StructType([of, T.StructField("low", number), T.StructField("high", number), *(T.StructField(n, T.LongType() if n == "at" else number) for n in names)]))
        return rows.where("_v is not null").join(F.broadcast(ranges), "_of").where(within)

    while wide := [k for k, (*_, n) in state.items() if n > GROUP_VALUES]:
        ranges = sorted({(k[0], *state[k][:2]) for k in wide}, key=repr)
        shares = [i / SPLITS for i in range(SPLITS + 1)]
        quantiles = {(r["_of"], r["low"], r["high"]): r["q"] for r in held(ranges).groupBy("_of", "low", "high").agg(F.percentile_approx("_v", shares, 10 * SPLITS).alias("q")).collect()}
        given = []
        for key, at in wide:
            low, high, before, n = state[key, at]
            i = int((at - before) / n * SPLITS)
            q = quantiles[key, low, high]
            given.append((key, low, high, at, q[max(0, i - 1)], q[min(SPLITS, i + 2)]))
        a, b = F.col("_v") < F.col("a"), F.col("_v") < F.col("b")
        counts = [F.count_if(a).alias("under"), F.count_if(F.col("_v") == F.col("a")).alias("at_a"), F.count_if((F.col("_v") > F.col("a")) & b).alias("between"), F.count_if((F.col("_v") == F.col("b")) & (F.col("a") != F.col("b"))).alias("at_b")]
        for r in held(given, "at", "a", "b").groupBy("_of", "at", "a", "b").agg(*counts).collect():
            k = (r["_of"], r["at"])
            low, high, before, n = state[k]
            edges = [before]
            for c in ("under", "at_a", "between", "at_b"):
                edges.append(edges[-1] + r[c])
            part = sum(r["at"] >= e for e in edges[1:])
            if part in (1, 3):
                out[k] = r["a"] if part == 1 else r["b"]
                del state[k]
            else:
                bounds = {0: (low, r["a"]), 2: (r["a"], r["b"]), 4: (r["b"], high)}[part]
                state[k] = (*bounds, edges[part], (before + n if part == 4 else edges[part + 1]) - edges[part])
    if state:
        given = [(key, low, high, at) for (key, at), (low, high, *_) in state.items()]
        for r in held(given, "at").groupBy("_of", "at").agg(F.sort_array(F.collect_list("_v")).alias("vs")).collect():
            out[r["_of"], r["at"]] = r["vs"][r["at"] - state[r["_of"], r["at"]][2]]
    return out


def relevance_report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Summary of (score, rationale): n, mean, median, a count for each anchor, parse failures."""
    counts = [F.count_if(F.col("score") == a).alias(f"anchor_{int(a * 100):03d}") for a in ANCHORS]
    return rows.where("score is not null").groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"), F.round(F.median("score"), 3).alias("median"), *counts, F.count_if(F.col("rationale").contains("PARSE_FAILED")).alias("n_parse_failures")
    )


def faithfulness_report(rows: DataFrame) -> DataFrame:
    """Summary of (score, rationale, attributions): scores by bucket, claims, their support, failures."""
    s = F.col("score")
    inner = [("b_0", s == 0), ("b_0_25", (s > 0) & (s < 0.25)), ("b_25_50", (s >= 0.25) & (s < 0.5)), ("b_50_75", (s >= 0.5) & (s < 0.75)), ("b_75_100", (s >= 0.75) & (s < 1)), ("b_1", s == 1)]
    claims = F.col("attributions")
    has = lambda word: F.size(F.filter(claims, lambda a: F.coalesce(a["rationale"].contains(word), F.lit(False))))
    supported = F.size(F.filter(claims, lambda a: a["supporting_chunk_idx"].isNotNull()))
    rows = rows.where("score is not null").withColumns({"n_claims": F.size(claims), "n_supported": supported, "n_failed": has("PARSE_FAILED"), "n_out": has("OUT_OF_RANGE")})
    total = F.sum("n_claims")
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg(s), 3).alias("mean"), F.round(F.median(s), 3).alias("median"), F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 3).alias("stdev"),
        F.round(F.min(s), 3).alias("min"), F.round(F.max(s), 3).alias("max"), *(F.count_if(test).alias(name) for name, test in inner),
        total.alias("total_claims"), F.sum("n_supported").alias("total_supported"), F.round(F.coalesce(F.sum("n_supported") / F.nullif(total, F.lit(0)), F.lit(0.0)), 3).alias("support_rate"),
        F.round(F.avg("n_claims"), 2).alias("claims_per_answer"), F.max("n_claims").alias("max_claims"), F.count_if(F.col("rationale").contains("NO_CLAIMS_EXTRACTED")).alias("n_no_claims"),
        F.count_if(F.col("rationale").contains("PARSE_FAILED")).alias("n_score_failures"), F.sum("n_failed").alias("n_claim_failures"), F.sum("n_out").alias("n_out_of_range"),
    )


def chunk_usage(rows: DataFrame) -> DataFrame:
    """How many claims each chunk number supports, 'none' for those without one."""
    claims = rows.where("score is not null").select(F.explode("attributions").alias("a"))
    return claims.groupBy(F.coalesce(F.col("a.supporting_chunk_idx").cast("string"), F.lit("none")).alias("chunk")).agg(F.count("*").alias("n"))


def refusal_report(rows: DataFrame) -> DataFrame:
    """Summary of (query_id, rule_refused, judge_refused or null, judge_rationale), with the ids of all that `disagreements` gives, in order.

    Without a verdict of the judge a row counts as not refused, but isn't named as a disagreement.
    """
    judge = F.coalesce("judge_refused", F.lit(False))
    agree = judge == F.col("rule_refused")
    numbers = rows.agg(
        F.count("*").alias("n"), F.round(F.avg(judge.cast("double")), 3).alias("frac_refused_judge"), F.round(F.avg(F.col("rule_refused").cast("double")), 3).alias("frac_refused_rule"),
        F.round(F.avg(agree.cast("double")), 3).alias("agreement_rate"), F.count_if(~agree).alias("n_disagreements"),
        F.count_if(F.coalesce(F.col("judge_rationale").contains("PARSE_FAILED"), F.lit(False))).alias("n_judge_failures"),
    )
    named = _in_order(disagreements(rows), "query_id").withColumnRenamed("all", "disagreement_ids")
    return numbers.crossJoin(named).select(*numbers.columns[:-1], "disagreement_ids", "n_judge_failures")


def _in_order(rows: DataFrame, column: str) -> DataFrame:
    """One row with a column's values in order, comma-joined, as `all`: ranges are sorted and joined by tasks of their own, and put one after the other."""
    ranged = rows.select(F.col(column).cast("string").alias("v")).repartitionByRange("v").select(F.spark_partition_id().alias("range"), "v")
    parts = ranged.groupBy("range").agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("part"))
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "part"))), lambda r: r["part"]), ",").alias("all"))


def disagreements(rows: DataFrame) -> DataFrame:
    """(query_id, rule_refused, judge_refused): a row for each answer on which the judge's verdict, if it gave one, isn't the rules'."""
    return rows.where("judge_refused is not null and judge_refused != rule_refused").select("query_id", "rule_refused", "judge_refused")


def citation_report(rows: DataFrame) -> DataFrame:
    """Summary of checked citations (any_marker, all_in_range, n_markers)."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    return rows.agg(F.count("*").alias("n"), share("any_marker").alias("frac_with_any_marker"), share("all_in_range").alias("frac_all_in_range"), F.round(F.avg("n_markers"), 3).alias("mean_n_markers"))


def generation_report(sections: dict[str, DataFrame]) -> DataFrame:
    """One tidy table (section, metric, value) of summaries of one row each; what isn't a number is left out."""
    out = None
    for name, summary in sections.items():
        numbers = [c for c, kind in summary.dtypes if kind in ("bigint", "int", "double")]
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers))).alias("m")
        part = summary.select(F.lit(name).alias("section"), pairs).select("section", "m.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sections")
    return out


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
