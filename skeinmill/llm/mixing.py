"""Mixing sources to target weights by Poisson replication, with built-in functions only.

A source with share w of the target and n of the input's N rows is repeated w * N / n times on average.
Each document's count is the Poisson quantile, with that mean, of a number drawn from a hash of seed and
doc_id; documents are exploded by their count, and the copies sorted by another hash, which shuffles them
globally and alike whatever the partitions were. Nothing is sampled by chance, so a lost task gives the
same rows again.

Means over PART are split into equal parts that are drawn apart and added, which is Poisson again, so that
tables of quantiles stay short.

Defined results: a null source is one more source; sources without a weight, or with weight 0, go;
weights are scaled to sum to 1 over the sources there are; without any the sources get equal ones; rows
with equal doc_id get equal counts, and equal places only if they are the same copy. Columns of any name
are kept; only mix_copy and mix_copies, which the result sets, take the place of a document's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinmill.llm.store import is_small, named

SEED = 7
PART = 32
#: Sources, of 32 MiB of names, whose table of quantiles (1 KB each) is sent to every task at most; more are joined by a shuffle.
TABLE_ROWS = 10_000

#: Poisson(m) as (k, log of its weight, sum of weights so far), from which the cumulative table is kept.
_TABLE = """aggregate(sequence(1, cast(ceil(part + 12 * sqrt(part) + 24) as int)),
  struct(-part as log_weight, exp(-part) as total, array(exp(-part)) as table),
  (a, k) -> named_struct('log_weight', a.log_weight + ln(part) - ln(k), 'total', a.total + exp(a.log_weight + ln(part) - ln(k)),
    'table', concat(a.table, array(a.total + exp(a.log_weight + ln(part) - ln(k))))), a -> a.table)"""


def _uniform(*parts: str) -> str:
    """A number in [0, 1) from the first 52 bits of a digest."""
    return f"cast(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) as double) / 4503599627370496D"


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, rate): mean repetitions of each source's documents."""
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        given = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        counts = counts.join(F.broadcast(given).withColumnRenamed("source", "given"), F.col("source").eqNullSafe(F.col("given"))).where("weight > 0").drop("given")
    totals = counts.agg(F.sum("n").alias("all"), F.sum("weight").alias("weights"))
    if weights is not None:
        whole = docs.count()
    row = totals.first()
    return counts.select("source", (F.col("weight") / F.lit(row["weights"]) * F.lit(row["all"] if weights is None else whole) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, table_rows: int = TABLE_ROWS) -> DataFrame:
    """The documents, all columns, as often as drawn, with mix_copy (from 0) and mix_copies, in shuffled order."""
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_copies")]
    by_source = rates(docs, weights).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("part", F.col("rate") / F.col("parts"))
    by_source = by_source.select(F.col("source").alias("of"), "parts", F.expr(_TABLE).alias("quantiles"))
    few = is_small(by_source, table_rows, "of")
    # The document is one struct, so that no name of its own meets those used here.
    rows = docs.select(F.struct(*named(kept)).alias("row"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("id"))
    rows = rows.join(F.broadcast(by_source) if few else by_source, F.col("source").eqNullSafe(F.col("of")))
    number = _uniform(repr(str(seed)), "id", "p")
    drawn = f"aggregate(sequence(1, parts), 0, (a, p) -> a + transform(array({number}), u -> size(filter(quantiles, c -> c <= u)))[0])"
    rows = rows.select("row", "id", F.expr(drawn).alias("mix_copies")).where("mix_copies > 0")
    rows = rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    place = F.md5(F.concat_ws(":", F.lit(f"{seed}-place"), "id", F.col("mix_copy")))
    return rows.withColumn("place", place).orderBy("place").select(*(F.col("row").getField(c).alias(c) for c in kept), "mix_copy", "mix_copies")


ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM s)) * (SELECT sum(n)::DOUBLE FROM s) / n AS rate FROM s),
p AS (SELECT source, greatest(1, ceil(rate / {PART})::INT) AS parts, rate / greatest(1, ceil(rate / {PART})::INT) AS part FROM r),
t AS (SELECT source, parts, k, sum(exp(k * ln(part) - part - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS total
      FROM (SELECT source, parts, part, unnest(range(0, ceil(part + 12 * sqrt(part) + 24)::INT + 1)) AS k FROM p)),
d AS (SELECT row_number() OVER () AS rn, * FROM documents),
u AS (SELECT rn, source, ('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, chr(0)), q)), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
      FROM (SELECT d.rn, d.source, d.doc_id, unnest(range(1, p.parts + 1)) AS q FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)),
c AS (SELECT u.rn, count(*) AS copies FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source AND t.total <= u.u GROUP BY u.rn)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(0, c.copies))::INT AS mix_copy, c.copies::INT AS mix_copies FROM d JOIN c USING (rn)
"""
