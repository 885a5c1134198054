"""Queries over documents made into markdown: parsing, chunking, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.functions.text import ADVICE_HEADING, ADVICE_TEXT, ANNOTATIONS, CODE_HINT, COMPARISON_TEXT, GENERIC_HEADINGS, POINTER_TEXT, REPL_LINE, chunk_id, headings, question_types
from skeinmill.operators import chunking, seeding
from skeinmill.plans.registry import SQL, query, table
from skeinmill.sources.files import parse_documents, with_positions

#: Markdown made from documents, by the same expression in both engines.
_MD = "concat('# ', source, chr(10), chr(10), '## Section about ', lang, ' texts [[anchor]]', chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10), '## Notes', chr(10), '### Further details of ', source, chr(10), 'Written in ', lang, ' by ', source, '. ', source, ' has no more of it.')"
_ID = "concat_ws('/', lang, source, cast(doc_id as string))"
_SQL_ID = "concat_ws('/', lang, source, doc_id::VARCHAR)"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): texts whose lines are paragraphs."""
    return table(spark, sf_dir, "documents").selectExpr(f"{_ID} as doc_id", "replace(text, chr(10), concat(chr(10), chr(10))) as content")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(f"{_ID} as doc_id", f"{_MD} as content")


SQL_PARAGRAPHS = f"SELECT {_SQL_ID} AS doc_id, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents"
SQL_MARKDOWN = f"SELECT {_SQL_ID} AS doc_id, {_MD} AS content FROM documents"


@query(
    r"""
WITH r AS (SELECT concat('---', chr(10), 'title: ', source, chr(10), 'lang : ', lang, chr(10), 'title: ', source, '-', lang, chr(10), 'no colon', chr(10), '---', chr(10), text) AS raw, doc_id FROM documents)
SELECT concat('p/', doc_id, '.md') AS doc_id, regexp_replace(regexp_replace(regexp_replace(raw, '\A---\s*\n((?s:.)*?\n)---\s*\n', ''), '^\s+', ''), '\s+$', '') AS content,
  regexp_extract(raw, 'title: (\S+-\S+)', 1) AS title, regexp_extract(raw, 'lang : (\S+)', 1) AS lang FROM r
"""
)
def ingest_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "concat('---', chr(10), 'title: ', source, chr(10), 'lang : ', lang, chr(10), 'title: ', source, '-', lang, chr(10), 'no colon', chr(10), '---', chr(10), text)"
    docs = parse_documents(table(spark, sf_dir, "documents").selectExpr("concat('p/', cast(doc_id as string), '.md') as source", f"{raw} as raw"))
    return docs.select("doc_id", "content", "title", F.try_element_at("metadata", F.lit("lang")).alias("lang"))


#: Files whose title is in their first line, nowhere, or in the first of several late headings.
_TITLED = "case doc_id % 3 when 0 then concat(chr(10), '  # # Title ', source, ' ', chr(10), text) when 1 then concat('#', text) else concat(text, chr(10), '## No title', chr(10), '# Late ', lang, chr(10), '# Later') end"


@query(
    rf"""WITH r AS (SELECT concat('p/', doc_id, '.md') AS doc_id, list_filter(list_transform(string_split({_TITLED}, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '# '))[1] AS line FROM documents)
SELECT doc_id, coalesce(nullif(trim(regexp_replace(line, '^[# ]+', '')), ''), doc_id) AS title FROM r"""
)
def ingest_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_documents(table(spark, sf_dir, "documents").selectExpr("concat('p/', cast(doc_id as string), '.md') as source", f"{_TITLED} as raw")).select("doc_id", "title")


#: Headings of every kind: generic, with an anchor, annotations, of another level, short, padded; then the text.
_HEADED = "concat_ws(chr(10), '## Overview', concat('## Loading ', source, ' files fast [[anchor]]'), concat('## Note: about ', lang, ' here'), '### Third level of it', concat('## ', lang, ' x'), concat('##   Padded heading ', source, '  '), '## See also', concat('## ', repeat('word', doc_id % 5), ' of ', lang), text)"


@query(
    rf"""WITH h AS (SELECT {_SQL_ID} AS doc_id, unnest(regexp_extract_all({_HEADED}, '(?m)^##\s+(.+?)(?:\s*\[\[[^\]]+\]\])?\s*$', 1)) AS heading FROM documents)
SELECT doc_id, heading FROM h WHERE lower(trim(heading)) NOT IN ({", ".join(f"'{x}'" for x in GENERIC_HEADINGS)}) AND NOT regexp_matches(lower(trim(heading)), '^({"|".join(ANNOTATIONS)})')
  AND len(list_filter(regexp_split_to_array(heading, '\s+'), lambda x: x <> '')) >= 2 AND length(trim(heading)) >= 12"""
)
def heading_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(f"{_ID} as doc_id", f"{_HEADED} as content").select("doc_id", F.explode(headings("content")).alias("heading"))


@query(
    f"""WITH d AS ({SQL_MARKDOWN}), p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS i FROM d)
SELECT printf('structural_%03d', i) AS query_id, concat('Section about ', split_part(doc_id, '/', 1), ' texts') AS query, doc_id AS prefix FROM p WHERE i <= 30"""
)
def structural_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.structural_queries(markdown(spark, sf_dir)).select("query_id", "query", F.get("prefixes", F.lit(0)).alias("prefix"))


_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def fixed_sql(source: str, size: int, overlap: int) -> str:
    """The fixed chunker over rows (doc_id, content), a window after the other."""
    space = f"strpos(reverse(substr(t, s + 1, {size})), ' ')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_STRIP.format("content")} AS t FROM ({source})),
w AS (
  SELECT doc_id, t, 0 AS start, 0 AS stop, -1 AS last, -1 AS idx, ''::VARCHAR AS piece FROM d WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, s, e, CASE WHEN p <> '' THEN s ELSE last END, CASE WHEN p <> '' THEN idx + 1 ELSE idx END, p FROM (
    SELECT *, {_STRIP.format("substr(t, s + 1, e - s)")} AS p FROM (
      SELECT *, CASE WHEN s + {size} < length(t) AND {space} BETWEEN 1 AND {size - 1} THEN s + {size} - {space} ELSE s + {size} END AS e FROM (
        SELECT *, CASE WHEN idx = -1 AND stop = 0 THEN 0 WHEN stop < length(t) AND {overlap} > 0 THEN greatest(stop - {overlap}, last + 1, start + 1) ELSE stop END AS s FROM w) WHERE s < length(t))))
SELECT doc_id, idx::INT AS chunk_index, piece AS text, start::INT AS char_start FROM w WHERE idx >= 0 AND piece <> ''"""


@query(fixed_sql(SQL_PARAGRAPHS, 512, 64))
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed(paragraphs(spark, sf_dir)).select("doc_id", "chunk_index", "text", "char_start")


def _levels(x: str, level: int, size: int) -> str:
    """SQL for the pieces of x by the separators from a level on."""
    if level == 4:
        return f"list_transform(range(0, ((length({x}) - 1) // {size}) + 1), lambda i4: substr({x}, (i4 * {size} + 1)::INT, {size}))"
    sep = ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"][level]
    p = f"p{level}"
    parts = f"list_filter(list_transform(string_split({x}, {sep}), lambda q{level}: {_STRIP.format(f'q{level}')}), lambda r{level}: r{level} <> '')"
    return f"flatten(list_transform({parts}, lambda {p}: CASE WHEN length({p}) <= {size} THEN [{p}] ELSE {_levels(p, level + 1, size)} END))"


def recursive_sql(source: str, size: int, overlap: int) -> str:
    """The recursive chunker over rows (doc_id, content)."""
    end = f"right(a.now, {overlap})"
    tail = f"(CASE WHEN strpos({end}, ' ') > 1 THEN substr({end}, strpos({end}, ' ') + 1) ELSE {end} END)"
    carried = f"CASE WHEN {overlap} > 0 AND length(a.now) > {overlap} AND length({tail}) + 2 + length(b.now) <= {size} THEN {tail} || chr(10) || chr(10) || b.now ELSE b.now END"
    return f"""
WITH d AS (SELECT doc_id, {_STRIP.format("content")} AS t FROM ({source})),
f AS (SELECT doc_id, CASE WHEN length(t) <= {size} THEN [t] ELSE {_levels("t", 0, size)} END AS fs FROM d WHERE t <> ''),
s AS (SELECT doc_id, list_reduce(list_transform(fs, lambda x: {{'done': []::VARCHAR[], 'now': x}}), lambda a, b: CASE WHEN length(a.now) + 2 + length(b.now) <= {size} THEN {{'done': a.done, 'now': a.now || chr(10) || chr(10) || b.now}}
  ELSE {{'done': list_append(a.done, a.now), 'now': {carried}}} END) AS r FROM f WHERE len(fs) > 0),
c AS (SELECT doc_id, list_append(r.done, r.now) AS cs FROM s)
SELECT doc_id, (unnest(range(1, len(cs) + 1)) - 1)::INT AS chunk_index, unnest(cs) AS text FROM c"""


@query(recursive_sql(SQL_PARAGRAPHS, 512, 64))
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive(paragraphs(spark, sf_dir)).select("doc_id", "chunk_index", "text")


def header_sql(source: str, size: int) -> str:
    """The header chunker over rows (doc_id, content)."""
    return rf"""
WITH d AS (SELECT doc_id, {_STRIP.format("content")} AS t FROM ({source})),
h AS (SELECT doc_id, list_prepend('', regexp_extract_all(t, '(?m)^#{{1,6}}\s+.+$')) AS hs, list_transform(regexp_split_to_array(t, '(?m)^#{{1,6}}\s+.+$'), lambda x: {_STRIP.format("x")}) AS bs FROM d),
s AS (SELECT doc_id, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h, unnest(bs) AS b FROM h),
w AS (SELECT doc_id, i, h, b, {_STRIP.format("CASE WHEN h <> '' THEN h || chr(10) || chr(10) || b ELSE b END")} AS x FROM s),
big AS (SELECT doc_id, i, list_reduce(list_prepend({{'done': []::VARCHAR[], 'now': CASE WHEN h <> '' THEN h || chr(10) || chr(10) ELSE '' END}}, list_transform(list_filter(list_transform(regexp_split_to_array(b, '\n\n+'), lambda q: {_STRIP.format("q")}), lambda q: q <> ''), lambda q: {{'done': []::VARCHAR[], 'now': q}})), lambda a, n:
  CASE WHEN length(CASE WHEN {_STRIP.format("a.now")} <> '' THEN {_STRIP.format("a.now || chr(10) || chr(10) || n.now")} ELSE n.now END) <= {size}
  THEN {{'done': a.done, 'now': CASE WHEN {_STRIP.format("a.now")} <> '' THEN {_STRIP.format("a.now || chr(10) || chr(10) || n.now")} ELSE n.now END}}
  ELSE {{'done': CASE WHEN {_STRIP.format("a.now")} <> '' THEN list_append(a.done, {_STRIP.format("a.now")}) ELSE a.done END, 'now': n.now}} END) AS r FROM w WHERE length(x) > {size}),
c AS (SELECT doc_id, i, [x] AS cs FROM w WHERE x <> '' AND length(x) <= {size} UNION ALL
  SELECT doc_id, i, CASE WHEN {_STRIP.format("r.now")} <> '' THEN list_append(r.done, {_STRIP.format("r.now")}) ELSE r.done END FROM big),
u AS (SELECT doc_id, i, unnest(range(1, len(cs) + 1)) AS j, unnest(cs) AS text FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS chunk_index, text FROM u"""


@query(f"SELECT concat(doc_id, '::chunk_', chunk_index) AS chunk_id, length(text)::INT AS size FROM ({SQL['chunk_fixed']})")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk(paragraphs(spark, sf_dir), ["fixed"])
    return chunks.select(chunk_id("doc_id", "chunk_index").alias("chunk_id"), F.length("text").alias("size"))


@query(header_sql(SQL_MARKDOWN, 512))
def chunk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.header(markdown(spark, sf_dir)).select("doc_id", "chunk_index", "text")


@query(
    f"""SELECT 'fixed' AS strategy, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, max(length(text))::INT AS longest, round(avg(length(text)), 3) AS mean_length FROM ({SQL["chunk_fixed"]})
UNION ALL SELECT 'recursive', count(*), count(DISTINCT doc_id), max(length(text))::INT, round(avg(length(text)), 3) FROM ({SQL["chunk_recursive"]})"""
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk(paragraphs(spark, sf_dir), ["fixed", "recursive"])
    return chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.max(F.length("text")).alias("longest"), F.round(F.avg(F.length("text")), 3).alias("mean_length"))


@query(
    """WITH d AS (SELECT *, string_split(concat_ws('/', lang, source, doc_id::VARCHAR), '/') AS path, doc_id AS n FROM documents)
SELECT concat_ws('/', lang, source, n::VARCHAR) AS doc_id, (row_number() OVER (ORDER BY path) - 1)::BIGINT AS pos FROM d"""
)
def corpus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(paragraphs(spark, sf_dir).withColumn("chunk_index", F.lit(0))).select("doc_id", "pos")


#: Texts with vocabulary of each kind, chosen by doc_id, before the document's own.
_TALK = """concat(case doc_id % 11 when 0 then concat('```python', chr(10), 'x = 1', chr(10), '```') when 1 then 'A versus B, which differ. ' when 2 then 'We recommend that you should be careful. '
 when 3 then 'See the training script for more details. ' when 4 then concat('## Tips', chr(10), 'unlike others, refer to the guide') when 5 then concat('>>> run()', chr(10)) when 6 then 'There are two types, compared to one; a good starting point. '
 when 7 then 'Make sure to read it, which leads to better results. ' when 8 then 'Values should be set; look at the conversion script. ' when 9 then '```bash only once, distinct and preferred ' else 'Plain words only. ' end, source, chr(10), text)"""


@query(
    rf"""WITH t AS (SELECT doc_id, {_TALK} AS x FROM documents)
SELECT doc_id, unnest(list_filter([
  CASE WHEN len(regexp_extract_all(x, '```')) >= 2 OR regexp_matches(x, '{CODE_HINT}') OR regexp_matches(x, '{REPL_LINE}') THEN 'procedural' END,
  CASE WHEN regexp_matches(x, '{COMPARISON_TEXT}') THEN 'comparison' END,
  CASE WHEN regexp_matches(x, '{ADVICE_TEXT}') OR regexp_matches(x, '{ADVICE_HEADING}') THEN 'best_practice' END,
  CASE WHEN regexp_matches(x, '{POINTER_TEXT}') THEN 'pointer' END], lambda k: k IS NOT NULL)) AS question_type FROM t"""
)
def chunk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TALK} as text").select("doc_id", F.explode(question_types("text")).alias("question_type"))
