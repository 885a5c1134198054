"""Chat formatting from event logs, with built-in functions only.

Events are partitioned by conversation and block of message numbers, sorted by number and sequence, and
folded into final messages: a `message` opens one, a `delta` adds to the one that is open, an `edit`
replaces its text, a `regenerate` starts it anew, a `delete` takes it away. Blocks are rendered where
they are folded; only rendered blocks meet again in one row for each conversation, so that a
conversation with a large share of all rows is folded by many tasks.

The template marks each turn as START role newline text END newline. Control strings inside texts and
roles are escaped: & as &amp; and <| as &lt;| and, in roles, a newline as &#10;. This is reversible.
The loss mask is the list of spans, in code points, of the texts of assistant turns.

Defined results: a null text or role is empty; a null kind is `message`; events of one number and
sequence sort by kind, role and text, and repeated `message` events are one turn each; changes to a
message that isn't open do nothing; null conversation ids are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinmill.llm.spans import prefix_sums

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 64
LOSS_ROLE = "assistant"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("&#10;"), F.lit("\n")))


#: Messages at the end of a block that changes reach at once; earlier ones are put by in parts of half as many.
_TAIL = 128
_MESSAGE = "named_struct('number', e.number, 'role', e.role, 'text', e.text)"
#: A fold whose state is the messages put by and the last ones, so that an event copies _TAIL messages at most.
_FOLD = f"""aggregate(events, named_struct('done', cast(array() as array<array<struct<number:bigint,role:string,text:string>>>), 'tail', cast(array() as array<struct<number:bigint,role:string,text:string>>)), (a, e) ->
  case when e.kind = 'message' and size(a.tail) < {_TAIL} then named_struct('done', a.done, 'tail', concat(a.tail, array({_MESSAGE})))
       when e.kind = 'message' then named_struct('done', concat(a.done, array(slice(a.tail, 1, {_TAIL // 2}))), 'tail', concat(slice(a.tail, {_TAIL // 2 + 1}, {_TAIL // 2}), array({_MESSAGE})))
       when size(a.tail) = 0 or not (a.tail[size(a.tail) - 1].number <=> e.number) then a
       when e.kind = 'delete' and size(a.tail) = 1 and size(a.done) > 0 then named_struct('done', slice(a.done, 1, size(a.done) - 1), 'tail', a.done[size(a.done) - 1])
       when e.kind = 'delete' then named_struct('done', a.done, 'tail', slice(a.tail, 1, size(a.tail) - 1))
       when e.kind in ('delta', 'edit', 'regenerate') then named_struct('done', a.done, 'tail', concat(slice(a.tail, 1, size(a.tail) - 1), array(named_struct('number', e.number,
         'role', if(e.role = '', a.tail[size(a.tail) - 1].role, e.role), 'text', if(e.kind = 'delta', concat(a.tail[size(a.tail) - 1].text, e.text), e.text)))))
       else a end, a -> concat(flatten(a.done), a.tail))"""


def fold_blocks(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, messages): final messages of each block of numbers, in order.

    Reads conv_id, number (of the message), seq, kind, role, text.
    """
    rows = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("number").cast("long").alias("number"), F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("kind"), F.lit("message")).alias("kind"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy("conv_id", F.floor(F.col("number") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", "seq", "kind", "role", "text"))).alias("events"))
    return grouped.select("conv_id", "block", F.expr(_FOLD).alias("messages"))


def render(folded: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) from folded blocks."""
    head = F.lit(START)

    def turn(m: Column) -> Column:
        role, text = _escape_role(m["role"]), escape(m["text"])
        return F.struct(F.concat(head, role, F.lit("\n"), text, F.lit(END + "\n")).alias("turn"), (F.length(role) + len(START) + 1).alias("lead"), F.length(text).alias("size"), (m["role"] == loss_role).alias("loss"))

    blocks = folded.withColumn("turns", F.transform("messages", turn))
    blocks = blocks.withColumn("at", prefix_sums(F.transform("turns", lambda t: F.length(t["turn"]))))
    spans = "filter(transform(turns, (t, i) -> if(t.loss, struct(cast(at[i] as bigint) + t.lead as start, cast(at[i] as bigint) + t.lead + t.size as end), null)), s -> s is not null)"
    blocks = blocks.select("conv_id", F.struct("block", F.size("turns").cast("long").alias("n"), F.expr("array_join(transform(turns, t -> t.turn), '')").alias("text"), F.expr(spans).alias("spans")).alias("b"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    whole = whole.withColumn("at", prefix_sums(F.transform("blocks", lambda b: F.length(b["text"]))))
    return whole.select(
        "conv_id", F.expr("aggregate(blocks, 0L, (a, b) -> a + b.n)").alias("n_turns"), F.expr("array_join(transform(blocks, b -> b.text), '')").alias("formatted"),
        F.expr("flatten(transform(blocks, (b, i) -> transform(b.spans, s -> struct(at[i] + s.start as start, at[i] + s.end as end))))").alias("loss_spans"),
    )


def format_chats(events: DataFrame, loss_role: str = LOSS_ROLE, block: int = BLOCK) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) for each conversation of an event log."""
    return render(fold_blocks(events, block), loss_role)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as (role, text)."""
    pieces = F.filter(F.split(formatted, r"\Q" + END + r"\E\n", -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(_unescape_role(F.substr(F.substring_index(x, "\n", 1), F.lit(len(START) + 1))).alias("role"), unescape(F.substr(x, F.locate("\n", x) + 1)).alias("text")))


def masked_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped. Spans are cut by blocks, each of which is cut out once."""
    plain = "replace(replace({}, '&lt;|', '<|'), '&amp;', '&')"
    first, last = f"{spans}[cast(c * {BLOCK} as int)].start", f"{spans}[cast(least(c * {BLOCK} + {BLOCK - 1}, size({spans}) - 1) as int)].end"
    piece = f"substring({formatted}, cast({first} + 1 as int), cast({last} - {first} as int))"
    cut = plain.format(f"substring(p, cast(s.start - {first} + 1 as int), cast(s.end - s.start as int))")
    texts = f"transform(array({piece}), p -> array_join(transform(slice({spans}, cast(c * {BLOCK} + 1 as int), {BLOCK}), s -> {cut}), ''))[0]"
    return F.expr(f"if(size({spans}) = 0, '', array_join(transform(sequence(0, (size({spans}) - 1) div {BLOCK}), c -> {texts}), ''))")


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(12 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 11)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
