"""Repair of conversations' structure by a lazily determinised weighted automaton.

Rows of a conversation are Kept, Reroled to user or assistant, Deleted, or have empty user or assistant rows Inserted
around them, so that the initials of the roles read (s?(ua)+)? at least cost. The edits are a weighted automaton with
four states: at the start, and after a system, a user or an assistant row.

1. Equal rows of a turn are counted before anything is shuffled: all but the first are duplicates. The distinct rows, without
   their texts, are dealt out by ranges of conversation, turn, role and digest, so that a conversation that holds
   a large share of all rows is split; segments of them become short lists of symbols (role initial and fault).
2. A conversation's segments are scanned from its end on. The costs of the four states, less their minimum, are a state of the
   deterministic automaton; what a symbol makes of it is worked out when it first occurs and is looked up from then on.
   Each segment gets the state that its end is in.
3. Segments are traced from the start on, against the scan: of the arcs that are tight, which means that their cost is
   what the two states' costs differ by, the one whose initial is least is taken. As the scan ran backwards, this gives the
   least audit in ASCII order. Choices are remembered by state and symbol, too.
4. Texts join the edits by a digest of the row. Results that are functions of a whole conversation (its audit, the digest
   of its text) are fed row by row from sorted rows: no task holds a conversation's texts.

Defined results: a null role or text is one space; rows go by turn, null first, then role, then the SHA-256 of the
text; a null conv_id is a conversation of its own; a role whose initial is none of s, u and a, or that is empty, can be
deleted or reroled, but not kept; repeated rows are duplicates; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinmill.llm.store import forget, keep, map_batches

#: Rows of a range in a segment, as a power of two.
SEGMENT = 12

# States, classes of initials, faults.
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 3
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
DELETE, RENAME, INSERT, UNFINISHED = 3, 2, 2, 1

#: The state after the row that may come next, and its role's initial; the state after a kept row by state and class (s, u, a).
_NEXT = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (ASSISTANT, "a"), ASSISTANT: (USER, "u")}
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_ROLES = {"u": "user", "a": "assistant"}


class Choice(NamedTuple):
    inserted: str
    edit: str
    role: str | None
    state: int
    cost: int


class Automaton:
    """Vectors of costs to go, less their minimum, are numbered as they occur; transitions and choices are worked out once."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], int] = {}
        self.choices: dict[tuple[int, int, int], Choice] = {}
        #: Of an accepted end: nothing at the start or after an assistant row, else what completes a turn.
        self.end = self.number([0, 2 * INSERT, INSERT, 0])

    def number(self, costs: list[int]) -> int:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    @staticmethod
    def _arcs(symbol: int, state: int) -> list[tuple[str, int, int, str | None]]:
        """(edit, cost, next state, new role) of what can be done with a row, by initials."""
        kind, fault = symbol >> 2, symbol & 3
        arcs: list[tuple[str, int, int, str | None]] = [("D", DELETE, state, None)]
        if fault in (FINE, TRUNCATED):
            more = UNFINISHED if fault == TRUNCATED else 0
            if (state, kind) in _KEPT:
                arcs.append(("K", more, _KEPT[state, kind], None))
            after, initial = _NEXT[state]
            arcs.append(("R", RENAME + more, after, _ROLES[initial]))
        return arcs

    def _costs(self, after: int, symbol: int) -> list[int]:
        """Costs to go before the row, not normalised: of edits of the row, then with insertions before it."""
        to_go = self.vectors[after]
        costs = [min(cost + to_go[then] for _, cost, then, _ in self._arcs(symbol, state)) for state in range(4)]
        for _ in range(2):
            costs = [min(c, INSERT + costs[_NEXT[state][0]]) for state, c in enumerate(costs)]
        return costs

    def before(self, after: int, symbol: int) -> int:
        got = self.steps.get((after, symbol))
        if got is None:
            got = self.steps[after, symbol] = self.number(self._costs(after, symbol))
        return got

    def choice(self, after: int, symbol: int, state: int) -> Choice:
        """The tight arcs of least initials from a state over a row: insertions, then an edit."""
        got = self.choices.get((after, symbol, state))
        if got is None:
            costs, to_go, at, inserted = self._costs(after, symbol), self.vectors[after], state, ""
            while True:
                tight = {edit: (then, role) for edit, cost, then, role in self._arcs(symbol, at) if costs[at] == cost + to_go[then]}
                then, initial = _NEXT[at]
                if costs[at] == INSERT + costs[then] and "D" not in tight:
                    inserted, at = inserted + initial, then
                    continue
                edit = min(tight)
                break
            then, role = tight[edit]
            got = self.choices[after, symbol, state] = Choice(inserted, edit, role, then, costs[state] - to_go[then])
        return got

    @staticmethod
    def closing(state: int) -> str:
        """Initials of rows that are inserted at the end."""
        out = ""
        while state not in (START, ASSISTANT):
            state, initial = _NEXT[state]
            out += initial
        return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, list[dict], int | None, tuple[int, ...] | None]]:
    for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
        yield row


_MARK = object()
_EDITS = "conv_id long, key binary, place long, inserted string, edit string, copies long, new_role string, trailing string, cost long, blank long, duplicate long, truncated long, illegal long"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (conv_id, seg, rows), the last one of a conversation first, with the costs to go after them, and whether they are the last."""
    automaton, conv, state, waiting = Automaton(), _MARK, 0, None
    for batch in batches:
        ends, last = [], []
        for conv_id, _, rows in _runs(batch):
            if conv is _MARK or conv_id != conv:
                conv, state = conv_id, automaton.end
                last.append(True)
            else:
                # The segment after this one is scanned only now that one comes before it.
                for row in reversed(waiting):
                    state = automaton.before(state, row["symbol"])
                last.append(False)
            ends.append(list(automaton.vectors[state]))
            waiting = rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32())), pa.array(last, pa.bool_())], names=["conv_id", "seg", "rows", "after", "last"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of the distinct rows of segments, which come in order of conversation and place."""
    automaton, conv, state, before = Automaton(), _MARK, START, None
    schema = pa.schema([("conv_id", pa.int64()), ("key", pa.binary()), ("place", pa.int64()), ("inserted", pa.string()), ("edit", pa.string()), ("copies", pa.int64()), ("new_role", pa.string()), ("trailing", pa.string())] + [(c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")])
    for batch in batches:
        for conv_id, _, rows, after, last in _runs(batch):
            if conv is _MARK or conv_id != conv:
                conv, state, before = conv_id, START, None
            numbers = [automaton.number(list(after))]
            for row in reversed(rows):
                numbers.append(automaton.before(numbers[-1], row["symbol"]))
            numbers.reverse()
            out = []
            for k, row in enumerate(rows):
                symbol, copies = row["symbol"], row["copies"]
                kind, fault = symbol >> 2, symbol & 3
                chosen = automaton.choice(numbers[k + 1], symbol, state)
                state = chosen.state
                trailing = automaton.closing(state) if last and k == len(rows) - 1 else ""
                illegal = copies - 1 + (before is not None and (before, kind) not in _LEGAL)
                before = kind
                out.append(
                    (conv_id, row["key"], row["place"], chosen.inserted, chosen.edit, copies, chosen.role, trailing, chosen.cost + DELETE * (copies - 1) + INSERT * len(trailing),
                     copies if fault == BLANK else 0, 0 if fault == BLANK else copies - (fault != DUPLICATE), int(fault == TRUNCATED), illegal)
                )
            yield pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _rows(rows: DataFrame) -> DataFrame:
    """The rows with nulls as one space, the text's digest, and a key by which equal rows of a turn are the same."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text")).withColumn("sha", F.sha2("text", 256))
    return own.withColumn("key", F.unhex(F.substring(F.sha2(F.concat_ws(":", one("conv_id"), one("turn"), "sha", "role"), 256), 1, 32)))


def edits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each distinct row of a turn of each conversation, without text: the initials of rows inserted before it, the edit
    of its first copy (others are deleted), a new role, rows inserted at the conversation's end, costs, and counts of faults.

    `place` orders the rows of a conversation; `key` tells which row it is.
    """
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(_is_blank(F.col("text")), BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), FINE).otherwise(TRUNCATED)
    own = _rows(rows).select("key", "conv_id", "turn", "role", F.unhex("sha").alias("sha"), (kind * 4 + fault).cast("int").alias("symbol"))
    distinct = keep(own.groupBy("key", "conv_id", "turn", "role", "sha").agg(F.max("symbol").alias("symbol"), F.count("*").alias("copies")), "distinct-rows")
    # A role and text seen at an earlier turn; only what occurs at several turns is joined.
    told = distinct.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    told = keep(told.select(F.col("conv_id").alias("of"), F.col("role").alias("of_role"), F.col("sha").alias("of_sha"), "first"), "told-again")
    joined = distinct.join(told, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")) & (F.col("role") == F.col("of_role")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    symbol = F.when(again & (F.col("symbol").bitwiseAND(3) != BLANK), F.shiftleft(F.shiftright("symbol", 2), 2) + DUPLICATE).otherwise(F.col("symbol"))
    order = ["conv_id", "turn", "role", "sha"]
    ranged = joined.select("key", *order, symbol.alias("symbol"), "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(ranged.select("key", "conv_id", F.monotonically_increasing_id().alias("place"), "symbol", "copies"), "placed-rows")
    forget(distinct, told)
    segments = placed.groupBy("conv_id", F.shiftright("place", segment).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("place", "symbol", "copies", "key"))).alias("rows"))
    kinds = "conv_id long, seg long, rows array<struct<place:long,symbol:int,copies:long,key:binary>>"
    scanned = map_batches(segments.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")), _ends, f"{kinds}, after array<int>, last boolean")
    traced = keep(map_batches(scanned.repartition("conv_id").sortWithinPartitions("conv_id", "seg"), _traced, _EDITS), "edits")
    forget(placed)
    return traced


def with_texts(edited: DataFrame, rows: DataFrame) -> DataFrame:
    """Edits with the role and the text that their row has after the repair, null if it's deleted."""
    texts = _rows(rows).groupBy("key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    stays = F.col("edit") != "D"
    return edited.join(texts, "key").withColumns({"role": F.when(stays, F.coalesce("new_role", "role")), "text": F.when(stays, F.col("text"))})


def repaired(full: DataFrame) -> DataFrame:
    """(conv_id, place, at, role, text): the rows of the repaired conversations, in order of place and at."""
    blank = lambda c: F.transform(F.split(c, ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    some = lambda c: F.when(F.length(c) > 0, blank(c)).otherwise(none)
    own = F.when(F.col("edit") != "D", F.array(F.struct("role", "text"))).otherwise(none)
    return full.select("conv_id", "place", F.posexplode(F.concat(some("inserted"), own, some("trailing"))).alias("at", "row")).select("conv_id", "place", "at", "row.role", "row.text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, repaired_sha256) of rows (conv_id, place, inserted, edit, copies, trailing, role, text) in order; texts are fed one by one."""
    conv, letters, digest, any_row, out = _MARK, [], hashlib.sha256(), False, []

    def feed(role: str, text: str) -> None:
        nonlocal any_row
        digest.update((f"\n{role}:{text}" if any_row else f"{role}:{text}").encode())
        any_row = True

    def done() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "audit", "repaired_sha256"])
        out.clear()
        return got

    for batch in batches:
        for conv_id, _, inserted, edit, copies, trailing, role, text in _runs(batch):
            if conv is _MARK or conv_id != conv:
                if conv is not _MARK:
                    out.append((conv, "".join(letters), digest.hexdigest()))
                conv, letters, digest, any_row = conv_id, [], hashlib.sha256(), False
            letters.append("I" * len(inserted) + edit + "D" * (copies - 1) + "I" * len(trailing))
            for initial in inserted:
                feed(_ROLES[initial], "")
            if edit != "D":
                feed(role, text)
            for initial in trailing:
                feed(_ROLES[initial], "")
        if out:
            yield done()
    if conv is not _MARK:
        out.append((conv, "".join(letters), digest.hexdigest()))
        yield done()


_TALLIES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(rows: DataFrame, conversations: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of the rows, and of `conversations`."""
    edited = edits(rows, segment)
    full = with_texts(edited, rows)
    streamed = full.select("conv_id", "place", "inserted", "edit", "copies", "trailing", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    digests = map_batches(streamed, _digests, "conv_id long, audit string, repaired_sha256 string")
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
    turns = own.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    asked = own.select("conv_id") if conversations is None else conversations.select(F.col("conv_id").cast("long").alias("conv_id"))
    asked = asked.groupBy("conv_id").agg(F.lit(1).alias("one")).drop("one")
    parts = edited.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in _TALLIES[1:]))
    every = asked.unionByName(gaps, True).unionByName(parts, True).unionByName(digests, True)
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in _TALLIES),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by the crc32 of `conv_id:turn`, modulo 20: 0 drops, 1 empties, 2 cuts sentence ends, 3 repeats, 4 makes it a user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), fault.alias("fault")).where("fault != 0")
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _add(value: str, cost: int, letter: str) -> str:
    return f"printf('%06d', {value}[1:6]::INT + {cost}) || '{letter}' || {value}[7:]"


def _oracle() -> str:
    """Costs to go as strings of six digits and the audit, so that the least string is the cheapest audit, least in ASCII; then the audit is replayed."""
    arcs = {state: [_add(f"x{state}", DELETE, "D")] for state in range(4)}
    for state in range(4):
        after, _ = _NEXT[state]
        for (at, kind), then in _KEPT.items():
            if at == state:
                arcs[state].append(f"CASE WHEN fault IN ('', 't') AND initial = '{'sua'[kind]}' THEN printf('%06d', x{then}[1:6]::INT + (fault = 't')::INT) || 'K' || x{then}[7:] END")
        arcs[state].append(f"CASE WHEN fault IN ('', 't') THEN printf('%06d', x{after}[1:6]::INT + 2 + (fault = 't')::INT) || 'R' || x{after}[7:] END")
    edited = ", ".join(f"least({', '.join(arcs[s])}) AS y{s}" for s in range(4))
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS f FROM conversations
), dam AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE f <> 0
), conv AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY c) AS n FROM dam JOIN conv ON dam.conv_id IS NOT DISTINCT FROM conv.conv_id),
d AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen, lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS pair FROM o),
r AS (SELECT *, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM d),
go(c, i, x0, x1, x2, x3) AS (
  SELECT c, n + 1, '000000', '000004II', '000002I', '000000' FROM r WHERE i = 1
  UNION ALL
  SELECT c, i, least(y0, {_add('z2', 2, 'I')}), least(y1, {_add('z2', 2, 'I')}), z2, least(y3, {_add('y2', 2, 'I')})
  FROM (SELECT *, least(y2, {_add('y3', 2, 'I')}) AS z2 FROM (SELECT r.c, r.i, {edited} FROM go JOIN r ON r.c = go.c AND r.i = go.i - 1))
), best AS (SELECT c, x0[1:6]::BIGINT AS cost, x0[7:] AS audit FROM go WHERE i = 1),
play(c, p, i, state, done) AS (
  SELECT c, 1, 1, 0, []::VARCHAR[] FROM best
  UNION ALL
  SELECT play.c, p + 1, CASE WHEN e = 'I' THEN play.i ELSE play.i + 1 END,
    CASE WHEN e = 'D' THEN state WHEN e = 'K' AND initial = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
    CASE WHEN e = 'D' THEN done ELSE list_append(done, CASE WHEN e = 'K' THEN role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (SELECT play.*, audit[p] AS e FROM play JOIN best USING (c) WHERE p <= length(audit)) play LEFT JOIN r ON r.c = play.c AND r.i = play.i
), shas AS (SELECT c, sha256(array_to_string(done, chr(10))) AS sha FROM play JOIN best USING (c) WHERE p = length(audit) + 1),
tally AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM conv LEFT JOIN tally USING (c) LEFT JOIN best USING (c) LEFT JOIN shas USING (c)
"""


ORACLE = _oracle()
