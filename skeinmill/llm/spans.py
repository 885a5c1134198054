"""Where a pattern matches in a text column, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, even where it's used inside lambdas of its own."""
    return F.transform(F.array(value), body)[0]


def _sum(xs: Column, first: Column, count: Column) -> Column:
    return F.aggregate(F.slice(xs, first, count), F.lit(0), lambda a, x: a + x)


def prefix_sums(lengths: Column) -> Column:
    """Sums of the integers before each, by blocks so that long arrays aren't summed over again for each."""

    def placed(s: Column) -> Column:
        blocks = F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: _sum(s, b * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.expr("cast(array() as array<int>)"))
        before = lambda b: F.transform(b, lambda x, i: _sum(b, F.lit(1), i))
        at = lambda p: F.transform(s, lambda x, i: F.get(p, F.floor(i / _BLOCK).cast("int")) + _sum(s, (i - i % _BLOCK + 1).cast("int"), i % _BLOCK))
        return let(let(blocks, before), at)

    return let(lengths, placed)


def find_spans(frame: DataFrame, out: str, pattern: str, gate: Column | None = None, text: str = "text", near: int = 80) -> DataFrame:
    """Adds a column of (start, end, found, before, after) for all leftmost non-overlapping matches of a pattern.

    Positions are code points, end exclusive; before and after are the characters nearest to the match of
    the text between it and its neighbours. The pattern must not match nothing. Texts for which the gate is false aren't searched.

    Matches and the gaps between them come from the same search, so positions are sums of lengths.
    """
    found, none = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.expr("cast(array() as array<string>)")
    matches = F.coalesce(found if gate is None else F.when(gate, found), none)

    def placed(m: Column, g: Column, ends: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = F.get(ends, i) + F.length(F.get(g, i))
            return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("found"), F.right(F.get(g, i), F.lit(near)).alias("before"), F.left(F.get(g, i + 1), F.lit(near)).alias("after"))

        return F.transform(m, span)

    def with_gaps(m: Column) -> Column:
        gaps = F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)).otherwise(none)
        return let(gaps, lambda g: let(prefix_sums(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i)))), lambda ends: placed(m, g, ends)))

    return frame.withColumn(out, let(matches, with_gaps))
