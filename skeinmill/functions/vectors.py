"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Scaled to length 1; vectors shorter than FLOOR are divided by that."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(FLOOR))), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]
