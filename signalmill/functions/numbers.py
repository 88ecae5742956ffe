"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def tenths(x: Column) -> Column:
    """Rounded half up to one decimal."""
    return F.floor(x * 10 + 0.5).cast("double") / 10


def tiers(x: Column, steps, otherwise) -> Column:
    """The value of the first (bound, value) with x >= bound."""
    out = F.lit(otherwise)
    for bound, value in reversed(list(steps)):
        out = F.when(x >= bound, F.lit(value)).otherwise(out)
    return out


def hours_between(start: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)).cast("double") / 3.6e9
