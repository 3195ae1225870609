"""Driver formulas as Columns: ``+ - * /``, powers, ABS, ROUND, MIN, MAX and held time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held() -> Column:
    """PRIOR and the other time functions read a period a shock does not reach: held at one."""
    return F.lit(1.0)


def divide(top: Column, bottom: Column) -> Column:
    """NULL on a zero divisor; the evaluation turns both of a driver's values to zero then."""
    return top / F.nullif(bottom, F.lit(0.0))


def power(base: Column, exponent: Column) -> Column:
    """``-a ^ b`` in a driver formula is ``(-a) ^ b``: pass the negated base."""
    return F.pow(base, exponent)


def round_even(value: Column, places: int = 0) -> Column:
    return F.bround(value, places)


minimum, maximum, absolute = F.least, F.greatest, F.abs
