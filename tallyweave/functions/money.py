"""Exact decimals: every product is cast on purpose, sums stay decimal, only quotients are doubles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


_LONG = 9.0e18


def zero(scale: int = 2) -> Column:
    return F.lit(0).cast(f"decimal(38,{scale})")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, NULL on a zero denominator."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def rounded(value: Column, places: int) -> Column:
    """A double rounded half up, by the same IEEE steps on any engine."""
    scale = float(10 ** places)
    near = F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    # Past this size a double has no digits left to round.
    return F.when(F.abs(value) < F.lit(_LONG / scale), near).otherwise(value)


def to_decimal(value: Column, places: int, precision: int = 38) -> Column:
    """A double as an exact decimal with the given places, rounded half up."""
    unit = F.lit(Decimal(1).scaleb(-places)).cast(f"decimal({places + 1},{places})")
    scale = float(10 ** places)
    whole = F.floor(value * F.lit(scale) + F.lit(0.5)).cast("decimal(20,0)")
    kind = f"decimal({precision},{places})"
    return F.when(F.abs(value) < F.lit(_LONG / scale), (whole * unit).cast(kind)).otherwise(value.cast(kind))


def cents(value: Column) -> Column:
    """A decimal shown in cents, half up."""
    return F.round(value, 2).cast("decimal(28,2)")


def cents_even(value: Column) -> Column:
    """A decimal stored in cents, half even."""
    return F.bround(value, 2).cast("decimal(28,2)")


def amount_of(quantity: Column, price: Column) -> Column:
    return F.round(quantity * price, 2).cast("decimal(18,2)")
