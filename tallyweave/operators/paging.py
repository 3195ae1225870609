"""Pages of a large result in order of size, without sorting all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 64  # bins for each doubling of a size


def _bin(size: Column) -> Column:
    """A whole number that grows with the size, in steps of about one percent; NULL sizes come last."""
    return F.coalesce(F.floor(F.log2(size.cast("double") + 1) * STEPS).cast("int"), F.lit(-1))


def page_by_size(rows: DataFrame, value: str, keys: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows from ``offset`` on, by absolute ``value`` downwards, NULL last, ties by ``keys``.

    Rows are counted in bins of their size, a few thousand whatever their number. The counts tell in which bins the page
    begins and ends; only rows of these bins are ordered, and of the first as many are passed over as the bins above
    leave. ``rows`` are read twice: keep them first where they are costly.
    """
    kept = rows.withColumn("__bin", _bin(F.abs(value) * 100))
    counts = sorted(((r["__bin"], r["count"]) for r in kept.groupBy("__bin").count().collect()), reverse=True)
    above, first, last, seen = 0, None, None, 0
    for number, count in counts:
        if first is None and seen + count > offset:
            first, above = number, seen
        seen += count
        last = number
        if seen >= offset + limit:
            break
    if first is None or limit <= 0:
        return kept.drop("__bin").limit(0)
    near = kept.filter(F.col("__bin").between(last, first)).drop("__bin")
    size = F.abs(value)
    return near.orderBy(size.isNull(), size.desc(), *keys).offset(offset - above).limit(limit)
