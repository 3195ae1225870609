"""Monthly time functions. Frames are month distances, so a missing month gives NULL, not a neighbour."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tallyweave.functions.money import ratio

_DEFAULT = {"PRIOR": 1, "LEAD": 1, "CAGR": 1, "ROLLING": 3}
NAMES = ("PRIOR", "LEAD", "YOY", "CAGR", "ROLLING", "YTD", "QTD", "MTD")
SUMMING = ("ROLLING", "YTD", "QTD")


@dataclass(frozen=True)
class TimeFn:
    name: str
    metric: str
    offset: int | None = None

    def __post_init__(self) -> None:
        if self.name not in NAMES:
            raise ValueError(f"unknown time function: {self.name}")
        if not isinstance(self.metric, str):
            raise ValueError("nested time functions are not supported")
        if self.offset is not None and self.name in _DEFAULT and self.offset <= 0:
            raise ValueError(f"{self.name} offset must be positive")

    @property
    def span(self) -> int:
        return self.offset or _DEFAULT.get(self.name, 1)

    @property
    def alias(self) -> str:
        return f"{self.name.lower()}_{self.metric}"

    @property
    def months_back(self) -> int:
        return {"PRIOR": self.span, "ROLLING": self.span - 1, "CAGR": 12 * self.span, "YOY": 12, "QTD": 2}.get(self.name, 0)

    @property
    def months_ahead(self) -> int:
        return self.span if self.name == "LEAD" else 0

    def column(self, dims: Sequence[str]) -> Column:
        """This function over a series with one row per (dims, period_month) and ``month_no``."""
        value = F.col(self.metric)

        def over(low: int, high: int, *keys: Column):
            return Window.partitionBy(*[F.col(d) for d in dims], *keys).orderBy("month_no").rangeBetween(low, high)

        def at(distance: int) -> Column:
            return F.first(value).over(over(distance, distance))

        if self.name == "PRIOR":
            return at(-self.span)
        if self.name == "LEAD":
            return at(self.span)
        if self.name == "YOY":
            return ratio(value, at(-12)) - F.lit(1.0)
        if self.name == "CAGR":
            return F.pow(ratio(value, at(-12 * self.span)), F.lit(1.0 / self.span)) - F.lit(1.0)
        if self.name == "ROLLING":
            return F.sum(value).over(over(1 - self.span, 0))
        start = Window.unboundedPreceding
        if self.name == "YTD":
            return F.sum(value).over(over(start, 0, F.year("period_month")))
        if self.name == "QTD":
            return F.sum(value).over(over(start, 0, F.date_trunc("quarter", F.col("period_month"))))
        return value
