"""Period tokens: 2026, 2026-Q2, 2026-H1, 2026-04 and a..b ranges; always half-open [start, end)."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(\d{4})(?:-(?:Q([1-4])|H([12])|(0[1-9]|1[0-2])))?")


def add_months(day: date, months: int) -> date:
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def token_bounds(token: str) -> tuple[date, date]:
    found = _TOKEN.fullmatch(token.strip())
    if not found:
        raise ValueError(f"not a period: {token!r}")
    year, quarter, half, month = found.groups()
    first, length = 1, 12
    if quarter:
        first, length = 3 * int(quarter) - 2, 3
    elif half:
        first, length = 6 * int(half) - 5, 6
    elif month:
        first, length = int(month), 1
    start = date(int(year), first, 1)
    return start, add_months(start, length)


def bounds(period: str) -> tuple[date, date]:
    parts = period.split("..")
    if len(parts) > 2:
        raise ValueError(f"not a period: {period!r}")
    start, end = token_bounds(parts[0])[0], token_bounds(parts[-1])[1]
    if start >= end:
        raise ValueError("period range must end after it starts")
    return start, end


def is_single(period: str | None) -> bool:
    """One token (a whole year counts); a range of two different tokens does not."""
    if period is None:
        return True
    parts = [p.strip() for p in period.split("..")]
    return parts[0] == parts[-1]


def within(start: date, end: date, column: str = "period_month") -> Column:
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def month_no(column: str = "period_month") -> Column:
    return F.year(column) * 12 + F.month(column)


def months_between(start: Column, end: Column) -> Column:
    """The first days of the months in [start, end)."""
    return F.sequence(start, F.add_months(end, -1), F.expr("interval 1 month"))


def plan_months(period: str, plan_year: int) -> tuple[date, date]:
    """A period's bounds, refused when it leaves the plan year."""
    start, end = bounds(period)
    if start.year != plan_year or add_months(end, -1).year != plan_year:
        raise ValueError(f"the plan covers {plan_year} only")
    return start, end
