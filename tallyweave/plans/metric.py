"""Metric queries: grouped measures, filters and monthly time functions over the ledger or the plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import periods
from tallyweave.functions.predicates import dimension_filter, in_scope, measure_filter, split_where
from tallyweave.functions.timefn import SUMMING, TimeFn
from tallyweave.model import ADDITIVE, AXES, DIMENSIONS, RATIO, SCENARIOS, SEMI_ADDITIVE, measure
from tallyweave.operators.asof import ledger_as_of, plan_current


@dataclass(frozen=True)
class Ask:
    """One asked-for measure: a registered name or a time function over one, and its output name."""

    what: str | TimeFn
    alias: str

    @property
    def base(self) -> str:
        return self.what.metric if isinstance(self.what, TimeFn) else self.what


def asks(measures: Sequence) -> list[Ask]:
    out = []
    for item in measures:
        what, alias = item if isinstance(item, tuple) else (item, None)
        alias = alias or (what.alias if isinstance(what, TimeFn) else what)
        if not (alias[0].isalpha() and alias.replace("_", "").isalnum()):
            raise ValueError(f"invalid measure alias: {alias}")
        out.append(Ask(what, alias))
    return out


def explicit_aggregate(function: str, name: str) -> str:
    """SUM of an additive measure is the measure; every other explicit aggregate is a type error."""
    kind = measure(name).kind
    if kind != ADDITIVE or function.upper() != "SUM":
        raise ValueError(f"{function}({name}) is a type error: {name} is {kind} and its registered kind fixes how it aggregates")
    return name


def check(asked: Sequence[Ask], by: Sequence[str], where: Sequence, period: str | None,
          as_of, scenario: str | None, limit: int | None) -> None:
    for dim in by:
        if dim not in DIMENSIONS and dim not in ("company", "account"):
            raise ValueError(f"unknown dimension: {dim}")
    split_where(where)
    if period is not None:
        periods.bounds(period)
    if scenario is not None and scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario: {scenario}")
    if as_of is not None and scenario is not None:
        raise ValueError("AS OF is only valid for actual-ledger queries")
    if limit is not None and limit < 0:
        raise ValueError("limit must be non-negative")
    for ask in asked:
        kind = measure(ask.base).kind
        if isinstance(ask.what, TimeFn):
            if ask.what.name in SUMMING and kind != ADDITIVE:
                raise ValueError(f"{ask.what.name}({ask.base}) sums across periods, and {ask.base} is {kind}")
            if period is None:
                raise ValueError(f"{ask.what.name} needs a period to know which months to produce")
        elif kind == SEMI_ADDITIVE and not periods.is_single(period):
            raise ValueError(f"{ask.base} is semi-additive: ask for it at a single closing period")


def metric_query(cube, measures: Sequence, by: Sequence[str] = (), where: Sequence = (), period: str | None = None,
                 as_of=None, plan: tuple[str, str] | None = None, scope=None, limit: int | None = None,
                 operands: bool = False) -> DataFrame:
    """Measures by dimensions over the as-of ledger, or over one (plan version, scenario).

    A limited answer is ordered by its dimensions, so it is repeatable.
    """
    asked = asks(measures)
    check(asked, by, where, period, as_of, plan[1] if plan else None, limit)
    if any(isinstance(a.what, TimeFn) for a in asked):
        return _monthly(cube, asked, list(by), where, period, as_of, plan, scope, limit)
    rows = _source(cube, where, period and periods.bounds(period), as_of, plan, scope)
    having, needed = measure_filter(where)
    columns = [measure(a.base).column().alias(a.alias) for a in asked]
    columns += [measure(n).column().alias(f"__having_{n}") for n in needed]
    extra: list[str] = []
    if operands:
        for a in asked:
            if measure(a.base).kind == RATIO:
                top, bottom = measure(a.base).operands()
                extra += [f"{a.alias}_numerator", f"{a.alias}_denominator"]
                columns += [top.alias(extra[-2]), bottom.alias(extra[-1])]
    out = _having(rows.groupBy(*by).agg(*columns), having)
    out = out.select(*by, *[a.alias for a in asked], *extra)
    for a in asked if operands else ():
        if measure(a.base).kind == RATIO:
            out = out.withColumn(f"{a.alias}_undefined", F.col(f"{a.alias}_denominator") == 0)
    return out.orderBy(*by).limit(limit) if limit is not None and by else out


def _having(grouped: DataFrame, condition: Column | None) -> DataFrame:
    return grouped if condition is None else grouped.filter(condition)


def _source(cube, where, bounds, as_of, plan, scope) -> DataFrame:
    """The innermost read, with dimension, period and scope filters already applied."""
    rows = cube.ledger if plan is None else cube.plan((plan[1],))
    condition = dimension_filter(where)
    if condition is not None:
        rows = rows.filter(condition)
    if bounds:
        rows = rows.filter(periods.within(*bounds))
    rows = in_scope(rows, scope)
    return ledger_as_of(rows, cube.vintages, as_of) if plan is None else plan_current(rows, *plan)


def _monthly(cube, asked, by, where, period, as_of, plan, scope, limit) -> DataFrame:
    """Month aggregates over a widened range, then month-distance windows, then the asked-for months."""
    start, end = periods.bounds(period)
    functions = [a.what for a in asked if isinstance(a.what, TimeFn)]
    wide_start = periods.add_months(start, -max(f.months_back for f in functions))
    if any(f.name == "YTD" for f in functions):
        wide_start = min(wide_start, start.replace(month=1))
    wide_end = periods.add_months(end, max(f.months_ahead for f in functions))
    rows = _source(cube, where, (wide_start, wide_end), as_of, plan, scope)
    having, needed = measure_filter(where)
    bases = sorted({a.base for a in asked})
    series = _having(
        rows.groupBy(*by, "period_month").agg(
            *[measure(b).column().alias(b) for b in bases],
            *[measure(n).column().alias(f"__having_{n}") for n in needed]),
        having,
    ).withColumn("month_no", periods.month_no())
    values = [(a.what.column(by) if isinstance(a.what, TimeFn) else F.col(a.base)).alias(a.alias) for a in asked]
    out = series.select(*by, "period_month", *values).filter(periods.within(start, end))
    return out.orderBy(*by, "period_month").limit(limit) if limit is not None else out
