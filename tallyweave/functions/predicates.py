"""Filters: comparisons joined strictly from the left, and the caller's company scope."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.model import AXES, DIMENSIONS, MEASURES, measure

COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge,
           "<": operator.lt, "<=": operator.le}
JOIN = {"AND": operator.and_, "OR": operator.or_}


def split_where(where: Sequence) -> tuple[list[tuple], list[str]]:
    """[(field, op, value), "AND", (field, op, value), …] into comparisons and connectors."""
    comparisons, connectors = list(where[0::2]), [c.upper() for c in where[1::2]]
    if where and len(where) % 2 == 0:
        raise ValueError("a filter list alternates comparisons and AND/OR")
    for name, op, value in comparisons:
        if name not in DIMENSIONS and name not in AXES and name not in MEASURES:
            raise ValueError(f"unknown predicate field: {name}")
        if name in MEASURES:
            measure(name)
        if op in ("IN", "NOT IN"):
            if not list(value):
                raise ValueError("membership predicate cannot be empty")
        elif op not in COMPARE:
            raise ValueError(f"unknown comparison: {op}")
    if any(c not in JOIN for c in connectors):
        raise ValueError("predicates are joined by AND or OR")
    kinds = {name in MEASURES for name, _, _ in comparisons}
    if "OR" in connectors and len(kinds) > 1:
        raise ValueError("OR cannot join a dimension filter (per row) and a measure filter (per group)")
    return comparisons, connectors


def compare(column: Column, op: str, value) -> Column:
    if op == "IN":
        return column.isin(*value)
    if op == "NOT IN":
        return ~column.isin(*value)
    return COMPARE[op](column, F.lit(value))


def fold(parts: Sequence[Column], connectors: Sequence[str]) -> Column | None:
    """((a op b) op c) …: AND does not bind tighter than OR."""
    if not parts:
        return None
    joins = [*connectors, *["AND"] * len(parts)]
    return reduce(lambda done, step: JOIN[step[0]](done, step[1]), zip(joins, parts[1:]), parts[0])


def dimension_filter(where: Sequence) -> Column | None:
    comparisons, connectors = split_where(where)
    return fold([compare(F.col(n), op, v) for n, op, v in comparisons if n not in MEASURES], connectors)


def measure_filter(where: Sequence) -> tuple[Column | None, list[str]]:
    """The HAVING part over helper columns ``__having_<measure>``, and the measures it needs."""
    comparisons, connectors = split_where(where)
    used = [c for c in comparisons if c[0] in MEASURES]
    condition = fold([compare(F.col(f"__having_{n}"), op, v) for n, op, v in used], connectors)
    return condition, sorted({n for n, _, _ in used})


def in_scope(df: DataFrame, scope: DataFrame | Iterable[str] | None, column: str = "company") -> DataFrame:
    """None reads everything, an empty scope reads nothing; a table scope is a semi join."""
    if scope is None:
        return df
    if isinstance(scope, DataFrame):
        return df.join(scope.select(F.col("company").alias(column)), column, "left_semi")
    names = sorted(scope)
    return df.filter(F.col(column).isin(*names)) if names else df.filter(F.lit(False))
