"""Keys, versions and point-in-time reads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.money import ratio
from tallyweave.functions.periods import add_months
from tallyweave.model import BY_HASH, GRAIN, IDENTITY, PLAN_GRAIN
from tallyweave.session import cut


def _moment(as_of: str | datetime) -> Column:
    return F.to_timestamp_ntz(F.lit(str(as_of)))


def closes_at(vintages: DataFrame, as_of: str | datetime | None) -> DataFrame:
    return vintages if as_of is None else vintages.filter(F.col("closed_at") <= _moment(as_of))


def vintage_lookup(vintages: DataFrame, as_of: str | datetime | None = None) -> DataFrame:
    """The close a read sees: the latest, or the latest at or before ``as_of``."""
    return (
        closes_at(vintages, as_of)
        .agg(F.max_by(F.struct("vintage", "closed_at", "note"), "closed_at").alias("c"))
        .filter(F.col("c").isNotNull()).select("c.*")
    )


def require_vintage(vintages: DataFrame, as_of: str | datetime | None = None) -> int:
    """The vintage number, or a refusal where no close exists yet."""
    found = vintage_lookup(vintages, as_of).head()
    if found is None:
        raise ValueError(f"no ledger close on or before {as_of}")
    return found["vintage"]


def close_in_month(vintages: DataFrame, year: int, month: int) -> DataFrame:
    start = datetime(year, month, 1).date()
    moment = F.col("closed_at")
    return vintages.filter((moment >= F.lit(start).cast("timestamp_ntz"))
                           & (moment < F.lit(add_months(start, 1)).cast("timestamp_ntz")))


def require_close_in_month(vintages: DataFrame, year: int, month: int):
    found = close_in_month(vintages, year, month).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{year}-{month:02d} has {'no' if not found else 'more than one'} ledger close")
    return found[0]


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key. ``row_number() = 1`` is cut per map task before the shuffle,
    so a key holding most of the rows still sends one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def ledger_as_of(ledger: DataFrame, vintages: DataFrame, as_of: str | datetime | None = None) -> DataFrame:
    """The ledger as it stood at a close: newest visible version per posting, then deletions hidden.

    Filter ``ledger`` on dimensions, period and scope first; all of them are functions of the
    identity, so filtering before the pick gives the same rows and reads less.
    """
    vintage = closes_at(vintages, as_of).agg(F.max("vintage")).scalar()
    return live_at(ledger, vintage)


VERSION_ORDER = ("_version", "amount_functional", "quantity")


def live_at(ledger: DataFrame, vintage: Column) -> DataFrame:
    order = [F.desc(c) for c in VERSION_ORDER]
    # The first three decide; the rest only make an exact tie repeatable.
    order += [F.desc("_is_deleted"), F.desc("resource_employee")] if "resource_employee" in ledger.columns else []
    return latest(ledger.filter(F.col("_version") <= vintage), IDENTITY, order).filter(F.col("_is_deleted") == 0)


def carried(names: Sequence[str]) -> list[Column]:
    """Columns that the grain determines: dimensions (hashed into it) and the company's currency.

    They ride along as aggregates, so the rollup is partitioned by the grain alone and the join to
    the plan needs no second shuffle or sort.
    """
    return [F.min(n).alias(n) for n in dict.fromkeys(["functional_currency", *names]) if n not in GRAIN]


def ledger_rollup(live: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Live postings summed to the signature grain; price is amount over quantity."""
    return live.groupBy(*BY_HASH).agg(
        *carried(dims),
        F.sum("quantity").cast("decimal(16,4)").alias("quantity"),
        F.sum("amount_functional").cast("decimal(18,2)").alias("amount_functional"),
        ratio(F.sum("amount_functional"), F.sum("quantity")).alias("unit_price"),
        F.count(F.lit(1)).alias("postings"),
    )


def two_closes(ledger: DataFrame, left: int, right: int, dims: Sequence[str] = ()) -> DataFrame:
    """Signature-grain actuals at two closes from one scan and one pick per posting.

    ``max(struct(version, amount, quantity, …))`` under ``version <= close`` is the same pick
    as the ordered read, and both closes share its shuffle.
    """
    pick = F.struct(*VERSION_ORDER, "_is_deleted")

    def seen(close: int) -> Column:
        return F.max(F.when(F.col("_version") <= close, pick))

    picked = (
        ledger.filter(F.col("_version") <= max(left, right))
        .groupBy(*IDENTITY).agg(*carried(dims), seen(left).alias("left"), seen(right).alias("right"))
    )

    def total(side: str, field: str, kind: str) -> Column:
        live = F.col(f"{side}._is_deleted") == 0
        return F.sum(F.when(live, F.col(f"{side}.{field}"))).cast(kind).alias(f"{side}_{field}")

    return picked.groupBy(*BY_HASH).agg(
        *carried(dims),
        total("left", "quantity", "decimal(16,4)"), total("left", "amount_functional", "decimal(18,2)"),
        total("right", "quantity", "decimal(16,4)"), total("right", "amount_functional", "decimal(18,2)"),
    )


def latest_revision(plan: DataFrame) -> DataFrame:
    """The plan as published: the highest revision per grain."""
    return latest(plan, PLAN_GRAIN, [F.desc("revision")])


def plan_current(plan: DataFrame, plan_version: str, scenario: str | None = None) -> DataFrame:
    """One version's published lines, of one scenario or all: keys fixed by the filter are left out of
    the shuffle, so a later join on the grain finds the lines in place."""
    lines = plan.filter(F.col("plan_version") == plan_version)
    if scenario is None:
        return latest(lines, [*BY_HASH, "scenario_id"], [F.desc("revision")])
    return latest(lines.filter(F.col("scenario_id") == scenario), BY_HASH, [F.desc("revision")])


def drivers_as_of(drivers: DataFrame, moment: Column) -> DataFrame:
    """Active driver rows in force at a date; the end date is exclusive."""
    return drivers.filter(
        (F.col("status") == "ACTIVE") & (F.col("effective_from") <= moment)
        & (F.col("effective_to").isNull() | (F.col("effective_to") > moment)))


def unknown_drivers(asked: DataFrame, drivers: DataFrame, moment: Column) -> DataFrame:
    """Asked-for codes with no active row in force."""
    known = drivers_as_of(drivers, moment).select("driver_code").distinct()
    return asked.select("driver_code").distinct().join(known, "driver_code", "left_anti")


def driver_now(drivers: DataFrame, moment: Column) -> DataFrame:
    """Per code the row in force with the newest start."""
    return latest(drivers_as_of(drivers, moment), ["driver_code"], [F.desc("effective_from")])


def citation_rows(ledger: DataFrame, vintages: DataFrame, keys: DataFrame, as_of, scope: DataFrame) -> DataFrame:
    """Live ledger rows behind cited grain keys at a pinned close; keys outside the caller's scope are refused."""
    keys = cut(keys.select(*GRAIN).distinct())  # read by both checks and by the ledger
    check_citation_request(keys, scope)
    return ledger_as_of(ledger.join(keys, list(GRAIN), "left_semi"), vintages, as_of)


def check_citation_request(keys: DataFrame, scope: DataFrame) -> None:
    """At least one key, all inside the scope; anything else is refused."""
    if keys.isEmpty():
        raise ValueError("citation lookup takes at least one key")
    if keys.join(scope.select("company"), "company", "left_anti").head():
        raise ValueError("citation company outside caller scope")


def lost_vintage_keys(ledger: DataFrame) -> DataFrame:
    """Postings restated in version 2 whose original version is gone."""
    return (
        ledger.groupBy(*IDENTITY)
        .agg(F.count_if(F.col("_version") == 1).alias("originals"), F.count_if(F.col("_version") == 2).alias("restated"))
        .filter((F.col("originals") == 0) & (F.col("restated") > 0))
    )
