"""Covenant figures and checks on a staged re-forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.money import ratio
from tallyweave.model import DELIVERY_ACCOUNTS, REVENUE_ACCOUNTS
from tallyweave.operators.fx import checked_rate, with_rate
from tallyweave.operators.recompute import live_with_staged


def figures(live: DataFrame, staged: DataFrame, fx_plan: DataFrame, plan_version: str, revision: int,
            companies: Sequence[str] = (), months: Sequence[str] = ()) -> DataFrame:
    """``figures_of`` a plan version as published and with a revision's staged rows in place."""
    return figures_of(live_with_staged(live, staged, plan_version, revision), fx_plan, plan_version, companies, months)


def figures_of(lines: DataFrame, fx_plan: DataFrame, plan_version: str, companies: Sequence[str] = (),
               months: Sequence[str] = ()) -> DataFrame:
    """Revenue and delivery cost in USD before and after, per scenario, for the request's slice and the whole plan.

    ``lines`` have ``amount_functional`` and ``after_amount``. Rates are those of the plan version; a line without one
    positive rate is refused.
    """
    inside = F.lit(True)
    if companies:
        inside = inside & F.col("company").isin(*companies)
    if months:
        inside = inside & F.date_format("period_month", "yyyy-MM-dd").isin(*months)
    rows = with_rate(lines, fx_plan, plan_version).withColumn("usd_rate", checked_rate())
    scopes = F.when(inside, F.array(F.lit("PLAN"), F.lit("REQUEST"))).otherwise(F.array(F.lit("PLAN")))

    def total(amount: str, accounts: Sequence[str]) -> Column:
        usd = (F.col(amount) * F.col("usd_rate")).cast("decimal(28,6)")
        return F.coalesce(F.sum(F.when(F.col("account").isin(*accounts), usd)), F.lit(0)).cast("decimal(38,6)")

    return rows.withColumn("scope", F.explode(scopes)).groupBy("scenario_id", "scope").agg(
        total("amount_functional", REVENUE_ACCOUNTS).alias("before_revenue"),
        total("amount_functional", DELIVERY_ACCOUNTS).alias("before_cost"),
        total("after_amount", REVENUE_ACCOUNTS).alias("after_revenue"),
        total("after_amount", DELIVERY_ACCOUNTS).alias("after_cost"))


def metric_value(side: str) -> Column:
    revenue, cost = F.col(f"{side}_revenue").cast("double"), F.col(f"{side}_cost").cast("double")
    return (
        F.when(F.col("metric") == "services_revenue", revenue)
        .when(F.col("metric") == "delivery_cost", cost)
        .when(F.col("metric") == "gross_margin_pct", ratio(revenue - cost, revenue) * F.lit(100.0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown covenant metric "), F.col("metric"))))
    )


def require_rules(rules: DataFrame) -> DataFrame:
    """The rules, or a refusal where there is none: nothing could show that covenants are met."""
    if rules.isEmpty():
        raise ValueError("no active covenant rule")
    return rules


def checks(rules: DataFrame, measured: DataFrame) -> DataFrame:
    """One verdict per (rule, scenario); what cannot be measured fails."""
    c = F.col
    joined = rules.withColumn("scenario_id", F.explode("scenarios")).drop("scenarios").join(measured, ["scenario_id", "scope"])
    joined = joined.withColumns({"before_value": metric_value("before"), "after_value": metric_value("after")})
    change = ratio(c("after_value") - c("before_value"), F.abs("before_value")) * F.lit(100.0)
    joined = joined.withColumn("measured_value", F.when(c("measure") == "LEVEL", c("after_value")).when(c("measure") == "CHANGE_PCT", change)
                               .otherwise(F.raise_error(F.concat(F.lit("unknown covenant measure "), c("measure")))))
    passed = F.when(c("comparator") == ">=", c("measured_value") >= c("threshold")).when(
        c("comparator") == "<=", c("measured_value") <= c("threshold")).otherwise(
        F.raise_error(F.concat(F.lit("unknown covenant comparator "), c("comparator"))))
    out = joined.withColumn("passed", F.coalesce(passed, F.lit(False)))
    out = out.withColumns({n: F.bround(n, 6) for n in ("before_value", "after_value", "measured_value")})
    return out.select("rule_code", "scenario_id", "scope", "metric", "measure", "before_value", "after_value",
                      "measured_value", "comparator", "threshold", "passed")


def failures(checked: DataFrame) -> DataFrame:
    """Failing checks in words."""
    c = F.col
    needs = F.format_string("%s (%s): %.2f, needs %s %s", c("rule_code"), c("scenario_id"), c("measured_value"),
                            c("comparator"), F.regexp_replace(c("threshold").cast("string"), r"\.0$", ""))
    unknown = F.format_string("%s (%s): could not be measured", c("rule_code"), c("scenario_id"))
    return checked.filter(~c("passed")).withColumn("message", F.when(c("measured_value").isNull(), unknown).otherwise(needs))


def verdict(checked: DataFrame) -> DataFrame:
    """How many checks there are and failed, and whether all passed; no check at all is refused when it is read."""
    none = F.raise_error("no covenant check was made").cast("boolean")
    return checked.agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"),
                       F.coalesce(F.every("passed"), none).alias("passed"))
