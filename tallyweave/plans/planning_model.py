"""The planning model: drivers in dependency order, bindings, scenario overrides, covenants, state moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.formula import divide, held
from tallyweave.operators.recompute import Driver
from tallyweave.session import listed


def constant(code: str, value: float) -> Driver:
    return Driver(code, lambda v: F.lit(value), (), str(value), value)


# The driver library.
DRIVERS = (
    constant("attrition", 0.12),
    Driver("heads", lambda v: held() * (F.lit(1.0) - divide(v["attrition"], F.lit(12.0))), ("attrition",),
           "PRIOR(heads, 1) * (1 - attrition / 12)"),
    Driver("available_hours", lambda v: v["heads"] * F.lit(160.0), ("heads",), "heads * 160"),
    constant("utilisation", 0.75),
    Driver("billable_hours", lambda v: v["available_hours"] * v["utilisation"], ("available_hours", "utilisation"),
           "available_hours * utilisation"),
    constant("rate_increase", 0.03),
    Driver("bill_rate", lambda v: held() * (F.lit(1.0) + v["rate_increase"]), ("rate_increase",),
           "PRIOR(bill_rate, 12) * (1 + rate_increase)"),
    constant("realisation_factor", 0.92),
    Driver("realisation", lambda v: v["bill_rate"] * v["realisation_factor"], ("bill_rate", "realisation_factor"),
           "bill_rate * realisation_factor"),
    constant("customers", 900.0),
    constant("attach_rate", 0.40),
    Driver("support_customers", lambda v: v["customers"] * v["attach_rate"], ("customers", "attach_rate"),
           "customers * attach_rate"),
)

# Fixed values: (driver, account, target, elasticity).
BINDINGS = (
    ("utilisation", "41000", "quantity", 1.0), ("utilisation", "41010", "quantity", 0.6),
    ("utilisation", "41400", "quantity", 0.8), ("utilisation", "51000", "quantity", 0.35),
    ("utilisation", "51100", "quantity", 0.9), ("available_hours", "41000", "quantity", 1.0),
    ("available_hours", "51000", "quantity", 1.0), ("heads", "51000", "quantity", 1.0),
    ("heads", "51050", "quantity", 1.0), ("heads", "63100", "quantity", 0.4),
    ("bill_rate", "41000", "unit_price", 1.0), ("bill_rate", "41020", "unit_price", 1.0),
    ("realisation", "41000", "unit_price", 1.0), ("realisation", "41010", "unit_price", 0.7),
    ("attach_rate", "41300", "quantity", 1.0), ("attach_rate", "51400", "quantity", 0.5),
)

# Fixed values: (scenario, driver, value) replacing the base value in a branch.
OVERRIDES = (
    ("stretch", "utilisation", 0.78), ("stretch", "rate_increase", 0.05),
    ("downside", "utilisation", 0.70), ("downside", "attrition", 0.18),
)

# Fixed values: (rule, metric, measure, comparator, threshold, scope).
COVENANTS = (
    ("GM_PCT_FLOOR", "gross_margin_pct", "LEVEL", ">=", 30.0, "REQUEST"),
    ("REVENUE_DROP_LIMIT", "services_revenue", "CHANGE_PCT", ">=", -5.0, "REQUEST"),
    ("DELIVERY_COST_CEILING", "delivery_cost", "CHANGE_PCT", "<=", 3.0, "REQUEST"),
)

# Fixed values: (from, to, role) of a plan version's allowed moves.
TRANSITIONS = (
    ("DRAFT", "IN_REVIEW", "planner"), ("IN_REVIEW", "APPROVED", "controller"), ("IN_REVIEW", "REJECTED", "controller"),
    ("APPROVED", "LOCKED", "cfo"), ("APPROVED", "SUPERSEDED", "planner"), ("LOCKED", "SUPERSEDED", "planner"),
    ("APPROVED", "REJECTED", "cfo"),
)


def bindings(spark: SparkSession) -> DataFrame:
    return listed(spark, BINDINGS, "driver_code string, account_code string, target string, elasticity double")


def overrides(spark: SparkSession) -> DataFrame:
    return listed(spark, OVERRIDES, "scenario_id string, driver_code string, override_value double")


def covenants(spark: SparkSession, scenarios=("base", "stretch", "downside")) -> DataFrame:
    rows = [(*r, list(scenarios)) for r in COVENANTS]
    return listed(
        spark, rows, "rule_code string, metric string, measure string, comparator string, threshold double, scope string, "
              "scenarios array<string>")


def transitions(spark: SparkSession) -> DataFrame:
    return listed(spark, TRANSITIONS, "from_state string, to_state string, role_code string")
