"""Schemas and the metric registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The planning dimensions. Alphabetical order is part of the
# signature, so it must not change.
DIMENSIONS = (
    "billing_type", "business_unit", "channel", "contract", "cost_center", "cost_pool", "customer",
    "delivery_shore", "engine", "funding_source", "geo_country", "geo_region", "grade",
    "intercompany_flag", "practice", "product", "project", "resource_employee", "revenue_type",
)
AXES = ("company", "account", "period_month")

GRAIN = ("company", "period_month", "account", "dim_signature_hash")
# The grain as a shuffle and sort key: the hash differs most, so comparing it first makes sorts short.
BY_HASH = ("dim_signature_hash", "account", "period_month", "company")
# Two vouchers on one grain are two postings; a correction keeps its voucher.
IDENTITY = (*BY_HASH, "voucher_no")
PLAN_GRAIN = (*BY_HASH, "scenario_id", "plan_version")

COST_TYPES = ("COGS", "OpEx")
SCENARIOS = ("base", "stretch", "downside")
BASE_SCENARIO = "base"
REPORT_CURRENCY = "USD"
MATERIALITY = 250000

QUANTITY = T.DecimalType(12, 4)
PRICE = T.DecimalType(14, 4)
AMOUNT = T.DecimalType(18, 2)
RATE = T.DecimalType(8, 4)


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


LEDGER_SCHEMA = T.StructType([
    *_text("company"), T.StructField("period_month", T.DateType()), *_text("account", *DIMENSIONS, "dim_signature_hash"),
    T.StructField("quantity", QUANTITY), T.StructField("unit_price", PRICE),
    T.StructField("amount_functional", AMOUNT), *_text("functional_currency", "voucher_no"),
    T.StructField("_version", T.IntegerType()), T.StructField("_is_deleted", T.IntegerType()),
])
PLAN_SCHEMA = T.StructType([
    *_text("plan_version", "scenario_id"), T.StructField("revision", T.IntegerType()),
    *_text("company"), T.StructField("period_month", T.DateType()), *_text("account", *DIMENSIONS, "dim_signature_hash"),
    T.StructField("quantity", QUANTITY), T.StructField("unit_price", PRICE),
    T.StructField("amount_functional", AMOUNT), *_text("functional_currency", "plan_line_type"),
])
#: Recomputed lines have six places; live, frozen, staged and replaced lines are stored alike.
MOVED = T.DecimalType(18, 6)
STORED_PLAN_SCHEMA = T.StructType([
    T.StructField(f.name, MOVED) if f.name in ("quantity", "unit_price") else f for f in PLAN_SCHEMA.fields])
PREIMAGE_SCHEMA = T.StructType([T.StructField("preimage_for_revision", T.IntegerType()), *STORED_PLAN_SCHEMA.fields])
VINTAGE_SCHEMA = T.StructType([
    T.StructField("vintage", T.IntegerType()), T.StructField("closed_at", T.TimestampNTZType()), *_text("note"),
])
FX_ACTUAL_SCHEMA = T.StructType([
    T.StructField("period_month", T.DateType()), *_text("from_currency", "to_currency"), T.StructField("rate", RATE),
])
FX_PLAN_SCHEMA = T.StructType([*_text("plan_version"), *FX_ACTUAL_SCHEMA.fields])
ACCOUNT_SCHEMA = T.StructType(_text("account", "account_name", "account_type", "engine_tag"))
COMPANY_SCHEMA = T.StructType([
    *_text("company", "company_name", "geo_country", "geo_region", "functional_currency"),
    T.StructField("is_elimination_entity", T.IntegerType())])
CUSTOMER_SCHEMA = T.StructType(_text("customer", "customer_name", "industry", "segment", "geo_country"))
EMPLOYEE_SCHEMA = T.StructType([
    *_text("resource_employee", "employee_name", "national_id", "grade", "practice", "geo_country", "delivery_shore",
           "cost_center", "company"),
    T.StructField("annual_loaded_cost", AMOUNT), T.StructField("standard_bill_rate", AMOUNT), T.StructField("hire_date", T.DateType())])
PROJECT_SCHEMA = T.StructType([
    *_text("project", "project_name", "customer", "practice", "engine", "billing_type", "company"),
    T.StructField("start_date", T.DateType()), T.StructField("end_date", T.DateType())])

TABLE_SCHEMAS = {
    "ledger": LEDGER_SCHEMA, "plan": PLAN_SCHEMA, "vintage": VINTAGE_SCHEMA,
    "fx_actual": FX_ACTUAL_SCHEMA, "fx_plan": FX_PLAN_SCHEMA, "account": ACCOUNT_SCHEMA, "company": COMPANY_SCHEMA,
    "customer": CUSTOMER_SCHEMA, "employee": EMPLOYEE_SCHEMA, "project": PROJECT_SCHEMA,
    "baseline": STORED_PLAN_SCHEMA, "staged": STORED_PLAN_SCHEMA, "preimage": PREIMAGE_SCHEMA,
}
#: The column that names one row of each master.
MASTER_KEYS = {"company": "company", "account": "account", "customer": "customer", "employee": "resource_employee",
               "project": "project"}

# Ledger accounts each measure adds up.
REVENUE_ACCOUNTS = ("41000", "41010", "41020", "41400")
DELIVERY_ACCOUNTS = ("51000", "51050", "51100", "51300", "51500")
SUBCONTRACTOR_ACCOUNTS = ("51100",)
BILLED_ACCOUNTS = ("41000", "41010", "41020")
CAPACITY_ACCOUNTS = ("51000", "51050", "51400")

ADDITIVE, RATIO, SEMI_ADDITIVE = "additive", "ratio", "semi_additive"


@dataclass(frozen=True)
class Measure:
    """A registered measure. Its kind, not the query, fixes how it aggregates."""

    name: str
    kind: str
    plus: tuple[str, ...] = ()
    minus: tuple[str, ...] = ()
    numerator: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None
    denominator: tuple[str, tuple[str, ...]] | None = None
    available: bool = True

    @property
    def accounts(self) -> tuple[str, ...]:
        return tuple(sorted((*self.plus, *self.minus)))

    def column(self) -> Column:
        if self.kind == ADDITIVE:
            return signed_sum("amount_functional", self.plus, self.minus)
        if self.kind == SEMI_ADDITIVE:
            return F.count_distinct(F.when(F.col("resource_employee") != "", F.col("resource_employee")))
        top, bottom = self.operands()
        return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))

    def operands(self) -> tuple[Column, Column]:
        """A ratio's numerator and denominator, each an exact sum."""
        field, plus, minus = self.numerator
        return signed_sum(field, plus, minus), signed_sum(self.denominator[0], self.denominator[1], ())


def sum_over(field: str, accounts: tuple[str, ...]) -> Column:
    value = F.sum(F.when(F.col("account").isin(*accounts), F.col(field)))
    kind = "decimal(28,2)" if field == "amount_functional" else "decimal(28,4)"
    return F.coalesce(value.cast(kind), F.lit(0).cast(kind))


def signed_sum(field: str, plus: tuple[str, ...], minus: tuple[str, ...]) -> Column:
    total = sum_over(field, plus)
    return (total - sum_over(field, minus)).cast("decimal(28,2)") if minus else total


MEASURES = {m.name: m for m in (
    Measure("services_revenue", ADDITIVE, REVENUE_ACCOUNTS),
    Measure("delivery_cost", ADDITIVE, DELIVERY_ACCOUNTS),
    Measure("subcontractor_cost", ADDITIVE, SUBCONTRACTOR_ACCOUNTS),
    Measure("gross_margin", ADDITIVE, REVENUE_ACCOUNTS, DELIVERY_ACCOUNTS),
    Measure("bookings", ADDITIVE, REVENUE_ACCOUNTS),
    Measure("utilisation", RATIO, numerator=("quantity", BILLED_ACCOUNTS, ()),
            denominator=("quantity", CAPACITY_ACCOUNTS)),
    Measure("realisation", RATIO, numerator=("amount_functional", BILLED_ACCOUNTS, ()),
            denominator=("quantity", BILLED_ACCOUNTS)),
    Measure("gross_margin_pct", RATIO, numerator=("amount_functional", REVENUE_ACCOUNTS, DELIVERY_ACCOUNTS),
            denominator=("amount_functional", REVENUE_ACCOUNTS)),
    Measure("headcount", SEMI_ADDITIVE),
    Measure("open_pipeline", SEMI_ADDITIVE, available=False),
)}


def measure(name: str) -> Measure:
    if name not in MEASURES:
        raise ValueError(f"unknown measure: {name}")
    if not MEASURES[name].available:
        raise ValueError(f"measure {name} is registered but has no data behind it")
    return MEASURES[name]
