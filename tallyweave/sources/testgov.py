"""Governance tables (shocks, publications, versions, runs, requests) derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.testcube import TestCube

# The drivers the derived shocks move, and their base values.
MOVED = (("utilisation", 0.75), ("attrition", 0.12), ("rate_increase", 0.03), ("attach_rate", 0.40))


def _pick(values) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("k") % len(values) + 1)


def moves(cube: TestCube) -> DataFrame:
    """Every event as a driver move: the plan is the user, size and scope come from its value and key."""
    none = F.array().cast("array<string>")
    base = _pick([v for _, v in MOVED])
    rows = cube.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.select(
        "event_id", "ts", "event_type", "k", "value", F.concat(F.lit("PV-"), "user_id").alias("plan_version"),
        _pick([c for c, _ in MOVED]).alias("driver_code"), base.alias("from_value"),
        (base * (F.lit(1.0) + F.col("value") / F.lit(1000.0))).alias("to_value"),
        F.when(F.col("k") % 5 == 0, F.array(F.concat(F.lit("NATION_"), F.col("k") % 25))).otherwise(none).alias("companies"),
        F.when(F.col("k") % 7 == 0, F.array(F.concat(F.lit("1998-0"), F.col("k") % 9 + 1, F.lit("-01")))).otherwise(none).alias("months"),
    )


def shock_set(cube: TestCube, event_type: str) -> DataFrame:
    """One kind of event as a shock set per plan: the last move of each (driver, scope)."""
    return (
        moves(cube).filter(F.col("event_type") == event_type)
        .groupBy("plan_version", "driver_code", "companies", "months")
        .agg(F.first("from_value").alias("from_value"), F.max_by("to_value", "event_id").alias("to_value"))
    )


def publications(cube: TestCube) -> DataFrame:
    """A revision per plan and day of the month, committed when something was bought and nothing failed."""
    kind = F.col("event_type")
    return (
        moves(cube).groupBy("plan_version", F.dayofmonth("ts").alias("revision"))
        .agg(F.bool_or(kind == "error").alias("failed"), F.bool_or(kind == "purchase").alias("bought"))
        .select("plan_version", "revision",
                F.when(F.col("failed"), "COMPENSATED").when(F.col("bought"), "COMMITTED").otherwise("RESERVED").alias("state"))
    )


def published_shocks(cube: TestCube) -> DataFrame:
    """The moves of each publication: the purchases of its day."""
    return moves(cube).filter(F.col("event_type") == "purchase").select(
        "plan_version", F.dayofmonth("ts").alias("revision"), "driver_code", "from_value", "to_value", "companies", "months", "event_id")


def versions(cube: TestCube) -> DataFrame:
    """A plan version per order; a customer's first order is the source the later ones replace."""
    orders = cube.table("orders")
    first = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    code = F.concat(F.lit("PV-"), F.col("o_orderkey"))
    source = F.concat(F.lit("PV-"), F.col("f.o_orderkey"))
    return orders.join(first, "o_custkey").select(
        code.alias("plan_version"), F.when(code != source, source).alias("supersedes"),
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("revision"),
        F.when(F.col("o_orderstatus") == "F", "LOCKED").when(F.col("o_orderstatus") == "O", "APPROVED").otherwise("DRAFT").alias("state"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total"), source.alias("source"),
        F.concat(F.lit("user_"), F.col("o_custkey")).alias("requested_by"))


# The state of a derived run, by its order's priority.
RUN_STATES = {"1": "RUNNING", "2": "AWAITING_APPROVAL", "3": "REJECTED", "4": "COMPLETED", "5": "AWAITING_LOCK"}


def runs(cube: TestCube) -> DataFrame:
    """A recompute run per pending order, against its customer's source version."""
    orders = cube.table("orders").filter(F.col("o_orderstatus") == "P").select("o_orderkey", "o_orderpriority", "o_totalprice")
    state = F.element_at(F.create_map(*[F.lit(x) for p in RUN_STATES.items() for x in p]), F.substring("o_orderpriority", 1, 1))
    code = F.concat(F.lit("PV-"), F.col("o_orderkey"))
    return (
        versions(cube).select(F.col("plan_version").alias("code"), F.col("source").alias("plan_version"),
                              F.col("created_at").alias("started_at"))
        .join(orders.withColumn("code", code), "code")
        .select(F.concat(F.lit("R-"), F.col("o_orderkey")).alias("run_id"), "plan_version", "started_at",
                F.when(F.col("o_totalprice") < 150000, F.expr("started_at + interval 90 days")).alias("ended_at"),
                state.alias("state"))
    )


def checks(cube: TestCube) -> DataFrame:
    """Covenant checks per order line."""
    rule = F.element_at(F.array(F.lit("DELIVERY_COST_CEILING"), F.lit("GM_PCT_FLOOR"), F.lit("REVENUE_DROP_LIMIT")),
                        F.col("l_linenumber") % 3 + 1)
    return cube.table("lineitem").select(
        F.concat(F.lit("R-"), F.col("l_orderkey")).alias("run_id"), F.concat(F.lit("PV-"), F.col("l_orderkey")).alias("plan_version"),
        rule.alias("rule_code"), F.col("l_linenumber").alias("check_no"), F.col("l_discount").alias("measured_value"),
        (F.col("l_discount") < 0.09).alias("passed"), (F.col("l_tax") < 0.02).alias("approved"))


def driver_history(cube: TestCube) -> DataFrame:
    """Effective-dated drivers: one row per supplier and year of trade, ending where the next begins."""
    rows = (
        cube.postings.groupBy("resource_employee", F.year("period_month").alias("year"))
        .agg(F.sum("quantity").cast("decimal(28,4)").alias("value"), F.count_if(F.col("l_returnflag") == "R").alias("returned"),
             F.count(F.lit(1)).alias("n"))
    )
    start = F.make_date("year", F.lit(1), F.lit(1))
    return rows.select(
        F.col("resource_employee").alias("driver_code"), F.col("value").cast("string").alias("formula"),
        start.alias("effective_from"), F.when(F.col("year") % 2 == 0, F.add_months(start, 12)).alias("effective_to"),
        F.when(F.col("returned") * 2 > F.col("n"), "RETIRED").otherwise("ACTIVE").alias("status"))
