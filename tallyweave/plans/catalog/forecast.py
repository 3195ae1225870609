"""Driver re-forecast, covenants, rates and intercompany, and the writers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyweave.functions import periods
from tallyweave.functions.money import cents, rounded
from tallyweave.model import GRAIN
from tallyweave.operators import asof, bridge, covenant, fx, lineage, recompute
from tallyweave.plans import planning_model as model
from tallyweave.plans.catalog.base import query, view
from tallyweave.plans.catalog.bridges import PLAN, even, lines_of, node_sql
from tallyweave.plans.catalog.reads import DEL, REV, rnd
from tallyweave.plans.metric import metric_query
from tallyweave.session import cut, listed, shared_dir
from tallyweave.sources import sinks, testgov
from tallyweave.sources.testcube import PLAN_VERSION

SCOPES = ["companies", "months"]
SET = ["plan_version", *SCOPES]

# -- derived governance tables, in check SQL -----------------------------------------------------

view("move", """
SELECT event_id, ts, event_type, k, value, 'PV-' || user_id AS plan_version,
       CASE k % 4 WHEN 0 THEN 'utilisation' WHEN 1 THEN 'attrition' WHEN 2 THEN 'rate_increase' ELSE 'attach_rate' END AS driver_code,
       b AS from_value, b * (1.0::DOUBLE + value / 1000.0::DOUBLE) AS to_value,
       CASE WHEN k % 5 = 0 THEN ['NATION_' || (k % 25)] ELSE [] END AS companies,
       CASE WHEN k % 7 = 0 THEN ['1998-0' || (k % 9 + 1) || '-01'] ELSE [] END AS months
FROM (SELECT *, CASE k % 4 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 0.12::DOUBLE WHEN 2 THEN 0.03::DOUBLE ELSE 0.40::DOUBLE END AS b
      FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))
""")
for _name, _type in (("committed_set", "purchase"), ("requested_set", "signup")):
    view(_name, f"""
SELECT plan_version, driver_code, companies, months, first(from_value) AS from_value, arg_max(to_value, event_id) AS to_value
FROM move WHERE event_type = '{_type}' GROUP BY ALL""")
view("plan_version_dim", """
SELECT 'PV-' || o_orderkey AS plan_version, CASE WHEN o_orderkey <> fk THEN 'PV-' || fk END AS supersedes,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS revision,
       CASE o_orderstatus WHEN 'F' THEN 'LOCKED' WHEN 'O' THEN 'APPROVED' ELSE 'DRAFT' END AS state,
       o_orderdate AS created_at, o_totalprice AS total, 'PV-' || fk AS source, o_orderkey, o_orderstatus, o_orderpriority,
       'user_' || o_custkey AS requested_by
FROM (SELECT *, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS fk FROM orders)
""")
view("run_dim", """
SELECT 'R-' || o_orderkey AS run_id, source AS plan_version, created_at AS started_at,
       CASE WHEN total < 150000 THEN created_at + INTERVAL 90 DAY END AS ended_at,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'RUNNING' WHEN '2' THEN 'AWAITING_APPROVAL' WHEN '3' THEN 'REJECTED'
            WHEN '4' THEN 'COMPLETED' ELSE 'AWAITING_LOCK' END AS state
FROM plan_version_dim WHERE o_orderstatus = 'P'
""")
view("check_dim", """
SELECT 'R-' || l_orderkey AS run_id, 'PV-' || l_orderkey AS plan_version,
       CASE l_linenumber % 3 WHEN 0 THEN 'DELIVERY_COST_CEILING' WHEN 1 THEN 'GM_PCT_FLOOR' ELSE 'REVENUE_DROP_LIMIT' END AS rule_code,
       l_linenumber AS check_no, l_discount AS measured_value, l_discount < 0.09 AS passed, l_tax < 0.02 AS approved
FROM lineitem
""")
view("driver_dim", """
SELECT resource_employee AS driver_code, CAST(CAST(sum(quantity) AS DECIMAL(28,4)) AS VARCHAR) AS formula,
       make_date(year(period_month), 1, 1) AS effective_from,
       CASE WHEN year(period_month) % 2 = 0 THEN make_date(year(period_month) + 1, 1, 1) END AS effective_to,
       CASE WHEN count(*) FILTER (l_returnflag = 'R') * 2 > count(*) THEN 'RETIRED' ELSE 'ACTIVE' END AS status
FROM cube_posting GROUP BY resource_employee, year(period_month)
""")

# -- drivers in force ----------------------------------------------------------------------------

_IN_FORCE = "status = 'ACTIVE' AND effective_from <= DATE '1998-07-01' AND (effective_to IS NULL OR effective_to > DATE '1998-07-01')"
MOMENT = "1998-07-01"


@query("drivers_effective", f"SELECT * FROM driver_dim WHERE {_IN_FORCE}")
def drivers_effective(cube):
    return asof.drivers_as_of(testgov.driver_history(cube), F.lit(MOMENT).cast("date"))


@query("drivers_unknown", f"""
SELECT DISTINCT s_name AS driver_code FROM supplier WHERE NOT EXISTS (SELECT 1 FROM driver_dim WHERE driver_code = s_name AND {_IN_FORCE})""")
def drivers_unknown(cube):
    asked = cube.table("supplier").select(F.col("s_name").alias("driver_code"))
    return asof.unknown_drivers(asked, testgov.driver_history(cube), F.lit(MOMENT).cast("date"))


@query("driver_latest_effective", f"""
SELECT driver_code, max(effective_from) AS effective_from, arg_max(formula, effective_from) AS formula
FROM driver_dim WHERE {_IN_FORCE} GROUP BY ALL""")
def driver_latest_effective(cube):
    now = asof.driver_now(testgov.driver_history(cube), F.lit(MOMENT).cast("date"))
    return now.select("driver_code", "effective_from", "formula")


# -- shocks, closure, ratios, factors ---------------------------------------------------------------


@query("shock_merge", """
SELECT coalesce(c.plan_version, r.plan_version) AS plan_version, coalesce(c.driver_code, r.driver_code) AS driver_code,
       coalesce(c.companies, r.companies) AS companies, coalesce(c.months, r.months) AS months,
       coalesce(c.from_value, r.from_value) AS from_value, coalesce(r.to_value, c.to_value) AS to_value
FROM committed_set c FULL JOIN requested_set r ON c.plan_version = r.plan_version AND c.driver_code = r.driver_code
     AND c.companies = r.companies AND c.months = r.months""")
def shock_merge(cube):
    return recompute.merge_shocks(testgov.shock_set(cube, "purchase"), testgov.shock_set(cube, "signup"), ["plan_version"])


@query("committed_shocks", """
SELECT m.plan_version, revision, driver_code, from_value, to_value, companies, months, event_id
FROM move m JOIN (SELECT plan_version, max(revision) AS revision FROM (
    SELECT plan_version, CAST(day(ts) AS INTEGER) AS revision FROM move GROUP BY ALL
    HAVING NOT bool_or(event_type = 'error') AND bool_or(event_type = 'purchase')) GROUP BY ALL) p
  ON p.plan_version = m.plan_version AND day(ts) = revision
WHERE event_type = 'purchase'""")
def committed_shocks(cube):
    return recompute.committed_shocks(testgov.publications(cube), testgov.published_shocks(cube))


def _edges(cube):
    region, nation = cube.table("region"), cube.table("nation")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    top = named.select(F.col("n_name").alias("driver"), F.col("r_name").alias("depends_on"))
    low = cube.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("driver"), F.col("n_name").alias("depends_on"))
    buyers = cube.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("driver"), F.col("n_name").alias("depends_on"))
    return top.unionByName(low).unionByName(buyers)


view("driver_edge", """
SELECT n_name AS driver, r_name AS depends_on FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
_ROOTS = "SELECT r_name AS driver, CAST(1 + r_regionkey * 0.01 AS DOUBLE) AS ratio FROM region UNION ALL SELECT n_name, CAST(1 - n_nationkey * 0.001 AS DOUBLE) FROM nation"
_REACH = """WITH RECURSIVE reach AS (
  SELECT depends_on AS driver, driver AS dependent FROM driver_edge WHERE depends_on IN (SELECT driver FROM roots)
  UNION SELECT r.driver, e.driver FROM reach r JOIN driver_edge e ON e.depends_on = r.dependent)"""
view("roots", _ROOTS)


def _roots(cube):
    region = cube.table("region").select(F.col("r_name").alias("driver_code"), F.lit(1.0).alias("from_value"),
                                         (F.lit(1.0) + F.col("r_regionkey") * F.lit(0.01)).alias("to_value"))
    nation = cube.table("nation").select(F.col("n_name").alias("driver_code"), F.lit(1.0).alias("from_value"),
                                         (F.lit(1.0) - F.col("n_nationkey") * F.lit(0.001)).alias("to_value"))
    return region.unionByName(nation)


@query("driver_closure", f"{_REACH} SELECT driver, dependent FROM reach")
def driver_closure(cube):
    return recompute.closure(_edges(cube), _roots(cube).select(F.col("driver_code").alias("driver")))


@query("driver_ratio_inherit", f"""{_REACH}
SELECT driver_code, {rnd('product(ratio)', 10)} AS ratio FROM (
  SELECT dependent AS driver_code, ratio FROM reach JOIN roots USING (driver) UNION ALL SELECT driver, ratio FROM roots) GROUP BY ALL""")
def driver_ratio_inherit(cube):
    shocks = _roots(cube)
    pairs = recompute.closure(_edges(cube), shocks.select(F.col("driver_code").alias("driver")))
    return recompute.inherited_ratios(pairs, shocks).withColumn("ratio", rounded(F.col("ratio"), 10))


_VALUES = {  # driver: (value over its inputs, which pinned drivers reach it)
    "attrition": ("{attrition}", ["attrition"]), "heads": ("1.0::DOUBLE * (1.0::DOUBLE - {attrition} / 12.0::DOUBLE)", ["attrition"]),
    "available_hours": ("1.0::DOUBLE * (1.0::DOUBLE - {attrition} / 12.0::DOUBLE) * 160.0::DOUBLE", ["attrition"]),
    "utilisation": ("{utilisation}", ["utilisation"]),
    "billable_hours": ("1.0::DOUBLE * (1.0::DOUBLE - {attrition} / 12.0::DOUBLE) * 160.0::DOUBLE * {utilisation}", ["attrition", "utilisation"]),
    "rate_increase": ("{rate_increase}", ["rate_increase"]), "bill_rate": ("1.0::DOUBLE * (1.0::DOUBLE + {rate_increase})", ["rate_increase"]),
    "realisation": ("1.0::DOUBLE * (1.0::DOUBLE + {rate_increase}) * 0.92::DOUBLE", ["rate_increase"]),
    "attach_rate": ("{attach_rate}", ["attach_rate"]), "support_customers": ("900.0::DOUBLE * {attach_rate}", ["attach_rate"]),
}
_BASE = {"attrition": "0.12", "utilisation": "0.75", "rate_increase": "0.03", "attach_rate": "0.40"}
_FORMULAS = {d.code: d.text for d in model.DRIVERS}


def _ratio_rows(source: str, keys: str) -> str:
    pins = ", ".join(f"max(CASE WHEN driver_code = '{d}' THEN {s}_value END) AS {s}_{d}" for d in _BASE for s in ("from", "to"))
    parts = []
    for code, (value, roots) in _VALUES.items():
        old, new = ({d: f"coalesce({s}_{d}, {b}::DOUBLE)" for d, b in _BASE.items()} for s in ("from", "to"))
        dirty = " OR ".join(f"from_{r} IS NOT NULL" for r in roots)
        direct = f"from_{code} IS NOT NULL" if code in _BASE else "false"
        parts.append(f"SELECT {keys}, '{code}' AS driver_code, {value.format(**old)} AS from_value, {value.format(**new)} AS to_value, "
                     f"{direct} AS shocked_directly, '{_FORMULAS[code]}' AS formula FROM grid WHERE {dirty}")
    return f"""
SELECT *, to_value / from_value AS ratio, from_value = 0 AS inherited FROM (
WITH grid AS (SELECT {keys}, {pins} FROM {source} GROUP BY ALL) {' UNION ALL '.join(parts)})"""


view("ratio_row", _ratio_rows("requested_set", "plan_version, companies, months"))


@query("driver_ratio_eval", f"""
SELECT plan_version, companies, months, driver_code, {rnd('from_value', 10)} AS from_value, {rnd('to_value', 10)} AS to_value,
       {rnd('ratio', 10)} AS ratio, shocked_directly, formula, inherited FROM ratio_row""")
def driver_ratio_eval(cube):
    """A what-if grid: one shock set per (plan, scope), every reached driver evaluated by its formula."""
    grid = recompute.shock_grid(testgov.shock_set(cube, "signup"), model.DRIVERS, SET)
    out = recompute.evaluate_ratios(grid, model.DRIVERS, SET)
    return out.withColumns({n: rounded(F.col(n), 10) for n in ("from_value", "to_value", "ratio")})


_BINDINGS = ",".join(f"('{d}','{a}','{t}',{e}::DOUBLE)" for d, a, t, e in model.BINDINGS)
view("binding", f"SELECT * FROM (VALUES {_BINDINGS}) b(driver_code, account_code, target, elasticity)")


def _grid_factors(cube):
    grid = recompute.shock_grid(testgov.shock_set(cube, "signup"), model.DRIVERS, SET)
    return recompute.account_factors(recompute.evaluate_ratios(grid, model.DRIVERS, SET), model.bindings(cube.spark), SET)


@query("account_factors", f"""
SELECT plan_version, companies, months, account_code, target,
       {rnd('product(1.0::DOUBLE + elasticity * (ratio - 1.0::DOUBLE))', 8)} AS factor, CAST(count(*) AS INTEGER) AS drivers
FROM ratio_row JOIN binding USING (driver_code) GROUP BY ALL""")
def account_factors(cube):
    return _grid_factors(cube).select(*SET, "account_code", "target", rounded(F.col("factor"), 8).alias("factor"),
                                      F.size("sources").alias("drivers"))


@query("dirty_scopes", """
SELECT plan_version, companies, months, list_sort(list_distinct(list(account_code))) AS accounts
FROM ratio_row JOIN binding USING (driver_code) GROUP BY ALL""")
def dirty_scopes(cube):
    return recompute.dirty_scopes(_grid_factors(cube), ["plan_version"])


# -- one re-forecast over the whole plan ----------------------------------------------------------------

SHOCKS = (
    ("utilisation", 0.75, 0.72, [], []),
    ("rate_increase", 0.03, 0.05, ["NATION_1", "NATION_7", "NATION_12"], []),
    ("attrition", 0.12, 0.18, [], ["1998-01-01", "1998-02-01", "1998-03-01"]),
)
REVISION = 2


def _shocks(cube, rows=SHOCKS):
    return listed(
        cube.spark, rows, "driver_code string, from_value double, to_value double, companies array<string>, months array<string>")


def factors_of(cube, rows=SHOCKS):
    return recompute.plan_factors(_shocks(cube, rows), model.DRIVERS, model.bindings(cube.spark))


def _arr(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


view("shock", " UNION ALL ".join(
    f"SELECT '{d}' AS driver_code, {a}::DOUBLE AS from_value, {b}::DOUBLE AS to_value, {_arr(c)} AS companies, {_arr(m)} AS months"
    for d, a, b, c, m in SHOCKS))
view("shock_ratio", _ratio_rows("shock", "companies, months"))
view("factor", """
SELECT companies, months, account_code AS account, target, product(1.0::DOUBLE + elasticity * (ratio - 1.0::DOUBLE)) AS factor
FROM shock_ratio JOIN binding USING (driver_code) GROUP BY ALL""")
_APPLIES = ("(len(f.companies) = 0 OR list_contains(f.companies, p.company)) "
            "AND (len(f.months) = 0 OR list_contains(f.months, CAST(p.period_month AS VARCHAR)))")
KEY = "plan_version, scenario_id, company, period_month, account, dim_signature_hash"
view("line_factor", f"""
SELECT {', '.join('p.' + k for k in KEY.split(', '))},
       coalesce(product(factor) FILTER (target = 'quantity'), 1) AS quantity_factor,
       coalesce(product(factor) FILTER (target = 'unit_price'), 1) AS unit_price_factor
FROM plan p JOIN factor f ON f.account = p.account AND {_APPLIES} GROUP BY ALL""")
view("recomputed", f"""
SELECT *, CAST(round(nq * np, 2) AS DECIMAL(18,2)) AS na FROM (
  SELECT p.*, quantity_factor, unit_price_factor, CAST(CAST(quantity AS DOUBLE) * quantity_factor AS DECIMAL(18,6)) AS nq,
         CAST(CAST(unit_price AS DOUBLE) * unit_price_factor AS DECIMAL(18,6)) AS np
  FROM plan p JOIN line_factor USING ({KEY}))""")
view("staged", f"""
SELECT plan_version, scenario_id, CAST({REVISION} AS INTEGER) AS revision, company, period_month, account, business_unit, geo_country,
       geo_region, grade, intercompany_flag, practice, dim_signature_hash, nq AS quantity, np AS unit_price, na AS amount_functional,
       functional_currency, plan_line_type FROM recomputed""")
view("baseline", "SELECT * REPLACE (CAST(quantity AS DECIMAL(18,6)) AS quantity, CAST(unit_price AS DECIMAL(18,6)) AS unit_price) FROM plan")


def _recomputed(cube, scenarios=("base", "stretch", "downside")):
    return recompute.recompute_lines(cube.plan(scenarios), factors_of(cube)[0])


def _staged(cube, scenarios=("base", "stretch", "downside")):
    plan = cube.plan(scenarios)
    return recompute.stage(_recomputed(cube, scenarios), REVISION, plan.columns)


def fresh_folder(cube, name: str) -> str:
    return f"{shared_dir(cube.spark)}/{name}-{uuid.uuid4().hex}"


@query("dirty_counts", f"""
SELECT scenario_id, period_month, count(*) AS lines FROM line_factor GROUP BY ALL""")
def dirty_counts(cube):
    return recompute.dirty_counts(cube.plan(), recompute.dirty_scopes(factors_of(cube)[0]))


@query("recompute_lines", f"""
SELECT {KEY}, nq AS quantity, np AS unit_price, na AS amount_functional, {rnd('quantity_factor', 8)} AS quantity_factor,
       {rnd('unit_price_factor', 8)} AS unit_price_factor FROM recomputed""")
def recompute_lines(cube):
    out = _recomputed(cube)
    return out.select(*recompute.LINE_KEY, "quantity", "unit_price", "amount_functional",
                      *[rounded(F.col(n), 8).alias(n) for n in ("quantity_factor", "unit_price_factor")])


@query("recompute_requested_only", f"""
SELECT {KEY}, nq AS quantity, np AS unit_price, na AS amount_functional FROM recomputed
WHERE account IN ('41000','41010','41020') AND company IN ('NATION_1','NATION_7','NATION_12')""")
def recompute_requested_only(cube):
    """Every merged move applies, but only lines the requested move reaches are rewritten."""
    requested = recompute.dirty_scopes(factors_of(cube, SHOCKS[1:2])[0])
    out = recompute.recompute_lines(cube.plan(), factors_of(cube)[0], requested)
    return out.select(*recompute.LINE_KEY, "quantity", "unit_price", "amount_functional")


_LABEL = "concat_ws('; ', CASE WHEN len(companies) > 0 THEN array_to_string(list_sort(companies), ',') END, CASE WHEN len(months) > 0 THEN array_to_string(list_sort(months), ',') END)"
view("trace_ratio", f"SELECT *, {_LABEL} AS label FROM shock_ratio")
view("trace_scope", f"""
SELECT {', '.join('p.' + k for k in KEY.split(', '))}, f.label, f.companies, f.months
FROM plan p JOIN (SELECT DISTINCT account_code AS account, companies, months, label FROM trace_ratio JOIN binding USING (driver_code)) f
  ON f.account = p.account AND {_APPLIES} WHERE p.scenario_id = 'base'""")
view("trace_line", f"""
SELECT {KEY}, list_sort(list(DISTINCT label)) AS moves, array_to_string(list_sort(list(DISTINCT driver_code) FILTER (shocked_directly)), ', ') AS driver,
       CAST(count(*) AS INTEGER) AS drivers FROM trace_scope JOIN trace_ratio USING (label) GROUP BY ALL""")
_MOVE = "CASE WHEN label = '' THEN r.driver_code ELSE r.driver_code || ' @ ' || label END"
_TERM = f"'(1 + ' || CAST(elasticity AS VARCHAR) || ' * ([' || {_MOVE} || '] - 1))'"
view("trace_binding", f"""
SELECT {KEY}, CAST(count(*) AS INTEGER) AS bindings,
       concat_ws(' * ', 'quantity', string_agg({_TERM}, ' * ' ORDER BY label, r.driver_code) FILTER (target = 'quantity')) || '; '
       || concat_ws(' * ', 'unit_price', string_agg({_TERM}, ' * ' ORDER BY label, r.driver_code) FILTER (target = 'unit_price')) AS expression
FROM trace_scope s JOIN trace_ratio r USING (label) JOIN binding b ON b.driver_code = r.driver_code AND b.account_code = s.account GROUP BY ALL""")


def traced(cube):
    factors, ratios = factors_of(cube)
    return lineage.traces(recompute.recompute_lines(cube.base_plan, factors, sources=True), factors, ratios)


@query("derivation_trace", f"""
SELECT {KEY}, l.moves, l.driver, false AS by_binding, b.expression, l.drivers, b.bindings, quantity AS baseline_quantity, unit_price AS baseline_unit_price,
       nq AS quantity, np AS unit_price, na AS amount_functional, {rnd('quantity_factor', 8)} AS quantity_factor, {rnd('unit_price_factor', 8)} AS unit_price_factor
FROM recomputed JOIN trace_line l USING ({KEY}) JOIN trace_binding b USING ({KEY})""")
def derivation_trace(cube):
    """Every governed line with the moves behind it, what they made of it and from which numbers."""
    return traced(cube).select(
        *recompute.LINE_KEY, "moves", "driver", "by_binding", "expression", F.size("drivers").alias("drivers"), F.size("bindings").alias("bindings"),
        "baseline_quantity", "baseline_unit_price", "quantity", "unit_price", "amount_functional",
        *[rounded(F.col(n), 8).alias(n) for n in ("quantity_factor", "unit_price_factor")])


@query("derivation_drivers", f"""
SELECT label, driver_code AS driver, {rnd('from_value', 8)} AS from_value, {rnd('to_value', 8)} AS to_value, {rnd('ratio', 8)} AS ratio, shocked_directly,
       formula, CASE WHEN inherited THEN '{lineage.ZERO_BASE.replace("'", "''")}' END AS note FROM trace_ratio""")
def derivation_drivers(cube):
    """The dictionary that the lines' moves are looked up in: every driver of every scope."""
    return lineage.driver_records(factors_of(cube)[1]).select(
        "label", "driver", *[rounded(F.col(n), 8).alias(n) for n in ("from_value", "to_value", "ratio")], "shocked_directly", "formula", "note")


@query("derivation_trace_json", f"""
SELECT {KEY}, amount_functional AS amount, json_extract_string(trace, '$.driver') AS driver, json_extract_string(trace, '$.formula') AS formula,
       json_extract_string(trace, '$.inputs.baseline.quantity') AS was, json_extract_string(trace, '$.result.quantity') AS now FROM (
  SELECT {KEY}, na AS amount_functional, to_json({{'driver': l.driver, 'formula': b.expression, 'inputs': {{'baseline': {{'quantity': CAST(quantity AS VARCHAR)}}}},
         'result': {{'quantity': CAST(nq AS VARCHAR)}}}}) AS trace
  FROM recomputed JOIN trace_line l USING ({KEY}) JOIN trace_binding b USING ({KEY}))""")
def derivation_trace_json(cube):
    """The traces as governed lines store them, read back from their JSON."""
    out = lineage.trace_json(traced(cube))
    return out.select(*recompute.LINE_KEY, F.col("amount_functional").alias("amount"), *[
        F.get_json_object("trace", path).alias(name) for name, path in (
            ("driver", "$.driver"), ("formula", "$.formula"), ("was", "$.inputs.baseline.quantity"), ("now", "$.result.quantity"))])


@query("base_only_guard", """
SELECT scenario_id, count(*) AS staged, count(*) FILTER (scenario_id = 'base') AS governed FROM recomputed GROUP BY ALL""")
def base_only_guard(cube):
    """Every branch is staged; only base lines become governed records."""
    lines = _recomputed(cube)
    governed = recompute.base_only(lines).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("governed"))
    staged = lines.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("staged"))
    return staged.join(governed, "scenario_id", "left").withColumn("governed", F.coalesce("governed", F.lit(0).cast("long")))


@query("stage_revision", "SELECT * FROM staged")
def stage_revision(cube):
    return _staged(cube)


@query("preimage_semi", f"SELECT p.* FROM plan_live p SEMI JOIN (SELECT {KEY} FROM staged) s USING ({KEY})")
def preimage_semi(cube):
    live, staged = cube.plan_history(), _staged(cube)
    return recompute.preimage(live, staged, REVISION).drop("preimage_for_revision")


@query("publish_check", """
SELECT scenario_id, staged, expected FROM (
  SELECT scenario_id, count(*) AS staged, (SELECT count(*) FROM recomputed WHERE scenario_id = 'base') AS expected FROM staged
  WHERE NOT (scenario_id = 'downside' AND company = 'NATION_3') GROUP BY scenario_id) WHERE staged <> expected""")
def publish_check(cube):
    """A branch that staged fewer rows than were approved stops the publish."""
    staged = _staged(cube).filter(~((F.col("scenario_id") == "downside") & (F.col("company") == "NATION_3")))
    approved = _recomputed(cube, ("base",)).agg(F.count(F.lit(1))).scalar()
    return recompute.publish_mismatch(staged, PLAN_VERSION, REVISION, approved)


view("published", f"""
SELECT * FROM staged UNION ALL BY NAME SELECT p.* FROM baseline p ANTI JOIN (SELECT {KEY} FROM staged) s USING ({KEY})""")


@query("live_with_staged", f"""
SELECT p.plan_version, p.scenario_id, p.company, p.period_month, p.account, p.dim_signature_hash, p.amount_functional, s.amount_functional AS staged_amount,
       coalesce(s.amount_functional, p.amount_functional) AS after_amount
FROM plan p LEFT JOIN staged s USING ({KEY})""")
def live_with_staged(cube):
    return recompute.live_with_staged(cube.plan(), _staged(cube), PLAN_VERSION, REVISION).select(
        *recompute.LINE_KEY, "amount_functional", "staged_amount", "after_amount")


view("paired", f"""
SELECT {', '.join('b.' + k for k in KEY.split(', '))}, b.functional_currency, account_type, account_type <> 'Revenue' AS is_cost,
       b.quantity AS plan_quantity, b.unit_price AS plan_unit_price, b.amount_functional AS plan_amount,
       s.quantity AS actual_quantity, s.unit_price AS actual_unit_price, s.amount_functional AS actual_amount,
       rate AS plan_fx, rate AS actual_fx
FROM plan b JOIN staged s USING ({KEY}) JOIN account_dim d ON d.account = b.account
LEFT JOIN fx_plan f ON f.period_month = b.period_month AND f.from_currency = b.functional_currency""")
view("paired_leg", """
SELECT *, CAST(plan_amount * plan_fx AS DECIMAL(28,6)) AS plan_usd, CAST(actual_amount * actual_fx AS DECIMAL(28,6)) AS actual_usd,
       CAST(CAST(actual_amount - plan_unit_price * actual_quantity AS DECIMAL(27,10)) * plan_fx AS DECIMAL(36,14)) AS price_effect,
       CAST(CAST((actual_quantity - plan_quantity) * plan_unit_price AS DECIMAL(27,10)) * plan_fx AS DECIMAL(36,14)) AS quantity_effect,
       CAST(0 AS DECIMAL(28,6)) AS fx_effect,
       CAST(CAST(plan_quantity * plan_unit_price AS DECIMAL(27,10)) * plan_fx AS DECIMAL(36,14)) AS weight,
       CAST(actual_quantity - plan_quantity AS DECIMAL(20,6)) AS delta_quantity
FROM paired""")


@query("baseline_vs_staged", f"""
SELECT {KEY}, account_type, plan_quantity, plan_unit_price, plan_amount, actual_quantity, actual_unit_price, actual_amount, plan_fx
FROM paired""")
def baseline_vs_staged(cube):
    return recompute.baseline_vs_staged(cube.plan(), _staged(cube), cube.fx_plan, cube.accounts, PLAN_VERSION, REVISION).drop("actual_fx", "functional_currency")


_REFORECAST = ("level, line_count, plan_amount, actual_amount, gap, fx, "
               + ", ".join(f"CAST(round({n}, 2) AS DECIMAL(28,2)) AS {n}" for n in ("price", "rate", "efficiency"))
               + f", {rnd('volume', 2)} AS volume, {rnd('mix', 2)} AS mix, ties")


def _reforecast(nodes, *keys):
    shown = {n: cents(F.col(n)) for n in ("price", "rate", "efficiency")} | {n: rounded(F.col(n), 2) for n in ("volume", "mix")}
    return nodes.withColumns(shown).select(*keys, "level", "line_count", "plan_amount", "actual_amount", "gap", "fx", "price",
                                           "rate", "efficiency", "volume", "mix", "ties")


@query("bridge_reforecast", f"""
SELECT account, company, {_REFORECAST} FROM ({node_sql(['account', 'company'], 'paired_leg', where="scenario_id = 'base'")})""")
def bridge_reforecast(cube):
    """Why the base plan moved: the frozen baseline against the staged revision."""
    lines = recompute.baseline_vs_staged(cube.base_plan, _staged(cube, ("base",)), cube.fx_plan, cube.accounts, PLAN_VERSION, REVISION)
    return _reforecast(bridge.decompose(lines, ["account", "company"]), "account", "company")


@query("bridge_reforecast_by_scenario", f"""
SELECT scenario_id, account, company, period_month, {_REFORECAST}
FROM ({node_sql(['account', 'company', 'period_month'], 'paired_leg', extra='scenario_id')})""")
def bridge_reforecast_by_scenario(cube):
    lines = recompute.baseline_vs_staged(cube.plan(), _staged(cube), cube.fx_plan, cube.accounts, PLAN_VERSION, REVISION)
    levels = ["account", "company", "period_month"]
    return _reforecast(bridge.decompose(lines, levels, extra=["scenario_id"]), "scenario_id", *levels)


@query("plan_lines_top", """
SELECT l.*, t.line_count, t.total, t.companies, t.first_month, t.last_month FROM (
  SELECT company, period_month, account, dim_signature_hash, amount_functional FROM plan WHERE scenario_id = 'base'
  ORDER BY abs(amount_functional) DESC, company, period_month, account, dim_signature_hash LIMIT 200 OFFSET 20) l,
 (SELECT count(*) AS line_count, CAST(sum(amount_functional) AS DECIMAL(38,2)) AS total, list_sort(list(DISTINCT company)) AS companies,
         min(period_month) AS first_month, max(period_month) AS last_month FROM plan WHERE scenario_id = 'base') t""")
def plan_lines_top(cube):
    """A page of a version's largest lines beside the summary of all of them."""
    lines = cube.base_plan
    summary = lines.agg(F.struct(
        F.count(F.lit(1)).alias("line_count"), F.sum("amount_functional").cast("decimal(38,2)").alias("total"),
        F.array_sort(F.collect_set("company")).alias("companies"), F.min("period_month").alias("first_month"),
        F.max("period_month").alias("last_month"))).scalar()
    page = bridge.paged(lines.select(*GRAIN, "amount_functional"), [F.desc(F.abs("amount_functional")), *GRAIN], 200, 20)
    return page.withColumn("s", summary).select(*GRAIN, "amount_functional", "s.*")


# -- requests, versions, runs ------------------------------------------------------------------------------


@query("idempotency_key", """
SELECT plan_version, substr(sha256('{"plan_version":"' || plan_version || '","scenarios":["base","downside","stretch"],"shocks":['
       || string_agg('"' || s || '"', ',' ORDER BY s) || ']}'), 1, 32) AS request_key, count(*) AS shocks
FROM (SELECT plan_version, driver_code || ':' || CAST(CAST(floor(to_value * 1e6) AS BIGINT) AS VARCHAR) || ':' || array_to_string(companies, ',')
             || ':' || array_to_string(months, ',') AS s FROM requested_set) GROUP BY plan_version""")
def idempotency_key(cube):
    """The same request, in whatever order it was put together, has one key."""
    text = F.concat_ws(":", "driver_code", F.floor(F.col("to_value") * F.lit(1e6)).cast("string"),
                       F.array_join("companies", ","), F.array_join("months", ","))
    sets = testgov.shock_set(cube, "signup").groupBy("plan_version").agg(F.collect_list(text).alias("shocks"))
    key = recompute.idempotency_key(F.col("plan_version"), F.array(F.lit("stretch"), F.lit("base"), F.lit("downside")), F.col("shocks"))
    return sets.select("plan_version", key.alias("request_key"), F.size("shocks").cast("long").alias("shocks"))


_COVERS = ("(len(m.companies) = 0 OR (len(q.companies) > 0 AND list_has_all(m.companies, q.companies))) "
           "AND (len(m.months) = 0 OR (len(q.months) > 0 AND list_has_all(m.months, q.months)))")
_TOUCH = ("(len(m.companies) = 0 OR len(q.companies) = 0 OR list_has_any(m.companies, q.companies)) "
          "AND (len(m.months) = 0 OR len(q.months) = 0 OR list_has_any(m.months, q.months))")


def _slices(cube):
    return testgov.moves(cube).filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("request_id"), "plan_version", "driver_code", F.col("from_value").alias("base_value"), *SCOPES)


@query("current_driver_value", f"""
SELECT request_id, base_value, refused, CASE WHEN NOT refused THEN {rnd('base_value * moved')} END AS current_value FROM (
  SELECT q.event_id AS request_id, first(q.from_value) AS base_value,
         coalesce(product(CASE WHEN {_COVERS} THEN m.to_value / m.from_value END), 1) AS moved,
         coalesce(bool_or(NOT ({_COVERS}) AND {_TOUCH}), false) AS refused
  FROM (SELECT * FROM move WHERE event_type = 'signup') q
  LEFT JOIN committed_set m ON m.plan_version = q.plan_version AND m.driver_code = q.driver_code GROUP BY q.event_id)""")
def current_driver_value(cube):
    out = recompute.current_value(_slices(cube), testgov.shock_set(cube, "purchase"), ["request_id"])
    return out.withColumn("current_value", rounded(F.col("current_value"), 8))


@query("target_from_change", f"""
WITH ask AS (
  SELECT event_id AS request_id, driver_code, from_value AS base_value, from_value AS current_value,
         CASE WHEN k % 3 = 0 THEN value / 400.0::DOUBLE END AS to_value, CASE WHEN k % 3 = 1 THEN (value - 40.0::DOUBLE) / 200.0::DOUBLE END AS by_amount,
         CASE WHEN k % 3 = 2 THEN 20.0::DOUBLE - value END AS by_percent FROM move WHERE event_type IN ('signup', 'view')),
t AS (SELECT *, CASE WHEN to_value IS NOT NULL THEN to_value WHEN by_amount IS NOT NULL THEN round_even(current_value + by_amount, 10)
        ELSE round_even(current_value * (1.0::DOUBLE + by_percent / 100.0::DOUBLE), 10) END AS target FROM ask),
r AS (SELECT *, CASE WHEN to_value <= 0 THEN 'to_value must be greater than zero'
        WHEN base_value <= 1 AND to_value > 1 THEN 'a ratio driver takes a value up to one'
        WHEN base_value <= 1 AND abs(by_amount) > 1 THEN 'a ratio driver moves by less than one'
        WHEN target <= 0 THEN 'that change leaves no positive value'
        WHEN abs(target - current_value) < 1e-12 THEN 'the driver already has that value' END AS refusal FROM t)
SELECT request_id, driver_code, refusal, CASE WHEN refusal IS NULL THEN {rnd('target')} END AS target,
       CASE WHEN to_value IS NOT NULL THEN 'absolute' WHEN by_amount IS NOT NULL THEN 'points' ELSE 'relative' END AS change_basis,
       {rnd('''CASE WHEN by_amount IS NOT NULL THEN current_value * (1.0::DOUBLE + (target - current_value))
                    WHEN by_percent IS NOT NULL THEN current_value + (target - current_value) / current_value END''')} AS alternative_value
FROM r""")
def target_from_change(cube):
    k, value = F.col("k"), F.col("value")
    asked = testgov.moves(cube).filter(F.col("event_type").isin("signup", "view")).select(
        F.col("event_id").alias("request_id"), "driver_code", F.col("from_value").alias("base_value"),
        F.col("from_value").alias("current_value"), F.when(k % 3 == 0, value / F.lit(400.0)).alias("to_value"),
        F.when(k % 3 == 1, (value - F.lit(40.0)) / F.lit(200.0)).alias("by_amount"),
        F.when(k % 3 == 2, F.lit(20.0) - value).alias("by_percent"))
    out = recompute.resolve_target(asked)
    return out.select("request_id", "driver_code", "refusal", rounded(F.col("target"), 8).alias("target"), "change_basis",
                      rounded(F.col("alternative_value"), 8).alias("alternative_value"))


@query("reason_covers_revision", """
SELECT a.plan_version, a.d AS day, a.asked, len(a.asked) > 0 AND list_has_all(coalesce(h.have, []), a.asked) AS covered
FROM (SELECT plan_version, CAST(day(ts) AS INTEGER) AS d, list_sort(list_distinct(list(driver_code) FILTER (event_type = 'signup'))) AS asked
      FROM move GROUP BY ALL) a
LEFT JOIN (SELECT plan_version, list_distinct(list(driver_code)) AS have FROM committed_set
           WHERE len(companies) = 0 AND len(months) = 0 GROUP BY ALL) h USING (plan_version)
""".replace("list_sort(list_distinct(list(driver_code) FILTER (event_type = 'signup')))",
            "coalesce(list_sort(list_distinct(list(driver_code) FILTER (event_type = 'signup'))), [])"))
def reason_covers_revision(cube):
    """A day's reason names drivers; it belongs to the plan's unscoped published moves when they hold all of them."""
    asked = testgov.moves(cube).groupBy("plan_version", F.dayofmonth("ts").alias("day")).agg(
        F.array_sort(F.collect_set(F.when(F.col("event_type") == "signup", F.col("driver_code")))).alias("asked"))
    unscoped = (F.size("companies") == 0) & (F.size("months") == 0)
    have = testgov.shock_set(cube, "purchase").filter(unscoped).groupBy("plan_version").agg(
        F.collect_set("driver_code").alias("have"))
    joined = asked.join(have, "plan_version", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return joined.select("plan_version", "day", "asked", recompute.reason_covers(F.col("asked"), F.col("have")).alias("covered"))


@query("version_lineage", """
SELECT v.plan_version, v.state, v.revision, v.supersedes, s.state AS supersedes_state, coalesce(n.successors, 0) AS successors, n.newest_successor
FROM plan_version_dim v LEFT JOIN plan_version_dim s ON s.plan_version = v.supersedes
LEFT JOIN (SELECT supersedes AS plan_version, count(*) AS successors, arg_max(plan_version, (revision, plan_version)) AS newest_successor
           FROM plan_version_dim WHERE supersedes IS NOT NULL GROUP BY ALL) n ON n.plan_version = v.plan_version""")
def version_lineage(cube):
    return recompute.version_lineage(testgov.versions(cube)).select(
        "plan_version", "state", "revision", "supersedes", "supersedes_state", "successors", "newest_successor")


@query("version_successors", """
SELECT supersedes AS plan_version, plan_version AS successor, state, revision FROM plan_version_dim
WHERE supersedes IN (SELECT plan_version FROM plan_version_dim WHERE state = 'LOCKED')""")
def version_successors(cube):
    """The chain behind every locked version: one row per successor."""
    versions = testgov.versions(cube)
    return recompute.version_successors(versions, versions.filter(F.col("state") == "LOCKED"))


@query("supersede_versions", """
SELECT plan_version, state, CASE WHEN state = 'LOCKED' AND (
    EXISTS (SELECT 1 FROM plan_version_dim n WHERE n.supersedes = v.plan_version AND n.state = 'LOCKED')
    OR EXISTS (SELECT 1 FROM plan_version_dim n WHERE n.supersedes = v.supersedes AND n.state = 'LOCKED' AND n.revision > v.revision))
  THEN 'SUPERSEDED' ELSE state END AS state_after FROM plan_version_dim v""")
def supersede_versions(cube):
    return recompute.supersede(testgov.versions(cube)).select("plan_version", "state", "state_after")


@query("run_window_join", """
SELECT r.run_id, r.plan_version, r.started_at, r.ended_at,
       (SELECT arg_min(v.plan_version, (v.created_at, v.plan_version)) FROM plan_version_dim v WHERE v.supersedes = r.plan_version
          AND v.created_at >= r.started_at AND v.created_at <= coalesce(r.ended_at, TIMESTAMP '2002-01-01')) AS successor
FROM run_dim r""")
def run_window_join(cube):
    found = recompute.first_successor_in_run(testgov.runs(cube), testgov.versions(cube), F.to_timestamp_ntz(F.lit("2002-01-01")))
    return found.select("run_id", "plan_version", "started_at", "ended_at", "successor")


@query("request_version", """
SELECT r.run_id, c.v AS checked_version, coalesce(c.v,
       (SELECT arg_min(v.plan_version, (v.created_at, v.plan_version)) FROM plan_version_dim v WHERE v.supersedes = r.plan_version
          AND v.created_at >= r.started_at AND v.created_at <= coalesce(r.ended_at, TIMESTAMP '2002-01-01'))) AS version
FROM run_dim r LEFT JOIN (SELECT run_id, arg_min(plan_version, check_no) AS v FROM check_dim WHERE check_no > 3 GROUP BY ALL) c USING (run_id)""")
def request_version(cube):
    """The version a run drafted: named by its checks (those from the fourth on), else by the time it was open."""
    found = recompute.request_version(testgov.runs(cube), testgov.checks(cube).filter("check_no > 3"), testgov.versions(cube),
                                      F.to_timestamp_ntz(F.lit("2002-01-01")))
    return found.select("run_id", "checked_version", "version")


@query("request_state", """
SELECT 'Q-' || o_orderkey AS request_id, coalesce(CASE r.state WHEN 'RUNNING' THEN 'RUNNING' WHEN 'AWAITING_APPROVAL' THEN 'AWAITING_CONTROLLER'
         WHEN 'AWAITING_LOCK' THEN 'AWAITING_CFO' WHEN 'COMPLETED' THEN 'PUBLISHED' WHEN 'REJECTED' THEN
           CASE WHEN c.failed THEN 'COVENANT_FAILED' WHEN c.approved THEN 'CFO_REJECTED' ELSE 'CONTROLLER_REJECTED' END END, 'CONFIRMED') AS state
FROM orders LEFT JOIN run_dim r ON r.run_id = 'R-' || o_orderkey
LEFT JOIN (SELECT run_id, bool_or(NOT passed) AS failed, bool_or(approved) AS approved FROM check_dim GROUP BY ALL) c USING (run_id)""")
def request_state(cube):
    requests = cube.table("orders").select(
        F.concat(F.lit("Q-"), F.col("o_orderkey")).alias("request_id"), F.concat(F.lit("R-"), F.col("o_orderkey")).alias("run_id"),
        F.lit("CONFIRMED").alias("state"))
    return recompute.request_state(requests, testgov.runs(cube), testgov.checks(cube)).select("request_id", "state")


_RULES = ",".join(f"('{r}','{m}','{k}','{c}',{t}::DOUBLE,'{s}')" for r, m, k, c, t, s in model.COVENANTS)


@query("request_checks", f"""
SELECT run_id, rule_code, check_no, metric, comparator, threshold, measured_value, passed, plan_version, state
FROM check_dim JOIN (VALUES {_RULES}) k(rule_code, metric, measure, comparator, threshold, scope) USING (rule_code)
JOIN plan_version_dim USING (plan_version)""")
def request_checks(cube):
    rules = model.covenants(cube.spark).drop("scenarios")
    return (
        testgov.checks(cube).join(rules, "rule_code").join(testgov.versions(cube).select("plan_version", "state"), "plan_version")
        .select("run_id", "rule_code", "check_no", "metric", "comparator", "threshold", "measured_value", "passed", "plan_version", "state")
    )


@query("run_history", """
SELECT run_id, plan_version, v.state AS version_state, r.state, started_at FROM run_dim r JOIN plan_version_dim v USING (plan_version)
WHERE r.state = 'COMPLETED' ORDER BY started_at DESC, run_id LIMIT 50""")
def run_history(cube):
    versions = testgov.versions(cube).select("plan_version", F.col("state").alias("version_state"))
    done = testgov.runs(cube).filter(F.col("state") == "COMPLETED").join(versions, "plan_version")
    return bridge.paged(done, [F.desc("started_at"), "run_id"], 50).select(
        "run_id", "plan_version", "version_state", "state", "started_at")


@query("scenario_branches", f"""
SELECT company, s.scenario_id, d.driver_code, {rnd('coalesce(o.v, d.base_value)')} AS value, o.v IS NOT NULL AS overridden FROM (
  SELECT company, 'utilisation' AS driver_code, CAST(sum(CASE WHEN account IN ('41000','41010','41020') THEN quantity END) AS DOUBLE)
    / CAST(sum(CASE WHEN account IN ('51000','51050','51400') THEN quantity END) AS DOUBLE) AS base_value FROM live GROUP BY ALL
  UNION ALL SELECT DISTINCT company, 'rate_increase', 0.03::DOUBLE FROM live UNION ALL SELECT DISTINCT company, 'attrition', 0.12::DOUBLE FROM live) d
CROSS JOIN (VALUES ('base'), ('stretch'), ('downside')) s(scenario_id)
LEFT JOIN (VALUES ('stretch','utilisation',0.78::DOUBLE),('stretch','rate_increase',0.05::DOUBLE),('downside','utilisation',0.70::DOUBLE),
                  ('downside','attrition',0.18::DOUBLE)) o(scenario_id, driver_code, v) ON o.scenario_id = s.scenario_id AND o.driver_code = d.driver_code
""")
def scenario_branches(cube):
    """Each company's drivers (its own measured utilisation) in every branch."""
    own = metric_query(cube, ["utilisation"], ["company"])
    values = F.array(*[F.struct(F.lit(c).alias("driver_code"), v.alias("base_value")) for c, v in (
        ("utilisation", F.col("utilisation")), ("rate_increase", F.lit(0.03)), ("attrition", F.lit(0.12)))])
    drivers = own.select("company", F.explode(values).alias("d")).select("company", "d.*")
    scenarios = listed(cube.spark, [("base",), ("stretch",), ("downside",)], "scenario_id string")
    out = recompute.scenario_drivers(drivers, scenarios, model.overrides(cube.spark))
    return out.select("company", "scenario_id", "driver_code", rounded(F.col("value"), 8).alias("value"),
                      F.col("override_value").isNotNull().alias("overridden"))


# -- covenants ------------------------------------------------------------------------------------------------

ASKED_COMPANIES = ["NATION_1", "NATION_7", "NATION_12"]
ASKED_MONTHS = [str(periods.add_months(periods.bounds("1998")[0], n)) for n in range(6)]
_RATED = f"""
SELECT p.*, coalesce(s.amount_functional, p.amount_functional) AS after_amount, rate,
       company IN ({', '.join(repr(c) for c in ASKED_COMPANIES)}) AND period_month >= DATE '1998-01-01' AND period_month < DATE '1998-07-01' AS inside
FROM plan p LEFT JOIN (SELECT {KEY}, amount_functional FROM staged) s USING ({KEY})
LEFT JOIN fx_plan f ON f.period_month = p.period_month AND f.from_currency = p.functional_currency"""
view("rated", _RATED)


def _usd(amount: str, accounts: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN account IN {accounts} THEN CAST({amount} * rate AS DECIMAL(28,6)) END), 0) AS DECIMAL(38,6))"


_FIGURE = (f"{_usd('amount_functional', REV)} AS before_revenue, {_usd('amount_functional', DEL)} AS before_cost, "
           f"{_usd('after_amount', REV)} AS after_revenue, {_usd('after_amount', DEL)} AS after_cost")
view("figure", f"""
SELECT scenario_id, 'PLAN' AS scope, {_FIGURE} FROM rated GROUP BY ALL
UNION ALL SELECT scenario_id, 'REQUEST', {_FIGURE} FROM rated WHERE inside GROUP BY ALL""")


def figures_of(cube):
    lines = recompute.with_after_amounts(cube.plan(), factors_of(cube)[0])
    return covenant.figures_of(lines, cube.fx_plan, PLAN_VERSION, ASKED_COMPANIES, ASKED_MONTHS)


@query("covenant_figures", "SELECT * FROM figure")
def covenant_figures(cube):
    """Before and after a staged revision; the checks below read both from one scan instead."""
    return covenant.figures(cube.plan(), _staged(cube), cube.fx_plan, PLAN_VERSION, REVISION, ASKED_COMPANIES, ASKED_MONTHS)


def _metric(side: str) -> str:
    r, c = f"CAST({side}_revenue AS DOUBLE)", f"CAST({side}_cost AS DOUBLE)"
    return (f"CASE metric WHEN 'services_revenue' THEN {r} WHEN 'delivery_cost' THEN {c} ELSE ({r} - {c}) / nullif({r}, 0) * 100.0::DOUBLE END")


view("covenant_row", f"""
SELECT *, coalesce(CASE comparator WHEN '>=' THEN m >= threshold ELSE m <= threshold END, false) AS passed FROM (
  SELECT *, CASE measure WHEN 'LEVEL' THEN a ELSE (a - b) / nullif(abs(b), 0) * 100.0::DOUBLE END AS m FROM (
    SELECT rule_code, f.scenario_id, scope, metric, measure, comparator, threshold, {_metric('before')} AS b, {_metric('after')} AS a
    FROM (VALUES {_RULES}) k(rule_code, metric, measure, comparator, threshold, scope) JOIN figure f USING (scope)))""")


@query("covenant_checks", f"""
SELECT rule_code, scenario_id, scope, metric, measure, {rnd('b', 4)} AS before_value, {rnd('a', 4)} AS after_value,
       {rnd('m', 4)} AS measured_value, comparator, threshold, passed FROM covenant_row""")
def covenant_checks(cube):
    out = covenant.checks(model.covenants(cube.spark), figures_of(cube))
    return out.withColumns({n: rounded(F.col(n), 4) for n in ("before_value", "after_value", "measured_value")})


@query("covenant_failures", """
SELECT rule_code, scenario_id, rule_code || ' (' || scenario_id || '): ' || coalesce(printf('%.2f', m) || ', needs ' || comparator || ' '
       || CAST(CAST(threshold AS INTEGER) AS VARCHAR), 'could not be measured') AS message FROM covenant_row WHERE NOT passed""")
def covenant_failures(cube):
    checked = covenant.checks(model.covenants(cube.spark), figures_of(cube))
    return covenant.failures(checked).select("rule_code", "scenario_id", "message")


@query("covenant_verdict", """
SELECT count(*) AS checks, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS passed FROM covenant_row""")
def covenant_verdict(cube):
    return covenant.verdict(covenant.checks(model.covenants(cube.spark), figures_of(cube)))


# -- rates and intercompany -------------------------------------------------------------------------------------

_BROKEN = """
SELECT period_month, from_currency, CASE WHEN from_currency = 'CUR_2' AND period_month = DATE '1996-05-01' THEN CAST(0 AS DECIMAL(8,4))
       ELSE rate END AS rate FROM fx_plan WHERE NOT (from_currency = 'CUR_3' AND period_month >= DATE '2001-01-01')
UNION ALL SELECT period_month, from_currency, rate FROM fx_plan WHERE from_currency = 'CUR_1' AND period_month = DATE '1997-03-01'"""


@query("fx_validity", f"""
SELECT p.company, p.period_month, p.account, p.dim_signature_hash, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'nonpositive' END AS problem
FROM plan p LEFT JOIN (SELECT period_month, from_currency, count(*) AS n, min(rate) AS rate FROM ({_BROKEN}) GROUP BY ALL) f
  ON f.period_month = p.period_month AND f.from_currency = p.functional_currency
WHERE scenario_id = 'base' AND (n IS NULL OR n > 1 OR rate <= 0)""")
def fx_validity(cube):
    """Plan lines that a rate table with a gap, a repeat and a zero would leave untranslated."""
    month, currency = F.col("period_month"), F.col("from_currency")
    rates = cube.fx_plan
    gap = (currency == "CUR_3") & (month >= F.lit("2001-01-01").cast("date"))
    zero = (currency == "CUR_2") & (month == F.lit("1996-05-01").cast("date"))
    broken = rates.filter(~gap).withColumn("rate", F.when(zero, F.lit(0).cast("decimal(8,4)")).otherwise(F.col("rate"))).unionByName(
        rates.filter((currency == "CUR_1") & (month == F.lit("1997-03-01").cast("date"))))
    return fx.invalid_rates(cube.base_plan, broken, PLAN_VERSION).select(*GRAIN, "problem")


@query("commitment_rollup", """
SELECT scenario_id, plan_line_type, CAST(round(sum(CAST(amount_functional * rate AS DECIMAL(28,6))), 2) AS DECIMAL(28,2)) AS amount_usd
FROM plan_live p JOIN fx_plan f ON f.period_month = p.period_month AND f.from_currency = p.functional_currency GROUP BY ALL""")
def commitment_rollup(cube):
    return fx.commitments(asof.plan_current(cube.plan_history(), PLAN_VERSION), cube.fx_plan, PLAN_VERSION)


view("internal_trade", """
SELECT company, period_month, account, dim_signature_hash, intercompany_flag, functional_currency, amount_functional FROM live
WHERE intercompany_flag = 'Yes' AND account IN ('41000','41010','41020','41400')
UNION ALL SELECT geo_country, period_month, '51500', dim_signature_hash, intercompany_flag, functional_currency, amount_functional FROM live
WHERE intercompany_flag = 'Yes' AND account IN ('41000','41010','41020') """)


def _internal_trade(cube):
    """Flagged sales, each but the 41400 ones with its mirror cost on the buying company."""
    sales = fx.intercompany(asof.ledger_as_of(cube.ledger, cube.vintages)).filter(
        F.col("account").isin("41000", "41010", "41020", "41400"))
    row = [F.struct(F.col("company").alias("company"), F.col("account").alias("account")),
           F.struct(F.col("geo_country").alias("company"), F.lit(fx.MIRROR_ACCOUNT).alias("account"))]
    both = F.explode(F.when(F.col("account") == "41400", F.array(row[0])).otherwise(F.array(*row)))
    return sales.select(both.alias("r"), "period_month", "dim_signature_hash", "intercompany_flag", "functional_currency",
                        "amount_functional").select("r.*", "period_month", "dim_signature_hash", "intercompany_flag",
                                                    "functional_currency", "amount_functional")


@query("intercompany_net", """
SELECT t.period_month, CAST(sum(CASE WHEN account = '51500' THEN -1 ELSE 1 END * CAST(amount_functional * rate AS DECIMAL(28,6))) AS DECIMAL(38,6)) AS net_usd,
       count(*) AS rows
FROM internal_trade t JOIN fx_actual f ON f.period_month = t.period_month AND f.from_currency = t.functional_currency GROUP BY ALL""")
def intercompany_net(cube):
    return fx.intercompany_net(_internal_trade(cube), cube.fx_actual, "period_month")


@query("intercompany_unpaired", """
SELECT dim_signature_hash, period_month, count(*) FILTER (account <> '51500') AS sales, count(*) FILTER (account = '51500') AS mirrors
FROM internal_trade GROUP BY ALL HAVING sales <> mirrors""")
def intercompany_unpaired(cube):
    return fx.intercompany_unpaired(_internal_trade(cube))


@query("intercompany_eliminate", """
SELECT company, account, CAST(sum(amount_functional) AS DECIMAL(28,2)) AS amount, count(*) AS rows
FROM live WHERE intercompany_flag <> 'Yes' GROUP BY ALL""")
def intercompany_eliminate(cube):
    kept = bridge.without_intercompany(asof.ledger_as_of(cube.ledger, cube.vintages))
    return kept.groupBy("company", "account").agg(
        F.sum("amount_functional").cast("decimal(28,2)").alias("amount"), F.count(F.lit(1)).alias("rows"))


# -- writers ----------------------------------------------------------------------------------------------------


@query("snk_partitioned", """
SELECT company, period_month, account, dim_signature_hash, voucher_no, _version, _is_deleted, quantity, amount_functional FROM ledger
WHERE period_month >= DATE '1997-01-01' AND period_month < DATE '1999-01-01'""")
def snk_partitioned(cube):
    """The ledger written by month, then two years of it read back from their folders alone."""
    path = fresh_folder(cube, "ledger")
    sinks.write_partitioned(cube.ledger, path)
    kept = cube.spark.read.parquet(path).filter(periods.within(*periods.bounds("1997..1998")))
    return kept.select(*GRAIN, "voucher_no", "_version", "_is_deleted", "quantity", "amount_functional")


@query("snk_baseline_once", "SELECT * FROM plan_live")
def snk_baseline_once(cube):
    """A frozen plan: the second freeze, of a changed plan, leaves the first one standing."""
    path = fresh_folder(cube, "baseline")
    frozen = sinks.freeze_baseline(cube.plan_history(), PLAN_VERSION, path)
    again = sinks.freeze_baseline(cube.plan(("base",)), PLAN_VERSION, path)
    return again.select(*[c for c in cube.plan_history().columns if c in frozen.columns])


@query("snk_plan_import", """
SELECT plan_version, scenario_id, company, period_month, account, dim_signature_hash, CAST(quantity AS DECIMAL(18,6)) AS quantity,
       CAST(unit_price AS DECIMAL(18,6)) AS unit_price, amount_functional, functional_currency,
       '{"driver":"imported_plan","formula":"amount_functional = round(quantity x unit_price, 2)","inputs":{"quantity":"'
       || CAST(CAST(quantity AS DECIMAL(18,6)) AS VARCHAR) || '","unit_price":"' || CAST(CAST(unit_price AS DECIMAL(18,6)) AS VARCHAR)
       || '","source":{"table":"plan","plan_version":"PV-1","scenario":"base","revision":1}},"method":"imported_plan"}' AS trace,
       false AS cents_differ
FROM plan_history WHERE scenario_id = 'base' AND revision = 1""")
def snk_plan_import(cube):
    return sinks.import_base_lines(cube.plan_history(), PLAN_VERSION)


@query("snk_report", f"""
SELECT line_no, level, plan, actual, cited FROM (
  SELECT row_number() OVER (ORDER BY practice NULLS FIRST, geo_region NULLS FIRST) AS line_no, level, practice, geo_region,
         {even('plan_amount')} AS plan, {even('actual_amount')} AS actual FROM node2) n
LEFT JOIN (SELECT practice, geo_region, count(*) AS cited FROM leg GROUP BY ALL) c
  ON n.level = 2 AND c.practice = n.practice AND c.geo_region = n.geo_region""".replace("actual, cited FROM (", "actual, coalesce(cited, 0) AS cited FROM ("))
def snk_report(cube):
    """A report stored as head, node lines and leaf citations; storing it again changes nothing."""
    levels = ["practice", "geo_region"]
    path = fresh_folder(cube, "reports")
    lines = lines_of(cube, *levels)
    nodes = bridge.decompose(lines, levels)
    rows = cut(bridge.report_rows(nodes, levels))
    leaf = rows.filter(F.size("path") == len(levels)).select(
        "line_no", *[F.col("path")[i].alias(d) for i, d in enumerate(levels)])
    cited = lines.join(leaf, levels).select("line_no", *GRAIN, "plan_amount", "actual_amount", "plan_quantity", "actual_quantity",
                                            "plan_unit_price", "plan_fx", "actual_fx", "account_type")
    head = nodes.filter(F.col("level") == 0).select(
        F.lit(PLAN[0]).alias("plan_version"), F.lit(PLAN[1]).alias("scenario"), "line_count", "gap", "ties",
        bridge.status(F.col("gap")).alias("status"))
    stored = [sinks.persist_report("r1", head, rows, cited, path) for _ in range(2)]
    if stored != [True, False]:
        raise RuntimeError(f"a report id was stored as {stored}")
    read = cube.spark.read.parquet
    counts = read(f"{path}/citation").groupBy("line_no").agg(F.count(F.lit(1)).alias("cited"))
    return (
        read(f"{path}/line").join(counts, "line_no", "left")
        .select("line_no", "level", "plan", "actual", F.coalesce("cited", F.lit(0).cast("long")).alias("cited"))
    )


