"""Joins of plan to actual, the variance bridge and vintage comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.money import rounded
from tallyweave.functions.periods import within
from tallyweave.model import GRAIN
from tallyweave.operators import asof, bridge, explain, vintage
from tallyweave.plans.catalog.base import query, view
from tallyweave.plans.catalog.reads import AUGUST, DEL, JULY, MEASURE_SQL, REV, rnd
from tallyweave.plans.metric import metric_query
from tallyweave.session import cut
from tallyweave.sources.testcube import CUBE_DIMS, PLAN_VERSION

PLAN = (PLAN_VERSION, "base")
MARGIN_ACCOUNTS = REV[:-1] + "," + DEL[1:]


def dec(precision: int, scale: int, value: str) -> str:
    return f"CAST({value} AS DECIMAL({precision},{scale}))"


def units(value: str, places: int) -> str:
    """A double as a decimal: floor(x·10^n + ½) units."""
    return (f"CAST(CAST(CAST(floor(({value}) * 1e{places} + 0.5) AS HUGEINT) AS DECIMAL(20,0)) "
            f"* CAST(1e-{places} AS DECIMAL({places + 1},{places})) AS DECIMAL(38,{places}))")


def even(value: str) -> str:
    """Half-even cents of a decimal: step back from an exact half that landed on an odd cent."""
    near = f"round({value}, 2)"
    return (f"CAST(CASE WHEN abs({near} - ({value})) = 0.005 AND CAST(abs({near}) * 100 AS HUGEINT) % 2 = 1 "
            f"THEN {near} - sign({value}) * CAST(0.01 AS DECIMAL(3,2)) ELSE {near} END AS DECIMAL(28,2))")


view("matched", f"""
SELECT a.*, account_type, p.quantity AS plan_quantity, p.unit_price AS plan_unit_price, p.amount_functional AS plan_amount,
       fp.rate AS plan_fx, fa.rate AS actual_fx
FROM (SELECT company, period_month, account, dim_signature_hash, functional_currency, business_unit, geo_country,
             geo_region, grade, practice, {dec(16, 4, 'sum(quantity)')} AS actual_quantity,
             {dec(18, 2, 'sum(amount_functional)')} AS actual_amount
      FROM live WHERE intercompany_flag <> 'Yes' GROUP BY ALL) a
JOIN plan p ON p.scenario_id = 'base' AND p.company = a.company AND p.period_month = a.period_month
     AND p.account = a.account AND p.dim_signature_hash = a.dim_signature_hash
JOIN account_dim d ON d.account = a.account
JOIN fx_plan fp ON fp.period_month = a.period_month AND fp.from_currency = a.functional_currency
JOIN fx_actual fa ON fa.period_month = a.period_month AND fa.from_currency = a.functional_currency
""")


def _leg_view(price: str, quantity: str, weight: str) -> str:
    return f"""
SELECT *, account_type <> 'Revenue' AS is_cost,
       {dec(28, 6, 'plan_amount * plan_fx')} AS plan_usd, {dec(28, 6, 'actual_amount * actual_fx')} AS actual_usd,
       {dec(36, 14, price)} AS price_effect, {dec(36, 14, quantity)} AS quantity_effect,
       {dec(28, 6, 'actual_amount * (actual_fx - plan_fx)')} AS fx_effect, {dec(36, 14, weight)} AS weight,
       {dec(20, 6, 'actual_quantity - plan_quantity')} AS delta_quantity
FROM matched_priced WHERE account IN {MARGIN_ACCOUNTS}
"""


view("matched_priced", f"""
SELECT *, {dec(20, 6, 'coalesce(' + units('CAST(actual_amount AS DOUBLE) / nullif(CAST(actual_quantity AS DOUBLE), 0)', 6) + ', 0)')}
       AS actual_unit_price FROM matched
""")
view("leg", _leg_view(
    f"{dec(27, 10, 'actual_amount - plan_unit_price * actual_quantity')} * plan_fx",
    f"{dec(27, 10, '(actual_quantity - plan_quantity) * plan_unit_price')} * plan_fx",
    f"{dec(27, 10, 'plan_quantity * plan_unit_price')} * plan_fx"))
_BOUGHT = dec(27, 10, "plan_quantity * actual_unit_price")
view("leg_price_first", _leg_view(
    f"({_BOUGHT} - {dec(27, 10, 'plan_quantity * plan_unit_price')}) * plan_fx",
    f"(actual_amount - {_BOUGHT}) * plan_fx",
    f"{_BOUGHT} * plan_fx"))


def node_sql(levels: list[str], source: str = "leg", extra: str = "", margin: str | None = None, where: str = "true") -> str:
    """Oracle nodes: straight from the lines with ROLLUP, margin as a sign on each cost line."""
    head = "".join(f"{d}, " for d in ([extra] if extra else []) + levels)
    keys = ", ".join(([extra] if extra else []))
    roll = f"ROLLUP ({', '.join(levels)})" if levels else ""
    group = ", ".join(k for k in (keys, roll) if k) or "ALL"
    depth = len(levels)
    level = f"CAST({depth} - bit_count(GROUPING({', '.join(levels)})) AS INTEGER)" if levels else "CAST(0 AS INTEGER)"
    per = f"PARTITION BY {extra}" if extra else ""
    flag = margin or f"(bool_or(is_cost) OVER ({per}) AND bool_or(NOT is_cost) OVER ({per}))"

    def s(value: str, scale: int, side: str = "") -> str:
        pick = {"": value, "r": f"CASE WHEN NOT is_cost THEN {value} END", "c": f"CASE WHEN is_cost THEN {value} END"}[side]
        return f"CAST(coalesce(sum({pick}), 0) AS DECIMAL({ {14: 32, 6: 28}[scale]},{scale}))"

    avg = (f"coalesce(CAST({s('weight', 14, 'r')} AS DOUBLE) / nullif(CAST({s('plan_quantity', 6, 'r')} AS DOUBLE), 0), 0)")
    return f"""
SELECT {head}level, line_count, plan_amount, actual_amount, gap, price, volume, CAST(quantity_variance AS DOUBLE) - volume AS mix,
       fx, rate, efficiency, quantity_variance, avg_plan_price,
       CAST(gap - (price + quantity_variance + fx + rate + efficiency) AS DECIMAL(32,14)) AS residual, tolerance,
       abs(CAST(gap - (price + quantity_variance + fx + rate + efficiency) AS DECIMAL(32,14))) < tolerance AS ties
FROM (SELECT *, CAST(actual_amount - plan_amount AS DECIMAL(28,6)) AS gap,
             CAST(dq AS DOUBLE) * avg_plan_price AS volume FROM (
  SELECT {head}{level} AS level, count(*) AS line_count,
         {s('sgn * plan_usd', 6)} AS plan_amount, {s('sgn * actual_usd', 6)} AS actual_amount, {s('sgn * fx_effect', 6)} AS fx,
         {s('price_effect', 14, 'r')} AS price, {s('sgn * price_effect', 14, 'c')} AS rate,
         {s('sgn * quantity_effect', 14, 'c')} AS efficiency, {s('quantity_effect', 14, 'r')} AS quantity_variance,
         {s('delta_quantity', 6, 'r')} AS dq, {avg} AS avg_plan_price,
         CAST(greatest(1, count(*) * 0.01::DECIMAL(3,2)) AS DECIMAL(22,2)) AS tolerance
  FROM (SELECT *, CASE WHEN is_cost AND {flag} THEN -1 ELSE 1 END AS sgn FROM {source} WHERE {where})
  GROUP BY {group}))
"""


EXACT = "level, line_count, plan_amount, actual_amount, gap, price, fx, rate, efficiency, quantity_variance, residual, tolerance, ties"
SHOWN = f"{EXACT}, {rnd('volume', 4)} AS volume, {rnd('mix', 4)} AS mix, {rnd('avg_plan_price', 6)} AS avg_plan_price"


def shown(nodes):
    return nodes.withColumns({"volume": rounded(F.col("volume"), 4), "mix": rounded(F.col("mix"), 4),
                              "avg_plan_price": rounded(F.col("avg_plan_price"), 6)})


def lines_of(cube, *dims, measures=("gross_margin",)):
    return bridge.bridge_lines(cube, list(measures), PLAN, list(dims))


LINE_COLUMNS = [*GRAIN, "functional_currency", "practice", "geo_region", "actual_quantity", "actual_amount", "account_type",
                "plan_quantity", "plan_unit_price", "plan_amount", "plan_fx", "actual_fx"]


@query("bridge_lines", f"SELECT {', '.join(LINE_COLUMNS)} FROM matched WHERE account IN {MARGIN_ACCOUNTS}")
def bridge_lines(cube):
    return lines_of(cube, "practice", "geo_region").select(*LINE_COLUMNS)


@query("plan_actual_overlap", """
SELECT count(*) AS matched_keys FROM (SELECT DISTINCT company, period_month, account, dim_signature_hash FROM plan
  WHERE scenario_id = 'base') p JOIN (SELECT DISTINCT company, period_month, account, dim_signature_hash FROM ledger
  WHERE period_month >= DATE '1997-01-01' AND period_month < DATE '2000-01-01') a
USING (company, period_month, account, dim_signature_hash)
""")
def plan_actual_overlap(cube):
    start, end = F.lit("1997-01-01").cast("date"), F.lit("2000-01-01").cast("date")
    inside = (F.col("period_month") >= start) & (F.col("period_month") < end)
    posted = cube.ledger.filter(inside).select(*GRAIN).distinct()
    planned = cube.base_plan.filter(inside).select(*GRAIN).distinct()
    return planned.join(posted, list(GRAIN)).agg(F.count(F.lit(1)).alias("matched_keys"))


LEG_COLUMNS = [*GRAIN, "is_cost", "actual_unit_price", "plan_usd", "actual_usd", "price_effect", "quantity_effect", "fx_effect",
               "weight", "delta_quantity"]


@query("bridge_line_legs", f"SELECT {', '.join(LEG_COLUMNS)} FROM leg")
def bridge_line_legs(cube):
    return bridge.line_legs(lines_of(cube)).select(*LEG_COLUMNS)


@query("bridge_decompose", f"SELECT practice, geo_region, {SHOWN} FROM ({node_sql(['practice', 'geo_region'])})")
def bridge_decompose(cube):
    return shown(bridge.decompose(lines_of(cube, "practice", "geo_region"), ["practice", "geo_region"]))


@query("bridge_price_first", f"SELECT practice, geo_region, {SHOWN} FROM ({node_sql(['practice', 'geo_region'], 'leg_price_first')})")
def bridge_price_first(cube):
    return shown(bridge.decompose(lines_of(cube, "practice", "geo_region"), ["practice", "geo_region"], bridge.PRICE_FIRST))


_MARGIN_CASES = (("services_revenue", REV), ("delivery_cost", DEL), ("gross_margin", MARGIN_ACCOUNTS))


@query("bridge_margin", " UNION ALL ".join(
    f"SELECT '{name}' AS measure, {SHOWN} FROM ({node_sql([], where=f'account IN {accounts}')})" for name, accounts in _MARGIN_CASES))
def bridge_margin(cube):
    """Root nodes of a revenue, a cost and a margin bridge: only the last one turns cost negative."""
    # the lines of all three are matched once and kept; each bridge takes those of its accounts
    lines = cut(lines_of(cube, measures=[name for name, _ in _MARGIN_CASES]).select(
        "account", "account_type", "plan_fx", "actual_fx", "plan_quantity", "plan_unit_price", "plan_amount", "actual_quantity", "actual_amount"))
    out = None
    for name, _ in _MARGIN_CASES:
        root = shown(bridge.decompose(lines.filter(F.col("account").isin(*bridge.bridge_accounts([name]))))).withColumn("measure", F.lit(name))
        out = root if out is None else out.unionByName(root)
    return out


@query("bridge_margin_forced", f"SELECT practice, {SHOWN} FROM ({node_sql(['practice'], margin='false')})")
def bridge_margin_forced(cube):
    return shown(bridge.decompose(lines_of(cube, "practice"), ["practice"], margin=False))


@query("bridge_avg_price", f"""
SELECT company, grade, level, {rnd('avg_plan_price', 6)} AS avg_plan_price FROM ({node_sql(['company', 'grade'])})""")
def bridge_avg_price(cube):
    nodes = bridge.decompose(lines_of(cube, "company", "grade"), ["company", "grade"])
    return nodes.select("company", "grade", "level", rounded(F.col("avg_plan_price"), 6).alias("avg_plan_price"))


view("node3", node_sql(["practice", "geo_region", "grade"]))


@query("bridge_mix_levels", f"""
SELECT level_name, {rnd('sum(between_)', 2)} AS mix FROM (
  SELECT CASE level WHEN 0 THEN 'practice' WHEN 1 THEN 'geo_region' WHEN 2 THEN 'grade' ELSE 'signature' END AS level_name,
    CASE WHEN level = 3 THEN mix ELSE coalesce((SELECT sum(c.volume) FROM node3 c WHERE c.level = n.level + 1
      AND (n.level < 1 OR c.practice IS NOT DISTINCT FROM n.practice) AND (n.level < 2 OR c.geo_region IS NOT DISTINCT FROM n.geo_region)), 0)
      - volume END AS between_ FROM node3 n) GROUP BY ALL
""")
def bridge_mix_levels(cube):
    levels = ["practice", "geo_region", "grade"]
    nodes = bridge.decompose(lines_of(cube, *levels), levels)
    return bridge.mix_by_level(nodes, levels).withColumn("mix", rounded(F.col("mix"), 2))


@query("bridge_ties", f"""
SELECT business_unit, geo_country, level, residual, tolerance, ties FROM ({node_sql(['business_unit', 'geo_country'])})""")
def bridge_ties(cube):
    nodes = bridge.decompose(lines_of(cube, "business_unit", "geo_country"), ["business_unit", "geo_country"])
    return nodes.select("business_unit", "geo_country", "level", "residual", "tolerance", "ties")


@query("bridge_tie_breaks", f"""
SELECT company, account, level, residual FROM ({node_sql(['company', 'account'])}) WHERE NOT ties""")
def bridge_tie_breaks(cube):
    nodes = bridge.decompose(lines_of(cube), ["company", "account"])
    return bridge.tie_breaks(nodes).select("company", "account", "level", "residual")


_LEG_CENTS = {**{leg: even(leg) for leg in ("price", "fx", "rate", "efficiency")},
              **{leg: even(units(leg, 6)) for leg in ("volume", "mix")}}


view("node2", node_sql(["practice", "geo_region"]))


REPORT_ROWS = f"""
SELECT row_number() OVER (ORDER BY practice NULLS FIRST, geo_region NULLS FIRST) AS line_no, plan, actual,
       {', '.join(f'{leg}_' + ' AS ' + leg for leg in _LEG_CENTS)},
       CAST(actual - plan - ({' + '.join(f'{leg}_' for leg in _LEG_CENTS)}) AS DECIMAL(28,2)) AS residual, level,
       list_filter([practice, geo_region], lambda x: x IS NOT NULL) AS path, line_count, tolerance,
       {even(units('between_', 6))} AS mix_between, dimension_key
FROM (SELECT *, {even('plan_amount')} AS plan, {even('actual_amount')} AS actual,
             {', '.join(f'{v} AS {leg}_' for leg, v in _LEG_CENTS.items())},
             CASE WHEN level = 2 THEN mix ELSE coalesce((SELECT sum(c.volume) FROM node2 c WHERE c.level = n.level + 1
               AND (n.level < 1 OR c.practice IS NOT DISTINCT FROM n.practice)), 0) - volume END AS between_,
             '{{' || coalesce('"practice":"' || practice || '",', '') || coalesce('"geo_region":"' || geo_region || '",', '')
             || '"level":' || level || '}}' AS dimension_key
      FROM node2 n)
"""
view("report_row", REPORT_ROWS)


@query("bridge_report_rows", REPORT_ROWS)
def bridge_report_rows(cube):
    levels = ["practice", "geo_region"]
    return bridge.report_rows(bridge.decompose(lines_of(cube, *levels), levels), levels)


@query("bridge_materiality", f"""
SELECT company, gap, CASE WHEN abs(gap) >= 250000 THEN 'ESCALATED' ELSE 'OPEN' END AS status
FROM ({node_sql([], extra='company')})""")
def bridge_materiality(cube):
    """One report per company, escalated by the size of its root gap."""
    roots = bridge.decompose(lines_of(cube), extra=["company"])
    return roots.select("company", "gap", bridge.status(F.col("gap")).alias("status"))


@query("bridge_nodes_flat", f"""
SELECT CASE WHEN level > 0 THEN practice ELSE '(all)' END AS practice, CASE WHEN level > 1 THEN geo_region ELSE '(all)' END AS geo_region,
       level, gap, price, {rnd('volume', 4)} AS volume, {rnd('mix', 4)} AS mix, fx, rate, efficiency, residual, line_count, ties,
       CAST(2 AS INTEGER) AS vintage, 'USD' AS currency FROM node2""")
def bridge_nodes_flat(cube):
    levels = ["practice", "geo_region"]
    closed = asof.vintage_lookup(cube.vintages).select("vintage").scalar()
    nodes = shown(bridge.decompose(lines_of(cube, *levels), levels))
    return bridge.nodes_flat(nodes, levels, closed).select(
        *levels, "level", "gap", "price", "volume", "mix", "fx", "rate", "efficiency", "residual", "line_count", "ties",
        "vintage", "currency")


@query("bridge_citations", f"""
SELECT {', '.join(LINE_COLUMNS)} FROM matched WHERE account IN {MARGIN_ACCOUNTS} AND practice = 'ECONOMY'
ORDER BY practice, geo_region, company, period_month, account, dim_signature_hash LIMIT 500 OFFSET 100""")
def bridge_citations(cube):
    """The second page of the ledger keys behind one practice."""
    lines = lines_of(cube, "practice", "geo_region")
    return bridge.citations(lines, ["practice", "geo_region"], ["ECONOMY"], 500, 100).select(*LINE_COLUMNS)


CONTRIBUTION_COLUMNS = [*GRAIN, "practice", "geo_region", "is_cost", "contribution"]


def contribution_sql(leg: str, tail: str = "") -> str:
    avg = "(SELECT coalesce(CAST(sum(weight) AS DOUBLE) / nullif(CAST(sum(plan_quantity) AS DOUBLE), 0), 0) FROM leg WHERE NOT is_cost AND practice = 'ECONOMY')"
    volume = f"CAST(delta_quantity AS DOUBLE) * {avg}"
    value = {
        "volume": f"CASE WHEN is_cost THEN 0 ELSE {even(units(volume, 6))} END",
        "mix": f"CASE WHEN is_cost THEN 0 ELSE {even(units(f'CAST(quantity_effect AS DOUBLE) - {volume}', 6))} END",
        "rate": f"CASE WHEN is_cost THEN {even('-price_effect')} ELSE 0 END",
        "fx": even("CASE WHEN is_cost THEN -fx_effect ELSE fx_effect END"),
    }[leg]
    return f"""SELECT * FROM (SELECT {', '.join(CONTRIBUTION_COLUMNS[:-1])}, CAST({value} AS DECIMAL(28,2)) AS contribution
FROM leg WHERE practice = 'ECONOMY') ORDER BY abs(contribution) DESC, practice, geo_region, company, period_month, account, dim_signature_hash {tail}"""


@query("bridge_contributions", contribution_sql("mix", "LIMIT 1000 OFFSET 50"))
def bridge_contributions(cube):
    """A page of the rows that moved one practice's mix most."""
    levels = ["practice", "geo_region"]
    out = bridge.contributions(lines_of(cube, *levels), levels, ["ECONOMY"], "mix", limit=1000, offset=50)
    return out.select(*CONTRIBUTION_COLUMNS)


for _leg in ("volume", "rate", "fx"):
    def _contribution(leg: str) -> None:
        @query(f"bridge_contributions_{leg}", contribution_sql(leg))
        def run(cube):
            levels = ["practice", "geo_region"]
            return bridge.contributions(lines_of(cube, *levels), levels, ["ECONOMY"], leg).select(*CONTRIBUTION_COLUMNS)

    _contribution(_leg)


_BY_VALUE = ("'-1 * (' || actual_quantity || ' - ' || plan_quantity || ') * ' || plan_unit_price || ' * ' || plan_fx")


@query("bridge_calculation_text", f"""
SELECT company, period_month, account, dim_signature_hash, CASE WHEN is_cost THEN {even('-quantity_effect')} ELSE CAST(0 AS DECIMAL(28,2)) END AS contribution,
       is_cost AS applies, CASE WHEN is_cost THEN 'sign * (actual_quantity - plan_quantity) * plan_unit_price * plan_fx' END AS expression,
       CASE WHEN is_cost THEN {_BY_VALUE} END AS by_value,
       CASE WHEN is_cost THEN {rnd('-1.0::DOUBLE * (CAST(actual_quantity AS DOUBLE) - CAST(plan_quantity AS DOUBLE)) * CAST(plan_unit_price AS DOUBLE) * CAST(plan_fx AS DOUBLE)', 4)} END AS result
FROM leg WHERE practice = 'ECONOMY'""")
def bridge_calculation_text(cube):
    levels = ["practice", "geo_region"]
    rows = bridge.contributions(lines_of(cube, *levels), levels, ["ECONOMY"], "efficiency")
    return explain.calculation(rows, "efficiency").select(
        *GRAIN, "contribution", "applies", "expression", "by_value", rounded(F.col("result"), 4).alias("result"))


@query("bridge_calculation_operands", """
SELECT company, period_month, account, dim_signature_hash, place, role, value, unit FROM (
  SELECT *, unnest([0, 1, 2, 3]) AS place, unnest(['sign', 'actual_amount', 'actual_fx', 'plan_fx']) AS role,
         unnest([CASE WHEN is_cost THEN CAST(-1 AS DECIMAL(28,8)) ELSE CAST(1 AS DECIMAL(28,8)) END, CAST(actual_amount AS DECIMAL(28,8)),
                 CAST(actual_fx AS DECIMAL(28,8)), CAST(plan_fx AS DECIMAL(28,8))]) AS value,
         unnest(['factor', 'currency', 'USD per currency', 'USD per currency']) AS unit
  FROM leg WHERE practice = 'ECONOMY')""")
def bridge_calculation_operands(cube):
    """What the exchange-rate share of every line of one practice is made of."""
    levels = ["practice", "geo_region"]
    rows = bridge.contributions(lines_of(cube, *levels), levels, ["ECONOMY"], "fx")
    return explain.operand_rows(rows, list(GRAIN), "fx")


# -- vintages --------------------------------------------------------------------------------

view("rollup_v1", f"""
SELECT company, period_month, account, dim_signature_hash, functional_currency, practice, geo_region,
       {dec(18, 2, 'sum(amount_functional)')} AS amount FROM live_v1
WHERE intercompany_flag <> 'Yes' AND account IN {MARGIN_ACCOUNTS} GROUP BY ALL""")
view("rollup_v2", f"""
SELECT company, period_month, account, dim_signature_hash, functional_currency, practice, geo_region,
       {dec(18, 2, 'sum(amount_functional)')} AS amount FROM live
WHERE intercompany_flag <> 'Yes' AND account IN {MARGIN_ACCOUNTS} GROUP BY ALL""")
view("delta_line", """
SELECT *, account_type <> 'Revenue' AS is_cost,
       CAST(left_amount * fa.rate - p.amount_functional * fp.rate AS DECIMAL(30,6)) AS left_gap,
       CAST(right_amount * fa.rate - p.amount_functional * fp.rate AS DECIMAL(30,6)) AS right_gap
FROM (SELECT coalesce(l.company, r.company) AS company, coalesce(l.period_month, r.period_month) AS period_month,
             coalesce(l.account, r.account) AS account, coalesce(l.dim_signature_hash, r.dim_signature_hash) AS dim_signature_hash,
             coalesce(l.functional_currency, r.functional_currency) AS functional_currency,
             coalesce(l.practice, r.practice) AS practice, coalesce(l.geo_region, r.geo_region) AS geo_region,
             l.amount AS left_amount, r.amount AS right_amount
      FROM rollup_v1 l FULL JOIN rollup_v2 r ON l.company = r.company AND l.period_month = r.period_month
           AND l.account = r.account AND l.dim_signature_hash = r.dim_signature_hash) x
JOIN (SELECT company, period_month, account, dim_signature_hash, amount_functional FROM plan WHERE scenario_id = 'base') p
     USING (company, period_month, account, dim_signature_hash)
JOIN account_dim d USING (account)
JOIN fx_plan fp ON fp.period_month = x.period_month AND fp.from_currency = functional_currency
JOIN fx_actual fa ON fa.period_month = x.period_month AND fa.from_currency = functional_currency
""")


def _sum6(value: str) -> str:
    return f"CAST(coalesce(sum({value}), 0) AS DECIMAL(38,6))"


@query("vintage_bridge", f"""
SELECT *, CAST(right_gap - left_gap AS DECIMAL(38,6)) AS change,
       CAST(right_gap - left_gap - (restated + reversed + new) AS DECIMAL(38,6)) AS residual FROM (
  SELECT practice, geo_region, CAST(2 - bit_count(GROUPING(practice, geo_region)) AS INTEGER) AS level,
         {_sum6('s * left_gap')} AS left_gap, {_sum6('s * right_gap')} AS right_gap,
         {_sum6('CASE WHEN left_gap IS NOT NULL AND right_gap IS NOT NULL THEN s * (right_gap - left_gap) END')} AS restated,
         {_sum6('CASE WHEN right_gap IS NULL THEN -s * left_gap END')} AS reversed,
         {_sum6('CASE WHEN left_gap IS NULL THEN s * right_gap END')} AS new,
         count(*) FILTER (left_gap <> right_gap) AS restated_lines, count(*) FILTER (right_gap IS NULL) AS reversed_lines,
         count(*) FILTER (left_gap IS NULL) AS new_lines
  FROM (SELECT practice, geo_region, left_gap, right_gap, CASE WHEN is_cost THEN -1 ELSE 1 END AS s FROM delta_line)
  GROUP BY ROLLUP (practice, geo_region))
""")
def vintage_bridge(cube):
    return vintage.vintage_delta(_two_close_lines(cube, "practice", "geo_region"), ["practice", "geo_region"])


def _two_close_lines(cube, *dims):
    accounts = bridge.bridge_accounts(["gross_margin"])
    chosen = F.col("account").isin(*accounts)
    left, right = (asof.require_close_in_month(cube.vintages, 2026, month)["vintage"] for month in (7, 8))
    actual = asof.two_closes(bridge.without_intercompany(cube.ledger.filter(chosen)), left, right, dims)
    lines = bridge.matched_lines(actual, asof.plan_current(cube.base_plan.filter(chosen), *PLAN), cube.accounts,
                                 cube.fx_plan, cube.fx_actual, PLAN_VERSION)
    return vintage.delta_lines(lines)


@query("key_full_outer", """
SELECT company, period_month, account, dim_signature_hash, l.amount AS left_amount_functional, r.amount AS right_amount_functional,
       l.amount IS NOT NULL AS has_left, r.amount IS NOT NULL AS has_right
FROM rollup_v1 l FULL JOIN rollup_v2 r USING (company, period_month, account, dim_signature_hash)
""")
def key_full_outer(cube):
    chosen = F.col("account").isin(*bridge.bridge_accounts(["gross_margin"]))
    rows = bridge.without_intercompany(cube.ledger.filter(chosen))
    sides = [asof.ledger_rollup(asof.ledger_as_of(rows, cube.vintages, moment)) for moment in (JULY, AUGUST)]
    return vintage.key_full_outer(*sides, list(GRAIN), ["amount_functional"])


@query("vintage_key_check", """
SELECT company, period_month, account, dim_signature_hash, count(*) AS rows, 'repeated key' AS problem
FROM live GROUP BY ALL HAVING count(*) > 1""")
def vintage_key_check(cube):
    """Postings offered to a vintage comparison without being rolled up: their repeated keys are refused."""
    return vintage.bad_keys(asof.ledger_as_of(cube.ledger, cube.vintages))


def _reconcile_side(name: str) -> str:
    row = ("sha256('{\"company\":\"' || company || '\",\"delivery_cost\":' || delivery_cost || ',\"practice\":\"' || practice "
           "|| '\",\"services_revenue\":' || services_revenue || '}')")
    lanes = ", ".join(f"('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT AS l{i}" for i in range(4))
    digest = " || '|' || ".join([f"CAST(sum(l{i}::HUGEINT) AS VARCHAR)" for i in range(4)] + [f"CAST(bit_xor(l{i}) AS VARCHAR)" for i in range(4)])
    return f"""
SELECT count(*) AS rows, sha256(count(*) || '|' || {digest}) AS digest,
       CAST(sum(services_revenue) AS DECIMAL(38,4)) AS total_services_revenue, CAST(sum(delivery_cost) AS DECIMAL(38,4)) AS total_delivery_cost
FROM (SELECT *, {lanes} FROM (SELECT *, {row} AS d FROM (
  SELECT company, practice, {MEASURE_SQL['services_revenue']} AS services_revenue, {MEASURE_SQL['delivery_cost']} AS delivery_cost
  FROM {name} GROUP BY ALL)))
"""


@query("reconcile_vintages", f"""
SELECT l.rows AS left_rows, l.digest AS left_digest, l.total_services_revenue AS left_total_services_revenue,
       l.total_delivery_cost AS left_total_delivery_cost, r.rows AS right_rows, r.digest AS right_digest,
       r.total_services_revenue AS right_total_services_revenue, r.total_delivery_cost AS right_total_delivery_cost,
       CAST(r.total_services_revenue - l.total_services_revenue AS DECIMAL(38,4)) AS delta_services_revenue,
       CAST(r.total_delivery_cost - l.total_delivery_cost AS DECIMAL(38,4)) AS delta_delivery_cost,
       l.digest <> r.digest AS drift
FROM ({_reconcile_side('live_v1')}) l, ({_reconcile_side('live')}) r
""")
def reconcile_vintages(cube):
    measures = ["services_revenue", "delivery_cost"]
    return vintage.reconcile_closes(lambda moment: metric_query(cube, measures, ["company", "practice"], as_of=moment),
                                    cube.vintages, JULY, AUGUST, ["company", "practice", *measures], measures)


@query("restatement_report", """
SELECT _version, count(*) AS rows, count(*) FILTER (_is_deleted = 1) AS reversals,
       CAST(sum(amount_functional) AS DECIMAL(38,2)) AS amount, CAST(sum(quantity) AS DECIMAL(38,4)) AS quantity
FROM ledger WHERE geo_region = 'EUROPE' AND period_month >= DATE '1998-04-01' AND period_month < DATE '1998-07-01' GROUP BY ALL
""")
def restatement_report(cube):
    from tallyweave.functions.periods import bounds

    return vintage.restatements(cube.ledger.filter(F.col("geo_region") == "EUROPE").filter(within(*bounds("1998-Q2"))))
