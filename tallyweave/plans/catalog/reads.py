"""Sources, keys, versions, point-in-time reads, filters, scope, measures and time functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import periods
from tallyweave.functions.money import rounded
from tallyweave.functions.timefn import TimeFn
from tallyweave.model import GRAIN, MEASURES
from tallyweave.operators import asof
from tallyweave.plans.catalog.base import query
from tallyweave.plans.metric import metric_query
from tallyweave.sources.tables import metric_registry
from tallyweave.sources.testcube import PLAN_VERSION

JULY, AUGUST = "2026-07-05 18:00:00", "2026-08-12 09:30:00"

REV = "('41000','41010','41020','41400')"
DEL = "('51000','51050','51100','51300','51500')"
BILLED = "('41000','41010','41020')"
CAP = "('51000','51050','51400')"


def amt(accounts: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN account IN {accounts} THEN amount_functional END), 0) AS DECIMAL(28,2))"


def qty(accounts: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN account IN {accounts} THEN quantity END), 0) AS DECIMAL(28,4))"


def div(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"


def rnd(value: str, places: int = 8) -> str:
    scale = f"1e{places}"
    return f"(floor(({value}) * {scale} + 0.5) / {scale})"


MARGIN = f"CAST({amt(REV)} - {amt(DEL)} AS DECIMAL(28,2))"
MEASURE_SQL = {
    "services_revenue": amt(REV), "delivery_cost": amt(DEL), "subcontractor_cost": amt("('51100')"),
    "gross_margin": MARGIN, "bookings": amt(REV),
    "utilisation": div(qty(BILLED), qty(CAP)), "realisation": div(amt(BILLED), qty(BILLED)),
    "gross_margin_pct": div(MARGIN, amt(REV)),
    "headcount": "count(DISTINCT CASE WHEN resource_employee <> '' THEN resource_employee END)",
}

# -- sources ---------------------------------------------------------------------------------

LEDGER_COLUMNS = ("company, period_month, account, business_unit, geo_country, geo_region, grade, intercompany_flag, "
                  "practice, resource_employee, dim_signature_hash, quantity, unit_price, amount_functional, "
                  "functional_currency, voucher_no, _version, _is_deleted")


@query("src_ledger", f"SELECT {LEDGER_COLUMNS} FROM ledger")
def src_ledger(cube):
    return cube.ledger


@query("src_plan_current", "SELECT * FROM plan_live WHERE scenario_id = 'base'")
def src_plan_current(cube):
    return asof.plan_current(cube.plan_history(("base",)), PLAN_VERSION, "base")


@query("src_dims", """
SELECT company, country, c.functional_currency, f.period_month, f.rate AS actual_rate, p.rate AS plan_rate,
       postings, amount
FROM (SELECT company, period_month, functional_currency, count(*) AS postings,
             CAST(sum(amount_functional) AS DECIMAL(28,2)) AS amount FROM cube_posting_amount GROUP BY ALL) l
JOIN company_dim c USING (company) JOIN fx_actual f ON f.period_month = l.period_month AND f.from_currency = l.functional_currency
JOIN fx_plan p ON p.period_month = l.period_month AND p.from_currency = l.functional_currency
""".replace("cube_posting_amount", "(SELECT *, CAST(round(quantity*unit_price,2) AS DECIMAL(18,2)) AS amount_functional FROM cube_posting)"))
def src_dims(cube):
    """Company and rate dimensions joined to what the ledger holds in each month."""
    used = cube.postings.groupBy("company", "period_month", "functional_currency").agg(
        F.count(F.lit(1)).alias("postings"), F.sum("amount_functional").alias("amount"))
    actual = cube.fx_actual.select("period_month", F.col("from_currency").alias("functional_currency"),
                                   F.col("rate").alias("actual_rate"))
    plan = cube.fx_plan.select("period_month", F.col("from_currency").alias("functional_currency"),
                               F.col("rate").alias("plan_rate"))
    keys = ["period_month", "functional_currency"]
    return used.join(cube.companies.drop("functional_currency"), "company").join(actual, keys).join(plan, keys)


REGISTRY_ROWS = ",".join(
    f"('{m.name}','{m.kind}',{str(m.available).lower()},'{a}',{s})"
    for m in MEASURES.values()
    for a, s in [(a, 1) for a in (m.plus or (m.numerator[1] if m.numerator else ()))]
    + [(a, -1) for a in (m.minus or (m.numerator[2] if m.numerator else ()))])


@query("src_registry", f"""
SELECT measure, kind, available, r.account, sign, count(l.account) AS postings
FROM (VALUES {REGISTRY_ROWS}) r(measure, kind, available, account, sign)
LEFT JOIN cube_posting l ON l.account = r.account GROUP BY ALL
""")
def src_registry(cube):
    """The registry's measure/account pairs with the postings each covers."""
    held = cube.postings.groupBy("account").agg(F.count(F.lit(1)).alias("postings"))
    return (
        metric_registry(cube.spark).filter(F.col("account").isNotNull()).join(held, "account", "left")
        .withColumn("postings", F.coalesce("postings", F.lit(0).cast("long")))
    )


# -- keys and versions -----------------------------------------------------------------------


@query("dim_signature", """
SELECT dim_signature_hash, business_unit, geo_country, geo_region, grade, intercompany_flag, practice, count(*) AS postings
FROM cube_posting GROUP BY ALL
""")
def dim_signature(cube):
    return cube.postings.groupBy(
        "dim_signature_hash", "business_unit", "geo_country", "geo_region", "grade", "intercompany_flag", "practice",
    ).agg(F.count(F.lit(1)).alias("postings"))


@query("vintage_lookup", f"""
SELECT a.asked, v.vintage, v.closed_at, v.note, v.postings, v.amount
FROM (SELECT asked, max(vintage) AS vintage FROM (VALUES ('{JULY}'), ('2026-08-01 00:00:00'), ('latest')) q(asked)
      JOIN vintage ON asked = 'latest' OR closed_at <= CAST(nullif(asked, 'latest') AS TIMESTAMP) GROUP BY asked) a
JOIN (SELECT vintage, closed_at, note, count(*) AS postings, CAST(sum(amount_functional) AS DECIMAL(28,2)) AS amount
      FROM vintage JOIN ledger ON _version <= vintage GROUP BY ALL) v USING (vintage)
""")
def vintage_lookup(cube):
    """The close each asked-for moment reads, with what the ledger holds up to it."""
    by_version = cube.ledger.groupBy("_version").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_functional").alias("s"))
    upto = Window.orderBy("_version")
    held = by_version.select(
        F.col("_version").alias("vintage"), F.sum("n").over(upto).alias("postings"),
        F.sum("s").over(upto).cast("decimal(28,2)").alias("amount"))
    found = None
    for asked in (JULY, "2026-08-01 00:00:00", None):
        row = asof.vintage_lookup(cube.vintages, asked).withColumn("asked", F.lit(asked or "latest"))
        found = row if found is None else found.unionByName(row)
    return found.join(held, "vintage").select("asked", "vintage", "closed_at", "note", "postings", "amount")


@query("close_month_lookup", """
SELECT vintage, closed_at, note, count(*) AS postings, count(*) FILTER (_is_deleted = 1) AS reversals
FROM vintage JOIN ledger ON _version = vintage
WHERE closed_at >= TIMESTAMP '2026-08-01' AND closed_at < TIMESTAMP '2026-09-01' GROUP BY ALL
""")
def close_month_lookup(cube):
    """The close sealed in a month and the postings that arrived with it."""
    close = asof.close_in_month(cube.vintages, 2026, 8)
    # counted per version first: a join on the version would send all postings of a close to one task
    by_version = cube.ledger.groupBy("_version").agg(
        F.count(F.lit(1)).alias("postings"), F.count_if(F.col("_is_deleted") == 1).alias("reversals"))
    return (
        by_version.join(close, F.col("_version") == F.col("vintage")).groupBy("vintage", "closed_at", "note")
        .agg(F.sum("postings").alias("postings"), F.sum("reversals").alias("reversals"))
    )


@query("ledger_as_of", f"SELECT {LEDGER_COLUMNS} FROM live")
def ledger_as_of(cube):
    return asof.ledger_as_of(cube.ledger, cube.vintages)


@query("ledger_as_of_july", f"SELECT {LEDGER_COLUMNS} FROM live_v1")
def ledger_as_of_july(cube):
    return asof.ledger_as_of(cube.ledger, cube.vintages, JULY)


@query("ledger_rollup", f"""
SELECT company, period_month, account, dim_signature_hash, functional_currency, practice, geo_region,
       CAST(sum(quantity) AS DECIMAL(16,4)) AS quantity, CAST(sum(amount_functional) AS DECIMAL(18,2)) AS amount_functional,
       {rnd(div('sum(amount_functional)', 'sum(quantity)'), 6)} AS unit_price, count(*) AS postings
FROM live GROUP BY ALL
""")
def ledger_rollup(cube):
    out = asof.ledger_rollup(asof.ledger_as_of(cube.ledger, cube.vintages), ["practice", "geo_region"])
    return out.withColumn("unit_price", rounded(F.col("unit_price"), 6))


@query("plan_latest_revision", "SELECT * FROM plan_live")
def plan_latest_revision(cube):
    return asof.latest_revision(cube.plan_history())


@query("citation_rows", f"""
SELECT {LEDGER_COLUMNS} FROM live_v1 SEMI JOIN (
  SELECT company, period_month, account, dim_signature_hash FROM cube_posting
  GROUP BY ALL HAVING count(*) > 1) k USING (company, period_month, account, dim_signature_hash)
WHERE company IN (SELECT company FROM company_dim WHERE country <> 'ASIA')
""")
def citation_rows(cube):
    """Rows behind every grain key that carries several postings, at the July close."""
    keys = cube.postings.groupBy(*GRAIN).count().filter(F.col("count") > 1)
    scope = cube.companies.filter(F.col("country") != "ASIA")
    return asof.citation_rows(cube.ledger, cube.vintages, keys.join(scope, "company", "left_semi"), JULY, scope)


@query("lost_vintage_check", """
SELECT company, period_month, account, dim_signature_hash, voucher_no, count(*) FILTER (_version = 1) AS originals,
       count(*) FILTER (_version = 2) AS restated
FROM (SELECT * FROM ledger WHERE NOT (_version = 1 AND practice = 'ECONOMY'))
GROUP BY ALL HAVING count(*) FILTER (_version = 1) = 0 AND count(*) FILTER (_version = 2) > 0
""")
def lost_vintage_check(cube):
    """What the check reports for a store that dropped one practice's original versions."""
    merged = cube.ledger.filter(~((F.col("_version") == 1) & (F.col("practice") == "ECONOMY")))
    return asof.lost_vintage_keys(merged)


# -- filters, periods, scope -----------------------------------------------------------------


@query("metric_select", f"""
SELECT practice, geo_region, {MEASURE_SQL['services_revenue']} AS services_revenue, {MEASURE_SQL['gross_margin']} AS margin,
       {rnd(MEASURE_SQL['gross_margin_pct'])} AS gross_margin_pct
FROM live GROUP BY ALL
""")
def metric_select(cube):
    out = metric_query(cube, ["services_revenue", ("gross_margin", "margin"), "gross_margin_pct"], ["practice", "geo_region"])
    return out.withColumn("gross_margin_pct", rounded(F.col("gross_margin_pct"), 8))


@query("metric_select_total", f"SELECT {amt(REV)} AS services_revenue, {amt(DEL)} AS delivery_cost FROM live WHERE false")
def metric_select_total(cube):
    """No grouping over no rows still answers one row of zeros: no close exists that early."""
    return metric_query(cube, ["services_revenue", "delivery_cost"], as_of="2026-01-01 00:00:00")


@query("metric_select_plan", f"""
SELECT company, {amt(REV)} AS services_revenue, {amt(DEL)} AS delivery_cost FROM plan WHERE scenario_id = 'stretch' GROUP BY ALL
""")
def metric_select_plan(cube):
    return metric_query(cube, ["services_revenue", "delivery_cost"], ["company"], plan=(PLAN_VERSION, "stretch"))


@query("metric_select_topn", f"""
SELECT company, practice, {amt(REV)} AS services_revenue FROM live GROUP BY ALL ORDER BY company, practice LIMIT 40
""")
def metric_select_topn(cube):
    return metric_query(cube, ["services_revenue"], ["company", "practice"], limit=40)


@query("filter_compare", f"""
SELECT practice, {amt(REV)} AS services_revenue FROM live WHERE geo_region <> 'ASIA' AND grade >= '2' AND grade < '5' GROUP BY ALL
""")
def filter_compare(cube):
    where = [("geo_region", "!=", "ASIA"), "AND", ("grade", ">=", "2"), "AND", ("grade", "<", "5")]
    return metric_query(cube, ["services_revenue"], ["practice"], where)


@query("filter_in", f"""
SELECT geo_country, {amt(DEL)} AS delivery_cost FROM live
WHERE business_unit IN ('HOUSEHOLD','BUILDING') AND practice NOT IN ('ECONOMY') GROUP BY ALL
""")
def filter_in(cube):
    where = [("business_unit", "IN", ["HOUSEHOLD", "BUILDING"]), "AND", ("practice", "NOT IN", ["ECONOMY"])]
    return metric_query(cube, ["delivery_cost"], ["geo_country"], where)


@query("filter_bool_leftassoc", f"""
SELECT practice, {amt(REV)} AS services_revenue FROM live
WHERE ((geo_region = 'ASIA' OR geo_region = 'EUROPE') AND business_unit = 'BUILDING') GROUP BY ALL
""")
def filter_bool_leftassoc(cube):
    where = [("geo_region", "=", "ASIA"), "OR", ("geo_region", "=", "EUROPE"), "AND", ("business_unit", "=", "BUILDING")]
    return metric_query(cube, ["services_revenue"], ["practice"], where)


@query("filter_measure_having", f"""
SELECT geo_country, practice, {amt(REV)} AS services_revenue FROM live WHERE intercompany_flag = 'No'
GROUP BY ALL HAVING {MARGIN} > 0
""")
def filter_measure_having(cube):
    where = [("intercompany_flag", "=", "No"), "AND", ("gross_margin", ">", 0)]
    return metric_query(cube, ["services_revenue"], ["geo_country", "practice"], where)


@query("filter_having_monthly", f"""
SELECT practice, period_month, services_revenue, prior_services_revenue FROM (
  SELECT *, first(services_revenue) OVER (PARTITION BY practice ORDER BY m RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)
         AS prior_services_revenue
  FROM (SELECT practice, period_month, year(period_month) * 12 + month(period_month) AS m, {amt(REV)} AS services_revenue
        FROM live WHERE period_month >= DATE '1995-12-01' AND period_month < DATE '2001-01-01'
        GROUP BY ALL HAVING {MARGIN} > 0))
WHERE period_month >= DATE '1996-01-01'
""")
def filter_having_monthly(cube):
    """A month that fails the measure filter is absent, so PRIOR from it is NULL."""
    return metric_query(cube, ["services_revenue", TimeFn("PRIOR", "services_revenue")], ["practice"],
                        [("gross_margin", ">", 0)], "1996..2000")


@query("period_filter", f"""
SELECT q.period, practice, {amt(REV)} AS services_revenue
FROM live JOIN (VALUES ('1997', DATE '1997-01-01', DATE '1998-01-01'), ('1997-Q2', DATE '1997-04-01', DATE '1997-07-01'),
  ('1998-H2', DATE '1998-07-01', DATE '1999-01-01'), ('1999-05', DATE '1999-05-01', DATE '1999-06-01'),
  ('1999-Q3..2000-H1', DATE '1999-07-01', DATE '2000-07-01')) q(period, s, e) ON period_month >= s AND period_month < e
GROUP BY ALL
""")
def period_filter(cube):
    """One answer per period form, from one read: the spans are columns of a conditional sum."""
    forms = ("1997", "1997-Q2", "1998-H2", "1999-05", "1999-Q3..2000-H1")
    months = metric_query(cube, ["services_revenue", TimeFn("MTD", "services_revenue")], ["practice"], period="1997..2000")
    spans = F.array(*[F.struct(F.lit(f).alias("period"), *[F.lit(d).alias(n) for d, n in zip(periods.bounds(f), "se")])
                      for f in forms])
    return (
        months.select("practice", "period_month", "services_revenue", F.explode(spans).alias("q"))
        .filter((F.col("period_month") >= F.col("q.s")) & (F.col("period_month") < F.col("q.e")))
        .groupBy("q.period", "practice").agg(F.sum("services_revenue").cast("decimal(28,2)").alias("services_revenue"))
    )


@query("period_months", """
SELECT company, CAST(m AS DATE) AS month, first_month, last_month
FROM (SELECT company, min(period_month) AS first_month, max(period_month) AS last_month FROM cube_posting GROUP BY ALL),
     generate_series(first_month, last_month, INTERVAL 1 MONTH) g(m)
""")
def period_months(cube):
    """Each company's span of activity, expanded to its months."""
    span = cube.postings.groupBy("company").agg(F.min("period_month").alias("first_month"),
                                                F.max("period_month").alias("last_month"))
    every = periods.months_between(F.col("first_month"), F.add_months("last_month", 1))
    return span.select("company", F.explode(every).alias("month"), "first_month", "last_month")


@query("scope_filter", f"""
SELECT company, {amt(REV)} AS services_revenue FROM live
WHERE company IN (SELECT company FROM company_dim WHERE country IN ('ASIA', 'EUROPE')) GROUP BY ALL
""")
def scope_filter(cube):
    scope = cube.companies.filter(F.col("country").isin("ASIA", "EUROPE"))
    return metric_query(cube, ["services_revenue"], ["company"], scope=scope)


@query("calc_operands", f"""
SELECT practice, geo_country, {rnd(MEASURE_SQL['utilisation'])} AS utilisation, {rnd(MEASURE_SQL['realisation'])} AS realisation,
       {qty(BILLED)} AS utilisation_numerator, {qty(CAP)} AS utilisation_denominator,
       {amt(BILLED)} AS realisation_numerator, {qty(BILLED)} AS realisation_denominator,
       {qty(CAP)} = 0 AS utilisation_undefined, {qty(BILLED)} = 0 AS realisation_undefined
FROM live GROUP BY ALL
""")
def calc_operands(cube):
    out = metric_query(cube, ["utilisation", "realisation"], ["practice", "geo_country"], operands=True)
    return out.withColumns({n: rounded(F.col(n), 8) for n in ("utilisation", "realisation")})


# -- measures --------------------------------------------------------------------------------


def _register_measure(name: str) -> None:
    kind = MEASURES[name].kind
    value = MEASURE_SQL[name]
    shown = rnd(value) if kind == "ratio" else value

    @query(f"m_{name}", f"SELECT company, practice, {shown} AS {name} FROM live GROUP BY ALL")
    def run(cube):
        out = metric_query(cube, [name], ["company", "practice"])
        return out.withColumn(name, rounded(F.col(name), 8)) if kind == "ratio" else out


for _name in MEASURE_SQL:
    _register_measure(_name)


@query("m_headcount_period", """
SELECT company, count(DISTINCT CASE WHEN resource_employee <> '' THEN resource_employee END) AS headcount
FROM live WHERE period_month = DATE '1998-06-01' GROUP BY ALL
""")
def m_headcount_period(cube):
    return metric_query(cube, ["headcount"], ["company"], period="1998-06")


# -- time functions --------------------------------------------------------------------------


def _series(start: str, end: str, columns: str, dims: str = "business_unit, geo_region") -> str:
    """Oracle: monthly series over [start, end) with the named window columns, trimmed to 1997..1999."""
    return f"""
SELECT * FROM (SELECT {dims}, period_month, {columns} FROM (
  SELECT {dims}, period_month, year(period_month) * 12 + month(period_month) AS m, {amt(REV)} AS services_revenue,
         {MEASURE_SQL['gross_margin_pct']} AS gross_margin_pct
  FROM live WHERE period_month >= DATE '{start}' AND period_month < DATE '{end}' GROUP BY ALL))
WHERE period_month >= DATE '1997-01-01' AND period_month < DATE '2000-01-01'
"""


def _over(low: int, high: int, column: str = "services_revenue", fn: str = "first", extra: str = "") -> str:
    def edge(n: int) -> str:
        return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    return (f"{fn}({column}) OVER (PARTITION BY business_unit, geo_region{extra} ORDER BY m "
            f"RANGE BETWEEN {edge(low)} AND {edge(high)})")


BY = ["business_unit", "geo_region"]


@query("w_prior", _series("1996-10-01", "2000-01-01", f"{_over(-1, -1)} AS prior_services_revenue, {_over(-3, -3)} AS back3"))
def w_prior(cube):
    return metric_query(cube, [TimeFn("PRIOR", "services_revenue"), (TimeFn("PRIOR", "services_revenue", 3), "back3")],
                        BY, period="1997..1999")


@query("w_lead", _series("1997-01-01", "2000-02-01", f"{_over(1, 1)} AS lead_services_revenue"))
def w_lead(cube):
    return metric_query(cube, [TimeFn("LEAD", "services_revenue")], BY, period="1997..1999")


@query("w_yoy", _series("1996-01-01", "2000-01-01", f"""
{rnd(div('services_revenue', _over(-12, -12)) + ' - 1.0')} AS yoy_services_revenue,
{rnd(div('gross_margin_pct', _over(-12, -12, 'gross_margin_pct')) + ' - 1.0')} AS yoy_gross_margin_pct"""))
def w_yoy(cube):
    out = metric_query(cube, [TimeFn("YOY", "services_revenue"), TimeFn("YOY", "gross_margin_pct")], BY, period="1997..1999")
    return out.withColumns({c: rounded(F.col(c), 8) for c in out.columns if c.startswith("yoy")})


@query("w_cagr", _series("1995-01-01", "2000-01-01",
                         f"{rnd('pow(' + div('services_revenue', _over(-24, -24)) + ', 0.5::DOUBLE) - 1.0')} AS cagr_services_revenue"))
def w_cagr(cube):
    out = metric_query(cube, [TimeFn("CAGR", "services_revenue", 2)], BY, period="1997..1999")
    return out.withColumn("cagr_services_revenue", rounded(F.col("cagr_services_revenue"), 8))


@query("w_rolling", _series("1996-11-01", "2000-01-01", f"{_over(-2, 0, fn='sum')} AS rolling_services_revenue"))
def w_rolling(cube):
    return metric_query(cube, [TimeFn("ROLLING", "services_revenue")], BY, period="1997..1999")


@query("w_ytd", _series("1997-01-01", "2000-01-01", """
sum(services_revenue) OVER (PARTITION BY business_unit, geo_region, year(period_month) ORDER BY m) AS ytd_services_revenue"""))
def w_ytd(cube):
    return metric_query(cube, [TimeFn("YTD", "services_revenue")], BY, period="1997..1999")


@query("w_qtd", _series("1996-11-01", "2000-01-01", """
sum(services_revenue) OVER (PARTITION BY business_unit, geo_region, date_trunc('quarter', period_month) ORDER BY m)
AS qtd_services_revenue"""))
def w_qtd(cube):
    return metric_query(cube, [TimeFn("QTD", "services_revenue")], BY, period="1997..1999")


@query("w_mtd", _series("1997-01-01", "2000-01-01", "services_revenue AS mtd_services_revenue"))
def w_mtd(cube):
    return metric_query(cube, [TimeFn("MTD", "services_revenue")], BY, period="1997..1999")


@query("w_monthly_series", _series("1996-01-01", "2000-01-01", f"""services_revenue,
{rnd('gross_margin_pct')} AS gross_margin_pct, {_over(-1, -1)} AS before, {_over(-5, 0, fn='sum')} AS half,
{rnd(div('services_revenue', _over(-12, -12)) + ' - 1.0')} AS yoy"""))
def w_monthly_series(cube):
    sr = "services_revenue"
    out = metric_query(cube, [sr, "gross_margin_pct", (TimeFn("PRIOR", sr), "before"), (TimeFn("ROLLING", sr, 6), "half"),
                              (TimeFn("YOY", sr), "yoy")], BY, period="1997..1999")
    return out.withColumns({c: rounded(F.col(c), 8) for c in ("gross_margin_pct", "yoy")})
