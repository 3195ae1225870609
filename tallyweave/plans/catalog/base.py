"""Registry of named queries and the independent SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyweave.sources.testcube import TestCube


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(cube) -> DataFrame`` under a key, with its check SQL where SQL can say it."""

    def add(fn: Callable[[TestCube], DataFrame]):
        if key in CATALOG:
            raise ValueError(f"query {key} is registered twice")
        CATALOG[key] = Entry(key, lambda spark, folder: fn(TestCube(spark, folder)), sql and with_views(sql))
        return fn

    return add


VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """Prefix the named views a statement uses, in dependency order, as one WITH list."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in used:
                    used.append(name)

    body = sql.strip()
    visit(body)
    if not used:
        return body
    views = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in used)
    if body[:5].upper() == "WITH ":
        recursive = body[5:15].upper() == "RECURSIVE "
        rest = body[15:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{views},\n{rest}"
    return f"WITH {views}\n{body}"


view("cube_posting", """
SELECT sn.n_name AS company, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month,
       CASE l_partkey % 10 WHEN 0 THEN '41000' WHEN 1 THEN '41010' WHEN 2 THEN '41020' WHEN 3 THEN '41400'
            WHEN 4 THEN '51000' WHEN 5 THEN '51050' WHEN 6 THEN '51100' WHEN 7 THEN '51300' WHEN 8 THEN '51400'
            ELSE '63100' END AS account,
       c_mktsegment AS business_unit, cn.n_name AS geo_country, r_name AS geo_region, o_orderpriority AS grade,
       CASE WHEN s_nationkey = c_nationkey THEN 'Yes' ELSE 'No' END AS intercompany_flag,
       p_type AS practice, s_name AS resource_employee,
       CAST(l_quantity AS DECIMAL(12,4)) AS quantity,
       CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(100 - l_linenumber AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2))
            AS DECIMAL(14,4)) AS unit_price,
       'CUR_' || sn.n_regionkey AS functional_currency,
       l_orderkey || '-' || l_linenumber AS voucher_no,
       substr(sha256('business_unit=' || c_mktsegment || '|geo_country=' || cn.n_name || '|geo_region=' || r_name
              || '|grade=' || o_orderpriority || '|intercompany_flag='
              || CASE WHEN s_nationkey = c_nationkey THEN 'Yes' ELSE 'No' END || '|practice=' || p_type), 1, 16)
           AS dim_signature_hash,
       l_orderkey, l_partkey, l_returnflag, l_linestatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
""")
view("cube_version", """
SELECT *, 1 AS _version, 0 AS _is_deleted, quantity AS q2 FROM cube_posting
UNION ALL
SELECT *, 2, CASE WHEN l_orderkey % 12 = 0 THEN 1 ELSE 0 END,
       CASE WHEN l_orderkey % 12 = 0 THEN quantity ELSE CAST(quantity * CAST(1.35 AS DECIMAL(3,2)) AS DECIMAL(12,4)) END
FROM cube_posting
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND intercompany_flag = 'No'
  AND (l_orderkey % 12 = 0 OR account IN ('51000','51050','51100'))
""")
view("ledger", """
SELECT company, period_month, account, business_unit, geo_country, geo_region, grade, intercompany_flag, practice,
       resource_employee, dim_signature_hash, q2 AS quantity, unit_price,
       CAST(round(q2 * unit_price, 2) AS DECIMAL(18,2)) AS amount_functional, functional_currency, voucher_no,
       _version, _is_deleted
FROM cube_version
""")
view("vintage", """
SELECT * FROM (VALUES (1, TIMESTAMP '2026-07-05 18:00:00', 'July close'),
                      (2, TIMESTAMP '2026-08-12 09:30:00', 'August restatement')) v(vintage, closed_at, note)
""")


def _live(close: str) -> str:
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY company, period_month, account, dim_signature_hash, voucher_no
         ORDER BY _version DESC, amount_functional DESC, quantity DESC, _is_deleted DESC, resource_employee DESC) AS rn
  FROM ledger WHERE _version <= {close}) WHERE rn = 1 AND _is_deleted = 0
"""


view("live", _live("(SELECT max(vintage) FROM vintage)"))
view("live_v1", _live("1"))
view("plan_base", """
SELECT company, period_month, account, dim_signature_hash, business_unit, geo_country, geo_region, grade,
       intercompany_flag, practice, functional_currency,
       CAST(CAST(sum(quantity) AS DECIMAL(12,4)) + CAST(CAST(sum(l_partkey) AS BIGINT) % 7 - 3 AS DECIMAL(4,0))
            AS DECIMAL(12,4)) AS q, max(unit_price) AS p
FROM cube_posting WHERE l_partkey % 20 <> 0
GROUP BY ALL
""")
view("plan", """
SELECT 'PV-1' AS plan_version, scenario_id, 1 AS revision, company, period_month, account, business_unit, geo_country,
       geo_region, grade, intercompany_flag, practice, dim_signature_hash,
       CAST(q * qf AS DECIMAL(12,4)) AS quantity, CAST(p * pf AS DECIMAL(14,4)) AS unit_price,
       CAST(round(CAST(q * qf AS DECIMAL(12,4)) * CAST(p * pf AS DECIMAL(14,4)), 2) AS DECIMAL(18,2)) AS amount_functional,
       functional_currency, CASE WHEN account LIKE '41%' THEN 'Revenue' ELSE 'Cost' END AS plan_line_type
FROM plan_base, (VALUES ('base', CAST(1.00 AS DECIMAL(3,2)), CAST(1.00 AS DECIMAL(3,2))),
                        ('stretch', CAST(1.12 AS DECIMAL(3,2)), CAST(1.04 AS DECIMAL(3,2))),
                        ('downside', CAST(0.90 AS DECIMAL(3,2)), CAST(0.97 AS DECIMAL(3,2)))) f(scenario_id, qf, pf)
""")
view("plan_history", """
SELECT * FROM plan UNION ALL
SELECT * REPLACE (2 AS revision, CAST(quantity * CAST(1.02 AS DECIMAL(3,2)) AS DECIMAL(12,4)) AS quantity,
       CAST(round(CAST(quantity * CAST(1.02 AS DECIMAL(3,2)) AS DECIMAL(12,4)) * unit_price, 2) AS DECIMAL(18,2))
       AS amount_functional)
FROM plan WHERE account = '41000'
""")
view("plan_live", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY plan_version, scenario_id, company, period_month,
       account, dim_signature_hash ORDER BY revision DESC) AS rn FROM plan_history) WHERE rn = 1
""")


def _fx(start: str, step: str) -> str:
    return f"""
SELECT CAST(m AS DATE) AS period_month, 'CUR_' || r_regionkey AS from_currency, 'USD' AS to_currency,
       CAST(CAST({start} AS DECIMAL(4,2)) + CAST(0.10 AS DECIMAL(4,2)) * CAST(r_regionkey AS DECIMAL(3,0)){step}
            AS DECIMAL(8,4)) AS rate
FROM region, (SELECT unnest(generate_series(min(date_trunc('month', o_orderdate)), max(date_trunc('month', o_orderdate)),
                                            INTERVAL 1 MONTH)) AS m FROM orders)
"""


view("fx_plan", _fx("0.50", ""))
view("fx_actual", _fx("0.52", " + CAST(month(m) % 3 AS DECIMAL(2,0)) * CAST(0.01 AS DECIMAL(3,2))"))
view("account_dim", """
SELECT account, CASE WHEN account LIKE '41%' THEN 'Revenue' WHEN account = '63100' THEN 'OpEx' ELSE 'COGS' END AS account_type
FROM (VALUES ('41000'),('41010'),('41020'),('41400'),('51000'),('51050'),('51100'),('51300'),('51400'),('63100'),
             ('51500')) a(account)
""")
view("company_dim", """
SELECT n_name AS company, r_name AS country, 'CUR_' || n_regionkey AS functional_currency
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
