"""Point-in-time reads, metric queries and time functions on small ledgers."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import periods
from tallyweave.functions.predicates import in_scope
from tallyweave.functions.timefn import TimeFn
from tallyweave.model import LEDGER_SCHEMA
from tallyweave.operators import asof
from tallyweave.plans.metric import explicit_aggregate, metric_query
from tallyweave.sources import sinks, tables

JULY = "2026-07-05 18:00:00"


class Cube:
    def __init__(self, spark, postings, closes=((1, JULY, "a"), (2, "2026-08-12 09:30:00", "b"))):
        self.spark = spark
        rows = []
        for p in postings:
            full = {f.name: None for f in LEDGER_SCHEMA.fields}
            full |= dict(company="C1", period_month=date(2026, 1, 1), account="41000", dim_signature_hash="h", quantity=D(1),
                         unit_price=D(10), functional_currency="USD", voucher_no="v", _version=1, _is_deleted=0,
                         practice="P", resource_employee="", geo_country="PL")
            full |= p
            full["amount_functional"] = p.get("amount_functional", (full["quantity"] * full["unit_price"]).quantize(D("0.01")))
            rows.append(tuple(full[f.name] for f in LEDGER_SCHEMA.fields))
        self.ledger = spark.createDataFrame(rows, LEDGER_SCHEMA)
        self.vintages = spark.createDataFrame(list(closes), "vintage int, closed_at string, note string").withColumn(
            "closed_at", F.to_timestamp_ntz("closed_at"))


def amounts(df):
    return sorted(r.amount_functional for r in df.collect())


def test_a_read_at_a_close_sees_only_what_was_booked_by_then(spark):
    cube = Cube(spark, [dict(voucher_no="a", quantity=D(1)), dict(voucher_no="a", quantity=D(3), _version=2),
                        dict(voucher_no="b", quantity=D(5)), dict(voucher_no="b", quantity=D(5), _version=2, _is_deleted=1)])
    assert amounts(asof.ledger_as_of(cube.ledger, cube.vintages, JULY)) == [10, 50]
    assert amounts(asof.ledger_as_of(cube.ledger, cube.vintages)) == [30]
    assert asof.ledger_as_of(cube.ledger, cube.vintages, "2026-01-01").count() == 0


def test_two_vouchers_on_one_grain_stay_two_postings_and_ties_are_repeatable(spark):
    cube = Cube(spark, [dict(voucher_no="a"), dict(voucher_no="b"), dict(voucher_no="c", quantity=D(2)), dict(voucher_no="c", quantity=D(4))])
    live = asof.ledger_as_of(cube.ledger, cube.vintages)
    assert amounts(live) == [10, 10, 40]
    got = asof.ledger_rollup(live, ["practice"]).head()
    assert (got.quantity, got.amount_functional, got.unit_price, got.postings) == (6, 60, 10.0, 3)


def test_two_closes_in_one_pass_equal_two_reads(spark):
    rows = [dict(voucher_no=f"v{n}", dim_signature_hash=f"h{n % 5}", quantity=D(n), _version=v, _is_deleted=int(n % 3 == 0 and v == 2))
            for n in range(1, 30) for v in ((1, 2) if n % 2 else (1,))]
    cube = Cube(spark, rows)
    both = {r.dim_signature_hash: r for r in asof.two_closes(cube.ledger, 1, 2).collect()}
    for side, moment in (("left", JULY), ("right", None)):
        for r in asof.ledger_rollup(asof.ledger_as_of(cube.ledger, cube.vintages, moment)).collect():
            assert both[r.dim_signature_hash][f"{side}_amount_functional"] == r.amount_functional


def test_closes_are_found_or_refused(spark):
    cube = Cube(spark, [{}])
    assert asof.require_vintage(cube.vintages, "2026-08-01") == 1 and asof.require_vintage(cube.vintages) == 2
    assert asof.require_close_in_month(cube.vintages, 2026, 8).vintage == 2
    with pytest.raises(ValueError):
        asof.require_vintage(cube.vintages, "2026-01-01")
    with pytest.raises(ValueError):
        asof.require_close_in_month(cube.vintages, 2026, 9)


def test_an_early_close_answers_zero_and_ratios_are_null_on_zero(spark):
    cube = Cube(spark, [{}])
    assert metric_query(cube, ["services_revenue"], as_of="2026-01-01").head().services_revenue == 0
    assert metric_query(cube, ["utilisation"]).head().utilisation is None
    row = metric_query(cube, ["utilisation"], operands=True).head()
    assert row.utilisation_undefined and row.utilisation_numerator == 1


def monthly(spark, months):
    return Cube(spark, [dict(period_month=date(y, m, 1), voucher_no=f"{y}{m}", quantity=D(q)) for (y, m), q in months.items()])


def values(df, column):
    return {r.period_month.month: r[column] for r in df.collect()}


def test_a_missing_month_is_null_not_its_neighbour(spark):
    cube = monthly(spark, {(2026, 1): 1, (2026, 2): 2, (2026, 4): 4})
    got = metric_query(cube, [TimeFn("PRIOR", "services_revenue"), TimeFn("LEAD", "services_revenue"), TimeFn("ROLLING", "services_revenue"),
                              TimeFn("YTD", "services_revenue"), TimeFn("QTD", "services_revenue")], period="2026-02..2026-04")
    assert values(got, "prior_services_revenue") == {2: 10, 4: None}
    assert values(got, "lead_services_revenue") == {2: None, 4: None}
    assert values(got, "rolling_services_revenue") == {2: 30, 4: 60}
    assert values(got, "ytd_services_revenue") == {2: 30, 4: 70}
    assert values(got, "qtd_services_revenue") == {2: 30, 4: 40}


def test_year_on_year_and_growth(spark):
    cube = monthly(spark, {(2024, 3): 4, (2025, 3): 5, (2026, 3): 9})
    got = metric_query(cube, [TimeFn("YOY", "services_revenue"), TimeFn("CAGR", "services_revenue", 2)], period="2026-03").head()
    assert got.yoy_services_revenue == pytest.approx(0.8) and got.cagr_services_revenue == pytest.approx(0.5)


def test_a_month_failing_a_measure_filter_is_gone_before_the_window(spark):
    cube = monthly(spark, {(2026, 1): 1, (2026, 2): 9, (2026, 3): 9})
    got = metric_query(cube, [TimeFn("PRIOR", "services_revenue")], where=[("services_revenue", ">", 50)], period="2026-02..2026-03")
    assert values(got, "prior_services_revenue") == {2: None, 3: 90}


def test_filters_fold_from_the_left_and_scope_narrows(spark):
    cube = Cube(spark, [dict(company=c, practice=p, voucher_no=c + p) for c in ("C1", "C2") for p in ("A", "B", "D")])
    where = [("practice", "=", "A"), "OR", ("practice", "=", "B"), "AND", ("company", "=", "C2")]
    assert metric_query(cube, ["services_revenue"], where=where).head().services_revenue == 20
    assert metric_query(cube, ["services_revenue"], scope=["C1"]).head().services_revenue == 30
    assert metric_query(cube, ["services_revenue"], scope=[]).head().services_revenue == 0
    table = spark.createDataFrame([("C2",)], "company string")
    assert {r.company for r in in_scope(cube.ledger, table).collect()} == {"C2"}


@pytest.mark.parametrize("bad", [
    dict(measures=["open_pipeline"]), dict(measures=["nothing"]), dict(measures=["services_revenue"], by=["shoe_size"]),
    dict(measures=[TimeFn("YTD", "utilisation")], period="2026"), dict(measures=[TimeFn("ROLLING", "headcount")], period="2026"),
    dict(measures=[TimeFn("YOY", "services_revenue")]), dict(measures=["headcount"], period="2026-01..2026-03"),
    dict(measures=["services_revenue"], period="2026-05..2026-02"), dict(measures=["services_revenue"], limit=-1),
    dict(measures=["services_revenue"], plan=("PV", "wild")), dict(measures=["services_revenue"], plan=("PV", "base"), as_of=JULY),
    dict(measures=[("services_revenue", "1x")]), dict(measures=["services_revenue"], where=[("practice", "IN", [])]),
    dict(measures=["services_revenue"], where=[("practice", "=", "A"), "OR", ("gross_margin", ">", 0)]),
])
def test_questions_without_a_meaning_are_refused(spark, bad):
    with pytest.raises(ValueError):
        metric_query(Cube(spark, [{}]), **bad)


def test_more_refusals():
    assert explicit_aggregate("SUM", "services_revenue") == "services_revenue"
    for function, name in (("AVG", "services_revenue"), ("SUM", "utilisation"), ("SUM", "headcount")):
        with pytest.raises(ValueError):
            explicit_aggregate(function, name)
    with pytest.raises(ValueError):
        TimeFn("PRIOR", "services_revenue", 0)
    with pytest.raises(ValueError):
        TimeFn("YOY", TimeFn("PRIOR", "services_revenue"))


def test_period_forms():
    assert periods.bounds("2026") == (date(2026, 1, 1), date(2027, 1, 1))
    assert periods.bounds("2026-Q4") == (date(2026, 10, 1), date(2027, 1, 1))
    assert periods.bounds("2026-H2..2027-02") == (date(2026, 7, 1), date(2027, 3, 1))
    assert periods.is_single("2026") and not periods.is_single("2026-01..2026-02")
    with pytest.raises(ValueError):
        periods.bounds("2026-13")
    with pytest.raises(ValueError):
        periods.bounds("1997..1998..1999")
    with pytest.raises(ValueError):
        periods.plan_months("2026-11..2027-01", 2026)


def test_a_written_ledger_prunes_folders(spark, tmp_path):
    cube = monthly(spark, {(2026, m): m for m in range(1, 7)})
    sinks.write_partitioned(cube.ledger, str(tmp_path / "ledger"))
    read = tables.read_table(spark, str(tmp_path), "ledger").filter(periods.within(*periods.bounds("2026-Q1")))
    assert read.count() == 3 and read.schema.names == LEDGER_SCHEMA.names
    assert "PartitionFilters: [isnotnull(period_month" in read._jdf.queryExecution().toString()
    assert tables.metric_registry(spark).filter("measure = 'gross_margin'").count() == 9


def test_lost_originals_and_restatements(spark):
    cube = Cube(spark, [dict(voucher_no="a", _version=2), dict(voucher_no="b"), dict(voucher_no="b", _version=2)])
    assert [r.voucher_no for r in asof.lost_vintage_keys(cube.ledger).collect()] == ["a"]


def test_citation_requests_are_scoped(spark):
    cube = Cube(spark, [dict(company="C1"), dict(company="C2", voucher_no="w")])
    keys, scope = cube.ledger.select("company", "period_month", "account", "dim_signature_hash"), spark.createDataFrame([("C1",)], "company string")
    assert asof.citation_rows(cube.ledger, cube.vintages, keys.filter("company = 'C1'"), JULY, scope).count() == 1
    for bad in (keys, keys.limit(0)):
        with pytest.raises(ValueError):
            asof.citation_rows(cube.ledger, cube.vintages, bad, JULY, scope)
