"""Shocks, ratios, factors, recomputed lines, publishing, covenants and currency checks."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.formula import divide
from tallyweave.operators import covenant, fx, lineage, recompute
from tallyweave.operators.recompute import Driver
from tallyweave.plans import planning_model as model
from tallyweave.sources import sinks

SHOCK = "driver_code string, from_value double, to_value double, companies array<string>, months array<string>"


def shocks(spark, *rows):
    return spark.createDataFrame([(*r, [], [])[:5] if len(r) == 3 else r for r in rows], SHOCK)


def ratios(spark, *rows, drivers=model.DRIVERS):
    grid = recompute.shock_grid(shocks(spark, *rows), drivers, recompute.SCOPE)
    return {r.driver_code: r for r in recompute.evaluate_ratios(grid, drivers, recompute.SCOPE).collect()}


def test_a_multiplicative_dependent_moves_with_its_input(spark):
    got = ratios(spark, ("utilisation", 0.75, 0.72))
    assert {k: pytest.approx(r.ratio) for k, r in got.items()} == {"utilisation": 0.96, "billable_hours": 0.96}


def test_an_additive_input_is_evaluated_not_inherited(spark):
    got = ratios(spark, ("attrition", 0.12, 0.18))
    expected = (1 - 0.18 / 12) / (1 - 0.12 / 12)
    assert all(got[d].ratio == pytest.approx(expected) for d in ("heads", "available_hours", "billable_hours"))
    assert got["attrition"].shocked_directly and not got["heads"].shocked_directly


def test_a_rate_increase_moves_the_bill_rate_by_one_plus_the_rate(spark):
    assert ratios(spark, ("rate_increase", 0.03, 0.05))["bill_rate"].ratio == pytest.approx(1.05 / 1.03)


def test_zero_baselines_and_divisions_by_zero(spark):
    drivers = (Driver("a", lambda v: F.lit(2.0)), Driver("b", lambda v: v["a"] - F.lit(2.0), ("a",)),
               Driver("c", lambda v: divide(F.lit(1.0), v["b"]), ("b",)), Driver("d", None, ("a",)))
    got = ratios(spark, ("a", 2.0, 3.0), drivers=drivers)
    assert got["b"].ratio == pytest.approx(1.5) and got["b"].inherited
    assert (got["c"].from_value, got["c"].to_value) == (0, 0) and got["c"].ratio == pytest.approx(1.5)
    assert got["d"].ratio == pytest.approx(1.5)


def test_closure_and_inherited_ratios(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "x")], "driver string, depends_on string")
    pairs = recompute.closure(edges, spark.createDataFrame([("a",)], "driver string"))
    assert {(r.driver, r.dependent) for r in pairs.collect()} == {("a", "b"), ("a", "c")}
    got = recompute.inherited_ratios(pairs, shocks(spark, ("a", 0.12, 0.18)))
    assert {r.driver_code: pytest.approx(r.ratio) for r in got.collect()} == {"a": 1.5, "b": 1.5, "c": 1.5}


def test_merging_shocks(spark):
    def merged(old, new):
        rows = recompute.merge_shocks(shocks(spark, *old), shocks(spark, *new)).collect()
        return sorted((r.driver_code, r.from_value, r.to_value) for r in rows)

    assert merged([("u", 0.75, 0.70)], [("h", 100.0, 110.0)]) == [("h", 100, 110), ("u", 0.75, 0.70)]
    assert merged([("u", 0.75, 0.70)], [("u", 0.70, 0.65)]) == [("u", 0.75, 0.65)]
    assert merged([("u", 0.75, 0.70)], [("u", 0.70, 0.75)]) == [("u", 0.75, 0.75)]
    assert len(merged([("u", 0.75, 0.70)], [("u", 0.70, 0.65, ["PL"], [])])) == 2


PLAN = ("plan_version string, scenario_id string, revision int, company string, period_month date, account string, dim_signature_hash string, "
        "quantity decimal(12,4), unit_price decimal(14,4), amount_functional decimal(18,2), functional_currency string, plan_line_type string")


def plan(spark, *rows, revision=1):
    return spark.createDataFrame(
        [("PV", s, revision, c, m, a, h, D(q), D(p), (D(q) * D(p)).quantize(D("0.01")), "PLN", "Revenue") for s, c, m, a, h, q, p in rows], PLAN)


def lines(spark):
    month = date(2026, 7, 1)
    return plan(spark, *[(s, c, month, a, "0" * 16, 100, 10) for s in ("base", "stretch") for c in ("PL", "DE") for a in ("41000", "63200")])


def factors(spark, *rows):
    return recompute.plan_factors(shocks(spark, *rows), model.DRIVERS, model.bindings(spark))


def test_scoped_moves_multiply_where_they_overlap(spark):
    both = factors(spark, ("utilisation", 0.75, 0.70), ("utilisation", 0.70, 0.69, ["PL"], ["2026-07-01"]))[0]
    got = {r.company: r for r in recompute.recompute_lines(lines(spark), both).filter("scenario_id = 'base'").collect()}
    assert set(got) == {"PL", "DE"}
    assert got["PL"].quantity_factor == pytest.approx(0.69 / 0.75) and got["DE"].quantity_factor == pytest.approx(0.70 / 0.75)
    for r in got.values():
        assert r.amount_functional == (r.quantity * r.unit_price).quantize(D("0.01")) and r.account == "41000"


def test_only_requested_lines_are_rewritten_but_all_moves_apply(spark):
    merged = factors(spark, ("utilisation", 0.75, 0.60), ("rate_increase", 0.03, 0.05, ["PL"], []))[0]
    asked = recompute.dirty_scopes(factors(spark, ("rate_increase", 0.03, 0.05, ["PL"], []))[0])
    got = recompute.recompute_lines(lines(spark), merged, asked).collect()
    assert {r.company for r in got} == {"PL"} and all(r.quantity == 80 for r in got)
    assert recompute.dirty_counts(lines(spark), asked).agg(F.sum("lines")).head()[0] == 2


def test_traces_name_driver_formula_and_inputs(spark):
    made, moved = factors(spark, ("utilisation", 0.75, 0.72))
    out = lineage.trace_json(lineage.traces(recompute.recompute_lines(lines(spark), made, sources=True), made, moved))
    row = out.select("scenario_id", F.get_json_object("trace", "$.driver").alias("driver"), F.get_json_object("trace", "$.formula").alias("formula"),
                     F.get_json_object("trace", "$.inputs.baseline.quantity").alias("was"), F.get_json_object("trace", "$.inputs.assumption").alias("held"),
                     F.get_json_object("trace", "$.result.quantity").alias("now")).collect()
    assert {r.scenario_id for r in row} == {"base"}
    assert row[0].driver == "utilisation" and row[0].formula == "quantity * (1 + 1.0 * ([utilisation] - 1)); unit_price"
    assert float(row[0].was) == 100 and float(row[0].now) == 96 and row[0].held == lineage.HELD


def test_traces_of_scoped_moves_share_a_lineage(spark):
    made, moved = factors(spark, ("utilisation", 0.75, 0.70), ("utilisation", 0.70, 0.69, ["PL"], ["2026-07-01"]), ("attrition", 0.12, 0.18, ["PL"], []))
    got = {(r.company, r.account): r for r in lineage.traces(recompute.recompute_lines(lines(spark), made, sources=True), made, moved).collect()}
    pl, de = got["PL", "41000"], got["DE", "41000"]
    assert pl.moves == ["", "PL", "PL; 2026-07-01"] and de.moves == [""] and pl.driver == "attrition, utilisation" and not pl.by_binding
    assert "[utilisation @ PL; 2026-07-01]" in pl.expression and {d.label for d in pl.drivers} == set(pl.moves)
    assert [b.driver for b in pl.bindings if b.label == "PL"] == ["available_hours"]
    assert len({r.lineage for r in got.values()}) == 2


def test_zero_bases_are_noted_and_bound_drivers_stand_in(spark):
    drivers = (Driver("a", lambda v: F.lit(2.0)), Driver("b", lambda v: v["a"] - F.lit(2.0), ("a",), "a - 2"))
    bound = spark.createDataFrame([("b", "41000", "quantity", 0.5)], "driver_code string, account_code string, target string, elasticity double")
    made, moved = recompute.plan_factors(shocks(spark, ("a", 2.0, 3.0)), drivers, bound)
    traced = lineage.traces(recompute.recompute_lines(lines(spark), made, sources=True), made, moved).head()
    assert traced.inherited == ["b"] and [d.note for d in traced.drivers] == [None, lineage.ZERO_BASE] and traced.driver == "a"
    indirect = lineage.traces(recompute.recompute_lines(lines(spark), made, sources=True), made, moved.withColumn("shocked_directly", F.lit(False))).head()
    assert indirect.driver == "b" and indirect.by_binding
    none = lineage.traces(recompute.recompute_lines(lines(spark), made, sources=True), made.limit(0), moved.limit(0)).head()
    assert none.driver == "none" and none.expression == "quantity; unit_price"


def test_publish_is_idempotent_and_restores_exactly(spark):
    live = lines(spark)
    staged = recompute.stage(recompute.recompute_lines(live, factors(spark, ("utilisation", 0.75, 0.72))[0]), 2, live.columns)
    once = recompute.publish(live, staged, 2)
    rows = lambda df: sorted(map(str, df.select(live.columns).collect()))
    assert rows(once) == rows(recompute.publish(once, staged, 2)) and once.filter("revision = 2").count() == 4
    saved = recompute.preimage(live, staged, 2)
    assert saved.count() == 4
    back = recompute.unpublish(once, saved, 2)
    key = lambda df: sorted((r.scenario_id, r.company, r.account, r.revision, float(r.quantity), r.amount_functional) for r in df.collect())
    assert key(back) == key(live) == key(recompute.unpublish(back, saved, 2))
    assert recompute.discard(staged, 2).count() == 0
    assert recompute.publish_mismatch(staged, "PV", 2, 2).count() == 0
    assert {r.scenario_id for r in recompute.publish_mismatch(staged.filter("scenario_id = 'stretch'"), "PV", 2, 2).collect()} == {"base"}


def test_a_baseline_is_frozen_once(spark, tmp_path):
    first = sinks.freeze_baseline(lines(spark), "PV", str(tmp_path))
    again = sinks.freeze_baseline(lines(spark).filter("company = 'PL'"), "PV", str(tmp_path))
    assert first.count() == again.count() == 8
    with pytest.raises(ValueError):
        sinks.freeze_baseline(lines(spark), "PV-none", str(tmp_path))


ALL = ("base", "stretch", "downside")


def figures(spark, br, bc, ar, ac, scenarios=ALL):
    return spark.createDataFrame([(s, "REQUEST", D(br), D(bc), D(ar), D(ac)) for s in scenarios],
                                 "scenario_id string, scope string, before_revenue decimal(18,6), before_cost decimal(18,6), "
                                 "after_revenue decimal(18,6), after_cost decimal(18,6)")


def test_covenants(spark):
    rules = model.covenants(spark)
    good = covenant.checks(rules, figures(spark, 5399000, 3591000, 5355000, 3585000))
    assert good.count() == 9 and covenant.verdict(good).head().passed
    assert round(good.filter("rule_code = 'GM_PCT_FLOOR'").head().measured_value, 2) == 33.05
    bad = covenant.checks(rules, figures(spark, 5399000, 3591000, 4739000, 3506000))
    failed = covenant.failures(bad).collect()
    assert {(r.rule_code, r.scenario_id) for r in failed} == {(c, s) for c in ("GM_PCT_FLOOR", "REVENUE_DROP_LIMIT") for s in ALL}
    assert "GM_PCT_FLOOR (base): 26.02, needs >= 30" in {r.message for r in failed}
    none = covenant.failures(covenant.checks(rules, figures(spark, 0, 0, 0, 0, ("base",)))).collect()
    assert len(none) == 3 and all(r.message.endswith("could not be measured") for r in none)


def test_currency_checks(spark):
    rates = spark.createDataFrame([(date(2026, 7, 1), "PLN", "USD", D("0.25"))] * 2, "period_month date, from_currency string, to_currency string, rate decimal(8,4)")
    assert {r.problem for r in fx.invalid_rates(lines(spark), rates).collect()} == {"duplicate"}
    assert fx.invalid_rates(lines(spark), rates.limit(1)).count() == 0
    assert {r.amount_usd for r in fx.commitments(lines(spark), rates.limit(1)).collect()} == {1000}


RATES = "period_month date, from_currency string, to_currency string, rate decimal(8,4), plan_version string"


def two_versions(spark):
    """Two plans of one grain, two staged revisions of each, and rates of two versions and two currencies."""
    month = date(2026, 7, 1)
    live = lines(spark).unionByName(lines(spark).withColumn("plan_version", F.lit("PV2")))
    staged = reduce(DataFrame.unionByName, [
        live.withColumns({"plan_version": F.lit(v), "revision": F.lit(r), "amount_functional": F.lit(D(a)).cast("decimal(18,2)")})
        .filter("scenario_id = 'base'").distinct() for v, r, a in (("PV", 2, 1100), ("PV", 3, 1200), ("PV2", 2, 7))])
    rates = spark.createDataFrame([(month, "PLN", "USD", D("0.25"), "PV"), (month, "PLN", "USD", D("0.30"), "PV2"),
                                   (month, "PLN", "EUR", D("0.20"), "PV"), (month, "EUR", "USD", D("1.1"), "PV")], RATES)
    return live, staged, rates


def test_plans_revisions_and_rates_are_kept_apart(spark):
    live, staged, rates = two_versions(spark)
    got = recompute.live_with_staged(live, staged, "PV", 2).collect()
    assert len(got) == 8 and {(r.scenario_id, r.after_amount) for r in got} == {("base", 1100), ("stretch", 1000)}
    side = recompute.baseline_vs_staged(live, staged, rates, spark.createDataFrame([("41000", "Revenue"), ("63200", "OpEx")],
                                        "account string, account_type string"), "PV", 3).collect()
    assert len(side) == 4 and {(r.plan_amount, r.actual_amount, r.plan_fx) for r in side} == {(1000, 1200, D("0.25"))}
    got = {r.scenario_id: (r.before_revenue, r.after_revenue) for r in covenant.figures(live, staged, rates, "PV", 2).collect()}
    assert got == {"base": (500, 550), "stretch": (500, 500)}
    assert {r.amount_usd for r in fx.commitments(live.filter("plan_version = 'PV2'"), rates, "PV2").collect()} == {1200}


def test_lines_without_one_rate_are_refused(spark):
    live, staged, rates = two_versions(spark)
    accounts = spark.createDataFrame([("41000", "Revenue"), ("63200", "OpEx")], "account string, account_type string")
    for bad in (rates.filter("from_currency = 'EUR'"), rates.unionByName(rates), rates.withColumn("rate", -F.col("rate"))):
        for wrong in (fx.commitments(live, bad, "PV"), covenant.figures(live, staged, bad, "PV", 2),
                      recompute.baseline_vs_staged(live, staged, bad, accounts, "PV", 2)):
            with pytest.raises(Exception, match="no single positive rate for PLN in 2026-07-01"):
                wrong.collect()


def test_a_driver_without_formula_takes_the_product_of_its_inputs(spark):
    drivers = (recompute.Driver("a"), recompute.Driver("b"), recompute.Driver("c", depends=("a", "b")))
    grid = recompute.shock_grid(shocks(spark, ("a", 1.0, 2.0), ("b", 1.0, 3.0)), drivers, recompute.SCOPE)
    got = {r.driver_code: r.ratio for r in recompute.evaluate_ratios(grid, drivers, recompute.SCOPE).collect()}
    assert got == {"a": 2.0, "b": 3.0, "c": 6.0}


def test_a_deep_driver_chain_is_followed_to_its_end(spark):
    edges = spark.createDataFrame([(f"d{k + 1}", f"d{k}") for k in range(12)] + [("d0", "d12")], "driver string, depends_on string")
    got = recompute.closure(edges, spark.createDataFrame([("d0",)], "driver string"))
    assert {r.dependent for r in got.collect()} == {f"d{k}" for k in range(13)}


def test_an_empty_plan_does_not_block_the_next_freeze(spark, tmp_path):
    for _ in range(2):
        with pytest.raises(ValueError, match="nothing to freeze"):
            sinks.freeze_baseline(lines(spark).limit(0), "PV", str(tmp_path / "b"))
    assert sinks.freeze_baseline(lines(spark), "PV", str(tmp_path / "b")).count() == 8


def test_unknown_covenant_terms_are_errors(spark):
    rules = model.covenants(spark)
    for column in ("metric", "measure", "comparator"):
        with pytest.raises(Exception, match=f"unknown covenant {column}"):
            covenant.checks(rules.withColumn(column, F.lit("odd")), figures(spark, 1, 1, 1, 1)).collect()


def test_internal_trade_nets_to_zero_after_translation(spark):
    schema = ("company string, account string, dim_signature_hash string, period_month date, functional_currency string, "
              "amount_functional decimal(18,2), intercompany_flag string")
    month = date(2026, 7, 1)
    rows = [("A", "41000", "h", month, "PLN", D(400), "Yes"), ("B", "51500", "h", month, "EUR", D(80), "Yes"), ("A", "41000", "k", month, "PLN", D(9), "Yes")]
    rates = spark.createDataFrame([(month, "PLN", "USD", D("0.25")), (month, "EUR", "USD", D("1.25")), (month, "EUR", "CHF", D("9"))],
                                  "period_month date, from_currency string, to_currency string, rate decimal(8,4)")
    ledger = spark.createDataFrame(rows, schema)
    assert fx.intercompany_net(ledger.filter("dim_signature_hash = 'h'"), rates, "period_month").head().net_usd == 0
    assert [(r.dim_signature_hash, r.sales, r.mirrors) for r in fx.intercompany_unpaired(ledger).collect()] == [("k", 1, 0)]


def test_current_value_and_targets(spark):
    moves = spark.createDataFrame([("PV", "u", 0.75, 0.60, [], []), ("PV", "u", 0.60, 0.66, ["PL", "DE"], [])],
                                  "plan_version string, " + SHOCK)
    slices = spark.createDataFrame([(1, "PV", "u", 0.75, ["PL"], ["2026-07-01"]), (2, "PV", "u", 0.75, ["FR"], []), (3, "PV", "u", 0.75, ["PL", "FR"], [])],
                                   "id int, plan_version string, driver_code string, base_value double, companies array<string>, months array<string>")
    got = {r.id: r for r in recompute.current_value(slices, moves, ["id"]).collect()}
    assert got[1].current_value == pytest.approx(0.66) and got[2].current_value == pytest.approx(0.60)
    assert got[3].refused and got[3].current_value is None
    schema = "id int, base_value double, current_value double, to_value double, by_amount double, by_percent double"
    rows = [(1, 0.75, 0.72, None, 0.05, None), (2, 0.75, 0.72, None, None, 10.0), (3, 0.75, 0.72, 72.0, None, None), (4, 0.75, 0.72, 0.72, None, None),
            (5, 0.75, 0.72, None, -0.8, None), (6, 0.75, 0.72, None, 5.0, None), (7, 0.75, 0.72, 0.7, 0.1, None)]
    out = {r.id: r for r in recompute.resolve_target(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].target == 0.77 and out[1].change_basis == "points" and out[1].alternative_value == pytest.approx(0.756)
    assert out[2].target == pytest.approx(0.792) and out[2].change_basis == "relative"
    assert all(out[n].target is None and out[n].refusal for n in (3, 4, 5, 6, 7))


def test_first_successor_inside_a_run_across_month_buckets(spark):
    runs = spark.createDataFrame([("r1", "S", "2026-01-20", "2026-03-31"), ("r2", "S", "2026-01-20", "2026-02-01"), ("r3", "S", "2026-06-01", None)],
                                 "run_id string, plan_version string, started_at string, ended_at string")
    versions = spark.createDataFrame([("S", None, "2026-01-01"), ("T", "S", "2026-03-05"), ("U", "S", "2026-03-06")],
                                     "plan_version string, supersedes string, created_at string")
    at = lambda df, *names: df.withColumns({n: F.to_timestamp_ntz(n) for n in names})
    got = recompute.first_successor_in_run(at(runs, "started_at", "ended_at"), at(versions, "created_at"), F.to_timestamp_ntz(F.lit("2027-01-01")))
    assert {r.run_id: r.successor for r in got.collect()} == {"r1": "T", "r2": None, "r3": None}


def test_superseding_and_request_states(spark):
    versions = spark.createDataFrame([("S", None, "LOCKED", 0), ("T", "S", "LOCKED", 1), ("U", "S", "LOCKED", 2), ("V", "S", "DRAFT", 3)],
                                     "plan_version string, supersedes string, state string, revision int")
    got = {r.plan_version: r.state_after for r in recompute.supersede(versions).collect()}
    assert got == {"S": "SUPERSEDED", "T": "SUPERSEDED", "U": "LOCKED", "V": "DRAFT"}
    requests = spark.createDataFrame([(s, s, "CONFIRMED") for s in ("COMPLETED", "REJECTED", "late", "AWAITING_LOCK")], "request_id string, run_id string, state string")
    runs = spark.createDataFrame([(s, s) for s in ("COMPLETED", "REJECTED", "AWAITING_LOCK")], "run_id string, state string")
    checks = spark.createDataFrame([("REJECTED", True, True)], "run_id string, passed boolean, approved boolean")
    got = {r.request_id: r.state for r in recompute.request_state(requests, runs, checks).collect()}
    assert got == {"COMPLETED": "PUBLISHED", "REJECTED": "CFO_REJECTED", "late": "CONFIRMED", "AWAITING_LOCK": "AWAITING_CFO"}


def test_current_values_equal_brute_force(spark):
    import random

    rng = random.Random(11)
    pick = lambda values: rng.sample(values, rng.randrange(0, 4)) * rng.choice((1, 1, 2))
    moves = [(f"PV{rng.randrange(2)}", f"d{rng.randrange(3)}", 1.0, rng.choice((0.5, 2.0, 4.0)), pick("ABCD"), pick(["01", "02", "03"])) for _ in range(60)]
    slices = [(k, f"PV{rng.randrange(3)}", f"d{rng.randrange(3)}", 3.0, pick("ABCD"), pick(["01", "02", "03"])) for k in range(150)]
    columns = "companies array<string>, months array<string>"
    got = {r.k: r for r in recompute.current_value(
        spark.createDataFrame(slices, f"k int, plan_version string, driver_code string, base_value double, {columns}"),
        spark.createDataFrame(moves, f"plan_version string, driver_code string, from_value double, to_value double, {columns}"), ["k"]).collect()}
    assert len(got) == 150
    for k, plan, driver, base, companies, months in slices:
        value, refused = base, False
        for p, d, was, now, by_companies, by_months in moves:
            axes = [(set(companies), set(by_companies)), (set(months), set(by_months))]
            if (p, d) != (plan, driver):
                continue
            if all(not theirs or (mine and mine <= theirs) for mine, theirs in axes):
                value *= now / was
            elif all(not theirs or not mine or mine & theirs for mine, theirs in axes):
                refused = True
        assert got[k].refused == refused and (refused or got[k].current_value == pytest.approx(value)), k
    assert {r.refused for r in got.values()} == {True, False}


def test_after_amounts_are_those_of_staged_lines(spark):
    made = factors(spark, ("utilisation", 0.75, 0.72, ["PL"], []))[0]
    live = lines(spark)
    staged = recompute.stage(recompute.recompute_lines(live, made), 2, live.columns)
    want = recompute.live_with_staged(live, staged, live.head().plan_version, 2)
    key = lambda df: sorted((r.scenario_id, r.company, r.account, r.amount_functional, r.after_amount) for r in df.collect())
    got = recompute.with_after_amounts(live, made)
    assert key(got) == key(want) and set(live.columns) < set(got.columns)
