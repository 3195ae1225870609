"""Bridge identities on hand-made lines."""

from __future__ import annotations

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import asof, bridge, explain, paging, vintage

SCHEMA = ("company string, period_month date, account string, dim_signature_hash string, practice string, grade string, "
          "account_type string, plan_quantity decimal(12,4), actual_quantity decimal(16,4), plan_unit_price decimal(14,4), "
          "plan_amount decimal(18,2), actual_amount decimal(18,2), plan_fx decimal(8,4), actual_fx decimal(8,4)")


def line(n, pq, aq, pp, ap, pfx="1", afx=None, practice="P", grade="G", kind="Revenue"):
    import datetime

    pq, aq, pp, ap, pfx, afx = (D(str(x)) for x in (pq, aq, pp, ap, pfx, afx or pfx))
    cent = D("0.01")
    return ("C", datetime.date(2026, 1, 1), "41000", f"{n:016x}", practice, grade, kind, pq, aq, pp,
            (pq * pp).quantize(cent), (aq * ap).quantize(cent), pfx, afx)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def root(spark, rows, **kw):
    return bridge.decompose(frame(spark, rows), **kw).head()


def test_volume_and_mix_add_up_to_the_quantity_variance(spark):
    got = root(spark, [line(1, 10, 12, 100, 110, "1", "1.1"), line(2, 20, 18, 200, 190, "1", "1.1")])
    assert got.volume + got.mix == pytest.approx(-200)
    assert got.ties and got.residual == 0


def test_rate_change_alone_is_all_fx(spark):
    got = root(spark, [line(1, 10, 10, 100, 100, "1", "1.2")])
    assert (got.fx, got.price, got.volume, got.mix) == (200, 0, 0, 0)


def test_price_is_valued_at_the_plan_rate(spark):
    got = root(spark, [line(1, 10, 10, 100, 120, "2", "3")])
    assert (got.price, got.fx, got.gap) == (400, 1200, 1600)


@pytest.mark.parametrize("convention, price, volume", [(bridge.VOLUME_FIRST, 120, 200), (bridge.PRICE_FIRST, 100, 220)])
def test_conventions_place_the_interaction(spark, convention, price, volume):
    got = root(spark, [line(1, 10, 12, 100, 110)], convention=convention)
    assert (got.price, got.volume, got.gap) == (price, volume, 320)


def test_cost_counts_negative_only_beside_revenue(spark):
    both = [line(1, 10, 10, 100, 110), line(2, 10, 12, 50, 55, kind="COGS")]
    got = root(spark, both)
    assert got.gap == 100 - 160 and got.rate == -60 and got.efficiency == -100
    alone = root(spark, both[1:])
    assert alone.gap == 160 and alone.rate == 60
    assert root(spark, both, margin=False).gap == 260


def test_zero_plan_quantity_puts_the_variance_into_mix(spark):
    got = root(spark, [line(1, 0, 5, 100, 100)])
    assert (got.avg_plan_price, got.volume, got.mix) == (0, 0, 500)


def test_nested_mix_sums_to_the_root_mix(spark):
    rows = [line(1, 10, 14, 100, 100, practice="A", grade="x"), line(2, 10, 8, 200, 200, practice="A", grade="y"),
            line(3, 20, 22, 50, 50, practice="B", grade="x"), line(4, 5, 9, 80, 80, practice="B", grade="y")]
    levels = ["practice", "grade"]
    nodes = bridge.decompose(frame(spark, rows), levels)
    got = {r.level_name: r.mix for r in bridge.mix_by_level(nodes, levels).collect()}
    assert got["practice"] != 0 and got["grade"] != 0 and got["signature"] == pytest.approx(0)
    every = nodes.collect()
    assert len(every) == 7 and all(n.ties for n in every)
    assert sum(got.values()) == pytest.approx(next(n.mix for n in every if n.level == 0))


@pytest.mark.parametrize("convention", [bridge.VOLUME_FIRST, bridge.PRICE_FIRST])
def test_every_node_ties_on_random_lines(spark, convention):
    rng = random.Random(7)
    rows = [line(n, rng.randint(0, 400), rng.randint(1, 400), f"{rng.uniform(1, 300):.4f}", f"{rng.uniform(1, 300):.4f}",
                 f"{rng.uniform(.2, 2):.4f}", f"{rng.uniform(.2, 2):.4f}", rng.choice("ABC"), rng.choice("xyz"),
                 rng.choice(["Revenue", "COGS", "OpEx"])) for n in range(400)]
    nodes = bridge.decompose(frame(spark, rows), ["practice", "grade"], convention).collect()
    assert len(nodes) == 13
    for n in nodes:
        assert n.ties and abs(n.residual) < D(1)
        kids = [k for k in nodes if k.level == n.level + 1 and (n.level == 0 or k.practice == n.practice)]
        if kids:
            for leg in ("plan_amount", "actual_amount", "price", "fx", "rate", "efficiency", "quantity_variance"):
                assert sum(k[leg] for k in kids) == n[leg]
            assert sum(k.volume + k.mix for k in kids) == pytest.approx(n.volume + n.mix)


def test_report_rows_hold_rounding_in_the_residual_and_run_depth_first(spark):
    rows = [line(1, 3, 4, "33.3333", "35.1", "0.3333", "0.3777", "A", "x"), line(2, 7, 5, "11.1111", "12.9", "0.3333", "0.3777", "B", "y")]
    levels = ["practice", "grade"]
    got = sorted(bridge.report_rows(bridge.decompose(frame(spark, rows), levels), levels).collect(), key=lambda r: r.line_no)
    assert [r.path for r in got] == [[], ["A"], ["A", "x"], ["B"], ["B", "y"]]
    for r in got:
        assert r.actual - r.plan == r.price + r.volume + r.mix + r.fx + r.rate + r.efficiency + r.residual


def test_contributions_sum_to_their_leg_whatever_the_page(spark):
    rows = [line(n, 10 + n, 20 - n, 100 + n, 90 + 2 * n, "0.5", "0.6", "A" if n % 2 else "B", "x") for n in range(12)]
    lines = frame(spark, rows)
    node = next(r for r in bridge.decompose(lines, ["practice"]).collect() if r.practice == "A")
    for leg in ("price", "volume", "mix", "fx"):
        shares = [r.contribution for r in bridge.contributions(lines, ["practice"], ["A"], leg).collect()]
        assert float(sum(shares)) == pytest.approx(float(node[leg]), abs=0.06)
        page = [r.contribution for r in bridge.contributions(lines, ["practice"], ["A"], leg, limit=2, offset=1).collect()]
        assert page == shares[1:3]
    with pytest.raises(ValueError):
        bridge.contributions(lines, ["practice"], ["A"], "luck")


def test_an_empty_match_is_refused(spark):
    for margin in (None, True):
        with pytest.raises(ValueError, match="nothing to bridge"):
            bridge.decompose(frame(spark, []), margin=margin)
    with pytest.raises(ValueError):
        bridge.bridge_accounts(["utilisation"])


def test_vintage_delta_splits_the_change(spark):
    # a restated 10 -> 14, b gone in the later read, c new there; price 50, rate 0.25.
    schema = ("k string, account_type string, plan_amount decimal(18,2), left_amount_functional decimal(18,2), "
              "right_amount_functional decimal(18,2), plan_fx decimal(8,4), actual_fx decimal(8,4)")
    rows = [("a", "Revenue", D(500), D(500), D(700), D("0.25"), D("0.25")),
            ("b", "Revenue", D(500), D(500), None, D("0.25"), D("0.25")),
            ("c", "Revenue", D(500), None, D(200), D("0.25"), D("0.25"))]
    got = vintage.vintage_delta(vintage.delta_lines(spark.createDataFrame(rows, schema))).head()
    assert (got.restated, got.reversed, got.new, got.change, got.residual) == (50, 0, -75, -25, 0)
    assert (got.restated_lines, got.reversed_lines, got.new_lines) == (1, 1, 1)


def test_null_and_repeated_keys_of_a_vintage_are_refused(spark):
    schema = "k string, account_type string, plan_amount int, left_amount_functional int, right_amount_functional int"
    for rows, problem in (([("a", "Revenue", 1, 2, 3)] * 2, "repeated key"), ([(None, "Revenue", 1, 2, 3)], "null key")):
        table = spark.createDataFrame(rows, schema)
        with pytest.raises(Exception, match=problem):
            vintage.delta_lines(table, ["k"]).collect()
        with pytest.raises(Exception, match=problem):
            vintage.key_full_outer(table, table.limit(0), ["k"], ["plan_amount"]).collect()
    assert vintage.delta_lines(spark.createDataFrame([("a", "Revenue", 1, 2, 3), ("b", "Revenue", 1, 2, 3)], schema), ["k"]).count() == 2


def test_a_missing_close_is_refused(spark):
    closes = spark.createDataFrame([(1, "2026-07-05 18:00:00")], "vintage int, at string").select("vintage", F.to_timestamp_ntz("at").alias("closed_at"), F.lit("n").alias("note"))
    answer = lambda moment: spark.range(2).withColumn("n", F.col("id"))
    with pytest.raises(ValueError, match="no ledger close"):
        vintage.reconcile_closes(answer, closes, "2026-07-01 00:00:00", None, ["n"], ["n"])
    assert not vintage.reconcile_closes(answer, closes, "2026-07-06 00:00:00", None, ["n"], ["n"]).head().drift
    with pytest.raises(ValueError, match="no ledger close"):
        asof.require_close_in_month(closes, 2026, 8)


@pytest.mark.parametrize("limit, offset", [(3, 0), (5, 4), (7, 38), (50, 0), (4, 60), (0, 2), (10, 25)])
def test_pages_by_size_are_those_of_a_full_sort(spark, limit, offset):
    rng = random.Random(3)
    rows = [(k, D(rng.choice([0, 0, 0, 5, -5, 100000, rng.randint(-10**9, 10**9)])) / 100 if k % 9 else None) for k in range(45)]
    table = spark.createDataFrame(rows, "k int, v decimal(28,2)").repartition(4)
    want = sorted(rows, key=lambda r: (r[1] is None, -abs(r[1] or 0), r[0]))[offset:offset + limit]
    got = paging.page_by_size(table, "v", ["k"], limit, offset)
    assert [tuple(r) for r in got.collect()] == want
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("convention", ["volume_first", "price_first"])
@pytest.mark.parametrize("leg", ["price", "volume", "mix", "fx", "rate", "efficiency"])
def test_a_calculation_gives_the_contribution(spark, leg, convention):
    rows = [line(n, 10 + n, 20 - n, 100 + n, 90 + 2 * n, "0.5", "0.6", "A", "x", "Revenue" if n % 3 else "COGS") for n in range(9)]
    found = bridge.contributions(frame(spark, rows), ["practice"], ["A"], leg, convention)
    for r in explain.calculation(found, leg, convention).collect():
        assert r.applies == (r.expression is not None) == (r.by_value is not None)
        if not r.applies:
            assert r.contribution == 0 and r.result is None
            continue
        assert r.result == pytest.approx(float(r.contribution), abs=0.02)
        names = {n: float(r[n]) for n in explain.UNITS}
        assert eval(r.expression, {}, names) == pytest.approx(r.result) == eval(r.by_value)  # noqa: S307
    operands = explain.operand_rows(found, ["company", "dim_signature_hash"], leg, convention).collect()
    assert {o.role for o in operands} == set(explain.operands(explain.tree_of(leg, convention))) and all(o.unit for o in operands)
    with pytest.raises(ValueError):
        explain.tree_of("luck")


def test_digest_ignores_order_and_sees_every_value(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "n int, s string")
    two = one.orderBy(F.desc("n")).repartition(3)
    other = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "n int, s string")
    digest = lambda df: vintage.content_digest(df, ["n", "s"], ["n"]).head().digest
    assert digest(one) == digest(two) != digest(other)
    assert vintage.reconcile(one, other, ["n", "s"], ["n"]).head().drift
    assert vintage.bad_keys(one, ["n"]).count() == 1
