"""How the work is laid out: what is shuffled, by how many keys and into how many tasks."""

from __future__ import annotations

import datetime as dt
import os
import re
import uuid

from pyspark.sql import functions as F

from tallyweave.model import GRAIN
from tallyweave.operators import asof, recompute
from tallyweave.plans import planning_model as model
from tallyweave.plans.catalog import CATALOG, bridges
from tallyweave.plans.catalog.forecast import factors_of
from tallyweave.session import listed
from tallyweave.sources import layout, testcube
from tallyweave.sources.testcube import TestCube

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listed_rows_keep_their_values(spark):
    rows = [("a", 1, 0.5, ["x", "y"]), ("b", None, 1.0, [])]
    got = listed(spark, rows, "name string, n int, v double, names array<string>")
    assert [tuple(r) for r in got.collect()] == rows
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["string", "int", "double", "array<string>"]
    assert model.bindings(spark).count() == len(model.BINDINGS)


def test_lines_look_factors_up_where_they_lie(spark, tmp_path):
    cube, path = TestCube(spark, FOLDER), str(tmp_path / "plan")
    cube.plan(("base",)).write.parquet(path)
    text = plan_of(recompute.recompute_lines(spark.read.parquet(path), factors_of(cube)[0]))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_postings_of_a_close_are_counted_before_they_meet_it(spark):
    text = CATALOG["close_month_lookup"].build(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    rows = [re.sub(r"^[ :+-]*", "", row) for row in text.splitlines()]
    joined = next(n for n, row in enumerate(rows) if row.startswith("Join") and "vintage" in row)
    assert [row for row in rows[joined + 1:] if row.startswith("Aggregate [_version")]


def test_a_table_that_its_scan_spreads_is_not_dealt_out(spark, tmp_path, monkeypatch):
    many, one = str(tmp_path / "many.parquet"), str(tmp_path / "one.parquet")
    spark.range(4000).repartition(64).write.parquet(many)
    spark.range(4000).coalesce(1).write.parquet(one)
    monkeypatch.setattr(testcube, "DEALT_ROWS", 100)
    monkeypatch.setattr(testcube, "rows_by_task", lambda s, path: [500] * 8 if path == many else [4000])
    spread, dealt = testcube.dealt(spark, many), testcube.dealt(spark, one)
    assert "Exchange" not in plan_of(spread) and spread.count() == 4000
    assert dealt.rdd.getNumPartitions() == 40 and dealt.count() == 4000  # as many as its rows ask for


def test_shuffles_start_from_more_partitions_never_fewer(spark):
    option = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(option, None)
    try:
        testcube.more_partitions(spark, 300)
        testcube.more_partitions(spark, 20)
        assert spark.conf.get(option) == "300"
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)


def test_more_tasks_than_buckets_write_a_stored_table(spark, tmp_path):
    months = [dt.date(2026, m, 1) for m in range(1, 13)]
    rows = spark.createDataFrame([("C", m, "41000", f"h{n}", n) for m in months for n in range(8)],
                                 "company string, period_month date, account string, dim_signature_hash string, n int")
    name, path, option = f"t_{uuid.uuid4().hex}", str(tmp_path / "t"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(option, "false")
    try:
        layout.store_bucketed(rows, name, path, 2)
    finally:
        spark.conf.unset(option)
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len({os.path.basename(f).split("-")[1] for f in files}) > 2 and len(files) <= 24
    assert spark.table(name).count() == 96


def test_cited_keys_are_computed_once(spark, tmp_path):
    cube, path = TestCube(spark, FOLDER), str(tmp_path / "asked")
    cube.postings.select(*GRAIN).limit(5).write.parquet(path)
    got = asof.citation_rows(cube.ledger, cube.vintages, spark.read.parquet(path), None, cube.companies)
    assert "asked" not in plan_of(got) and got.count() > 0


def test_three_margin_bridges_match_their_lines_once(spark, monkeypatch):
    calls, real = [], bridges.lines_of
    monkeypatch.setattr(bridges, "lines_of", lambda *a, **k: calls.append(k) or real(*a, **k))
    assert CATALOG["bridge_margin"].build(spark, FOLDER).select("measure").distinct().count() == 3 and len(calls) == 1


def test_staged_lines_meet_their_plan_in_place(spark, tmp_path):
    path, scenarios = str(tmp_path / "grains"), F.explode(F.array(F.lit("base"), F.lit("stretch")))
    rows = [(f"h{n}", "41000", dt.date(2026, 1, 1), "C" if n % 5 else None, "EUR", n) for n in range(60)]
    spark.createDataFrame(rows, "dim_signature_hash string, account string, period_month date, company string, functional_currency string, n int").write.parquet(path)
    grains = spark.read.parquet(path).groupBy("dim_signature_hash", "account", "period_month", "company").agg(
        F.min("functional_currency").alias("functional_currency"), F.sum("n").cast("decimal(12,4)").alias("quantity"))
    plan = grains.withColumn("scenario_id", scenarios).select(
        F.lit("PV").alias("plan_version"), "scenario_id", F.lit(1).alias("revision"), *GRAIN, "quantity",
        F.lit(1).cast("decimal(14,4)").alias("unit_price"), F.col("quantity").cast("decimal(18,2)").alias("amount_functional"), "functional_currency")
    twice = F.explode(F.when(F.col("dim_signature_hash") == "h7", F.array(F.lit(5), F.lit(6))).otherwise(F.array(F.lit(5))))
    staged = plan.filter("quantity >= 5").withColumn("revision", F.lit(2)).withColumn("amount_functional", twice).withColumn(
        "amount_functional", F.col("amount_functional").cast("decimal(18,2)"))
    rates = spark.createDataFrame([("PV", dt.date(2026, 1, 1), "EUR", "USD", 2)], "plan_version string, period_month date, from_currency string, to_currency string, rate int")
    kinds = spark.createDataFrame([("41000", "Revenue")], "account string, account_type string")
    made = {"live": recompute.live_with_staged(plan, staged, "PV", 2), "pre": recompute.preimage(plan, staged, 2),
            "side": recompute.baseline_vs_staged(plan, staged, rates, kinds, "PV", 2)}
    option = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(option, "-1")
    try:
        texts = {name: plan_of(df) for name, df in made.items()}
    finally:
        spark.conf.unset(option)
    for name, text in texts.items():
        assert not re.findall(r"Exchange hashpartitioning\([^)]*scenario_id", text), name
    # 12 of 60 grains have no company and meet nothing; of the 48 others 44 are staged, one of them twice
    live = made["live"].collect()
    assert len(live) == 2 * 61 and sum(r.staged_amount is not None for r in live) == 2 * 45
    assert made["pre"].count() == 2 * 44 and made["side"].count() == 2 * 45
    assert made["pre"].schema["quantity"].dataType.simpleString() == "decimal(12,4)"
