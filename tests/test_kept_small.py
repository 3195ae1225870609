"""What a job of several steps holds on disk: shuffles that are over are gone, and wide rows move once."""

from __future__ import annotations

import datetime as dt
import os
import time
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import asof, recompute
from tallyweave.plans.catalog import CATALOG
from tallyweave.session import FREE_SHUFFLES, cut, freeing
from tallyweave.sources import layout, planstore, sinks
from tallyweave.sources.planstore import PlanStore
from tallyweave.sources.testcube import TestCube


@pytest.fixture
def left(spark):
    """The shuffle files that were written since the test began and are there still."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def found():
        return {f for top in manager.localDirs() for d, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = found()

    def now():
        for _ in range(20):  # deleting them takes a moment
            if not (new := found() - before):
                break
            time.sleep(0.2)
        return new

    return now


def shuffled(spark, names="k"):
    return spark.range(2000).withColumn(names, F.col("id") % 7).groupBy(names).count()


def test_a_kept_table_leaves_no_shuffle(spark, left):
    before, asked = spark.conf.get(FREE_SHUFFLES, None), shuffled(spark)
    kept = cut(asked)
    assert not left() and kept.count() == 7
    assert asked.count() == 7  # what was asked before is computed anew
    assert spark.conf.get(FREE_SHUFFLES, None) == before


def test_the_option_is_as_before_after_a_failure(spark):
    before = spark.conf.get(FREE_SHUFFLES, None)
    with pytest.raises(KeyError), freeing(spark):
        raise KeyError
    assert spark.conf.get(FREE_SHUFFLES, None) == before


def test_cited_keys_leave_no_shuffle(spark, left, monkeypatch):
    monkeypatch.setattr(asof, "check_citation_request", lambda *a: None)  # shuffles a few keys of its own
    month = dt.date(2026, 1, 1)
    posted = "company string, period_month date, account string, dim_signature_hash string, voucher_no string, quantity int, amount_functional int, _version int, _is_deleted int"
    ledger = spark.createDataFrame([("C1", month, "41000", f"h{n % 3}", f"v{n}", n, n, 1, 0) for n in range(9)], posted)
    closes = spark.createDataFrame([(1, dt.datetime(2026, 7, 5))], "vintage int, closed_at timestamp_ntz")
    keys = ledger.filter("dim_signature_hash <> 'h2'").groupBy("company", "period_month", "account", "dim_signature_hash").count()
    got = asof.citation_rows(ledger, closes, keys, None, spark.createDataFrame([("C1",)], "company string"))
    assert not left() and got.count() == 6


def test_a_stored_report_leaves_no_shuffle(spark, left, tmp_path):
    assert sinks.persist_report("r", shuffled(spark), shuffled(spark), shuffled(spark), str(tmp_path))
    assert not left() and spark.read.parquet(f"{tmp_path}/citation").count() == 7


def test_a_stored_table_leaves_no_shuffle(spark, left, tmp_path):
    rows = spark.createDataFrame([("C", dt.date(2026, m, 1), "41000", f"h{n}") for m in (1, 2) for n in range(8)],
                                 "company string, period_month date, account string, dim_signature_hash string")
    name = f"t_{uuid.uuid4().hex}"
    layout.store_bucketed(rows, name, str(tmp_path / "t"), 2)
    assert not left() and spark.table(name).count() == 16


def depths(text, word):
    """How deep the operators lie in a plan whose lines hold a word."""
    return [len(row) - len(row.lstrip(" :+-")) for row in text.splitlines() if word in row]


def test_grains_move_before_their_scenarios_are_made(spark):
    cube = TestCube(spark, "/root/testdata/sf0.001")
    plan = cube.plan(deal=lambda base: layout.by_bucket(base, 8))
    text = layout.by_bucket(plan, 8)._jdf.queryExecution().executedPlan().toString()
    dealt = depths(text, "REPARTITION_BY_COL")
    assert len(dealt) == 1 and depths(text, "Generate explode")[0] < dealt[0]
    assert plan.columns == cube.plan().columns
    rows = [sorted(map(str, df.collect())) for df in (plan, cube.plan())]
    assert rows[0] == rows[1] != []


def test_the_stored_cube_deals_grains_not_lines(spark, monkeypatch):
    stored, texts = layout.store_bucketed, {}

    def seen(df, table, path, buckets):
        text = layout.by_bucket(df, buckets)._jdf.queryExecution().executedPlan().toString()
        texts[table.split("_")[0]] = (depths(text, "REPARTITION_BY_COL"), depths(text, "Generate explode"))
        stored(df, table, path, buckets)

    monkeypatch.setattr(layout, "store_bucketed", seen)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    try:
        assert CATALOG["ledger_as_of_stored"].build(spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)
    (moved,), (scenarios, *_) = texts["plan"]
    assert moved > scenarios and len(texts["ledger"][0]) == 1


LINES = "plan_version string, scenario_id string, revision int, company string, period_month date, account string, dim_signature_hash string, quantity decimal(18,6), unit_price decimal(18,6), amount_functional decimal(18,2)"
MONTHS = [dt.date(2026, m, 1) for m in (1, 2, 3)]


def plan_lines(spark, revision, amount, some=range(40), month=MONTHS):
    rows = [("PV", s, revision, f"C{n % 3}", m, "41000", f"h{n:02d}", Decimal(1), Decimal(amount), Decimal(amount))
            for s in ("base", "stretch") for m in month for n in some]
    return spark.createDataFrame(rows, LINES)


def values(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    made = PlanStore(spark, str(tmp_path / "plans"), plan_lines(spark, 1, 1).schema)
    made.load(plan_lines(spark, 1, 100), "PV")
    return made


def test_steps_of_a_stored_plan_leave_no_shuffle(spark, left, store):
    before = values(store.plan("PV"))
    store.stage(plan_lines(spark, 2, 150, range(5)), "PV", 2)
    assert not left()
    assert store.snapshot("PV", 2) == 30 and not left()
    assert store.publish("PV", 2, 15) == 30 and not left()
    assert store.unpublish("PV", 2) == 30 and not left()
    assert values(store.plan("PV")) == before


@pytest.mark.parametrize("per_part", [10_000_000, 10])
def test_grains_that_lie_by_month_are_loaded_in_place(spark, tmp_path, monkeypatch, per_part):
    monkeypatch.setattr(planstore, "MONTH_PART_LINES", per_part)
    seen, real = [], PlanStore._replace
    monkeypatch.setattr(PlanStore, "_replace", lambda self, lines, version: seen.append(lines) or real(self, lines, version))
    rows = [(f"h{n % 25}", "41000", m, f"C{n % 3}" if n % 7 else None, n) for m in [*MONTHS, None] for n in range(40)]
    grains = spark.createDataFrame(rows, "dim_signature_hash string, account string, period_month date, company string, n int")

    def lines(laid):
        scenario = F.explode(F.array(F.struct(F.lit("base").alias("s"), F.lit(1).alias("r")), F.struct(F.lit("base").alias("s"), F.lit(2).alias("r")),
                                     F.struct(F.lit("stretch").alias("s"), F.lit(1).alias("r"))))
        return laid.withColumn("x", scenario).select(
            F.lit("PV").alias("plan_version"), F.col("x.s").alias("scenario_id"), F.col("x.r").alias("revision"), "company", "period_month", "account",
            "dim_signature_hash", *[c for c in laid.columns if c == recompute.PART])

    base = grains.groupBy("dim_signature_hash", "account", "period_month", "company").agg(F.max("n").alias("n"))
    schema = lines(base).schema
    for name, laid in (("as before", base), ("by month", planstore.by_month(base, 160))):
        PlanStore(spark, f"{tmp_path}/{name}", schema).load(lines(laid), "PV")
    got = [values(PlanStore(spark, f"{tmp_path}/{name}", schema).plan("PV")) for name in ("as before", "by month")]
    assert got[0] == got[1] and len(got[0]) == 2 * base.count()
    text = seen[1]._jdf.queryExecution().executedPlan().toString()
    dealt = depths(text, "REPARTITION_BY_COL")
    assert len(dealt) == 1 and depths(text, "Generate explode")[0] < dealt[0] and "Exchange rebalance" not in text
    assert not [at for at in depths(text, "Exchange") if at < dealt[0]]


def test_files_of_a_stored_plan_hold_equal_dimensions_side_by_side(spark, store):
    files = spark.read.parquet(f"{store.root}/plan").inputFiles()
    for file in files:
        held = [r.dim_signature_hash for r in spark.read.parquet(file).coalesce(1).collect()]
        assert held == sorted(held)
    assert "zstd" in files[0]


def test_lines_of_parts_are_sorted_once(spark, monkeypatch, store):
    seen, real = [], PlanStore._store
    monkeypatch.setattr(PlanStore, "_store", staticmethod(lambda lines, *a: seen.append(lines) or real(lines, *a)))
    store.stage(plan_lines(spark, 2, 150, range(5)), "PV", 2)
    store.snapshot("PV", 2)
    text = seen[1]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window ") == text.count("Window [") == 1 and text.count("Sort [") == 1
