"""The stored plan: folders replaced by publishing, lost jobs, pre-images, taking back, recorded checks."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.model import STORED_PLAN_SCHEMA, TABLE_SCHEMAS
from tallyweave.operators import covenant
from tallyweave.sources import planstore, tables
from tallyweave.sources.planstore import PlanStore
from tallyweave.sources.sinks import append_once

PV, MONTHS = "PV", [dt.date(2026, m, 1) for m in (1, 2, 3)]


def line(scenario, month, account, amount, revision=1, version=PV):
    row = {f.name: None for f in STORED_PLAN_SCHEMA.fields} | {
        "plan_version": version, "scenario_id": scenario, "revision": revision, "company": "C1", "period_month": month, "account": account,
        "dim_signature_hash": f"h{account}", "quantity": Decimal(amount), "unit_price": Decimal(1), "amount_functional": Decimal(amount),
        "functional_currency": "USD", "plan_line_type": "Revenue"}
    return tuple(row[f.name] for f in STORED_PLAN_SCHEMA.fields)


def frame(spark, rows):
    return spark.createDataFrame(rows, STORED_PLAN_SCHEMA)


def base_rows():
    return [line(s, m, a, 100) for s in ("base", "stretch") for m in MONTHS for a in ("41000", "51000")]


def staged_rows(revision, months=MONTHS[:1], amount=150):
    return [line(s, m, "41000", amount, revision) for s in ("base", "stretch") for m in months]


@pytest.fixture
def store(spark, tmp_path):
    made = PlanStore(spark, str(tmp_path / "plans"))
    made.load(frame(spark, base_rows() + [line("base", MONTHS[0], "41000", 90, 0), line("base", MONTHS[0], "41000", 1, 1, "OTHER")]), PV)
    return made


def rows(df):
    return sorted((r.scenario_id, r.period_month, r.account, r.revision, int(r.amount_functional)) for r in df.collect())


def files(store):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{store.root}/plan") for f in names if f.endswith(".parquet")}


def expected(staged, before):
    keys = {r[:3] for r in staged}
    return sorted([*staged, *(r for r in before if r[:3] not in keys)])


def test_publishing_replaces_touched_folders_only(spark, store):
    before, old = rows(store.plan(PV)), files(store)
    assert len(before) == 12 and all(r[3] == 1 for r in before)
    store.stage(frame(spark, staged_rows(2)), PV, 2)
    assert store.publish(PV, 2, 1) == 2
    after = rows(store.plan(PV))
    assert after == expected(rows(store.staged(PV, 2)), before)
    gone = {f.split("/period_month=")[1].split("/")[0] for f in old - files(store)}
    assert gone == {str(MONTHS[0])} and len(old & files(store)) >= 4
    now = files(store)
    assert store.publish(PV, 2, 1) == 2 and files(store) == now  # twice is once, and writes nothing
    assert store.marks(PV) == [(PV, 2, "pending", "DONE", 2), (PV, 2, "preimage", "DONE", 2), (PV, 2, "publish", "DONE", 2)]
    assert store.marks("NONE") == []


def test_a_snapshot_is_never_refreshed_and_restores_exactly(spark, store):
    before = rows(store.plan(PV))
    store.stage(frame(spark, staged_rows(2)), PV, 2)
    assert store.snapshot(PV, 2) == 2
    store.publish(PV, 2, 1)
    assert store.snapshot(PV, 2) == 2 and {r[4] for r in rows(store.preimage(PV, 2))} == {100}
    assert store.unpublish(PV, 2) == 2 and rows(store.plan(PV)) == before
    assert store.unpublish(PV, 2) == 0 and rows(store.plan(PV)) == before
    assert store.publish(PV, 2, 1) == 2 and {r[3] for r in rows(store.plan(PV))} == {1, 2}
    assert store.unpublish(PV, 2) == 2 and rows(store.plan(PV)) == before


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", ["side table", "some folders", "all folders", "folder gone"])
def test_a_lost_publication_is_repeated(spark, store, monkeypatch, step):
    before = rows(store.plan(PV))
    store.stage(frame(spark, staged_rows(2, MONTHS)), PV, 2)
    real = PlanStore._replace

    def lost(self, lines, version):
        if step == "some folders":
            real(self, lines.filter(F.col("period_month") == MONTHS[0]), version)
        elif step == "all folders":
            real(self, lines, version)
        elif step == "folder gone":  # lost between deleting a folder and moving the new one there
            planstore.drop_folder(spark, f"{self.root}/plan/plan_version={PV}/scenario_id=base/period_month={MONTHS[1]}")
        raise Lost

    monkeypatch.setattr(PlanStore, "_replace", lost)
    with pytest.raises(Lost):
        store.publish(PV, 2, 3)
    monkeypatch.setattr(PlanStore, "_replace", real)
    with pytest.raises(ValueError, match="half in place"):
        store.stage(frame(spark, staged_rows(3)), PV, 3)
        store.publish(PV, 3, 1)
    if step == "all folders":  # or is taken back from where it was lost
        assert store.unpublish(PV, 2) == 6 and rows(store.plan(PV)) == before
    assert store.publish(PV, 2, 3) == 6
    assert rows(store.plan(PV)) == expected(rows(store.staged(PV, 2)), before)
    assert store.unpublish(PV, 2) == 6 and rows(store.plan(PV)) == before


def test_what_meets_lies_as_it_will_be_written(spark, store, monkeypatch):
    monkeypatch.setattr(planstore, "PART_ROWS", 1)  # a part per line
    before, real = rows(store.plan(PV)), PlanStore._replace
    store.stage(frame(spark, [*staged_rows(2), line("base", None, "41000", 5, 2), line("stretch", None, "41000", 5, 2)]), PV, 2)
    moved = []

    def seen(self, lines, version):
        moved.append((lines._jdf.queryExecution().executedPlan().toString(), {f.split("/kind=")[1].rsplit("/", 1)[0] for f in lines.inputFiles()}))
        real(self, lines, version)

    monkeypatch.setattr(PlanStore, "_replace", seen)
    assert store.publish(PV, 2, 2) == 4
    assert len(rows(store.plan(PV).filter("period_month IS NOT NULL"))) == 12 and store.plan(PV).count() == 14
    assert rows(store.preimage(PV, 2)) == [r for r in before if r[1] == MONTHS[0] and r[2] == "41000"]
    assert store.unpublish(PV, 2) == 2 and rows(store.plan(PV).filter("period_month IS NOT NULL")) == before
    for (text, folders), kind in zip(moved, ("after", "undo"), strict=True):
        assert "Exchange" not in text and f"{kind}/scenario_id=base/period_month={MONTHS[0]}" in folders


def test_a_lost_taking_back_is_repeated(spark, store, monkeypatch):
    before = rows(store.plan(PV))
    store.stage(frame(spark, [*staged_rows(2, MONTHS), line("base", dt.date(2027, 1, 1), "41000", 5, 2), line("stretch", dt.date(2027, 1, 1), "41000", 5, 2)]), PV, 2)
    store.publish(PV, 2, 4)
    assert ("base", dt.date(2027, 1, 1), "41000", 2, 5) in rows(store.plan(PV))  # a line that was not there before
    real = PlanStore._replace

    def lost(self, lines, version):
        real(self, lines.filter(F.col("period_month") == MONTHS[0]), version)
        raise Lost

    monkeypatch.setattr(PlanStore, "_replace", lost)
    with pytest.raises(Lost):
        store.unpublish(PV, 2)
    monkeypatch.setattr(PlanStore, "_replace", real)
    with pytest.raises(ValueError, match="taken back"):
        store.publish(PV, 2, 4)
    assert store.unpublish(PV, 2) == 6 and rows(store.plan(PV)) == before


def test_later_revisions_stay(spark, store):
    before = rows(store.plan(PV))
    for revision, months, amount in ((2, MONTHS, 150), (3, MONTHS[:1], 170)):
        store.stage(frame(spark, staged_rows(revision, months, amount)), PV, revision)
        store.publish(PV, revision, len(months))
    store.unpublish(PV, 2)
    third = rows(store.staged(PV, 3))
    assert rows(store.plan(PV)) == expected(third, before)
    store.stage(frame(spark, staged_rows(1, MONTHS[:1], 5)), PV, 1)
    store.publish(PV, 1, 1)  # an older revision does not replace a newer one
    assert rows(store.plan(PV)) == expected(third, before)


def test_refusals_of_the_store(spark, store):
    with pytest.raises(ValueError, match="nothing is staged"):
        store.publish(PV, 2, 1)
    store.stage(frame(spark, staged_rows(2)), PV, 2)
    with pytest.raises(ValueError, match="approved were 2"):
        store.publish(PV, 2, 2)
    store.stage(frame(spark, [r for r in staged_rows(2) if r[1] != "base"]), PV, 2)
    with pytest.raises(ValueError, match="approved were 1"):
        store.publish(PV, 2, 1)
    with pytest.raises(ValueError, match="stored already"):
        store.load(frame(spark, base_rows()), PV)
    store.stage(frame(spark, staged_rows(2)), PV, 2)
    store.publish(PV, 2, 1)
    for step in (lambda: store.stage(frame(spark, staged_rows(2)), PV, 2), lambda: store.discard(PV, 2)):
        with pytest.raises(ValueError, match="is published"):
            step()
    store.stage(frame(spark, staged_rows(3)), PV, 3)
    store.discard(PV, 3)
    assert store.staged(PV, 3).isEmpty() and not store.staged(PV, 2).isEmpty()
    assert store.unpublish(PV, 9) == 0


def test_reading_a_month_reads_its_folder(spark, store):
    plan = store.plan(PV).filter((F.col("scenario_id") == "base") & (F.col("period_month") == MONTHS[1]))
    assert len(plan.inputFiles()) >= 2 and plan.count() == 2
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario_id" in text and "period_month" in text.split("PartitionFilters")[1][:200]


def test_checks_are_recorded_once(spark, tmp_path):
    def checks(value, names=("A", "B")):
        return spark.createDataFrame([(n, "base", float(value), value > 1) for n in names], "rule_code string, scenario_id string, measured_value double, passed boolean")

    store = PlanStore(spark, str(tmp_path / "checks"))
    assert store.record_checks(checks(2, ("A",)), "R1", 1).count() == 1
    got = store.record_checks(checks(0), "R1", 1)
    assert {(r.rule_code, r.measured_value, r.passed) for r in got.collect()} == {("A", 2.0, True), ("B", 0.0, False)}
    assert store.record_checks(checks(3), "R1", 2).count() == 2 and store.record_checks(checks(9), "R1", 1).count() == 2
    with pytest.raises(ValueError, match="no line"):
        store.record_checks(checks(1, ()), "R2", 1)
    again = append_once(checks(5).withColumn("run_id", F.lit("R1")), str(tmp_path / "other"), ["run_id"], ["rule_code"])
    assert again.count() == 2


def test_no_rule_and_no_check_are_refused(spark):
    rules = spark.createDataFrame([], "rule_code string")
    with pytest.raises(ValueError, match="no active covenant rule"):
        covenant.require_rules(rules)
    none = spark.createDataFrame([], "passed boolean")
    with pytest.raises(Exception, match="no covenant check"):
        covenant.verdict(none).collect()


def test_masters_and_side_tables_are_read_with_their_schemas(spark, tmp_path):
    for name in ("company", "customer", "employee", "project", "account", "baseline", "staged", "preimage"):
        schema = TABLE_SCHEMAS[name]
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
        assert tables.read_table(spark, str(tmp_path), name).schema.fieldNames() == schema.fieldNames()
    rows_ = [("c1", "Old", "x", "s", "DE"), ("c1", "Old", "y", "s", "DE"), ("c2", None, None, None, None)]
    spark.createDataFrame(rows_, TABLE_SCHEMAS["customer"]).write.mode("overwrite").parquet(f"{tmp_path}/customer")
    got = tables.read_master(spark, str(tmp_path), "customer").collect()
    assert sorted((r.customer, r.industry) for r in got) == [("c1", "y"), ("c2", None)]
