"""A stored cube: buckets meet in place, months are read from their folders."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import periods
from tallyweave.operators import asof, bridge
from tallyweave.sources import layout
from tallyweave.sources.testcube import PLAN_VERSION, TestCube

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cubes(spark, tmp_path_factory):
    cube = TestCube(spark, FOLDER)
    root, names = tmp_path_factory.mktemp("cube"), {}
    for name, rows in (("ledger", cube.ledger), ("plan", cube.plan())):
        names[name] = f"{name}_{uuid.uuid4().hex}"
        layout.store_bucketed(rows, names[name], f"{root}/{name}", 4)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    layout.joins_in_place(spark)
    yield cube, layout.StoredCube(spark, names["ledger"], names["plan"], cube.vintages, cube.fx_plan, cube.fx_actual, cube.accounts)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_month_reads_one_folder_without_a_shuffle(cubes):
    cube, stored = cubes
    month = periods.within(*periods.bounds("1997-03"))
    got = asof.ledger_as_of(stored.ledger.filter(month), stored.vintages)
    rows = asof.ledger_rollup(got, ["practice"])
    text = plan_of(rows)
    assert "hashpartitioning" not in text and "PartitionFilters: [isnotnull(period_month" in text
    files = [f for f in stored.ledger.filter(month).inputFiles()]
    assert files and len({re.search(r"period_month=([0-9-]+)", f)[1] for f in stored.ledger.inputFiles()}) > 50
    want = asof.ledger_as_of(cube.ledger.filter(month), cube.vintages)
    assert got.count() == want.count() > 0
    pruned = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "1997-03-01" in pruned and "1997-04-01" in pruned


def test_plan_and_ledger_meet_without_a_shuffle(spark, cubes):
    cube, stored = cubes
    months = periods.within(*periods.bounds("1997"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        args = (["gross_margin"], (PLAN_VERSION, "base"), ["practice"])
        lines = bridge.bridge_lines(stored, *args, months=months)
        text = plan_of(lines)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines_of_plan = text.splitlines()
    at = next(n for n, row in enumerate(lines_of_plan) if "SortMergeJoin [dim_signature_hash" in row)
    depth = lines_of_plan[at].index("SortMergeJoin")
    below = []
    for row in lines_of_plan[at + 1:]:
        if len(row) - len(row.lstrip(" :+-")) <= depth - 3:
            break
        below.append(row)
    scans = [row for row in below if "FileScan parquet spark_catalog" in row]
    assert len(scans) >= 2 and all("Bucketed: true" in row and "SelectedBucketsCount: 4 out of 4" in row for row in scans)
    assert not [row for row in below if "Exchange hashpartitioning" in row]
    want = bridge.bridge_lines(cube, *args, months=months)
    rows = lambda df: sorted(map(str, df.select("company", "period_month", "account", "dim_signature_hash", "actual_amount", "plan_amount", F.col("practice")).collect()))
    assert rows(lines) == rows(want) != []
