"""Neighbours and numbers inside groups, NULL keys included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import ordered
from tallyweave.session import shared_dir


def test_rows_are_numbered_in_order_within_groups(spark):
    rng = random.Random(1)
    rows = [(None if k % 11 == 0 else "big" if k % 3 else f"g{k % 5}", rng.randrange(50), k) for k in range(700)]
    table = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {r.id: r.n for r in ordered.numbered(table, ["g"], ["v", "id"], "n").collect()}
    for group in {g for g, _, _ in rows}:
        inside = sorted((v, i) for g, v, i in rows if g == group)
        assert [got[i] for _, i in inside] == list(range(1, len(inside) + 1))
    assert ordered.numbered(table.limit(0), ["g"], ["v"], "n").collect() == []


def test_the_row_before_keeps_rows_without_an_order(spark):
    rows = [("a", 1, "x"), ("a", 12, "y"), ("a", None, "z"), (None, 3, "w")]
    table = spark.createDataFrame(rows, "g string, id long, v string")
    got = ordered.with_previous(table, ["g"], "id", "v", F.floor(F.col("id") / 10), "before").collect()
    assert len(got) == 4 and {r.v: r.before for r in got}["y"] == "x"


def test_the_next_event_leaves_rows_without_key_or_time(spark):
    asks = spark.createDataFrame([("a", 5), ("a", None), (None, 5), ("b", 9)], "k string, t long")
    events = spark.createDataFrame([("a", 7, "e7"), ("a", 6, "e6"), (None, 6, "no"), ("b", 3, "e3"), ("a", None, "no")], "k string, at long, name string")
    got = ordered.first_at_or_after(asks, events, ["k"], "t", "at", ["name"], lambda c: F.floor(c / 2)).collect()
    assert sorted(((r.k, r.t, r.found and r.found.name) for r in got), key=repr) == sorted(
        [("a", 5, "e6"), ("a", None, None), (None, 5, None), ("b", 9, None)], key=repr)


def test_a_cluster_needs_a_named_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
