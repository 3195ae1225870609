"""Parquet tables of a persisted cube, read with fixed schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.model import MASTER_KEYS, MEASURES, TABLE_SCHEMAS


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A cube table. Facts are stored by ``period_month``, so month filters prune folders."""
    schema = TABLE_SCHEMAS[table]
    return spark.read.schema(schema).parquet(os.path.join(root, table)).select(*schema.fieldNames())


def read_master(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A master table, one row per key: of repeated keys the greatest row, so that later joins never multiply lines."""
    key = MASTER_KEYS[table]
    rows = read_table(spark, root, table)
    return rows.groupBy(key).agg(F.max(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(
        *[key if c == key else F.col("r")[c].alias(c) for c in rows.columns])


def metric_registry(spark: SparkSession) -> DataFrame:
    """One row per (measure, account) with the measure's kind and the account's sign."""
    rows = [
        (m.name, m.kind, m.available,
         [(a, 1) for a in m.plus] + [(a, -1) for a in m.minus]
         + ([(a, 1) for a in m.numerator[1]] + [(a, -1) for a in m.numerator[2]] if m.numerator else []))
        for m in MEASURES.values()
    ]
    schema = "measure string, kind string, available boolean, accounts array<struct<account:string,sign:int>>"
    return (
        spark.createDataFrame(rows, schema)
        .select("measure", "kind", "available", F.explode_outer("accounts").alias("a"))
        .select("measure", "kind", "available", "a.account", "a.sign")
    )
