"""A cube stored so that its large joins need no shuffle.

The ledger and the plan lie in one folder per month, and inside it in the same number of buckets by the keys that both
share besides the month. The pick of the newest version, the rollup and the match of plan to actual all group by these
keys, so every bucket is read, picked, summed and matched where it lies. Month filters read their folders only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import freeing

BUCKET_KEYS = ("dim_signature_hash", "account", "company")
FOLDER = "period_month"


def store_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """Write a fact table by month and bucket as ``table``, its files at ``path``.

    Rows are dealt out by bucket and month before they are written, so that each folder gets one file per bucket and all
    tasks of the session write; a month that holds most rows still spreads over all buckets. The writer sorts.
    """
    with freeing(df.sparkSession):
        (by_bucket(df, buckets).write.mode("errorifexists").partitionBy(FOLDER)
         .bucketBy(buckets, *BUCKET_KEYS).sortBy(*BUCKET_KEYS).option("compression", "zstd").option("path", path).saveAsTable(table))


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt out as ``store_bucketed`` writes them; rows that lie so already are not moved again."""
    return df.repartition(FOLDER, F.pmod(F.hash(*BUCKET_KEYS), F.lit(max(buckets, 1))))


def joins_in_place(spark: SparkSession) -> None:
    """Let this session join on the buckets although the month is a folder and not one of their keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


@dataclass(frozen=True)
class StoredCube:
    """A cube whose ledger and plan are bucketed tables; small tables are given as they are."""

    spark: SparkSession
    ledger_table: str
    plan_table: str
    vintages: DataFrame
    fx_plan: DataFrame
    fx_actual: DataFrame
    accounts: DataFrame

    @property
    def ledger(self) -> DataFrame:
        return self.spark.table(self.ledger_table)

    def plan(self, scenarios: tuple[str, ...] | None = None) -> DataFrame:
        lines = self.spark.table(self.plan_table)
        return lines if scenarios is None else lines.filter(F.col("scenario_id").isin(*scenarios))
