"""Writers. Every write goes to a folder the caller names and can be repeated safely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tallyweave.model import BASE_SCENARIO, GRAIN
from tallyweave.operators.asof import plan_current
from tallyweave.session import cut, freeing


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("period_month",), mode: str = "append",
                      sort: Sequence[str] = ("company", "account")) -> None:
    """A fact batch stored by month.

    Rows are rebalanced on the folder columns: AQE splits a month that holds most of the data over
    many tasks and joins small ones, so files come out even. Rows are sorted inside each file, which
    keeps its min/max statistics narrow for later key filters.
    """
    even_files(df, by, sort).write.mode(mode).partitionBy(*by).parquet(path)


def even_files(df: DataFrame, by: Sequence[str], sort: Sequence[str]) -> DataFrame:
    """Rows as ``write_partitioned`` puts them into files."""
    return df.hint("rebalance", *[F.col(c) for c in by]).sortWithinPartitions(*by, *sort)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, base: str | None = None) -> DataFrame:
    """A stored table with a fixed schema, folder columns below ``base`` included; no rows where nothing is stored."""
    try:
        found = spark.read.schema(schema).option("basePath", base or path).parquet(path)
    except AnalysisException as refused:
        if refused.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return found.select(*schema.fieldNames())


def append_once(df: DataFrame, path: str, folder: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add the rows of ``df`` whose key is not stored yet, and return all stored rows of its folders.

    ``df`` has one row per key and folder. Stored rows are never rewritten, so the first record of a key stands and a
    repeat adds what is missing.
    """
    spark, all_keys = df.sparkSession, [*folder, *keys]
    df = cut(df)
    stored = read_or_empty(spark, path, df.schema)
    new = df.join(stored.select(*all_keys), all_keys, "left_anti").select(*df.columns)
    new.write.mode("append").partitionBy(*folder).parquet(path)
    return read_or_empty(spark, path, df.schema).join(df.select(*folder).distinct(), list(folder), "left_semi").select(*df.columns)


def freeze_baseline(plan: DataFrame, plan_version: str, path: str) -> DataFrame:
    """The current plan copied once per version and never rewritten; an empty plan is an error."""
    spark = plan.sparkSession
    target = f"{path}/plan_version={plan_version}"
    if not exists(spark, target):
        lines = plan_current(plan, plan_version).drop("plan_version")
        if lines.isEmpty():
            raise ValueError(f"no plan lines for {plan_version}; nothing to freeze")
        lines.write.mode("overwrite").parquet(target)  # what is there holds no rows
    return spark.read.parquet(target).withColumn("plan_version", F.lit(plan_version))


def import_base_lines(plan: DataFrame, plan_version: str) -> DataFrame:
    """Governed lines from the base scenario's first revision: six-place inputs, recomputed amount, trace.

    A stored amount that differs by cents from quantity x price is kept in the trace.
    """
    c = F.col
    lines = plan.filter((c("plan_version") == plan_version) & (c("scenario_id") == BASE_SCENARIO) & (c("revision") == 1))
    lines = lines.withColumns({
        "quantity": F.round("quantity", 6).cast("decimal(18,6)"), "unit_price": F.round("unit_price", 6).cast("decimal(18,6)"),
        "stored_amount": c("amount_functional")})
    lines = lines.withColumn("amount_functional", F.round(c("quantity") * c("unit_price"), 2).cast("decimal(18,2)"))
    differs = c("stored_amount") != c("amount_functional")
    inputs = F.struct(c("quantity").cast("string").alias("quantity"), c("unit_price").cast("string").alias("unit_price"),
                      F.struct(F.lit("plan").alias("table"), "plan_version", c("scenario_id").alias("scenario"), "revision").alias("source"),
                      F.when(differs, c("stored_amount").cast("string")).alias("stored_amount"))
    trace = F.to_json(F.struct(F.lit("imported_plan").alias("driver"),
                               F.lit("amount_functional = round(quantity x unit_price, 2)").alias("formula"),
                               inputs.alias("inputs"), F.lit("imported_plan").alias("method")))
    return lines.withColumns({"trace": trace, "cents_differ": differs}).select(
        "plan_version", "scenario_id", *GRAIN, "quantity", "unit_price", "amount_functional", "functional_currency",
        "trace", "cents_differ")


def persist_report(report_id: str, head: DataFrame, rows: DataFrame, citations: DataFrame, path: str) -> bool:
    """Head, node lines and leaf citations of one report; a known id is left as it is.

    The head is written last: a job lost half-way leaves no head, and the next try overwrites its parts.
    """
    spark = head.sparkSession
    part = f"report_id={report_id}"
    if exists(spark, f"{path}/report/{part}"):
        return False
    with freeing(spark):
        rows.write.mode("overwrite").parquet(f"{path}/line/{part}")
        citations.write.mode("overwrite").parquet(f"{path}/citation/{part}")
        head.write.mode("overwrite").parquet(f"{path}/report/{part}")
    return True
