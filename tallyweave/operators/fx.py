"""Rates, translated rollups and intercompany trade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.model import REVENUE_ACCOUNTS

MIRROR_ACCOUNT = "51500"


def rates_to(fx: DataFrame, to_currency: str = "USD", plan_version: str | None = None) -> DataFrame:
    """Rates into one currency (of one plan version), one row per month and currency: how many there are, and the rate."""
    chosen = fx.filter(F.col("to_currency") == to_currency)
    if plan_version is not None:
        chosen = chosen.filter(F.col("plan_version") == plan_version)
    return chosen.groupBy("period_month", F.col("from_currency").alias("functional_currency")).agg(
        F.count(F.lit(1)).alias("rates"), F.min("rate").alias("rate"))


def checked_rate(rates: str = "rates", rate: str = "rate") -> Column:
    """The row's rate; a row with none, several or one that is not positive fails the query."""
    refusal = F.raise_error(F.format_string("no single positive rate for %s in %s", F.col("functional_currency"),
                                            F.col("period_month").cast("string")))
    return F.when((F.col(rates) == 1) & (F.col(rate) > 0), F.col(rate)).otherwise(refusal)


def with_rate(df: DataFrame, fx: DataFrame, plan_version: str | None = None) -> DataFrame:
    """Rows with how many rates into USD their month and currency have, and that rate."""
    return df.join(rates_to(fx, plan_version=plan_version), ["period_month", "functional_currency"], "left")


def invalid_rates(plan: DataFrame, fx: DataFrame, plan_version: str | None = None) -> DataFrame:
    """Plan lines whose rate is missing, duplicated or not positive."""
    return (
        with_rate(plan, fx, plan_version)
        .withColumn("problem", F.when(F.col("rates").isNull(), "missing").when(F.col("rates") > 1, "duplicate")
                    .when(F.col("rate") <= 0, "nonpositive"))
        .filter(F.col("problem").isNotNull())
    )


def commitments(plan: DataFrame, fx: DataFrame, plan_version: str | None = None) -> DataFrame:
    """The plan in USD per scenario and line type: translated line by line, then added; see ``checked_rate``."""
    usd = (F.col("amount_functional") * checked_rate()).cast("decimal(28,6)")
    return with_rate(plan, fx, plan_version).groupBy("scenario_id", "plan_line_type").agg(
        F.round(F.sum(usd), 2).cast("decimal(28,2)").alias("amount_usd"))


def intercompany(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("intercompany_flag") == "Yes")


def intercompany_net(ledger: DataFrame, fx: DataFrame, *by: str) -> DataFrame:
    """Flagged trade in USD at actual rates, the buyer's mirror negative: whole pairs net to zero."""
    usd = (F.col("amount_functional") * checked_rate()).cast("decimal(28,6)")
    signed = F.when(F.col("account") == MIRROR_ACCOUNT, -usd).otherwise(usd)
    return with_rate(intercompany(ledger), fx).groupBy(*by).agg(
        F.sum(signed).cast("decimal(38,6)").alias("net_usd"), F.count(F.lit(1)).alias("rows"))


def intercompany_unpaired(ledger: DataFrame) -> DataFrame:
    """Signatures and months whose flagged sales and mirror rows do not pair one to one."""
    mirror = F.col("account") == MIRROR_ACCOUNT
    return (
        intercompany(ledger).filter(mirror | F.col("account").isin(*REVENUE_ACCOUNTS))
        .groupBy("dim_signature_hash", "period_month")
        .agg(F.count_if(~mirror).alias("sales"), F.count_if(mirror).alias("mirrors"))
        .filter(F.col("sales") != F.col("mirrors"))
    )

