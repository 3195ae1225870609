"""The planning cube as views over the supplied order tables: one posting per order line.

Everything is lazy and exact-decimal. A real installation reads the same shapes
with ``tables.read_table``; the operators only see DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.functions.keys import dim_signature
from tallyweave.functions.money import amount_of
from tallyweave.model import BASE_SCENARIO, BY_HASH, SCENARIOS, VINTAGE_SCHEMA
from tallyweave.operators.asof import carried
from tallyweave.session import listed

PLAN_VERSION = "PV-1"
CUBE_DIMS = ("business_unit", "geo_country", "geo_region", "grade", "intercompany_flag", "practice")

# The account of a posting, by the last digit of its part key.
ACCOUNT_BY_DIGIT = ("41000", "41010", "41020", "41400", "51000", "51050", "51100", "51300", "51400", "63100")
# Quantity and price factors of the plan's scenarios.
SCENARIO_FACTORS = {"base": ("1.00", "1.00"), "stretch": ("1.12", "1.04"), "downside": ("0.90", "0.97")}
# The two ledger closes.
CLOSES = ((1, "2026-07-05 18:00:00", "July close"), (2, "2026-08-12 09:30:00", "August restatement"))
TRUE_UP = Decimal("1.35")
TRUED_UP_ACCOUNTS = ("51000", "51050", "51100")


# Test tables that may arrive as one file with one row group, which a scan cannot split; a stored cube needs none of this.
WIDE_TABLES = ("lineitem", "events", "documents", "conversations")
# The rows that a task takes of a table that has to be dealt out, and of a shuffle.
DEALT_ROWS, SHUFFLED_ROWS = 500_000, 250_000


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose schema is read from its files once per application: supplied tables do not change."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


_HELD: dict[tuple[str, str], list[int]] = {}


def rows_by_task(spark: SparkSession, path: str) -> list[int]:
    """The rows that each task of a scan gets, counted once per application and from the files' footers alone."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _HELD:
        _HELD[key] = [r["count"] for r in read_known(spark, path).groupBy(F.spark_partition_id()).count().collect()]
    return _HELD[key]


def dealt(spark: SparkSession, path: str) -> DataFrame:
    """A wide table in at least as many tasks as there are cores, and more as it grows.

    Only a table that its scan cannot spread is dealt out; any other is read where it lies, without a shuffle.
    """
    df, held = read_known(spark, path), rows_by_task(spark, path)
    cores = spark.sparkContext.defaultParallelism
    more_partitions(spark, -(-sum(held) // SHUFFLED_ROWS))
    if len(held) >= cores and max(held) <= 2 * max(DEALT_ROWS, sum(held) // cores):
        return df
    return df.repartition(max(cores, -(-sum(held) // DEALT_ROWS)))


def more_partitions(spark: SparkSession, wanted: int) -> None:
    """Let shuffles start from at least so many partitions, so that none grows with the input; AQE joins small ones."""
    option = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if wanted > int(spark.conf.get(option, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(option, wanted)


class TestCube:
    """Cube views over one folder of test tables."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = f"{self.folder}/{name}.parquet"
            self._tables[name] = dealt(self.spark, path) if name in WIDE_TABLES else read_known(self.spark, path)
        return self._tables[name]

    @property
    def lines(self) -> int:
        """The order lines, and so the postings of vintage 1."""
        return sum(rows_by_task(self.spark, f"{self.folder}/lineitem.parquet"))

    @cached_property
    def postings(self) -> DataFrame:
        """Vintage 1: every order line as a posting."""
        t = self.table
        line, orders, part, customer, supplier = t("lineitem"), t("orders"), t("part"), t("customer"), t("supplier")
        buyer = t("nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("geo_country"),
            F.col("n_regionkey").alias("buyer_region"))
        region = t("region").select(F.col("r_regionkey").alias("buyer_region"), F.col("r_name").alias("geo_region"))
        seller = t("nation").select(
            F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("company"),
            F.col("n_regionkey").alias("seller_region"))
        part = part.select("p_partkey", "p_type", F.col("p_retailprice").cast("decimal(10,2)").alias("list_price"))
        # Narrow types on purpose: up to 18 digits Spark multiplies decimals as longs.
        price = (
            F.col("list_price") * (100 - F.col("l_linenumber")).cast("decimal(3,0)") * F.lit(Decimal("0.01")).cast("decimal(2,2)")
        ).cast("decimal(14,4)")
        # Orders meet their buyers before lines do: orders are fewer, and lines, the many, then move once for both.
        # Lines meet part and seller while they are narrow.
        bought = (
            orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
            .join(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
            .join(buyer, "c_nationkey").join(region, "buyer_region")
        )
        rows = (
            line.join(part, line.l_partkey == part.p_partkey)
            .join(supplier, line.l_suppkey == supplier.s_suppkey)
            .join(seller, "s_nationkey")
            .join(bought, line.l_orderkey == bought.o_orderkey)
            .select(
                "company",
                F.trunc("o_orderdate", "month").alias("period_month"),
                F.element_at(F.array(*[F.lit(a) for a in ACCOUNT_BY_DIGIT]),
                             (F.col("l_partkey") % 10 + 1).cast("int")).alias("account"),
                F.col("c_mktsegment").alias("business_unit"),
                "geo_country", "geo_region",
                F.col("o_orderpriority").alias("grade"),
                F.when(F.col("s_nationkey") == F.col("c_nationkey"), "Yes").otherwise("No").alias("intercompany_flag"),
                F.col("p_type").alias("practice"),
                F.col("s_name").alias("resource_employee"),
                F.col("l_quantity").cast("decimal(12,4)").alias("quantity"),
                price.alias("unit_price"),
                F.concat(F.lit("CUR_"), F.col("seller_region")).alias("functional_currency"),
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("voucher_no"),
                "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus",
            )
        )
        return (
            rows.withColumn("dim_signature_hash", dim_signature(CUBE_DIMS))
            .withColumn("amount_functional", amount_of(F.col("quantity"), F.col("unit_price")))
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Both vintages in one pass: a corrected posting emits its version 2 beside version 1."""
        rows = self.postings
        corrected = (
            (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("intercompany_flag") == "No"))
        reversed_ = corrected & (F.col("l_orderkey") % 12 == 0)
        trued_up = corrected & ~reversed_ & F.col("account").isin(*TRUED_UP_ACCOUNTS)
        more = (F.col("quantity") * F.lit(TRUE_UP).cast("decimal(3,2)")).cast("decimal(12,4)")

        def version(number: int, deleted: int, quantity: Column) -> Column:
            return F.struct(F.lit(number).alias("_version"), F.lit(deleted).alias("_is_deleted"),
                            quantity.alias("quantity"))

        first = version(1, 0, F.col("quantity"))
        versions = (
            F.when(reversed_, F.array(first, version(2, 1, F.col("quantity"))))
            .when(trued_up, F.array(first, version(2, 0, more)))
            .otherwise(F.array(first))
        )
        return (
            rows.withColumn("v", F.explode(versions))
            .withColumn("quantity", F.col("v.quantity"))
            .withColumn("amount_functional", amount_of(F.col("quantity"), F.col("unit_price")))
            .select(
                "company", "period_month", "account", *CUBE_DIMS, "resource_employee", "dim_signature_hash",
                "quantity", "unit_price", "amount_functional", "functional_currency", "voucher_no",
                "v._version", "v._is_deleted")
        )

    @cached_property
    def vintages(self) -> DataFrame:
        return listed(
            self.spark, CLOSES, "vintage int, closed_at string, note string"
        ).withColumn("closed_at", F.to_timestamp_ntz("closed_at")).select(*VINTAGE_SCHEMA.fieldNames())

    def plan(self, scenarios: Iterable[str] = SCENARIOS, deal: Callable[[DataFrame], DataFrame] = lambda base: base) -> DataFrame:
        """Plan lines, revision 1, for the named scenarios.

        ``deal`` may lay the grains out before their scenarios are made of them: a third of the rows to move.
        """
        base = (
            self.postings.filter(F.col("l_partkey") % 20 != 0)
            .groupBy(*BY_HASH)
            .agg(
                *carried(CUBE_DIMS),
                (F.sum("quantity").cast("decimal(12,4)")
                 + (F.sum("l_partkey") % 7 - 3).cast("decimal(4,0)")).cast("decimal(12,4)").alias("q"),
                F.max("unit_price").alias("p"),
            )
        )
        factors = F.array(*[
            F.struct(F.lit(s).alias("scenario_id"),
                     F.lit(Decimal(SCENARIO_FACTORS[s][0])).cast("decimal(3,2)").alias("qf"),
                     F.lit(Decimal(SCENARIO_FACTORS[s][1])).cast("decimal(3,2)").alias("pf"))
            for s in scenarios])
        lying = deal(base)
        return (
            lying.withColumn("s", F.explode(factors))
            .withColumn("quantity", (F.col("q") * F.col("s.qf")).cast("decimal(12,4)"))
            .withColumn("unit_price", (F.col("p") * F.col("s.pf")).cast("decimal(14,4)"))
            .select(
                F.lit(PLAN_VERSION).alias("plan_version"), "s.scenario_id", F.lit(1).alias("revision"),
                "company", "period_month", "account", *CUBE_DIMS, "dim_signature_hash", "quantity", "unit_price",
                amount_of(F.col("quantity"), F.col("unit_price")).alias("amount_functional"),
                "functional_currency",
                F.when(F.col("account").startswith("41"), "Revenue").otherwise("Cost").alias("plan_line_type"),
                *[c for c in lying.columns if c not in base.columns])
        )

    @cached_property
    def base_plan(self) -> DataFrame:
        return self.plan((BASE_SCENARIO,))

    def plan_history(self, scenarios: Iterable[str] = SCENARIOS) -> DataFrame:
        """The plan with a second revision of its 41000 lines (quantity up 2%)."""
        first = self.plan(scenarios)
        more = (F.col("quantity") * F.lit(Decimal("1.02")).cast("decimal(3,2)")).cast("decimal(12,4)")
        revised = F.when(
            F.col("account") == "41000",
            F.array(F.struct(F.lit(1).alias("revision"), F.col("quantity")),
                    F.struct(F.lit(2).alias("revision"), more.alias("quantity"))),
        ).otherwise(F.array(F.struct(F.lit(1).alias("revision"), F.col("quantity"))))
        return (
            first.withColumn("r", F.explode(revised))
            .withColumn("revision", F.col("r.revision"))
            .withColumn("quantity", F.col("r.quantity"))
            .withColumn("amount_functional", amount_of(F.col("quantity"), F.col("unit_price")))
            .select(*first.columns)
        )

    def _rates(self, start: str) -> DataFrame:
        """One rate per currency and month from the first order's to the last one's."""
        day = self.table("orders").agg(F.struct(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")))
        first, last = (F.trunc(day.scalar()[end], "month") for end in ("first", "last"))
        month = F.explode(F.sequence(first, last, F.expr("interval 1 month")))
        step = (F.month("period_month") % 3).cast("decimal(2,0)") * F.lit(Decimal("0.01")).cast("decimal(3,2)")
        rate = (F.lit(Decimal(start)).cast("decimal(4,2)")
                + F.lit(Decimal("0.10")).cast("decimal(4,2)") * F.col("r_regionkey").cast("decimal(3,0)"))
        if start != "0.50":
            rate = rate + step
        return (
            self.table("region").withColumn("period_month", month)
            .select("period_month", F.concat(F.lit("CUR_"), F.col("r_regionkey")).alias("from_currency"),
                    F.lit("USD").alias("to_currency"), rate.cast("decimal(8,4)").alias("rate"))
        )

    @cached_property
    def fx_plan(self) -> DataFrame:
        return self._rates("0.50").withColumn("plan_version", F.lit(PLAN_VERSION))

    @cached_property
    def fx_actual(self) -> DataFrame:
        return self._rates("0.52")

    @cached_property
    def accounts(self) -> DataFrame:
        kind = (F.when(F.col("account").startswith("41"), "Revenue").when(F.col("account") == "63100", "OpEx")
                .otherwise("COGS"))
        rows = [(a,) for a in (*ACCOUNT_BY_DIGIT, "51500")]
        return listed(self.spark, rows, "account string").withColumn("account_type", kind)

    @cached_property
    def companies(self) -> DataFrame:
        return (
            self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("company"), F.col("r_name").alias("country"),
                    F.concat(F.lit("CUR_"), F.col("n_regionkey")).alias("functional_currency"))
        )
