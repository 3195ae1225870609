"""Neighbours in an order without one task holding a whole group.

A group is cut into buckets of its order column. Inside a bucket a window finds the neighbour;
across buckets only one row per (group, bucket) is looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import cut


def with_previous(df: DataFrame, keys: Sequence[str], order: str, value: str, bucket: Column, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the row before, by ``order`` inside ``keys``. ``bucket`` must grow with the order."""
    rows = df.withColumn("__bucket", bucket)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order)
    rows = rows.withColumns({"__lag": F.lag(F.struct(F.col(value).alias("v"))).over(inside)})
    last = rows.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__bucket")
    carried = last.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"),
        F.lag("__last").over(before).alias("__carried"))
    match = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(carried, match)
    return joined.withColumn(name, F.coalesce("__lag", "__carried")["v"]).select(*df.columns, name)


def first_at_or_after(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
                      payload: Sequence[str], bucket) -> DataFrame:
    """Each left row with ``found``: the earliest right row of its group at or after its time.

    Rows of both sides share one time line, so a group is walked once instead of paired with itself. A left row with a
    NULL key or time stays and finds nothing; a right row with one is found by none.
    """
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col(left_time).isNotNull())
    right = right.dropna(subset=[*keys, right_time])
    left, rest = left.filter(known), left.filter(~known)
    names = left.columns
    item = F.struct(F.col(right_time).alias("at"), *payload)
    events = right.select(*keys, F.col(right_time).alias("__t"), F.lit(1).alias("__kind"), item.alias("__item"))
    asks = left.select(*keys, F.col(left_time).alias("__t"), F.lit(0).alias("__kind"), F.struct(*names).alias("__ask"))
    line = events.unionByName(asks, allowMissingColumns=True).withColumn("__bucket", bucket(F.col("__t")))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__t", "__kind", "__item").rowsBetween(0, Window.unboundedFollowing)
    near = line.withColumn("__near", F.first("__item", ignorenulls=True).over(inside))
    firsts = line.groupBy(*keys, "__bucket").agg(F.min("__item").alias("__first"))
    later = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.withColumn("__later", F.first("__first", ignorenulls=True).over(later)).drop("__first")
    met = (near.filter(F.col("__kind") == 0).join(carried, [*keys, "__bucket"])
           .select("__ask.*", F.coalesce("__near", "__later").alias("found")))
    return met.unionByName(rest.withColumn("found", F.lit(None).cast(met.schema["found"].dataType)))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a column ``name``: the place of each row, from 1, among those of its group in ``order``.

    Rows are range-partitioned over group and order together and counted per partition, so a group that holds most
    rows spreads over many tasks; only one count per group and partition meets in a window.
    """
    keys = [*group, *order]
    at, part, first = f"_{name}_at", f"_{name}_part", f"_{name}_first"
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .withColumn(at, F.monotonically_increasing_id())
                 .withColumn(part, F.spark_partition_id()))
    counts = placed.groupBy(*group, part).agg(F.min(at).alias(first), F.count("*").alias(name))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(name, F.coalesce(F.sum(name).over(before), F.lit(0)))
    other = [F.col(k).alias(f"_{k}") for k in group]
    counts = counts.select(*other, F.col(part).alias(f"_{part}"), first, F.col(name))
    same = F.col(part) == F.col(f"_{part}")
    for k in group:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(counts, same).select(
        *df.columns, (F.col(name) + F.col(at) - F.col(first) + 1).alias(name))
