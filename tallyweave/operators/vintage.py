"""Comparing two closes: why a bridge's gap moved, and whether an answer drifted."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.keys import lane, row_digest
from tallyweave.model import BY_HASH, COST_TYPES, GRAIN
from tallyweave.operators.asof import require_vintage
from tallyweave.operators.bridge import roll_up
from tallyweave.session import cut

SIDES = ("left", "right")


def delta_lines(lines: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Matched lines present at either close, from lines with ``left_``/``right_`` actuals (NULL: not matched).

    ``keys`` (the grain, where the lines have it) name one line each; see ``checked_keys``.
    """
    c = F.col
    if keys is None and all(k in lines.columns for k in GRAIN):
        keys = BY_HASH
    return (checked_keys(lines, keys) if keys else lines).withColumns({
        "is_cost": c("account_type").isin(*COST_TYPES),
        "has_left": c("left_amount_functional").isNotNull(), "has_right": c("right_amount_functional").isNotNull(),
    }).filter(c("has_left") | c("has_right"))


def key_full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two reads matched by ledger key, with each side's values and presence."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return checked_keys(df, keys).select(*keys, *[F.col(v).alias(f"{name}_{v}") for v in values], F.lit(True).alias(f"has_{name}"))

    joined = side(left, "left").join(side(right, "right"), list(keys), "full_outer")
    return joined.withColumns({f"has_{s}": F.coalesce(f"has_{s}", F.lit(False)) for s in SIDES})


def _added(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(22,2)")


def vintage_delta(lines: DataFrame, levels: Sequence[str] = (), margin: bool | None = None) -> DataFrame:
    """Per node: both gaps and the change as restated, reversed and new lines; the parts sum to the change."""
    c = F.col
    was, now, plan = c("left_amount_functional"), c("right_amount_functional"), c("plan_amount")
    both, gone, fresh = c("has_left") & c("has_right"), c("has_left") & ~c("has_right"), ~c("has_left") & c("has_right")
    restated = both & (now != was) & (c("actual_fx") != 0)
    # part: (lines it takes, their actual amounts, how often the plan amount counts)
    parts = {
        "left_gap": (c("has_left"), was, 1), "right_gap": (c("has_right"), now, 1), "restated": (restated, now - was, 0),
        "reversed": (gone, -was, -1), "new": (fresh, now, 1),
    }
    counts = {"restated_lines": restated, "reversed_lines": gone, "new_lines": fresh}
    # Per path and rate pair first: a gap is actual x actual rate - plan x plan rate, so sums are translated, not lines.
    sums = lines.groupBy(*levels, "is_cost", "plan_fx", "actual_fx").agg(
        F.count(F.lit(1)).alias("lines"),
        *[_added(F.when(on, amount)).alias(f"{n}_actual") for n, (on, amount, _) in parts.items()],
        *[_added(F.when(on, plan * F.lit(times))).alias(f"{n}_plan") for n, (on, _, times) in parts.items() if times],
        *[F.count_if(on).alias(n) for n, on in counts.items()])

    def usd(n: str) -> Column:
        value = c(f"{n}_actual") * c("actual_fx")
        return (value - c(f"{n}_plan") * c("plan_fx") if parts[n][2] else value).cast("decimal(30,6)")

    side = {"r": ~c("is_cost"), "c": c("is_cost")}
    cells = sums.withColumns({n: usd(n) for n in parts}).groupBy(*levels).agg(
        *[F.coalesce(F.sum(F.when(s, c("lines"))), F.lit(0)).alias(f"{p}_lines") for p, s in side.items()],
        *[F.coalesce(F.sum(F.when(s, c(n))), F.lit(0)).cast("decimal(38,6)").alias(f"{p}_{n}")
          for p, s in side.items() for n in parts],
        *[F.sum(n).alias(n) for n in counts])
    cells = cells if margin is not None else cut(cells)
    flag = F.lit(margin) if margin is not None else cells.agg(
        ((F.sum("r_lines") > 0) & (F.sum("c_lines") > 0)).alias("m")).scalar()
    sign = F.when(F.coalesce(flag, F.lit(False)), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    nodes = roll_up(cells, levels).withColumns(
        {n: (c(f"r_{n}") + sign * c(f"c_{n}")).cast("decimal(38,6)") for n in parts})
    nodes = nodes.withColumn("change", (c("right_gap") - c("left_gap")).cast("decimal(38,6)"))
    explained = c("restated") + c("reversed") + c("new")
    return nodes.withColumn("residual", (c("change") - explained).cast("decimal(38,6)")).select(
        *levels, "level", *parts, "change", "residual", *counts)


def bad_keys(lines: DataFrame, keys: Sequence[str] = GRAIN) -> DataFrame:
    """Keys that are NULL or appear twice on one side; a vintage read has one row per key."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return (
        lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        .filter(missing | (F.col("rows") > 1))
        .withColumn("problem", F.when(missing, "null key").otherwise("repeated key"))
    )


def checked_keys(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lines; a key that is NULL or stands on two of them fails the query, because it would be compared twice.

    Lines that come from a rollup or a join by these keys lie in place, so counting them adds no shuffle.
    """
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    missing = reduce(lambda a, k: a | F.col(k).isNull(), keys, F.lit(False))
    refusal = F.raise_error(F.concat(F.when(missing, "null").otherwise("repeated"), F.lit(" key in a vintage read: "),
                                     F.to_json(F.struct(*keys)))).cast("boolean")
    return lines.withColumn("__once", F.when(missing | (count > 1), refusal).otherwise(F.lit(True))).filter("__once").drop("__once")


LANES = 4


def content_digest(df: DataFrame, columns: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """Row count, totals and an order-free digest of a result.

    Each row's sha256 is cut into four lanes that are added up and xor-ed, so the digest is
    combined map-side; rows are never gathered to be sorted.
    """
    rows = df.withColumn("__d", row_digest(columns))
    sums = [F.sum(lane(F.col("__d"), i).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in range(LANES)]
    xors = [F.bit_xor(lane(F.col("__d"), i)).alias(f"x{i}") for i in range(LANES)]
    grouped = rows.agg(F.count(F.lit(1)).alias("rows"), *sums, *xors,
                       *[F.coalesce(F.sum(t), F.lit(0)).cast("decimal(38,4)").alias(f"total_{t}") for t in totals])
    parts = [F.coalesce(F.col(f"{k}{i}").cast("string"), F.lit("")) for k in "sx" for i in range(LANES)]
    return grouped.withColumn("digest", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *parts), 256)).select(
        "rows", "digest", *[f"total_{t}" for t in totals])


def reconcile(left: DataFrame, right: DataFrame, columns: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """One answer at two closes: rows, digests, totals, their differences and the drift flag."""
    names = ("rows", "digest", *[f"total_{t}" for t in totals])
    sides = content_digest(left, columns, totals).withColumn("side", F.lit("left")).unionByName(
        content_digest(right, columns, totals).withColumn("side", F.lit("right")))
    out = sides.agg(*[F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{s}_{n}") for s in SIDES for n in names])
    deltas = {f"delta_{t}": (F.col(f"right_total_{t}") - F.col(f"left_total_{t}")).cast("decimal(38,4)") for t in totals}
    return out.withColumns({**deltas, "drift": F.col("left_digest") != F.col("right_digest")})


def reconcile_closes(answer: Callable[[object], DataFrame], vintages: DataFrame, left: object, right: object,
                     columns: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """The same answer read at two moments; a moment before the first close is refused, not answered with no rows."""
    for moment in (left, right):
        require_vintage(vintages, moment)
    return reconcile(answer(left), answer(right), columns, totals)


def restatements(ledger: DataFrame) -> DataFrame:
    """Rows, reversals and amounts per vintage of a ledger slice."""
    return ledger.groupBy("_version").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_is_deleted") == 1).alias("reversals"),
        F.sum("amount_functional").cast("decimal(38,2)").alias("amount"),
        F.sum("quantity").cast("decimal(38,4)").alias("quantity"))
