"""Where a recomputed line's numbers come from, kept as a dictionary of moves.

The moves of one scope (companies, months) share an id. Lines carry the ids of the scopes that reached them and nothing
else; lines of one account with the same ids share a lineage. Each lineage is explained once, by joining its ids with
the drivers and bindings of their scopes, and lines look their explanation up. JSON is written only where a trace
leaves the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.recompute import LINE_KEY, SCOPE, TARGETS, base_only, scope_id

METHOD = "driver_elasticity"
ZERO_BASE = "base value is zero: takes the product of its inputs' ratios"
HELD = "earlier periods are untouched, so readings of them count as 1: values built on them are relative, their ratios exact"


def move(driver: Column, label: Column) -> Column:
    """A driver's move by name; a scoped one says where it holds."""
    return F.when(label == "", driver).otherwise(F.concat(driver, F.lit(" @ "), label))


def scope_label(companies: Column, months: Column) -> Column:
    """Companies, then months; empty for a move of the whole plan."""
    parts = [F.when(F.size(values) > 0, F.array_join(F.array_sort(values), ",")) for values in (companies, months)]
    return F.concat_ws("; ", *parts)


def driver_records(ratios: DataFrame) -> DataFrame:
    """The dictionary of drivers: one row per scope and driver that its moves reach."""
    return ratios.select(
        scope_id().alias("scope_id"), *SCOPE, scope_label(F.col("companies"), F.col("months")).alias("label"),
        F.col("driver_code").alias("driver"), *[F.round(n, 10).alias(n) for n in ("from_value", "to_value", "ratio")],
        "shocked_directly", "formula", F.when(F.col("inherited"), ZERO_BASE).alias("note"))


def binding_records(factors: DataFrame) -> DataFrame:
    """The dictionary of bindings: one row per scope, account, target and bound driver."""
    label = scope_label(F.col("companies"), F.col("months"))
    rows = factors.select(scope_id().alias("scope_id"), label.alias("label"), F.col("account_code").alias("account"), "target",
                          F.explode("sources").alias("s"))
    return rows.select("scope_id", "account", "target", "label", "s.driver", "s.elasticity", "s.ratio", "s.factor")


def term(binding: Column) -> Column:
    """One factor of a line: what a binding makes of its driver's ratio."""
    name = move(binding["driver"], binding["label"])
    return F.concat(F.lit("(1 + "), binding["elasticity"].cast("string"), F.lit(" * ([") , name, F.lit("] - 1))"))


def explained(lineages: DataFrame, drivers: DataFrame, bindings: DataFrame) -> DataFrame:
    """Every (lineage, account, scopes) with its moves, drivers, bindings and the expression they make.

    ``driver`` names the drivers that were moved; where none of the scopes moved one directly, those that are bound.
    """
    parts = lineages.select("lineage", "account", F.explode("scopes").alias("scope_id"))
    entry = F.struct("label", "driver", "from_value", "to_value", "ratio", "shocked_directly", "formula", "note")
    by_driver = parts.select("lineage", "scope_id").join(drivers, "scope_id").groupBy("lineage").agg(
        F.array_sort(F.collect_list(entry)).alias("drivers"),
        F.array_sort(F.collect_set("label")).alias("moves"),
        F.array_sort(F.collect_set(F.when(F.col("shocked_directly"), F.col("driver")))).alias("moved"),
        F.array_sort(F.collect_set(F.when(F.col("note").isNotNull(), move(F.col("driver"), F.col("label"))))).alias("inherited"))
    bound = F.struct("target", "label", "driver", "elasticity", "ratio", "factor")
    by_binding = parts.join(bindings, ["scope_id", "account"]).groupBy("lineage").agg(
        F.array_sort(F.collect_list(bound)).alias("bindings"), F.array_sort(F.collect_set("driver")).alias("bound"))
    out = lineages.join(by_driver, "lineage", "left").join(by_binding, "lineage", "left")
    fallback = F.size(F.coalesce("moved", F.array().cast("array<string>"))) == 0
    names = F.when(fallback, F.coalesce("bound", F.array().cast("array<string>"))).otherwise(F.col("moved"))

    def expression(target: str) -> Column:
        terms = F.transform(F.filter("bindings", lambda b: b["target"] == target), term)
        return F.array_join(F.concat(F.array(F.lit(target)), F.coalesce(terms, F.array().cast("array<string>"))), " * ")

    return out.select(
        "lineage", "moves", F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("none").alias("driver"),
        fallback.alias("by_binding"), F.concat_ws("; ", *map(expression, TARGETS)).alias("expression"), "inherited", "drivers", "bindings",
        F.when(F.exists("drivers", lambda d: d["formula"] != ""), HELD).alias("assumption"))


def traces(recomputed: DataFrame, factors: DataFrame, ratios: DataFrame) -> DataFrame:
    """Base lines of ``recompute_lines(…, sources=True)`` with the typed parts of their trace."""
    keyed = base_only(recomputed).withColumn("lineage", F.substring(F.sha2(F.concat_ws(" ", "account", "scopes"), 256), 1, 16))
    lineages = keyed.groupBy("lineage").agg(F.first("account").alias("account"), F.first("scopes").alias("scopes"))
    known = explained(lineages, driver_records(ratios), binding_records(factors))
    return keyed.drop("scopes").join(known, "lineage")


def trace_json(traced: DataFrame) -> DataFrame:
    """Traces as the JSON text of a governed line: driver, formula, inputs and result."""
    c = F.col
    numbers = F.struct(*[c(n).cast("string").alias(n) for n in TARGETS], c("amount_functional").cast("string").alias("amount"))
    text = F.to_json(F.struct(
        F.lit(METHOD).alias("method"), c("account"), c("driver"), c("expression").alias("formula"),
        F.struct(F.struct(*[c(f"baseline_{t}").cast("string").alias(t) for t in TARGETS]).alias("baseline"),
                 c("drivers"), c("bindings"), c("assumption"),
                 F.struct(*[F.round(f"{t}_factor", 10).alias(t) for t in TARGETS]).alias("applied_factors")).alias("inputs"),
        numbers.alias("result")))
    return traced.select(*LINE_KEY, "amount_functional", text.alias("trace"))
