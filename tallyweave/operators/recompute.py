"""Driver re-forecast: shocks, ratios, factors, recomputed lines, and publishing them.

Drivers, bindings and shocks are small governance tables; plan lines are the large side and are
read once, in place, with the factors that apply to them attached by account.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyweave.model import BASE_SCENARIO, BY_HASH
from tallyweave.operators.asof import latest_revision, plan_current
from tallyweave.operators.ordered import first_at_or_after
from tallyweave.operators.fx import checked_rate, rates_to
from tallyweave.session import cut, listed

SCOPE = ("companies", "months")
LINE_KEY = ("plan_version", *BY_HASH, "scenario_id")
#: A number that the line's key determines, by which lines may be dealt out; see ``unpublish``.
PART = "__part"
#: The columns by which a stored plan lies in folders.
FOLDER = ("scenario_id", "period_month")
Deal = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Driver:
    """A driver and its formula over the values of the drivers listed before it."""

    code: str
    formula: Callable[[dict[str, Column]], Column] | None = None
    depends: tuple[str, ...] = ()
    text: str = ""
    value: float | None = None


# -- shock sets --------------------------------------------------------------------------------


def merge_shocks(committed: DataFrame, requested: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Published and requested moves as one set per ``keys``: a driver moved again keeps its first
    ``from`` and takes the latest ``to``; a move back to the start stays, with a ratio of one."""
    on = [*keys, "driver_code", *SCOPE]

    def scoped(df: DataFrame) -> DataFrame:
        return df.withColumns({s: F.array_sort(s) for s in SCOPE})

    old = scoped(committed).select(*on, F.col("from_value").alias("old_from"), F.col("to_value").alias("old_to"))
    new = scoped(requested).select(*on, F.col("from_value").alias("new_from"), F.col("to_value").alias("new_to"))
    return old.join(new, on, "full_outer").select(
        *on, F.coalesce("old_from", "new_from").alias("from_value"), F.coalesce("new_to", "old_to").alias("to_value"))


def committed_shocks(publications: DataFrame, shocks: DataFrame) -> DataFrame:
    """Per plan version, the shocks of its newest COMMITTED revision (one row per shock)."""
    current = (
        publications.filter(F.col("state") == "COMMITTED").groupBy("plan_version").agg(F.max("revision").alias("revision"))
    )
    return shocks.join(current, ["plan_version", "revision"])


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(driver, dependent) pairs reachable over (driver, depends_on) edges, each pair once.

    One join per level of the driver graph; every level's new pairs are kept in the shared folder,
    so no level recomputes the ones before it. It ends, cycles or not, when a level has no new pair.
    """
    children = edges.select(F.col("depends_on").alias("dependent"), F.col("driver").alias("next"))
    frontier = roots.select(F.col("driver"), F.col("driver").alias("dependent")).distinct()
    reached: DataFrame | None = None
    while True:
        step = frontier.join(children, "dependent").select("driver", F.col("next").alias("dependent")).distinct()
        if reached is not None:
            step = step.join(reached, ["driver", "dependent"], "left_anti")
        step = cut(step)
        if step.isEmpty():
            break
        reached = step if reached is None else reached.unionByName(step)
        frontier = step
    return reached if reached is not None else roots.select("driver", F.col("driver").alias("dependent")).limit(0)


def inherited_ratios(pairs: DataFrame, shocks: DataFrame) -> DataFrame:
    """Without formulas: a driver's ratio is the product of the ratios of every shock that reaches it."""
    moved = shocks.select(F.col("driver_code").alias("driver"), (F.col("to_value") / F.col("from_value")).alias("ratio"))
    reach = moved.select("driver", F.col("driver").alias("dependent")).distinct().unionByName(
        pairs.select("driver", "dependent")).distinct()
    return reach.join(moved, "driver").groupBy(F.col("dependent").alias("driver_code")).agg(F.product("ratio").alias("ratio"))


# -- ratios from formulas ----------------------------------------------------------------------


def shock_grid(shocks: DataFrame, drivers: Sequence[Driver], keys: Sequence[str]) -> DataFrame:
    """One row per shock set (``keys``), with the pinned from/to of every driver it moves."""
    def pinned(side: str, code: str) -> Column:
        return F.max(F.when(F.col("driver_code") == code, F.col(f"{side}_value"))).alias(f"{side}_{code}")

    return shocks.groupBy(*keys).agg(*[pinned(side, d.code) for d in drivers for side in ("from", "to")])


def evaluate_ratios(grid: DataFrame, drivers: Sequence[Driver], keys: Sequence[str]) -> DataFrame:
    """Old value, new value and ratio of every driver a set's shocks reach.

    Drivers come in dependency order and each is one column expression. A driver whose old value is
    zero has no ratio of its own and takes the product of its inputs' ratios; a division by zero
    makes both its values zero.
    """
    made: list[Column] = []  # later columns read earlier ones of the same select, so the plan is analysed once
    for d in drivers:
        pin_old, pin_new = F.col(f"from_{d.code}"), F.col(f"to_{d.code}")
        hit = pin_old.isNotNull()
        dirty = reduce(lambda a, p: a | F.col(f"dirty_{p}"), d.depends, hit)
        inherited = reduce(lambda a, p: a * F.when(F.col(f"dirty_{p}"), F.col(f"ratio_{p}")).otherwise(F.lit(1.0)),
                           d.depends, F.lit(1.0))
        if d.formula is None:
            old, new = pin_old, pin_new
            ratio = F.coalesce(pin_new / F.nullif(pin_old, F.lit(0.0)), inherited)
        else:
            was = d.formula({p: F.col(f"old_{p}") for p in d.depends}).cast("double")
            now = d.formula({p: F.col(f"new_{p}") for p in d.depends}).cast("double")
            failed = was.isNull() | now.isNull()
            old = F.when(hit, pin_old).when(failed, F.lit(0.0)).otherwise(was)
            new = F.when(hit, pin_new).when(failed, F.lit(0.0)).otherwise(now)
            ratio = F.coalesce(F.col(f"new_{d.code}") / F.nullif(F.col(f"old_{d.code}"), F.lit(0.0)), inherited)
        made += [c.alias(f"{n}_{d.code}") for n, c in (("old", old), ("new", new), ("dirty", dirty), ("ratio", ratio), ("hit", hit))]
    out = grid.select(*keys, *made)
    entry = F.explode(F.array(*[
        F.struct(F.lit(d.code).alias("driver_code"), F.col(f"old_{d.code}").alias("from_value"),
                 F.col(f"new_{d.code}").alias("to_value"), F.col(f"ratio_{d.code}").alias("ratio"),
                 F.col(f"hit_{d.code}").alias("shocked_directly"), F.lit(d.text).alias("formula"),
                 (F.col(f"old_{d.code}") == 0).alias("inherited"), F.col(f"dirty_{d.code}").alias("dirty"))
        for d in drivers]))
    return out.select(*keys, entry.alias("e")).select(*keys, "e.*").filter("dirty").drop("dirty")


def account_factors(ratios: DataFrame, bindings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """factor = 1 + elasticity·(ratio − 1), multiplied per (set, account, target)."""
    bound = ratios.join(bindings, "driver_code").withColumn(
        "factor", F.lit(1.0) + F.col("elasticity") * (F.col("ratio") - F.lit(1.0)))
    source = F.struct(F.col("driver_code").alias("driver"), "elasticity", F.round("ratio", 10).alias("ratio"),
                      F.round("factor", 10).alias("factor"))
    return bound.groupBy(*keys, "account_code", "target").agg(
        F.product("factor").alias("factor"), F.array_sort(F.collect_list(source)).alias("sources"))


def plan_factors(shocks: DataFrame, drivers: Sequence[Driver], bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors of one shock set, each with its companies and months, and the driver ratios behind them."""
    scoped = shocks.withColumns({s: F.array_sort(s) for s in SCOPE})
    ratios = evaluate_ratios(shock_grid(scoped, drivers, SCOPE), drivers, SCOPE)
    return account_factors(ratios, bindings, SCOPE), ratios


def dirty_scopes(factors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The accounts touched per (companies, months); an empty list means all."""
    return factors.groupBy(*keys, *SCOPE).agg(F.array_sort(F.collect_set("account_code")).alias("accounts"))


# -- lines -------------------------------------------------------------------------------------


TARGETS = ("quantity", "unit_price")
#: A scope limits companies, months, both or neither; each kind is looked up by its own key.
KINDS = (("company", "month"), ("company",), ("month",), ())


def scope_id() -> Column:
    """A short name of a row's scope: the same companies and months, in any order, have the same."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.array_join(F.array_sort(s), ",") for s in SCOPE]), 256), 1, 16)


def per_key(scoped: DataFrame) -> DataFrame:
    """Rows with (companies, months) lists as one row per company and month; NULL where the scope is open."""
    return (scoped.withColumn("company", F.explode_outer(F.array_distinct("companies")))
            .withColumn("month", F.explode_outer(F.array_distinct("months"))))


def looked_up(lines: DataFrame, entries: DataFrame, columns: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Lines with, for each kind of scope, the aggregates of the entries that cover them (``name_kind``).

    Entries are unique per key once aggregated, so lines are never multiplied; each lookup is a plain left join.
    """
    out = lines.withColumn("month", F.date_format("period_month", "yyyy-MM-dd"))
    for n, kind in enumerate(KINDS):
        part = entries
        for axis in ("company", "month"):
            part = part.filter(F.col(axis).isNotNull() if axis in kind else F.col(axis).isNull())
        part = part.groupBy("account", *kind).agg(*[c.alias(f"{name}_{n}") for c, name in zip(columns, names, strict=True)])
        out = out.join(part, ["account", *kind], "left")
    return out.drop("month")


def with_factors(lines: DataFrame, factors: DataFrame, sources: bool = False, keep: bool = False) -> DataFrame:
    """Lines that some factor covers, with the product of their factors per target.

    ``keep`` keeps the others too, and tells in ``covered`` which is which. ``sources`` also adds ``scopes``: the ids of the scopes behind the factors, in order, for a trace.
    """
    entries = per_key(factors.withColumnRenamed("account_code", "account").withColumn("scope_id", scope_id()))
    columns = [F.product(F.when(F.col("target") == t, F.col("factor"))) for t in TARGETS]
    columns.append(F.count(F.lit(1)))
    names = [*TARGETS, "covered"]
    names[:2] = [f"{t}_factor" for t in TARGETS]
    if sources:
        columns.append(F.collect_set("scope_id"))
        names.append("scopes")
    found = looked_up(lines, entries, columns, names)
    kinds = range(len(KINDS))

    def product(name: str) -> Column:
        return reduce(lambda a, n: a * F.coalesce(f"{name}_{n}", F.lit(1.0)), kinds, F.lit(1.0))

    covered = F.coalesce(*[f"covered_{n}" for n in kinds]).isNotNull()
    found = found.withColumn("covered", covered) if keep else found.filter(covered)
    out = found.withColumns({f"{t}_factor": product(f"{t}_factor") for t in TARGETS})
    if sources:
        empty = F.array().cast("array<string>")
        out = out.withColumn("scopes", F.array_sort(F.concat(*[F.coalesce(f"scopes_{n}", empty) for n in kinds])))
    return out.drop(*[f"{name}_{n}" for name in names for n in kinds])


def in_dirty(lines: DataFrame, scopes: DataFrame) -> DataFrame:
    """Lines inside some (accounts, companies, months) scope."""
    entries = per_key(scopes.select(F.explode("accounts").alias("account"), *SCOPE))
    found = looked_up(lines, entries, [F.count(F.lit(1))], ["covered"])
    names = [f"covered_{n}" for n in range(len(KINDS))]
    return found.filter(F.coalesce(*names).isNotNull()).select(*lines.columns)


def dirty_counts(baseline: DataFrame, scopes: DataFrame) -> DataFrame:
    return in_dirty(baseline, scopes).groupBy("scenario_id", "period_month").agg(F.count(F.lit(1)).alias("lines"))


MOVED = "decimal(18,6)"


def recompute_lines(baseline: DataFrame, factors: DataFrame, scopes: DataFrame | None = None,
                    sources: bool = False) -> DataFrame:
    """New quantity, price and amount of the dirty lines, under every factor that applies to them.

    Inputs are rounded to six places half up, then their product to cents. ``scopes`` limits which
    lines are rewritten (the requested moves) without limiting the moves they carry. A trace needs ``sources``.
    """
    lines = baseline if scopes is None else in_dirty(baseline, scopes)
    return _moved(with_factors(lines, factors, sources))


def _moved(lines: DataFrame) -> DataFrame:
    """Lines with their quantity and price times their factors, and what they were."""
    out = lines.withColumns({"baseline_quantity": F.col("quantity"), "baseline_unit_price": F.col("unit_price")})
    out = out.withColumns({
        "quantity": (F.col("quantity").cast("double") * F.col("quantity_factor")).cast(MOVED),
        "unit_price": (F.col("unit_price").cast("double") * F.col("unit_price_factor")).cast(MOVED)})
    return out.withColumn("amount_functional", F.round(F.col("quantity") * F.col("unit_price"), 2).cast("decimal(18,2)"))


def with_after_amounts(live: DataFrame, factors: DataFrame) -> DataFrame:
    """Published lines with ``after_amount``: what each would be if the moves were published. One scan, nothing is staged."""
    before = with_factors(live, factors, keep=True).withColumn("before_amount", F.col("amount_functional"))
    return _moved(before).select(
        *[c for c in live.columns if c not in ("quantity", "unit_price", "amount_functional")],
        F.col("baseline_quantity").alias("quantity"), F.col("baseline_unit_price").alias("unit_price"),
        F.col("before_amount").alias("amount_functional"),
        F.when(F.col("covered"), F.col("amount_functional")).otherwise(F.col("before_amount")).alias("after_amount"))


def base_only(lines: DataFrame) -> DataFrame:
    """Only the base scenario is the governed record; the other branches are staged without traces."""
    return lines.filter(F.col("scenario_id") == BASE_SCENARIO)


# -- staging and publishing ---------------------------------------------------------------------


def stage(recomputed: DataFrame, revision: int, columns: Sequence[str]) -> DataFrame:
    return recomputed.withColumn("revision", F.lit(revision)).select(*columns)


def _beside(live: DataFrame, staged: DataFrame, **more: Column) -> DataFrame:
    """Live and staged lines in one table, ``__new`` telling which is which; ``more`` names columns of staged lines only.

    Windows over the line's key then match both. Lines that come from one plan lie by their grain already, so they meet
    where they are; and since both sides ask the plan for the same columns, Spark computes it once. A join would ask for
    other columns of each side and deal both out again, by scenario too.
    """
    old = [c for c in live.columns if c in staged.columns]
    new = staged.select(*old, *[c.alias(name) for name, c in more.items()], F.lit(True).alias("__new"))
    return live.withColumn("__new", F.lit(False)).unionByName(new, allowMissingColumns=True)


def of_line(both: DataFrame) -> WindowSpec:
    """Lines of one key, found inside their part where ``both`` was dealt out by parts.

    The hash first makes sorts short; lines of parts are sorted as their folders hold them, so they are not sorted twice.
    """
    first = (*FOLDER, *BY_HASH) if PART in both.columns else BY_HASH
    return Window.partitionBy(*dict.fromkeys([*first, *LINE_KEY, *[c for c in both.columns if c == PART]]))


def whole(line: WindowSpec) -> WindowSpec:
    """All lines of one key, in the order of ``line``: one pass serves both."""
    return line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _known() -> Column:
    """A line meets another only if its whole key is known."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in LINE_KEY])


def _as_in(live: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns with the types they had in ``live``."""
    return [F.col(c).cast(live.schema[c].dataType).alias(c) for c in names]


def _with_staged(live: DataFrame, staged: DataFrame, outer: bool, **more: Column) -> DataFrame:
    """Live lines with ``more`` of each staged line of their key; ``outer`` keeps those that have none."""
    both = _beside(live, staged, **more)
    each = F.collect_list(F.when(F.col("__new"), F.struct(*more))).over(of_line(both))
    met = both.withColumn("__met", F.when(_known(), each)).filter(~F.col("__new"))
    names = [*LINE_KEY, *[c for c in live.columns if c not in LINE_KEY]]
    return met.withColumn("__met", (F.explode_outer if outer else F.explode)("__met")).select(
        *_as_in(live, names), *[F.col(f"__met.{name}").alias(name) for name in more])


def preimage(live: DataFrame, staged: DataFrame, revision: int, deal: Deal = lambda both: both) -> DataFrame:
    """The published rows a revision is about to replace. ``deal`` may lay the lines out before they meet."""
    both = deal(_beside(live, staged.filter(F.col("revision") == revision)))
    line = of_line(both)
    line = line.orderBy("__new", F.desc("revision"))
    both = both.withColumns({"__rank": F.row_number().over(line), "__met": F.max("__new").over(whole(line)) & _known()})
    return both.filter(~F.col("__new") & (F.col("__rank") == 1) & F.col("__met")).select(
        *_as_in(live, live.columns)).withColumn("preimage_for_revision", F.lit(revision))


def publish_mismatch(staged: DataFrame, plan_version: str, revision: int, expected: int | Column) -> DataFrame:
    """Scenarios whose staged count is not the approved one, and a missing base."""
    counts = (
        staged.filter((F.col("plan_version") == plan_version) & (F.col("revision") == revision))
        .groupBy("scenario_id").agg(F.count(F.lit(1)).alias("staged"))
    )
    base = listed(staged.sparkSession, [(BASE_SCENARIO,)], "scenario_id string")
    return (
        counts.join(base, "scenario_id", "full_outer")
        .select("scenario_id", F.coalesce("staged", F.lit(0).cast("long")).alias("staged"), (expected if isinstance(expected, Column) else F.lit(expected)).cast("long").alias("expected"))
        .filter(F.col("staged") != F.col("expected"))
    )


def publish(live: DataFrame, staged: DataFrame, revision: int) -> DataFrame:
    """The published plan with a revision in place: its rows, and the live ones that it does not replace.

    Publishing twice is publishing once: the second time the revision's rows replace themselves.
    """
    fresh = staged.filter(F.col("revision") == revision)
    return live.join(fresh.select(*LINE_KEY), list(LINE_KEY), "left_anti").select(*live.columns).unionByName(fresh)


def unpublish(live: DataFrame, preimages: DataFrame, revision: int, deal: Deal = lambda both: both) -> DataFrame:
    """The plan as it was before a revision: its rows out, the replaced rows back in where no later revision stands.

    Doing it twice is doing it once. ``deal`` may lay the replaced rows and the keys that stay out before they meet;
    rows that stay are not moved.
    """
    kept = live.filter(F.col("revision") != revision)
    back = preimages.filter(F.col("preimage_for_revision") == revision).select(*live.columns)
    both = deal(_beside(back, kept.select(*LINE_KEY)))
    met = F.max("__new").over(of_line(both)) & _known()
    returned = both.withColumn("__met", met).filter(~F.col("__new") & ~F.col("__met"))
    return kept.unionByName(returned.select(*live.columns))


def discard(staged: DataFrame, revision: int) -> DataFrame:
    return staged.filter(F.col("revision") != revision)


def live_with_staged(live: DataFrame, staged: DataFrame, plan_version: str, revision: int) -> DataFrame:
    """Every published line of a plan with the amount it would have if the revision's staged rows replaced theirs."""
    found = _with_staged(plan_current(live, plan_version), _of(staged, plan_version, revision), True,
                         staged_amount=F.col("amount_functional"))
    return found.withColumn("after_amount", F.coalesce("staged_amount", "amount_functional"))


def _of(rows: DataFrame, plan_version: str, revision: int) -> DataFrame:
    return rows.filter((F.col("plan_version") == plan_version) & (F.col("revision") == revision))


def baseline_vs_staged(baseline: DataFrame, staged: DataFrame, fx_plan: DataFrame, accounts: DataFrame,
                       plan_version: str, revision: int) -> DataFrame:
    """A plan's frozen lines and a revision's recomputed ones side by side, as a bridge's plan and actual.

    A line without one positive rate is refused when it is read.
    """
    rates = rates_to(fx_plan, plan_version=plan_version)
    was = baseline.filter(F.col("plan_version") == plan_version).select(*LINE_KEY, "functional_currency", F.col("quantity").alias("plan_quantity"),
                          F.col("unit_price").alias("plan_unit_price"), F.col("amount_functional").alias("plan_amount"))
    now = _of(staged, plan_version, revision).withColumns({
        "plan_quantity": F.col("quantity"), "plan_unit_price": F.col("unit_price"), "plan_amount": F.col("amount_functional")})
    return (
        _with_staged(was, now, False, actual_quantity=F.col("quantity"), actual_unit_price=F.col("unit_price"),
                     actual_amount=F.col("amount_functional"))
        .join(accounts.select("account", "account_type"), "account")
        .join(rates, ["period_month", "functional_currency"], "left")
        .withColumn("plan_fx", checked_rate()).withColumn("actual_fx", F.col("plan_fx")).drop("rates", "rate")
    )


# -- requests ----------------------------------------------------------------------------------


def idempotency_key(plan: Column, scenarios: Column, shocks: Column) -> Column:
    """sha256 of the request's canonical JSON, first 32 hex digits; list order does not matter."""
    body = F.to_json(F.struct(plan.alias("plan_version"), F.array_sort(scenarios).alias("scenarios"),
                              F.array_sort(shocks).alias("shocks")))
    return F.substring(F.sha2(body, 256), 1, 32)


ANY, SOME = "*", "?"


def _cells(rows: DataFrame, sets: Sequence[str], empty: Sequence[str], more: Sequence[str]) -> DataFrame:
    """Rows once per combination of the elements of their sets, in ``company_key`` and ``month_key``.

    An empty set stands as ``empty``, another as its elements and ``more``.
    """
    def keys(name: str) -> Column:
        few = F.array(*map(F.lit, empty)).cast("array<string>")
        extra = F.array(*map(F.lit, more)).cast("array<string>")
        return F.explode(F.when(F.size(name) == 0, few).otherwise(F.concat(F.array_distinct(name), extra)))

    return rows.withColumn("company_key", keys(sets[0])).withColumn("month_key", keys(sets[1]))


def current_value(slices: DataFrame, shocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per asked-for slice: base value times every published move that covers all of it.

    A move that only partly overlaps the slice has no single current value; the row is refused. A move covers a slice
    when on each axis it is open or holds all of the slice's values; it overlaps one when on each axis it is open, the
    slice is open or they share a value.

    Slices and scopes meet through the cells (company, month) that both list, so a slice sees only scopes that overlap
    it, and the count of shared cells tells whether it is covered. Where a slice is open on an axis that a scope limits,
    it can only be overlapped: such scopes are one row per cell, however many they are.
    """
    # moves of one scope act as one: a slice meets scopes, not moves
    moves = shocks.groupBy("plan_version", "driver_code", F.array_sort(F.array_distinct("companies")).alias("by_companies"),
                           F.array_sort(F.array_distinct("months")).alias("by_months")).agg(
        F.product(F.col("to_value") / F.col("from_value")).alias("ratio"))
    on = ["plan_version", "driver_code", "company_key", "month_key"]
    spread = _cells(moves, ["by_companies", "by_months"], [ANY], [SOME])
    open_cell = (F.col("company_key") == SOME) | (F.col("month_key") == SOME)
    exact = spread.filter(~open_cell).select(
        *on, F.struct(F.size("by_companies").alias("companies"), F.size("by_months").alias("months"),
                      F.xxhash64("by_companies", "by_months").alias("scope"), "ratio").alias("hit"))
    index = exact.unionByName(spread.filter(open_cell).select(*on).distinct(), allowMissingColumns=True)

    asked = _cells(slices, ["companies", "months"], [SOME, ANY], [ANY])
    met = asked.join(index, on).select(
        *keys, F.size(F.array_distinct("companies")).alias("n_companies"), F.size(F.array_distinct("months")).alias("n_months"), "hit")
    # cells to share: all of the slice's values on an axis that the scope limits, one on an open axis
    need = F.greatest(F.when(F.col("hit.companies") > 0, F.col("n_companies")).otherwise(1), F.lit(1)) * F.greatest(
        F.when(F.col("hit.months") > 0, F.col("n_months")).otherwise(1), F.lit(1))
    by_scope = met.groupBy(*keys, "hit", need.alias("need")).agg(F.count(F.lit(1)).alias("shared"))
    whole = F.coalesce(F.col("hit").isNotNull() & (F.col("shared") == F.col("need")), F.lit(False))
    found = by_scope.groupBy(*keys).agg(
        F.product(F.when(whole, F.col("hit.ratio")).otherwise(F.lit(1.0))).alias("moved"), F.bool_or(~whole).alias("partly"))
    refused = F.coalesce("partly", F.lit(False))
    return slices.select(*keys, "base_value").join(found, list(keys), "left").select(
        *keys, "base_value", refused.alias("refused"),
        F.when(~refused, F.col("base_value") * F.coalesce("moved", F.lit(1.0))).alias("current_value"))


def resolve_target(requests: DataFrame) -> DataFrame:
    """``to_value``, ``by_amount`` or ``by_percent`` against the current value, with the reason where refused."""
    c = F.col
    given = sum((F.when(c(n).isNotNull(), 1).otherwise(0) for n in ("by_amount", "by_percent")),
                F.when(c("to_value").isNotNull(), 1).otherwise(0))
    target = (
        F.when(c("to_value").isNotNull(), c("to_value"))
        .when(c("by_amount").isNotNull(), F.bround(c("current_value") + c("by_amount"), 10))
        .otherwise(F.bround(c("current_value") * (F.lit(1.0) + c("by_percent") / F.lit(100.0)), 10))
    )
    ratio_driver = c("base_value") <= 1
    refusal = (
        F.when(given != 1, "give exactly one of to_value, by_amount, by_percent")
        .when(c("to_value") <= 0, "to_value must be greater than zero")
        .when(ratio_driver & (c("to_value") > 1), "a ratio driver takes a value up to one")
        .when(ratio_driver & (F.abs("by_amount") > 1), "a ratio driver moves by less than one")
        .when(c("target") <= 0, "that change leaves no positive value")
        .when(F.abs(c("target") - c("current_value")) < F.lit(1e-12), "the driver already has that value")
    )
    basis = F.when(c("to_value").isNotNull(), "absolute").when(c("by_amount").isNotNull(), "points").otherwise("relative")
    delta = c("target") - c("current_value")
    other = F.when(basis == "points", F.bround(c("current_value") * (F.lit(1.0) + delta), 10)).when(
        basis == "relative", F.bround(c("current_value") + delta / F.nullif("current_value", F.lit(0.0)), 10))
    return requests.withColumn("target", target).withColumns({
        "change_basis": basis, "alternative_value": other, "refusal": refusal,
    }).withColumn("target", F.when(c("refusal").isNull(), c("target")))


def reason_covers(asked: Column, have: Column) -> Column:
    """A recorded reason belongs to a revision when all its moves are in it (and it names some)."""
    return (F.size(asked) > 0) & F.forall(asked, lambda s: F.array_contains(have, s))


# -- versions, requests, runs --------------------------------------------------------------------


def version_lineage(versions: DataFrame) -> DataFrame:
    """Every version with the one it replaces, how many replace it and the newest of those."""
    source = versions.select(F.col("plan_version").alias("supersedes"), F.col("state").alias("supersedes_state"))
    successors = (
        versions.filter(F.col("supersedes").isNotNull()).groupBy(F.col("supersedes").alias("plan_version"))
        .agg(F.count(F.lit(1)).alias("successors"), F.max(F.struct("revision", F.col("plan_version").alias("v")))["v"].alias("newest_successor"))
    )
    return (
        _with_source(versions, source).join(successors, "plan_version", "left")
        .withColumn("successors", F.coalesce("successors", F.lit(0).cast("long")))
    )


def _with_source(versions: DataFrame, source: DataFrame) -> DataFrame:
    """Versions with what is known of the one they supersede; first versions have none and stay out of the join."""
    later = versions.filter(F.col("supersedes").isNotNull()).join(source, "supersedes", "left")
    return later.unionByName(versions.filter(F.col("supersedes").isNull()), allowMissingColumns=True)


def version_successors(versions: DataFrame, of: DataFrame) -> DataFrame:
    """The versions that replace the given ones, one row each."""
    chain = versions.filter(F.col("supersedes").isNotNull()).select(
        F.col("supersedes").alias("plan_version"), F.col("plan_version").alias("successor"), "state", "revision")
    return chain.join(of.select("plan_version"), "plan_version", "left_semi")


def supersede(versions: DataFrame) -> DataFrame:
    """States after every LOCKED successor retired its source and that source's earlier LOCKED successors."""
    top = (
        versions.filter((F.col("state") == "LOCKED") & F.col("supersedes").isNotNull())
        .groupBy("supersedes").agg(F.max("revision").alias("locked_revision"))
    )
    as_source = top.select(F.col("supersedes").alias("plan_version"), F.lit(True).alias("is_source"))
    joined = _with_source(versions.join(as_source, "plan_version", "left"), top)
    retired = (F.col("state") == "LOCKED") & (
        F.coalesce("is_source", F.lit(False)) | F.coalesce(F.col("revision") < F.col("locked_revision"), F.lit(False)))
    return joined.withColumn("state_after", F.when(retired, "SUPERSEDED").otherwise(F.col("state"))).drop(
        "is_source", "locked_revision")


def first_successor_in_run(runs: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Per run, the first successor of its plan created between its start and its end (or now)."""
    born = versions.filter(F.col("supersedes").isNotNull()).select(
        F.col("supersedes").alias("plan_version"), F.col("plan_version").alias("successor"), "created_at")
    found = first_at_or_after(runs, born, ["plan_version"], "started_at", "created_at", ["successor"],
                              lambda t: F.date_trunc("month", t))
    inside = F.col("found.at") <= F.coalesce("ended_at", now)
    return found.withColumn("successor", F.when(inside, F.col("found.successor"))).drop("found")


def request_version(runs: DataFrame, checks: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """Per run the version that it drafted: the one its covenant checks name, before that the successor born in its time.

    ``checks``: run_id, plan_version, check_no; of several versions the one of the first check counts.
    """
    checked = checks.groupBy("run_id").agg(F.min_by("plan_version", "check_no").alias("checked_version"))
    return first_successor_in_run(runs, versions, now).join(checked, "run_id", "left").withColumn(
        "version", F.coalesce("checked_version", "successor"))


# How a run's state shows on its request (a REJECTED run depends on its checks).
REQUEST_STATE = {
    "RUNNING": "RUNNING", "AWAITING_SUBMISSION": "AWAITING_SUBMISSION", "AWAITING_APPROVAL": "AWAITING_CONTROLLER",
    "AWAITING_LOCK": "AWAITING_CFO", "PUBLISHING": "PUBLISHING", "COMPLETED": "PUBLISHED",
}


def request_state(requests: DataFrame, runs: DataFrame, checks: DataFrame) -> DataFrame:
    """The state a request reads from its run."""
    flags = checks.groupBy("run_id").agg(F.bool_or(~F.col("passed")).alias("failed"), F.bool_or("approved").alias("approved"))
    joined = requests.join(runs.select("run_id", F.col("state").alias("run_state")), "run_id", "left").join(flags, "run_id", "left")
    mapped = F.create_map(*[F.lit(x) for pair in REQUEST_STATE.items() for x in pair])
    rejected = (
        F.when(F.coalesce("failed", F.lit(False)), "COVENANT_FAILED")
        .when(F.coalesce("approved", F.lit(False)), "CFO_REJECTED").otherwise("CONTROLLER_REJECTED")
    )
    state = (
        F.when(F.col("run_state").isNull(), F.col("state")).when(F.col("run_state") == "REJECTED", rejected)
        .otherwise(F.coalesce(F.try_element_at(mapped, F.col("run_state")), F.col("run_state")))
    )
    return joined.withColumn("state", state).drop("run_state", "failed", "approved")


def scenario_drivers(drivers: DataFrame, scenarios: DataFrame, overrides: DataFrame) -> DataFrame:
    """Base driver values per scenario, replaced where the branch overrides them."""
    return (
        drivers.withColumn("scenario_id", F.explode(scenarios.agg(F.collect_set("scenario_id")).scalar()))
        .join(overrides, ["scenario_id", "driver_code"], "left")
        .withColumn("value", F.coalesce("override_value", "base_value"))
    )
