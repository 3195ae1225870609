"""A stored plan: published, taken back and checked on Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import periods
from tallyweave.functions.money import rounded
from tallyweave.model import MOVED
from tallyweave.operators import asof, bridge, covenant, recompute
from tallyweave.plans import planning_model as model
from tallyweave.plans.catalog.base import query, view
from tallyweave.plans.catalog.bridges import LINE_COLUMNS, MARGIN_ACCOUNTS, PLAN
from tallyweave.plans.catalog.forecast import KEY, REVISION, SHOCKS, factors_of, figures_of, fresh_folder
from tallyweave.plans.catalog.reads import LEDGER_COLUMNS, rnd
from tallyweave.session import cut
from tallyweave.sources import layout
from tallyweave.sources.planstore import PlanStore, by_month
from tallyweave.sources.testcube import PLAN_VERSION


def _store(cube, *revisions, rows=SHOCKS) -> PlanStore:
    """The cube's plan as a stored one, with the same shocks staged as each revision."""
    lines = cube.plan(deal=lambda base: by_month(base, cube.lines))
    names = [c for c in lines.columns if c != recompute.PART]
    schema = T.StructType([T.StructField(f.name, MOVED) if f.name in ("quantity", "unit_price") else f for f in lines.select(*names).schema.fields])
    store = PlanStore(cube.spark, fresh_folder(cube, "plans"), schema)
    store.load(lines, PLAN_VERSION)
    for revision in revisions:
        moved = recompute.recompute_lines(store.plan(PLAN_VERSION), factors_of(cube, rows)[0])
        store.stage(recompute.stage(moved, revision, names), PLAN_VERSION, revision)
    return store


def _approved(store: PlanStore, revision: int) -> int:
    return store.staged(PLAN_VERSION, revision).filter("scenario_id = 'base'").count()


view("published", f"""
SELECT * FROM staged UNION ALL BY NAME SELECT p.* FROM baseline p ANTI JOIN (SELECT {KEY} FROM staged) s USING ({KEY})""")


@query("publish_upsert", "SELECT * FROM published")
def publish_upsert(cube):
    """A staged revision put in place of the rows that it replaces; publishing it again changes nothing."""
    store = _store(cube, REVISION)
    approved = _approved(store, REVISION)
    for _ in range(2):
        store.publish(PLAN_VERSION, REVISION, approved)
    return store.plan(PLAN_VERSION)


_MONTHS = SHOCKS[2][4]
_FIRST = ", ".join(f"DATE '{m}'" for m in _MONTHS)


@query("publish_touched", f"""
SELECT *, moved > 0 AS rewritten FROM (
  SELECT scenario_id, period_month, count(*) AS lines,
         count(*) FILTER (account IN ('41000', '51000', '51050', '63100') AND period_month IN ({_FIRST})) AS moved FROM plan GROUP BY ALL)""")
def publish_touched(cube):
    """A move of three months rewrites the folders of these months; all other files stay as they are."""
    store = _store(cube, REVISION, rows=SHOCKS[2:])
    before = cut(_files(store).select("scenario_id", "period_month", F.col("files").alias("before")))
    store.publish(PLAN_VERSION, REVISION, _approved(store, REVISION))
    return _files(store).join(before, ["scenario_id", "period_month"]).select(
        "scenario_id", "period_month", "lines", "moved", (~F.arrays_overlap("files", "before")).alias("rewritten"))


def _files(store: PlanStore) -> DataFrame:
    """The files of every live folder, with its lines and those of the revision."""
    plan = store.spark.read.schema(store.schema).option("basePath", f"{store.root}/plan").parquet(f"{store.root}/plan")
    return plan.groupBy("scenario_id", "period_month").agg(
        F.collect_set(F.col("_metadata.file_path")).alias("files"), F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("revision") == REVISION).alias("moved"))


@query("preimage_snapshot", f"""
SELECT scenario_id, 2 AS preimage_for_revision, count(*) AS rows, CAST(sum(amount_functional) AS DECIMAL(38,2)) AS amount
FROM plan p SEMI JOIN (SELECT {KEY} FROM staged) s USING ({KEY}) GROUP BY ALL""")
def preimage_snapshot(cube):
    """The rows that a revision replaces, kept once: taking the snapshot again after publishing does not refresh it."""
    store = _store(cube, REVISION)
    first = store.snapshot(PLAN_VERSION, REVISION)
    store.publish(PLAN_VERSION, REVISION, _approved(store, REVISION))
    if store.snapshot(PLAN_VERSION, REVISION) != first:
        raise RuntimeError("a pre-image was taken twice")
    return store.preimage(PLAN_VERSION, REVISION).groupBy("scenario_id", "preimage_for_revision").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount_functional").cast("decimal(38,2)").alias("amount"))


@query("unpublish_restore", "SELECT * FROM baseline")
def unpublish_restore(cube):
    """A publication taken back, twice: the plan is exactly what it was."""
    store = _store(cube, REVISION)
    store.publish(PLAN_VERSION, REVISION, _approved(store, REVISION))
    for _ in range(2):
        store.unpublish(PLAN_VERSION, REVISION)
    return store.plan(PLAN_VERSION)


@query("discard_staged", f"""
SELECT scenario_id, 3 AS revision, count(*) AS rows FROM plan p SEMI JOIN (SELECT {KEY} FROM staged) s USING ({KEY}) GROUP BY ALL""")
def discard_staged(cube):
    """Two staged revisions, the earlier one rejected."""
    store = _store(cube, REVISION, REVISION + 1)
    store.discard(PLAN_VERSION, REVISION)
    both = store.staged(PLAN_VERSION, REVISION).unionByName(store.staged(PLAN_VERSION, REVISION + 1))
    return both.groupBy("scenario_id", "revision").agg(F.count(F.lit(1)).alias("rows"))


# Fixed value: the buckets of the stored cube.
BUCKETS = 8


def _stored_cube(cube) -> layout.StoredCube:
    """The cube's facts as bucketed tables of the session's catalog."""
    names = {}
    for name, rows in (("ledger", cube.ledger), ("plan", cube.plan(deal=lambda base: layout.by_bucket(base, BUCKETS)))):
        path = fresh_folder(cube, name)
        names[name] = path.rsplit("/", 1)[1].replace("-", "_")
        layout.store_bucketed(rows, names[name], path, BUCKETS)
    layout.joins_in_place(cube.spark)
    return layout.StoredCube(cube.spark, names["ledger"], names["plan"], cube.vintages, cube.fx_plan, cube.fx_actual, cube.accounts)


_MONTH = "1997-03"


@query("ledger_as_of_stored", f"SELECT {LEDGER_COLUMNS} FROM live WHERE period_month = DATE '{_MONTH}-01'")
def ledger_as_of_stored(cube):
    """One month at the latest close, read from its folder of the stored cube."""
    stored = _stored_cube(cube)
    return asof.ledger_as_of(stored.ledger.filter(periods.within(*periods.bounds(_MONTH))), stored.vintages).select(*LEDGER_COLUMNS.split(", "))


@query("bridge_lines_stored", f"""
SELECT {', '.join(LINE_COLUMNS)} FROM matched
WHERE account IN {MARGIN_ACCOUNTS} AND period_month >= DATE '1997-01-01' AND period_month < DATE '1998-01-01'""")
def bridge_lines_stored(cube):
    """A year's matched lines from the stored cube, where plan and ledger meet bucket by bucket."""
    months = periods.within(*periods.bounds("1997"))
    return bridge.bridge_lines(_stored_cube(cube), ["gross_margin"], PLAN, ["practice", "geo_region"], months=months).select(*LINE_COLUMNS)


@query("covenant_recorded", f"""
SELECT 'R-1' AS run_id, {REVISION} AS revision, rule_code, scenario_id, {rnd('m', 4)} AS measured_value, threshold, passed FROM covenant_row""")
def covenant_recorded(cube):
    """Checks are recorded once per run and revision: a second run of the same checks with other figures changes nothing."""
    rules = covenant.require_rules(model.covenants(cube.spark))
    store = PlanStore(cube.spark, fresh_folder(cube, "checks"))
    figures = figures_of(cube)
    first = covenant.checks(rules.filter("rule_code <> 'GM_PCT_FLOOR'"), figures)
    store.record_checks(first, "R-1", REVISION)  # as if the run was lost before its last rule
    store.record_checks(covenant.checks(rules, figures), "R-1", REVISION)
    other = covenant.checks(rules, figures.withColumn("after_cost", F.col("after_cost") * 2))
    recorded = store.record_checks(other, "R-1", REVISION)
    return recorded.select("run_id", "revision", "rule_code", "scenario_id", rounded(F.col("measured_value"), 4).alias("measured_value"),
                           "threshold", "passed")
