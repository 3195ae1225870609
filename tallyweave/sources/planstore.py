"""A stored plan: live, staged and pre-image lines in Parquet folders, published and taken back folder by folder.

Live lines lie in one folder per plan version, scenario and month. Publishing a revision writes what the folders that
it touches will hold to a side table first, marks that as complete, and then lets dynamic partition overwrite replace
exactly those folders. A job lost before the mark has changed nothing; one lost after it is repeated from the side
table, which no longer depends on the live folders. Pre-images, publications and recorded checks are written once and
marked; a second call finds the mark.

Steps of one plan version follow each other; two writers at once are not coordinated here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.model import BASE_SCENARIO, BY_HASH, PLAN_GRAIN, STORED_PLAN_SCHEMA
from tallyweave.operators import recompute
from tallyweave.operators.asof import latest, latest_revision
from tallyweave.session import drop_folder, freeing, get_texts, put_text
from tallyweave.sources.sinks import append_once, read_or_empty

FOLDER = recompute.FOLDER
DONE, UNDONE = "DONE", "UNDONE"
# Fixed value: the rows of a folder that one task takes.
PART_ROWS = 250_000
# Fixed value: of the lines of all months, so many stand for one part of every month.
MONTH_PART_LINES = 10_000_000
# Live and side tables lie beside each other while a revision is put in place, so their files are packed well.
PACKED = "zstd"


def by_month(grains: DataFrame, lines: int) -> DataFrame:
    """Grains dealt out by month and a part of it, as ``PlanStore.load`` writes what is made of them; ``PART`` tells so.

    The part follows from the grain, so all lines of one grain lie together; there are more parts the more ``lines`` there
    are, and a month that holds most of them spreads over all parts.
    """
    part = F.pmod(F.hash(*[c for c in BY_HASH if c != "period_month"]), F.lit(-(-max(lines, 1) // MONTH_PART_LINES)))
    return grains.withColumn(recompute.PART, part).repartition("period_month", recompute.PART)


def _step(run: Callable) -> Callable:
    """A step of a plan: it leaves no shuffles to the next one."""
    @wraps(run)
    def freed(self: PlanStore, *args, **kwargs):
        with freeing(self.spark):
            return run(self, *args, **kwargs)
    return freed


@dataclass(frozen=True)
class PlanStore:
    """Plan tables below ``root``, all with the columns of ``schema``."""

    spark: SparkSession
    root: str
    schema: T.StructType = STORED_PLAN_SCHEMA

    # -- tables ------------------------------------------------------------------------------------

    def _plan_path(self, plan_version: str) -> str:
        return f"{self.root}/plan/plan_version={plan_version}"

    def _side_path(self, plan_version: str, revision: int, kind: str = "") -> str:
        path = f"{self.root}/revision/plan_version={plan_version}/for_revision={revision}"
        return f"{path}/kind={kind}" if kind else path

    def plan(self, plan_version: str) -> DataFrame:
        """The live lines; filters on scenario and month read their folders only."""
        return read_or_empty(self.spark, self._plan_path(plan_version), self.schema, f"{self.root}/plan")

    def _side(self, plan_version: str, revision: int, kind: str) -> DataFrame:
        return read_or_empty(self.spark, self._side_path(plan_version, revision, kind), self.schema, f"{self.root}/revision")

    def staged(self, plan_version: str, revision: int) -> DataFrame:
        return self._side(plan_version, revision, "staged")

    def preimage(self, plan_version: str, revision: int) -> DataFrame:
        """The rows that a revision replaced, with ``preimage_for_revision``."""
        return self._side(plan_version, revision, "replaced").withColumn("preimage_for_revision", F.lit(revision))

    def _in_order(self, lines: DataFrame, *first: str) -> DataFrame:
        """Lines of a task as files hold them. Equal dimensions side by side keep files and later shuffles small.

        Equal hashes have equal dimensions, and comparing them first makes the sort short.
        """
        names = [c for c in self.schema.fieldNames() if c != "plan_version"]
        order = [*FOLDER, *[c for c in BY_HASH if c not in FOLDER]]
        return lines.select(*first, *names).sortWithinPartitions(*first, *order)

    @staticmethod
    def _store(lines: DataFrame, mode: str, by: Sequence[str], path: str) -> None:
        lines.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", PACKED).partitionBy(*by).parquet(path)

    def _write(self, lines: DataFrame, plan_version: str, revision: int, kind: str, by: Sequence[str] = ()) -> None:
        """Replace a side table of one revision."""
        self._store(self._in_order(lines), "static", by, self._side_path(plan_version, revision, kind))

    def _replace(self, lines: DataFrame, plan_version: str) -> None:
        """Replace the live folders that ``lines`` has rows for, and no others. Lines lie by folder already."""
        self._store(self._in_order(lines), "dynamic", FOLDER, self._plan_path(plan_version))

    @staticmethod
    def _by_folder(lines: DataFrame) -> DataFrame:
        """Lines dealt out by folder and, where a folder holds many, by a part of it that the line's key determines.

        What meets by key then also lies as it will be written, so nothing is moved twice.
        """
        parts = lines.groupBy(*FOLDER).agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_ROWS)).alias("__parts"))
        part = F.pmod(F.hash(*recompute.LINE_KEY), F.coalesce("__parts", F.lit(1)))
        # one row per folder, a size that the optimizer cannot know
        return lines.join(F.broadcast(parts), list(FOLDER), "left").withColumn(recompute.PART, part).drop("__parts").repartition(
            *FOLDER, recompute.PART)

    @staticmethod
    def _folders(lines: DataFrame) -> set[tuple]:
        return {tuple(row) for row in lines.select(*FOLDER).distinct().collect()}

    def touched(self, lines: DataFrame, plan_version: str) -> DataFrame:
        """The live lines of the folders that ``lines`` has rows for.

        The driver learns scenario and month of those folders, as many as there are folders and no rows of them.
        """
        by_scenario: dict[str, list] = {}
        for scenario, month in self._folders(lines):
            by_scenario.setdefault(scenario, []).append(month)
        inside = F.lit(False)
        for scenario, months in by_scenario.items():
            inside = inside | ((F.col("scenario_id") == scenario) & F.col("period_month").isin(*months))
        return self.plan(plan_version).filter(inside)

    # -- marks -------------------------------------------------------------------------------------

    def mark(self, plan_version: str, revision: int, step: str) -> tuple[str, int] | None:
        """State and row count of a step that is known to be complete."""
        for text in get_texts(self.spark, f"{self.root}/mark/{plan_version}/{revision}/{step}").values():
            state, rows = text.split()
            return state, int(rows)
        return None

    def _set(self, plan_version: str, revision: int, step: str, state: str, rows: int) -> None:
        put_text(self.spark, f"{self.root}/mark/{plan_version}/{revision}/{step}", f"{state} {rows}")

    def _is(self, plan_version: str, revision: int, step: str, state: str = DONE) -> bool:
        found = self.mark(plan_version, revision, step)
        return found is not None and found[0] == state

    def marks(self, plan_version: str = "*") -> list[tuple[str, int, str, str, int]]:
        """Every mark: plan version, revision, step, state and rows."""
        found = []
        for path, text in get_texts(self.spark, f"{self.root}/mark/{plan_version}/*/*").items():
            version, revision, step = path.split("/")[-3:]
            if "." not in step:
                state, rows = text.split()
                found.append((version, int(revision), step, state, int(rows)))
        return sorted(found)

    # -- steps -------------------------------------------------------------------------------------

    @_step
    def load(self, lines: DataFrame, plan_version: str) -> None:
        """The first lines of a plan version: the highest revision per grain. A stored version is refused.

        Lines made of grains that ``by_month`` laid out are picked and written where they lie.
        """
        if not self.plan(plan_version).isEmpty():
            raise ValueError(f"plan {plan_version} is stored already")
        mine = lines.filter(F.col("plan_version") == plan_version)
        if recompute.PART in lines.columns:
            found = latest(mine, [*dict.fromkeys([*FOLDER, *PLAN_GRAIN, recompute.PART])], [F.desc("revision")])
        else:  # by month alone: a line's scenarios then travel side by side, and cost little more than one of them
            found = latest_revision(mine).hint("rebalance", F.col("period_month"))
        self._replace(found, plan_version)

    @_step
    def stage(self, lines: DataFrame, plan_version: str, revision: int) -> None:
        """Recomputed lines as a revision that waits; staging it again replaces it, a published one is refused."""
        self._not_published(plan_version, revision)
        self._write(lines.filter(F.col("plan_version") == plan_version), plan_version, revision, "staged")

    def discard(self, plan_version: str, revision: int) -> None:
        """Drop a revision that waits; a published one is refused."""
        self._not_published(plan_version, revision)
        drop_folder(self.spark, self._side_path(plan_version, revision, "staged"))

    def _not_published(self, plan_version: str, revision: int) -> None:
        if self._is(plan_version, revision, "publish"):
            raise ValueError(f"revision {revision} of {plan_version} is published")

    @_step
    def snapshot(self, plan_version: str, revision: int) -> int:
        """Keep the live rows that a revision is about to replace: once, and never refreshed afterwards."""
        known = self.mark(plan_version, revision, "preimage")
        if known:
            return known[1]
        staged = self.staged(plan_version, revision)
        known = staged.select(*recompute.LINE_KEY, "revision")
        replaced = recompute.preimage(self.touched(staged, plan_version), known, revision, self._by_folder)
        self._write(replaced, plan_version, revision, "replaced")
        return self._snapshot_taken(plan_version, revision)

    def _snapshot_taken(self, plan_version: str, revision: int) -> int:
        count = self.preimage(plan_version, revision).count()
        self._set(plan_version, revision, "preimage", DONE, count)
        return count

    @_step
    def publish(self, plan_version: str, revision: int, expected: int) -> int:
        """Put a staged revision in place: ``expected`` rows in every scenario, base among them. Returns its rows.

        A live row of a later revision stays. Publishing again, also after a job was lost on the way, gives the same.
        """
        if self._is(plan_version, revision, "undo"):
            raise ValueError(f"revision {revision} of {plan_version} is being taken back")
        if self._is(plan_version, revision, "publish"):
            return self.mark(plan_version, revision, "publish")[1]
        if not self._is(plan_version, revision, "pending"):
            self._no_other(plan_version, revision)
            staged = self.staged(plan_version, revision)
            counts = {r.scenario_id: r["count"] for r in staged.groupBy("scenario_id").count().collect()}
            if not counts:
                raise ValueError(f"nothing is staged for revision {revision} of {plan_version}")
            if BASE_SCENARIO not in counts or set(counts.values()) != {expected}:
                raise ValueError(f"revision {revision} of {plan_version} staged {counts}, approved were {expected} in each scenario")
            self._prepare(staged, plan_version, revision)
            self._set(plan_version, revision, "pending", DONE, sum(counts.values()))
        rows = self.mark(plan_version, revision, "pending")[1]
        self._replace(self._side(plan_version, revision, "after"), plan_version)
        self._set(plan_version, revision, "publish", DONE, rows)
        drop_folder(self.spark, self._side_path(plan_version, revision, "after"))
        return rows

    def _prepare(self, staged: DataFrame, plan_version: str, revision: int) -> None:
        """Side tables of a publication: what the touched folders will hold and, if not kept before, what is replaced.

        Both come from one pass over the touched folders: of each line the highest revision stays, and live lines that
        stand beside a staged one are replaced.
        """
        kept_before = self._is(plan_version, revision, "preimage")
        live = self.touched(staged, plan_version).withColumn("__new", F.lit(False))
        both = self._by_folder(live.unionByName(staged.withColumn("__new", F.lit(True))))
        line = recompute.of_line(both).orderBy(F.desc("revision"), F.desc("__new"))
        both = both.withColumns({"__rank": F.row_number().over(line), "__met": F.max("__new").over(recompute.whole(line))})
        kinds = [F.when(F.col("__rank") == 1, "after")]
        if not kept_before:
            kinds.append(F.when(F.col("__met") & ~F.col("__new"), "replaced"))
        for kind in ("after", "replaced")[:len(kinds)]:  # what a lost try left
            drop_folder(self.spark, self._side_path(plan_version, revision, kind))
        sides = both.withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))
        self._store(self._in_order(sides, "kind"), "dynamic", ("kind", *FOLDER), self._side_path(plan_version, revision))
        if not kept_before:
            self._snapshot_taken(plan_version, revision)

    @_step
    def unpublish(self, plan_version: str, revision: int) -> int:
        """Take a revision back: its rows go, the rows that it replaced return. Returns how many did.

        Rows of later revisions stay. A publication that was lost on the way is taken back from its side table. A
        revision that was never published, or was taken back before, changes nothing.
        """
        if not self._is(plan_version, revision, "pending"):
            return 0
        rows = self.mark(plan_version, revision, "preimage")[1]
        if not self._is(plan_version, revision, "undo"):
            if self._is(plan_version, revision, "publish"):
                now = self.touched(self.staged(plan_version, revision), plan_version)
            else:
                now = self._side(plan_version, revision, "after")
            before = recompute.unpublish(now, self.preimage(plan_version, revision), revision, self._by_folder)
            self._write(before, plan_version, revision, "undo", by=FOLDER)
            self._set(plan_version, revision, "undo", DONE, rows)
        undo = self._side(plan_version, revision, "undo")
        self._replace(undo, plan_version)
        for scenario, month in self._folders(self.staged(plan_version, revision)) - self._folders(undo):  # held this revision alone
            drop_folder(self.spark, f"{self._plan_path(plan_version)}/scenario_id={scenario}/period_month={month}")
        for step in ("publish", "pending", "undo"):
            self._set(plan_version, revision, step, UNDONE, rows)
        for kind in ("after", "undo"):
            drop_folder(self.spark, self._side_path(plan_version, revision, kind))
        return rows

    def _no_other(self, plan_version: str, revision: int) -> None:
        """Another revision that is half in place has to be finished or taken back first."""
        steps: dict[int, set[str]] = {}
        for _, other, step, state, _ in self.marks(plan_version):
            if state == DONE and step in ("pending", "publish") and other != revision:
                steps.setdefault(other, set()).add(step)
        for other, done in steps.items():
            if len(done) == 1:
                raise ValueError(f"revision {other} of {plan_version} is half in place: publish or take it back first")

    # -- covenants ---------------------------------------------------------------------------------

    def record_checks(self, checks: DataFrame, run_id: str, revision: int) -> DataFrame:
        """The recorded checks of a run and revision: what is recorded stays, only checks not yet there are added.

        The verdict is read from the record, so a repeat after a lost job reaches the one that was written down.
        """
        new = checks.withColumns({"run_id": F.lit(run_id), "revision": F.lit(revision)})
        recorded = append_once(new, f"{self.root}/covenant_check", ["run_id", "revision"], ["rule_code", "scenario_id"])
        if recorded.isEmpty():
            raise ValueError("the re-forecast touches no line that a covenant rule measures")
        return recorded
