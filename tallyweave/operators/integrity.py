"""Audit chains, event dedup, data quality, state-move conformance and access gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.keys import chain_hash, event_key
from tallyweave.model import BASE_SCENARIO, GRAIN
from tallyweave.operators.asof import latest
from tallyweave.operators.ordered import with_previous

FACTS = ("entity_type", "entity_id", "action", "payload")


def keyed(log: DataFrame) -> DataFrame:
    return log.withColumn("event_key", event_key(F.col("actor"), *[F.col(f) for f in FACTS]))


def build_chain(log: DataFrame, keys: Sequence[str], order: str = "id", heads: DataFrame | None = None) -> DataFrame:
    """``previous_hash`` and ``event_hash`` per entity, folded in order, after the ``heads`` of what is chained already.

    A chain is sequential by definition, so each entity is walked once, batch by batch, carrying one
    hash: memory does not grow with the entity. Everything else (the keys) is hashed beforehand in
    parallel, and only ids and keys travel. With heads (from ``chain_heads``) only new events are walked; one that does
    not come after its entity's head is refused.
    """
    slim = keyed(log).select(*keys, order, "event_key").withColumn("seed", F.lit(None).cast("string"))
    if heads is not None:
        slim = slim.unionByName(heads.select(*keys, order, F.col("event_hash").alias("seed")), allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"{n} {kinds[n]}" for n in (*keys, order, "event_key")] + ["previous_hash string", "event_hash string"])
    names = list(keys)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, last = None, None
        for rows in batches:
            before, after, new = [], [], []
            for *who, key, seed in rows[[*names, "event_key", "seed"]].itertuples(index=False, name=None):
                if who != entity:
                    entity, last = who, None
                new.append(seed is None)
                if seed is not None:
                    if last is not None:
                        raise ValueError(f"an event of {who} is not after what is chained already")
                    last = seed
                    continue
                before.append(last)
                last = sha256(f"{last or ''}|{key}".encode()).hexdigest()
                after.append(last)
            kept = {n: pd.Series(rows[n].to_numpy(object)[new], dtype=object) for n in (*names, order, "event_key")}
            yield pd.DataFrame(kept | {"previous_hash": pd.Series(before, dtype=object), "event_hash": pd.Series(after, dtype=object)})

    # a new event with the id of the head stands before it, and is refused
    sorted_rows = slim.repartition(*keys).sortWithinPartitions(*keys, order, F.col("seed").asc_nulls_first())
    return sorted_rows.mapInPandas(walk, schema)


def chain_heads(chained: DataFrame, keys: Sequence[str], order: str = "id") -> DataFrame:
    """The last event of every entity: where its chain goes on."""
    return chained.groupBy(*keys).agg(F.max_by(F.struct(order, "event_hash"), order).alias("h")).select(*keys, "h.*")


def changed_heads(chained: DataFrame, heads: DataFrame, keys: Sequence[str], order: str = "id") -> DataFrame:
    """Heads that the stored chain does not hold any more: the event is gone, or has another hash."""
    there = chained.select(*keys, order, F.col("event_hash").alias("stored_hash"))
    return heads.join(there, [*keys, order], "left").filter(~F.col("stored_hash").eqNullSafe(F.col("event_hash"))).withColumn(
        "problem", F.when(F.col("stored_hash").isNull(), "head missing").otherwise("head changed")).drop("stored_hash")


def verify_chain(log: DataFrame, keys: Sequence[str] = (), order: str = "id", bucket_rows: int = 1_000_000) -> DataFrame:
    """Every row whose stored facts, link or hash does not hold, with the reasons.

    Links are checked against the *stored* hash of the row before, so rows are verified in parallel;
    ids are cut into buckets so that even one long chain spreads over many tasks.
    """
    bucket = F.floor(F.col(order) / F.lit(bucket_rows))
    fresh = log.withColumn("recomputed_key", event_key(F.col("actor"), *[F.col(f) for f in FACTS]))
    rows = with_previous(fresh, keys, order, "event_hash", bucket, "expected_previous")
    altered = F.col("recomputed_key") != F.col("event_key")
    unlinked = ~F.nullif("previous_hash", F.lit("")).eqNullSafe(F.col("expected_previous"))
    unchained = chain_hash(F.col("expected_previous"), F.col("recomputed_key")) != F.col("event_hash")
    problems = F.filter(F.array(
        F.when(F.col(order).isNull(), "no id"), F.when(altered, "facts altered"), F.when(unlinked, "link broken"), F.when(unchained, "hash does not chain")),
        lambda p: p.isNotNull())
    return rows.withColumn("problems", problems).filter(F.size("problems") > 0).drop("recomputed_key", "expected_previous")


def chain_verdict(log: DataFrame, broken: DataFrame, keys: Sequence[str] = (), order: str = "id") -> DataFrame:
    """Per chain: rows, broken rows and the first broken id."""
    total = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    bad = broken.groupBy(*keys).agg(F.count(F.lit(1)).alias("broken"), F.min(order).alias("broken_at"))
    if not keys:
        found = bad.agg(F.struct(F.sum("broken").alias("broken"), F.min("broken_at").alias("broken_at"))).scalar()
        return total.withColumn("f", found).select("rows", "f.*").withColumn("ok", F.col("broken") == 0)
    joined = total.join(bad, list(keys), "left").withColumn("broken", F.coalesce("broken", F.lit(0).cast("long")))
    return joined.withColumn("ok", F.col("broken") == 0)


def audit_trail(log: DataFrame, entity_type: str | None = None, entity_id: str | None = None, limit: int = 50) -> DataFrame:
    out = log
    for name, value in (("entity_type", entity_type), ("entity_id", entity_id)):
        out = out if value is None else out.filter(F.col(name) == value)
    return out.orderBy(F.desc("id")).limit(limit)


def dedup_events(log: DataFrame) -> DataFrame:
    """The same facts appended twice land once: the first of each event key."""
    return latest(keyed(log), ["event_key"], [F.asc("id")])


# -- data quality --------------------------------------------------------------------------------


def plan_line_violations(lines: DataFrame, trace: str = "trace") -> DataFrame:
    """(grain, violation) rows: one pass of row checks and one count of the grain."""
    c = F.col

    def named(part: str) -> Column:
        return F.coalesce(F.get_json_object(c(trace), f"$.{part}"), F.lit("")) != ""

    checks = {
        "not first of month": c("period_month") != F.trunc("period_month", "month"),
        "hash format": ~c("dim_signature_hash").rlike("^[0-9a-f]{16}$"),
        "amount": c("amount_functional") != F.round(c("quantity") * c("unit_price"), 2),
        "trace": ~(named("driver") & named("formula") & F.coalesce(F.get_json_object(c(trace), "$.inputs").startswith("{"), F.lit(False))),
        "scenario": c("scenario_id") != BASE_SCENARIO,
    }
    found = F.explode(F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda v: v.isNotNull()))
    keys = ["plan_version", "scenario_id", *GRAIN]
    rows = lines.select(*keys, found.alias("violation"))
    repeated = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        *keys, F.lit("repeated grain").alias("violation"))
    return rows.unionByName(repeated)


def report_line_violations(rows: DataFrame, legs: Sequence[str]) -> DataFrame:
    """Stored report lines whose residual is out of tolerance or whose legs do not add up to the gap."""
    total = F.col("residual")
    for leg in legs:
        total = total + F.col(leg)
    loose = F.abs("residual") >= F.col("tolerance")
    apart = (F.col("actual") - F.col("plan")) != total
    found = F.filter(F.array(F.when(loose, "does not tie"), F.when(apart, "legs do not add up")), lambda v: v.isNotNull())
    return rows.withColumn("violation", F.explode(found))


# -- state moves -----------------------------------------------------------------------------------


def state_moves(log: DataFrame, bucket: Column) -> DataFrame:
    """Logged changes of state with the state and the actor before; these come from the log itself."""
    before = log.withColumn("__now", F.struct("state", "actor"))
    moves = with_previous(before, ["entity"], "id", "__now", bucket, "was").withColumns(
        {"from_state": F.col("was.state"), "from_actor": F.col("was.actor")}).drop("__now", "was")
    return moves.filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("state")))


def transition_violations(log: DataFrame, rules: DataFrame, roles: DataFrame, bucket: Column) -> DataFrame:
    """Logged moves that break a rule: undeclared, no role for it, or one person on both sides.

    ``log``: entity, id, actor, state, requested_by, started_by. The requester decides nothing, the starter does not
    approve, the approver does not lock.
    """
    moves = state_moves(log, bucket)
    declared = rules.select("from_state", F.col("to_state").alias("state")).distinct().withColumn("declared", F.lit(True))
    allowed = roles.join(rules, "role_code").select(
        F.col("user_id").alias("actor"), "from_state", F.col("to_state").alias("state")).distinct().withColumn("allowed", F.lit(True))
    joined = moves.join(declared, ["from_state", "state"], "left").join(allowed, ["actor", "from_state", "state"], "left")
    state, actor = F.col("state"), F.col("actor")
    own = actor == F.col("requested_by")
    problems = F.filter(F.array(
        F.when(F.col("declared").isNull(), "undeclared move"),
        F.when(F.col("declared").isNotNull() & F.col("allowed").isNull(), "role missing"),
        *[F.when((state == to) & own, f"requester {duty}") for to, duty in DECISIONS.items()],
        F.when((state == "APPROVED") & (actor == F.col("started_by")), "starter approved"),
        F.when((state == "LOCKED") & (F.col("from_state") == "APPROVED") & (actor == F.col("from_actor")), "approver locked"),
    ), lambda v: v.isNotNull())
    return joined.withColumn("violation", F.explode(problems)).select("entity", "id", "actor", "from_state", "state", "violation")


#: What a move into a state decides.
DECISIONS = {"APPROVED": "approved", "LOCKED": "locked", "REJECTED": "rejected"}
#: Duties that one person may not hold together.
APART = (("requested", "approved"), ("requested", "locked"), ("requested", "rejected"), ("started", "approved"), ("approved", "locked"))


def duty_conflicts(log: DataFrame, bucket: Column) -> DataFrame:
    """Per entity and person the set of duties held over its whole life, where two of them must be kept apart.

    A move is judged on its own by ``transition_violations``; here an approver who locks much later, after others have
    moved the entity, is found too. Duties are gathered per entity and person before they meet: five at most.
    """
    moves = state_moves(log, bucket)
    decided = F.coalesce(*[F.when(F.col("state") == to, duty) for to, duty in DECISIONS.items()])
    held = F.explode(F.array(
        F.struct(F.col("requested_by").alias("person"), F.lit("requested").alias("duty")),
        F.struct(F.col("started_by").alias("person"), F.lit("started").alias("duty")),
        F.struct(F.col("actor").alias("person"), decided.alias("duty"))))
    duties = moves.select("entity", held.alias("h")).select("entity", "h.*").filter("person IS NOT NULL AND duty IS NOT NULL").groupBy(
        "entity", "person").agg(F.array_sort(F.collect_set("duty")).alias("duties"))
    clash = F.filter(F.array(*[F.when(F.array_contains("duties", a) & F.array_contains("duties", b), f"{a} and {b}") for a, b in APART]),
                     lambda v: v.isNotNull())
    return duties.withColumn("conflict", F.explode(clash))


def status_violations(log: DataFrame, people: DataFrame, bucket: Column) -> DataFrame:
    """Report status moves out of CLOSED, down from ESCALATED, or closed by someone who may not.

    ``people``: user_id, is_human, can_close.
    """
    moves = with_previous(log, ["entity"], "id", "state", bucket, "from_state")
    moves = moves.filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("state")))
    joined = moves.join(people.select(F.col("user_id").alias("actor"), "is_human", "can_close"), "actor", "left")
    was, now = F.col("from_state"), F.col("state")
    yes = F.lit(True)
    problems = F.filter(F.array(
        F.when(was == "CLOSED", "reopened"),
        F.when((was == "ESCALATED") & now.isin("OPEN", "INVESTIGATING"), "downgraded"),
        F.when((now == "CLOSED") & ~F.col("is_human").eqNullSafe(yes), "closed by a machine"),
        F.when((now == "CLOSED") & F.col("is_human").eqNullSafe(yes) & ~F.col("can_close").eqNullSafe(yes), "closed without the role"),
    ), lambda v: v.isNotNull())
    return joined.withColumn("violation", F.explode(problems)).select("entity", "id", "actor", "from_state", "state", "violation")


# -- access gates ----------------------------------------------------------------------------------


def report_visible(asked: DataFrame, citations: DataFrame, scope: DataFrame) -> DataFrame:
    """Per asked (user, report): visible only when it has citations and all their companies are in the user's scope."""
    cited = citations.select("report_id", "company").distinct()
    mine = scope.select("user_id", "company").distinct().withColumn("mine", F.lit(True))
    return (
        asked.select("user_id", "report_id").distinct().join(cited, "report_id", "left").join(mine, ["user_id", "company"], "left")
        .groupBy("user_id", "report_id").agg(F.every(F.coalesce("mine", F.lit(False))).alias("visible"), F.count("company").alias("cited"))
        .withColumn("visible", F.col("visible") & (F.col("cited") > 0))
    )


def refused_countries(asked: DataFrame, scope: DataFrame, companies: DataFrame) -> DataFrame:
    """(user, country) pairs a query names outright that hold no company of the user's scope."""
    allowed = scope.join(companies.select("company", "country"), "company").select("user_id", "country").distinct()
    return asked.select("user_id", F.upper(F.trim("country")).alias("country")).distinct().join(
        allowed, ["user_id", "country"], "left_anti")


def asked_countries(where: Sequence) -> list[str]:
    """Countries a filter asks to see: only ``=`` and ``IN`` name one."""
    out: set[str] = set()
    for name, op, value in where[0::2]:
        if name == "geo_country" and op in ("=", "IN"):
            out.update(str(v).strip().upper() for v in ([value] if op == "=" else value))
    return sorted(out)


def history(asks: DataFrame, visible: Column, search: str = "", limit: int = 100) -> DataFrame:
    """Questions newest first; an answer whose companies are not all visible is withheld."""
    out = asks
    if search.strip():
        out = out.filter(F.col("question").ilike(f"%{search.strip()}%"))
    withheld = F.size(F.array_except(F.coalesce("companies", F.array().cast("array<string>")), visible)) > 0
    return out.withColumn("withheld", withheld).orderBy(F.desc("created_at"), F.desc("ask_id")).limit(limit)
