"""Chains, dedup, conformance, masking and claim checks against brute force."""

from __future__ import annotations

import random
import re
from decimal import Decimal as D
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import evidence, integrity, ordered
from tallyweave.plans import planning_model as model
from tallyweave.sources import chainlog, planstore

LOG = "id long, actor string, entity_type string, entity_id string, action string, payload string"


def log(spark, n=60):
    rows = [(i * 7, f"u{i % 3}" if i % 5 else None, "plan", "one" if i % 3 else f"e{i % 4}", "MOVE", f'{{"n":{i}}}') for i in range(n)]
    return spark.createDataFrame(rows, LOG), rows


def test_chain_matches_a_plain_fold(spark):
    df, rows = log(spark)
    built = {r.id: r for r in integrity.build_chain(df, ["entity_id"]).collect()}
    last: dict = {}
    for i, actor, *facts in rows:
        key = sha256("|".join([actor or "", *facts]).encode()).hexdigest()
        entity = facts[1]
        assert (built[i].event_key, built[i].previous_hash) == (key, last.get(entity))
        last[entity] = sha256(f"{last.get(entity) or ''}|{key}".encode()).hexdigest()
        assert built[i].event_hash == last[entity]


@pytest.mark.parametrize("bucket_rows", [10, 10_000])
def test_tampering_is_found_however_the_log_is_cut(spark, bucket_rows):
    df, _ = log(spark)
    one = df.withColumn("entity_id", F.lit("one"))
    stored = one.join(integrity.build_chain(one, ["entity_id"]), ["entity_id", "id"])
    assert integrity.verify_chain(stored, bucket_rows=bucket_rows).count() == 0
    spoiled = stored.filter("id <> 70").withColumn("payload", F.when(F.col("id") == 140, "{}").otherwise(F.col("payload")))
    found = {r.id: list(r.problems) for r in integrity.verify_chain(spoiled, bucket_rows=bucket_rows).collect()}
    assert found == {77: ["link broken", "hash does not chain"], 140: ["facts altered", "hash does not chain"]} or set(found) == {77, 140}
    verdict = integrity.chain_verdict(spoiled, integrity.verify_chain(spoiled, bucket_rows=bucket_rows)).head()
    assert (verdict.rows, verdict.broken, verdict.broken_at, verdict.ok) == (59, 2, 77, False)


def test_previous_value_and_next_match_across_buckets(spark):
    rng = random.Random(3)
    rows = [(g, t, f"{g}{t}") for g in "ab" for t in sorted(rng.sample(range(500), 80))]
    df = spark.createDataFrame(rows, "g string, t long, v string")
    got = {(r.g, r.t): r.p for r in ordered.with_previous(df, ["g"], "t", "v", F.floor(F.col("t") / 25), "p").collect()}
    for g in "ab":
        times = [t for h, t, _ in rows if h == g]
        assert [got[g, t] for t in times] == [None, *[f"{g}{t}" for t in times[:-1]]]
    asks = spark.createDataFrame([(g, t) for g in "ab" for t in range(0, 520, 13)], "g string, at long")
    found = ordered.first_at_or_after(asks, df, ["g"], "at", "t", ["v"], lambda c: F.floor(c / 25)).collect()
    for r in found:
        later = [t for h, t, _ in rows if h == r.g and t >= r["at"]]
        assert (r.found.at if r.found else None) == (min(later) if later else None)


def test_same_facts_land_once(spark):
    df, _ = log(spark, 10)
    twice = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    assert sorted(r.id for r in integrity.dedup_events(twice).collect()) == [i * 7 for i in range(10)]
    assert [r.id for r in integrity.audit_trail(df, entity_id="one", limit=2).collect()] == [56, 49]


def test_moves_are_checked_against_rules_roles_and_duties(spark):
    rows = [("p", 1, "ann", "DRAFT", "ann"), ("p", 2, "ann", "IN_REVIEW", "ann"), ("p", 3, "bob", "APPROVED", "ann"), ("p", 4, "bob", "LOCKED", "ann"),
            ("q", 1, "ann", "DRAFT", "ann"), ("q", 2, "ann", "LOCKED", "ann"), ("r", 1, "bob", "IN_REVIEW", "bob"), ("r", 2, "bob", "APPROVED", "bob"),
            ("r", 3, "cat", "LOCKED", "bob")]
    moves = spark.createDataFrame(rows, "entity string, id long, actor string, state string, requested_by string").withColumn("started_by", F.lit("dan"))
    roles = spark.createDataFrame([("ann", "planner"), ("bob", "controller"), ("cat", "cfo")], "user_id string, role_code string")
    got = integrity.transition_violations(moves, model.transitions(spark), roles, F.col("id"))
    assert {(r.entity, r.id, r.violation) for r in got.collect()} == {
        ("p", 4, "role missing"), ("p", 4, "approver locked"), ("q", 2, "undeclared move"), ("q", 2, "requester locked"), ("r", 2, "requester approved")}
    statuses = moves.withColumn("state", F.element_at(F.create_map(*[F.lit(x) for x in (
        "DRAFT", "OPEN", "IN_REVIEW", "ESCALATED", "APPROVED", "OPEN", "LOCKED", "CLOSED")]), F.col("state")))
    people = spark.createDataFrame([("ann", True, False), ("bob", False, True), ("cat", True, True)], "user_id string, is_human boolean, can_close boolean")
    got = integrity.status_violations(statuses, people, F.col("id"))
    assert {(r.entity, r.id, r.violation) for r in got.collect()} == {
        ("p", 3, "downgraded"), ("p", 4, "closed by a machine"), ("q", 2, "closed without the role"), ("r", 2, "downgraded")}


def test_nobody_decides_on_what_they_asked_for_or_started(spark):
    rows = [("a", 1, "ann", "IN_REVIEW", "ann", "bob"), ("a", 2, "bob", "APPROVED", "ann", "bob"), ("a", 3, "ann", "LOCKED", "ann", "bob"),
            ("b", 1, "ann", "IN_REVIEW", "cat", "bob"), ("b", 2, "cat", "REJECTED", "cat", "bob"), ("b", 3, None, "IN_REVIEW", "cat", None),
            ("c", 1, "ann", "IN_REVIEW", None, None), ("c", 2, "bob", "APPROVED", None, None), ("c", 3, "ann", "IN_REVIEW", None, None),
            ("c", 4, "cat", "APPROVED", None, None), ("c", 5, "bob", "LOCKED", None, None)]
    log = spark.createDataFrame(rows, "entity string, id long, actor string, state string, requested_by string, started_by string")
    rules = spark.createDataFrame([(a, b, "any") for a in ("IN_REVIEW", "APPROVED", "REJECTED") for b in ("APPROVED", "LOCKED", "REJECTED", "IN_REVIEW")], "from_state string, to_state string, role_code string")
    roles = spark.createDataFrame([(p, "any") for p in ("ann", "bob", "cat")], "user_id string, role_code string")
    got = {(r.entity, r.id, r.violation) for r in integrity.transition_violations(log, rules, roles, F.col("id")).collect()}
    assert got == {("a", 2, "starter approved"), ("a", 3, "requester locked"), ("b", 2, "requester rejected"), ("b", 3, "role missing")}
    duties = {(r.entity, r.person, tuple(r.duties), r.conflict) for r in integrity.duty_conflicts(log, F.col("id")).collect()}
    assert duties == {("a", "ann", ("locked", "requested"), "requested and locked"), ("a", "bob", ("approved", "started"), "started and approved"),
                      ("b", "cat", ("rejected", "requested"), "requested and rejected"), ("c", "bob", ("approved", "locked"), "approved and locked")}


def test_chains_go_on_from_their_heads(spark, tmp_path):
    schema = "id long, actor string, entity_type string, entity_id string, action string, payload string"
    rows = [(n, f"u{n % 3}", "t", f"e{n % 4}", "act", f"p{n}") for n in range(60)]
    log = spark.createDataFrame(rows, schema).repartition(5)
    whole = {(r.entity_id, r.id, r.previous_hash, r.event_hash) for r in integrity.build_chain(log, ["entity_id"]).collect()}
    store = chainlog.ChainLog(spark, str(tmp_path / "chain"), ("entity_id",))
    for n, (low, high) in enumerate(((0, 20), (20, 20), (20, 59), (59, 60))):
        store.append(log.filter((F.col("id") >= low) & (F.col("id") < high)), n)
    store.append(log.limit(3), 2)  # a batch that is complete stays as it is
    read = lambda: {(r.entity_id, r.id, r.previous_hash, r.event_hash) for r in store.log().collect()}
    assert read() == whole and store.heads().count() == 4
    with pytest.raises(Exception, match="not after"):
        store.append(log.filter("id = 56"), 9)
    assert integrity.verify_chain(log.join(store.log(), ["entity_id", "id"]), ["entity_id"], bucket_rows=7).count() == 0
    heads = store.heads()
    spoiled = store.log().filter("id <> 59").withColumn("event_hash", F.when(F.col("id") == 58, "x").otherwise(F.col("event_hash")))
    assert {(r.entity_id, r.id, r.problem) for r in integrity.changed_heads(spoiled, heads, ["entity_id"]).collect()} == {
        ("e3", 59, "head missing"), ("e2", 58, "head changed")}
    assert integrity.changed_heads(store.log(), heads, ["entity_id"]).count() == 0
    planstore.drop_folder(spark, f"{store.root}/head/batch=3")  # lost between the batch and its heads
    store.append(log.filter("id = 59"), 3)
    assert read() == whole


def test_access_gates(spark):
    cited = spark.createDataFrame([("r1", "A"), ("r1", "B"), ("r2", "A")], "report_id string, company string")
    scope = spark.createDataFrame([("u", "A"), ("w", "A"), ("w", "B")], "user_id string, company string")
    asked = spark.createDataFrame([(u, r) for u in "uw" for r in ("r1", "r2", "r3")], "user_id string, report_id string")
    got = {(r.user_id, r.report_id): r.visible for r in integrity.report_visible(asked, cited, scope).collect()}
    assert {k for k, v in got.items() if v} == {("u", "r2"), ("w", "r1"), ("w", "r2")}
    assert integrity.asked_countries([("geo_country", "=", "pl"), "AND", ("geo_country", "!=", "DE"), "AND", ("practice", "=", "X")]) == ["PL"]
    asks = spark.createDataFrame([(1, "Why?", ["A"], 1), (2, "why PL", ["B"], 2), (3, "how", [], 3)], "ask_id int, question string, companies array<string>, created_at int")
    got = integrity.history(asks, F.array(F.lit("A")), "WHY").collect()
    assert [(r.ask_id, r.withheld) for r in got] == [(2, True), (1, False)]


def token(value):
    return f"<masked:{sha256(value.encode()).hexdigest()[:12]}>"


def test_masking_columns_and_text(spark):
    row = evidence.mask_columns(spark.createDataFrame([("Ann", 5, None)], "Customer string, n int, salary string")).head()
    assert (row.Customer, row.n, row.salary) == (token("Ann"), 5, token("None"))
    texts = ["salary: 500, rest", "Salary is 5 ; customer_name = Bob Ray\nnext", "no keys here", "", "the employee is  Al , pay_rate=1,pay_rate = 2", "presalary: 5"]
    keys = "|".join(sorted(evidence.SENSITIVE, key=len, reverse=True))
    pattern = re.compile(rf"(?i)\b(?:{keys})\b\s*(?:=|:|is)\s*([^,;\n]+)")
    want = [pattern.sub(lambda m: m.group(0)[:m.start(1) - m.start(0)] + token(m.group(1).strip()), t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", evidence.mask_text(F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(texts))] == want


TEXTS = [
    "Revenue fell by 11.4 million, price -3.5k and FX caused -0.7M.", "Sales of 100 against 12,345.67; margin 8%", "delivery cost across 2026-01 to 2026-06 was 50",
    "The gap was -5 while volume rose by 7", "volume dropped by 7. Mix: 3; revenue 100", "exchange rates cost rate 2 and bill rate erosion 4", "x12 12x 1,2 .5 5% 3 k",
    "revenue grew by 100", "nothing here", "Unexplained 9 and the shortfall of 5", "revenue of 100 and the result beat 7", "price 3,500 higher",
    "The top 12 of them", "cost 12", "12 and 2026 and 1999", "exchange rate erosion of 7 fell; missed by 5 and the cost rates rose 2", "price\nby 3500 down\tby 3500",
    "declined_2x by 5", "Cost 50.00000000000 and revenue 0.100000000000k", "revenue 100.000000000001 or 0.00000000000001k", "éprice 3500, złoty -500000",
]


def brute(text, rows, query):
    """The same rules, one text at a time."""
    number = re.compile(evidence.NUMBER)
    labels = [(n, re.compile(rf"(?<![A-Za-z])(?:{p})(?![A-Za-z])", re.I)) for n, p in evidence.LABELS]
    way = {w: re.compile(rf"(?<![A-Za-z])(?:{p})(?![A-Za-z])", re.I) for w, p in (("down", evidence.DOWN), ("up", evidence.UP))}
    known = {abs(D(m[1].replace(",", ""))) for m in number.finditer(query) if not m[2]}
    facts = [(k, D(str(v))) for k, v in rows.items()]
    missing, wrong, start = [], [], 0
    for place, m in enumerate(number.finditer(text)):
        window = re.split(r"[.;:\n]", text[start:m.start()])[-1]
        start = m.end()
        raw, scale = m[1].replace(",", ""), (m[2] or "").strip().lower()
        size = abs(D(raw)) * D(10) ** evidence.SCALES.get(scale, 0)
        ends = [(f.end(), f.end() - f.start(), n) for n, p in labels for f in p.finditer(window)]
        label = max(ends)[2] if ends else None
        low, high = (max((f.end() for f in way[w].finditer(window)), default=-1) for w in ("down", "up"))
        direction = None if low == high == -1 else "down" if low > high else "up"
        change = bool(direction and re.search(evidence.CHANGE, window.rstrip(), re.I))
        if not scale and size in known and size == int(size) and 1900 <= size <= 2200:
            continue
        if not any(abs(v) == size for _, v in facts) and not (size in known and label is None):
            missing.append(place)
            continue
        names = {k for k, _ in facts}
        deltas = {k for keys in evidence.LEG_KEYS.values() for k in keys} & names
        if label in evidence.LEG_KEYS:
            pool = set(evidence.LEG_KEYS[label]) & names
        elif label in evidence.LEVEL_WORDS:
            pool = (deltas or {"-"}) if change else {k for k in names if label in k and not k.startswith(("plan_unit", "actual_unit"))}
        else:
            pool = deltas if change else set()
        if not pool:
            continue
        negative = raw.startswith("-")
        signed = -size if negative or direction == "down" else size if direction == "up" else None
        if signed is not None and (negative or change or label in evidence.LEG_KEYS):
            good = any(v == signed for k, v in facts if k in pool)
        else:
            good = any(abs(v) == size for k, v in facts if k in pool)
        if not good:
            wrong.append(place)
    return missing, wrong


@pytest.mark.parametrize("facts", [
    dict(revenue=100, cost=50, margin=0.08, gap=-5, volume=7, mix=3, fx=-500000, price=-3500, rate=2),
    dict(total_revenue=100, delivery_cost=50), dict(gap=-11400000, revenue=11400000, plan_unit_cost=50, residual=9)])
def test_claims_match_brute_force(spark, facts):
    names = list(facts)
    query = "SELECT revenue WHERE geo_country = 'PL' FOR PERIOD 2026-Q2 LIMIT 12"
    rows = [(i, t, query, *[float(facts[n]) for n in names]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i int, t string, q string, " + ", ".join(f"{n} double" for n in names))
    claims = evidence.numbers(df, "i", "t")
    facts_df, context = evidence.evidence_values(df, "i", names), evidence.period_years(df, "i", "q")
    missing, wrong = {i: [] for i in range(len(TEXTS))}, {i: [] for i in range(len(TEXTS))}
    for r in evidence.misattributed(claims, facts_df, context, df, "i", "t").collect():
        wrong[r.i].append(r.place)
    for r in evidence.ungrounded(claims, facts_df, context, df, "i", "t").collect():
        missing[r.i].append(r.place)
    assert claims.filter("NOT comparable").count() == 2
    for i, text in enumerate(TEXTS):
        want = brute(text, facts, query)
        assert (sorted(missing[i]), sorted(wrong[i])) == want, (text, facts)


def test_scope_claims(spark):
    rows = [("not limited to one country", "SELECT x WHERE a = 1"), ("not limited to one country", "SELECT x"),
            ("anything outside the caller's scope is hidden", "SELECT x WHERE a = 1"), ("Revenue for the caller's whole scope is 5", "select x where a = 1")]
    df = spark.createDataFrame(rows, "a string, q string")
    assert [r.found for r in evidence.overreach(df, "a", "q").collect()] == ["not limited to", "Revenue for the caller's whole scope"]


def test_plan_line_checks(spark):
    from datetime import date

    schema = ("plan_version string, scenario_id string, company string, period_month date, account string, dim_signature_hash string, "
              "quantity decimal(18,6), unit_price decimal(18,6), amount_functional decimal(18,2), trace string")
    good = '{"driver":"d","formula":"f","inputs":{"a":1}}'
    row = lambda **k: tuple({**dict(v="PV", s="base", c="C", m=date(2026, 1, 1), a="41000", h="0" * 16, q=D(2), p=D(3), t=D(6), j=good), **k}.values())
    rows = [row(), row(c="D", m=date(2026, 1, 2)), row(c="E", h="xyz"), row(c="F", t=D(7)), row(c="G", j="{}"), row(c="H", s="stretch"), row(c="I"), row(c="I")]
    got = {(r.company, r.violation) for r in integrity.plan_line_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("D", "not first of month"), ("E", "hash format"), ("F", "amount"), ("G", "trace"), ("H", "scenario"), ("I", "repeated grain")}
