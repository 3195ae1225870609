"""Access gates, audit chains, data quality, state moves, masking and claim checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.money import cents
from tallyweave.model import DELIVERY_ACCOUNTS, REVENUE_ACCOUNTS
from tallyweave.operators import asof, bridge, evidence, integrity
from tallyweave.plans import planning_model as model
from tallyweave.plans.catalog.base import query, view
from tallyweave.plans.catalog.bridges import REPORT_ROWS, lines_of
from tallyweave.plans.catalog.forecast import fresh_folder
from tallyweave.plans.catalog.reads import DEL, REV
from tallyweave.session import cut
from tallyweave.sources import chainlog, sinks
from tallyweave.sources.testcube import PLAN_VERSION

# -- access --------------------------------------------------------------------------------------

view("ev", "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events")


def _events(cube):
    return cube.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _scope(cube):
    """Companies each user may see: the ones their purchases name."""
    return _events(cube).filter(F.col("event_type") == "purchase").select(
        "user_id", F.concat(F.lit("NATION_"), F.col("k") % 25).alias("company"))


view("user_scope", "SELECT DISTINCT user_id, 'NATION_' || (k % 25) AS company FROM ev WHERE event_type = 'purchase'")


@query("scope_group_gate", """
SELECT e.user_id, e.report_id, count(DISTINCT c.company) AS cited, count(DISTINCT c.company) > 0
       AND count(DISTINCT c.company) = count(DISTINCT s.company) AS visible
FROM (SELECT DISTINCT user_id, event_id AS report_id FROM ev) e
LEFT JOIN (SELECT DISTINCT l_orderkey AS report_id, n_name AS company FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
           JOIN nation ON s_nationkey = n_nationkey) c ON c.report_id = e.report_id
LEFT JOIN user_scope s ON s.user_id = e.user_id AND s.company = c.company GROUP BY ALL""")
def scope_group_gate(cube):
    """Every event asks for one report; a report is an order and cites its lines' companies."""
    seller = cube.table("supplier").join(cube.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cited = cube.table("lineitem").join(seller, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("report_id"), F.col("n_name").alias("company"))
    asked = _events(cube).select("user_id", F.col("event_id").alias("report_id"))
    return integrity.report_visible(asked, cited, _scope(cube))


@query("scope_country_gate", """
SELECT DISTINCT user_id, r_name AS country FROM ev JOIN region ON r_regionkey = k % 5
WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM user_scope s JOIN company_dim c USING (company)
  WHERE s.user_id = ev.user_id AND c.country = r_name)""")
def scope_country_gate(cube):
    asked = _events(cube).filter(F.col("event_type") == "view").withColumn("r_regionkey", F.col("k") % 5).join(
        cube.table("region"), "r_regionkey").select("user_id", F.col("r_name").alias("country"))
    return integrity.refused_countries(asked, _scope(cube), cube.companies)


@query("scope_withheld", """
SELECT ask_id, question, created_at, NOT list_has_all((SELECT list(company) FROM company_dim WHERE country <> 'EUROPE'), companies) AS withheld
FROM (SELECT conv_id * 100 + turn AS ask_id, text AS question, conv_id AS created_at,
             ['NATION_' || (conv_id % 25), 'NATION_' || ((conv_id + turn) % 25)] AS companies FROM conversations WHERE role = 'user')
WHERE question ILIKE '%the%' ORDER BY created_at DESC, ask_id DESC LIMIT 100""")
def scope_withheld(cube):
    asks = cube.table("conversations").filter(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("ask_id"), F.col("text").alias("question"), F.col("conv_id").alias("created_at"),
        F.array(F.concat(F.lit("NATION_"), F.col("conv_id") % 25),
                F.concat(F.lit("NATION_"), (F.col("conv_id") + F.col("turn")) % 25)).alias("companies"))
    visible = cube.companies.filter(F.col("country") != "EUROPE").agg(F.collect_set("company")).scalar()
    return integrity.history(asks, visible, "the").select("ask_id", "question", "created_at", "withheld")


# -- audit ------------------------------------------------------------------------------------------

view("audit_log", """
SELECT event_id AS id, 'user_' || user_id AS actor, 'account' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, event_type AS action,
       props AS payload, k, sha256(concat_ws('|', 'user_' || user_id, 'account', CAST(user_id AS VARCHAR), event_type, props)) AS event_key FROM ev""")


def _log(cube):
    return _events(cube).select(
        F.col("event_id").alias("id"), F.concat(F.lit("user_"), "user_id").alias("actor"), F.lit("account").alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("action"), F.col("props").alias("payload"), "k")


CHAIN = """WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS n FROM audit_log),
chain AS (SELECT entity_id, id, n, event_key, CAST(NULL AS VARCHAR) AS previous_hash, sha256('|' || event_key) AS event_hash FROM ranked WHERE n = 1
  UNION ALL SELECT r.entity_id, r.id, r.n, r.event_key, c.event_hash, sha256(c.event_hash || '|' || r.event_key)
  FROM chain c JOIN ranked r ON r.entity_id = c.entity_id AND r.n = c.n + 1)"""


@query("hash_chain_build", f"{CHAIN} SELECT entity_id, id, event_key, previous_hash, event_hash FROM chain")
def hash_chain_build(cube):
    return integrity.build_chain(_log(cube), ["entity_id"])


@query("hash_chain_append", f"{CHAIN} SELECT entity_id, id, event_key, previous_hash, event_hash FROM chain")
def hash_chain_append(cube):
    """The log chained in three batches, each going on from the heads that the one before left."""
    store = chainlog.ChainLog(cube.spark, fresh_folder(cube, "chain"), ("entity_id",))
    log = _log(cube)
    last = log.agg(F.max("id")).head()[0]
    bounds = [-1, last // 3, 2 * last // 3, last]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:])):
        store.append(log.filter((F.col("id") > low) & (F.col("id") <= high)), n)
    return store.log()


@query("hash_chain_heads", f"""{CHAIN}
SELECT entity_id, max(id) AS id, arg_max(event_hash, id) AS event_hash, CASE WHEN max(id) % 3 = 0 THEN 'head missing' ELSE 'head changed' END AS problem
FROM chain GROUP BY entity_id HAVING max(id) % 3 < 2""")
def hash_chain_heads(cube):
    """Heads that a stored chain no longer holds: some last events are taken out, others have another hash."""
    chained = cut(integrity.build_chain(_log(cube), ["entity_id"]))
    heads = integrity.chain_heads(chained, ["entity_id"])
    marked = chained.join(heads.select("entity_id", F.col("id").alias("head")), "entity_id")
    at_head = F.col("id") == F.col("head")
    spoiled = marked.filter(~(at_head & (F.col("id") % 3 == 0))).withColumn(
        "event_hash", F.when(at_head & (F.col("id") % 3 == 1), F.sha2("event_hash", 256)).otherwise(F.col("event_hash")))
    return integrity.changed_heads(spoiled, heads, ["entity_id"])


STORED = f"""{CHAIN},
stored AS (SELECT l.id, actor, entity_type, l.entity_id, action, CASE WHEN k = 13 THEN payload || ' ' ELSE payload END AS payload, c.event_key,
                  CASE WHEN k = 57 THEN c.event_hash ELSE previous_hash END AS previous_hash, event_hash
           FROM audit_log l JOIN chain c USING (id) WHERE k <> 77),
checked AS (SELECT *, sha256(concat_ws('|', actor, entity_type, entity_id, action, payload)) AS fresh,
                   lag(event_hash) OVER (PARTITION BY entity_id ORDER BY id) AS expected FROM stored),
judged AS (SELECT entity_id, id, list_filter([CASE WHEN fresh <> event_key THEN 'facts altered' END,
             CASE WHEN previous_hash IS DISTINCT FROM expected THEN 'link broken' END,
             CASE WHEN sha256(coalesce(expected, '') || '|' || fresh) <> event_hash THEN 'hash does not chain' END],
             lambda p: p IS NOT NULL) AS problems FROM checked)"""


def _stored(cube):
    """A chained log with altered payloads, a broken link and rows taken out."""
    log = _log(cube)
    return cut(log.join(integrity.build_chain(log, ["entity_id"]), ["entity_id", "id"]).filter(F.col("k") != 77).withColumns({
        "payload": F.when(F.col("k") == 13, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")),
        "previous_hash": F.when(F.col("k") == 57, F.col("event_hash")).otherwise(F.col("previous_hash"))}))


@query("hash_chain_verify", f"{STORED} SELECT entity_id, id, problems FROM judged WHERE len(problems) > 0")
def hash_chain_verify(cube):
    return integrity.verify_chain(_stored(cube), ["entity_id"], bucket_rows=1000).select("entity_id", "id", "problems")


@query("hash_chain_verdict", f"""{STORED}
SELECT entity_id, count(*) AS rows, count(*) FILTER (len(problems) > 0) AS broken, min(id) FILTER (len(problems) > 0) AS broken_at,
       count(*) FILTER (len(problems) > 0) = 0 AS ok FROM judged GROUP BY ALL""")
def hash_chain_verdict(cube):
    log = _stored(cube)
    return integrity.chain_verdict(log, integrity.verify_chain(log, ["entity_id"], bucket_rows=1000), ["entity_id"])


@query("audit_trail", """
SELECT id, actor, entity_type, entity_id, action, payload FROM audit_log WHERE entity_type = 'account' AND entity_id = '8' ORDER BY id DESC LIMIT 50""")
def audit_trail(cube):
    return integrity.audit_trail(_log(cube), "account", "8").drop("k")


@query("dedup_event_key", "SELECT event_key, min(id) AS id FROM audit_log GROUP BY ALL")
def dedup_event_key(cube):
    return integrity.dedup_events(_log(cube)).select("event_key", "id")


# -- data quality --------------------------------------------------------------------------------------

_SPOILED = """
SELECT plan_version, CASE WHEN company = 'NATION_6' AND account = '41010' THEN 'stretch' ELSE scenario_id END AS scenario_id, company,
       CASE WHEN company = 'NATION_2' THEN CAST(period_month + 1 AS DATE) ELSE period_month END AS period_month, account,
       CASE WHEN company = 'NATION_3' AND account = '41000' THEN dim_signature_hash || 'X' ELSE dim_signature_hash END AS dim_signature_hash,
       CASE WHEN account = '51300' THEN amount_functional + 0.01::DECIMAL(3,2) ELSE amount_functional END AS amount_functional,
       quantity, unit_price, company = 'NATION_4' AND account = '63100' AS bare FROM plan_history WHERE scenario_id = 'base' AND revision = 1"""
view("spoiled", f"SELECT * FROM ({_SPOILED}) UNION ALL SELECT * FROM ({_SPOILED}) WHERE company = 'NATION_5' AND account = '51000'")
_LINE = "plan_version, scenario_id, company, period_month, account, dim_signature_hash"


@query("dq_plan_lines", f"""
SELECT {_LINE}, violation FROM (
  SELECT *, unnest(['not first of month', 'hash format', 'amount', 'trace', 'scenario']) AS violation,
         unnest([day(period_month) <> 1, NOT regexp_full_match(dim_signature_hash, '[0-9a-f]{{16}}'),
                 amount_functional <> round(quantity * unit_price, 2), bare, scenario_id <> 'base']) AS bad FROM spoiled) WHERE bad
UNION ALL SELECT {_LINE}, 'repeated grain' FROM spoiled GROUP BY ALL HAVING count(*) > 1""")
def dq_plan_lines(cube):
    """Imported plan lines with each kind of fault put in."""
    c = F.col
    lines = sinks.import_base_lines(cube.plan_history(("base",)), PLAN_VERSION)
    twice = F.explode(F.when((c("company") == "NATION_5") & (c("account") == "51000"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    spoiled = lines.withColumn("copy", twice).withColumns({
        "scenario_id": F.when((c("company") == "NATION_6") & (c("account") == "41010"), "stretch").otherwise(c("scenario_id")),
        "period_month": F.when(c("company") == "NATION_2", F.date_add("period_month", 1)).otherwise(c("period_month")),
        "dim_signature_hash": F.when((c("company") == "NATION_3") & (c("account") == "41000"), F.concat("dim_signature_hash", F.lit("X")))
        .otherwise(c("dim_signature_hash")),
        "amount_functional": F.when(c("account") == "51300", c("amount_functional") + F.lit("0.01").cast("decimal(3,2)")).otherwise(c("amount_functional")),
        "trace": F.when((c("company") == "NATION_4") & (c("account") == "63100"), "{}").otherwise(c("trace"))})
    return integrity.plan_line_violations(spoiled)


@query("dq_report_lines", f"""
SELECT line_no, residual, violation FROM (SELECT *, unnest(['does not tie', 'legs do not add up']) AS violation,
  unnest([abs(residual) >= tolerance, actual - plan <> price + volume + mix + fx + rate + efficiency + residual]) AS bad FROM (
    SELECT * REPLACE (CAST(CASE WHEN level = 1 THEN residual + 50 ELSE residual END AS DECIMAL(28,2)) AS residual,
                      CAST(CASE WHEN level = 2 THEN price + tolerance ELSE price END AS DECIMAL(28,2)) AS price) FROM ({REPORT_ROWS}))) WHERE bad""")
def dq_report_lines(cube):
    """Stored report lines with residuals and prices changed after the fact."""
    levels = ["practice", "geo_region"]
    c = F.col
    rows = bridge.report_rows(bridge.decompose(lines_of(cube, *levels), levels), levels)
    spoiled = rows.withColumns({
        "residual": cents(F.when(c("level") == 1, c("residual") + 50).otherwise(c("residual"))),
        "price": cents(F.when(c("level") == 2, c("price") + c("tolerance")).otherwise(c("price")))})
    return integrity.report_line_violations(spoiled, bridge.LEGS).select("line_no", "residual", "violation")


# -- state moves ------------------------------------------------------------------------------------------

_STATES = {"click": "DRAFT", "view": "IN_REVIEW", "signup": "APPROVED", "purchase": "LOCKED", "error": "REJECTED"}
_STATUSES = {"click": "OPEN", "view": "INVESTIGATING", "signup": "ESCALATED", "purchase": "REVIEWED", "error": "CLOSED"}
_ROLES = ("planner", "controller", "cfo", "planner", "controller")


def _moves(cube, names):
    state = F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("event_type"))
    return _events(cube).select(
        F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("id"), F.concat(F.lit("user_"), F.col("k") % 20).alias("actor"),
        state.alias("state"), F.concat(F.lit("user_"), F.col("user_id") % 20).alias("requested_by"),
        F.concat(F.lit("user_"), (F.col("user_id") + 3) % 20).alias("started_by"))


def _case(names) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _moved(names) -> str:
    return f"""
SELECT * FROM (SELECT *, lag(state) OVER w AS from_state, lag(actor) OVER w AS from_actor FROM (
  SELECT CAST(user_id AS VARCHAR) AS entity, event_id AS id, 'user_' || (k % 20) AS actor, {_case(names)} AS state,
         'user_' || (user_id % 20) AS requested_by, 'user_' || ((user_id + 3) % 20) AS started_by FROM ev) WINDOW w AS (PARTITION BY entity ORDER BY id))
WHERE from_state <> state"""


view("user_role", "SELECT 'user_' || n_nationkey AS user_id, CASE n_regionkey WHEN 0 THEN 'planner' WHEN 1 THEN 'controller' WHEN 2 THEN 'cfo' WHEN 3 THEN 'planner' ELSE 'controller' END AS role_code, n_nationkey FROM nation")
_RULES = ",".join(f"('{f}','{t}','{r}')" for f, t, r in model.TRANSITIONS)


def _roles(cube):
    return cube.table("nation").select(
        F.concat(F.lit("user_"), "n_nationkey").alias("user_id"),
        F.element_at(F.array(*[F.lit(r) for r in _ROLES]), F.col("n_regionkey") + 1).alias("role_code"), "n_nationkey")


@query("transition_conformance", f"""
WITH rule AS (SELECT * FROM (VALUES {_RULES}) r(from_state, to_state, role_code)),
m AS (SELECT m.*, EXISTS (SELECT 1 FROM rule r WHERE r.from_state = m.from_state AND r.to_state = m.state) AS declared,
             EXISTS (SELECT 1 FROM rule r JOIN user_role u USING (role_code) WHERE r.from_state = m.from_state AND r.to_state = m.state
                     AND u.user_id = m.actor) AS allowed FROM ({_moved(_STATES)}) m)
SELECT entity, id, actor, from_state, state, violation FROM (
  SELECT *, unnest(['undeclared move', 'role missing', 'requester approved', 'requester locked', 'requester rejected', 'starter approved',
                    'approver locked']) AS violation,
         unnest([NOT declared, declared AND NOT allowed, state = 'APPROVED' AND actor = requested_by, state = 'LOCKED' AND actor = requested_by,
                 state = 'REJECTED' AND actor = requested_by, state = 'APPROVED' AND actor = started_by,
                 state = 'LOCKED' AND from_state = 'APPROVED' AND actor = from_actor]) AS bad FROM m) WHERE bad""")
def transition_conformance(cube):
    bucket = F.floor(F.col("id") / 1000)
    return integrity.transition_violations(_moves(cube, _STATES), model.transitions(cube.spark), _roles(cube), bucket)


@query("duty_conflicts", f"""
WITH m AS (SELECT * FROM ({_moved(_STATES)})),
held AS (SELECT entity, requested_by AS person, 'requested' AS duty FROM m UNION SELECT entity, started_by, 'started' FROM m
  UNION SELECT entity, actor, CASE state WHEN 'APPROVED' THEN 'approved' WHEN 'LOCKED' THEN 'locked' ELSE 'rejected' END FROM m WHERE state IN ('APPROVED', 'LOCKED', 'REJECTED')),
apart(a, b) AS (VALUES ('requested', 'approved'), ('requested', 'locked'), ('requested', 'rejected'), ('started', 'approved'), ('approved', 'locked'))
SELECT x.entity, x.person, (SELECT list_sort(list(duty)) FROM held h WHERE h.entity = x.entity AND h.person = x.person) AS duties, a || ' and ' || b AS conflict
FROM apart JOIN held x ON x.duty = a JOIN held y ON y.entity = x.entity AND y.person = x.person AND y.duty = b""")
def duty_conflicts(cube):
    """Who held duties over one plan that must be kept apart, whatever lay between them."""
    return integrity.duty_conflicts(_moves(cube, _STATES), F.floor(F.col("id") / 1000))


@query("report_status_conformance", f"""
SELECT entity, id, actor, from_state, state, violation FROM (
  SELECT m.*, unnest(['reopened', 'downgraded', 'closed by a machine', 'closed without the role']) AS violation,
         unnest([from_state = 'CLOSED', from_state = 'ESCALATED' AND state IN ('OPEN', 'INVESTIGATING'),
                 state = 'CLOSED' AND NOT coalesce(human, false), state = 'CLOSED' AND coalesce(human, false) AND role_code NOT IN ('controller', 'cfo')]) AS bad
  FROM ({_moved(_STATUSES)}) m LEFT JOIN (SELECT *, n_nationkey < 15 AS human FROM user_role) u ON u.user_id = m.actor) WHERE bad""")
def report_status_conformance(cube):
    people = _roles(cube).select("user_id", (F.col("n_nationkey") < 15).alias("is_human"),
                                 F.col("role_code").isin("controller", "cfo").alias("can_close"))
    return integrity.status_violations(_moves(cube, _STATUSES), people, F.floor(F.col("id") / 1000))


# -- masking ------------------------------------------------------------------------------------------------


@query("mask_columns", """
SELECT o_orderkey, '<masked:' || substr(sha256(c_name), 1, 12) || '>' AS customer_name,
       '<masked:' || substr(sha256(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)), 1, 12) || '>' AS salary, o_orderdate, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def mask_columns(cube):
    rows = cube.table("orders").join(cube.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_name").alias("customer_name"), F.col("c_acctbal").cast("decimal(12,2)").alias("salary"), "o_orderdate", "c_mktsegment")
    return evidence.mask_columns(rows)


_KEYS = "|".join(sorted(evidence.SENSITIVE, key=len, reverse=True))
_FRAGMENT = rf"(?i)\b(?:{_KEYS})\b\s*(?:=|:|is)\s*[^,;\n]+"
_PARTS = rf"(?is)^((?:{_KEYS})\s*(?:=|:|is)\s*)([^,;\n]+)$"


@query("mask_text", rf"""
SELECT doc_id, array_to_string(flatten(list_transform(list_zip(b, m), lambda p: [p[1], coalesce(p[2], '')])), '') AS masked FROM (
  SELECT doc_id, regexp_split_to_array(t, '{_FRAGMENT}') AS b,
         list_transform(regexp_extract_all(t, '{_FRAGMENT}'), lambda f: regexp_extract(f, '{_PARTS}', 1) || '<masked:'
           || substr(sha256(trim(regexp_extract(f, '{_PARTS}', 2), E' \t\n\r')), 1, 12) || '>') AS m
  FROM (SELECT doc_id, 'Customer : ' || source || ', ' || text || E'; pay_rate is ' || n_chars || E' per day\nlast line' AS t FROM documents))""")
def mask_text(cube):
    """Whole documents with a sensitive field put before and after the text."""
    text = F.concat(F.lit("Customer : "), "source", F.lit(", "), "text", F.lit("; pay_rate is "), F.col("n_chars").cast("string"),
                    F.lit(" per day\nlast line"))
    return cube.table("documents").select("doc_id", evidence.mask_text(text).alias("masked"))


# -- claims ---------------------------------------------------------------------------------------------------


def _answers(cube):
    """An answer per practice, country and month, its evidence row and its query.

    The texts state revenue, cost and gap, some with the wrong measure, direction, size or scope.
    """
    keys = ["practice", "geo_country", "period_month"]

    def total(accounts, name):
        return F.coalesce(F.sum(F.when(F.col("account").isin(*accounts), F.col("amount_functional"))), F.lit(0)).cast("decimal(18,2)").alias(name)

    actual = asof.ledger_as_of(cube.ledger, cube.vintages).groupBy(*keys).agg(
        total(REVENUE_ACCOUNTS, "revenue"), total(DELIVERY_ACCOUNTS, "cost"))
    planned = cube.base_plan.groupBy(*keys).agg(total(REVENUE_ACCOUNTS, "planned"))
    rows = actual.join(planned, keys).withColumns({
        "gap": (F.col("revenue") - F.col("planned")).cast("decimal(18,2)"), "margin": (F.col("revenue") - F.col("cost")).cast("decimal(18,2)"),
        "answer_id": F.concat_ws("/", "practice", "geo_country", F.date_format("period_month", "yyyy-MM"))})
    text = {n: F.col(n).cast("string") for n in ("revenue", "cost", "gap", "margin")}
    size = F.abs("gap").cast("string")
    thousand = (F.col("revenue") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(22,5)").cast("string")
    month = F.month("period_month") % 6
    story = (
        F.when(month == 0, F.concat(F.lit("Revenue fell by "), size, F.lit(" while costs were "), text["cost"], F.lit(".")))
        .when(month == 1, F.concat(F.lit("Sales reached "), thousand, F.lit(" thousand; delivery cost across "), F.date_format("period_month", "yyyy"), F.lit(" held.")))
        .when(month == 2, F.concat(F.lit("The gap was "), text["gap"], F.lit(" and revenue fell by "), text["revenue"], F.lit(".")))
        .when(month == 3, F.concat(F.lit("Margin of "), text["revenue"], F.lit(": cost 12,345.67 and 8% lower.")))
        .when(month == 4, F.concat(F.lit("These figures are for the caller's whole scope: sales "), text["revenue"], F.lit("; the shortfall grew by "), size))
        .otherwise(F.concat(F.lit("Revenue of "), text["revenue"], F.lit(" against cost of "), text["cost"], F.lit("; margin "), text["margin"])))
    asked = F.concat(F.lit("SELECT revenue WHERE geo_country = '"), "geo_country", F.lit("' FOR PERIOD "), F.date_format("period_month", "yyyy-MM"))
    return rows.withColumns({"answer": story, "asked": asked})


def _claim_inputs(cube):
    answers = cut(_answers(cube))
    claims = evidence.numbers(answers, "answer_id", "answer")
    facts = evidence.evidence_values(answers, "answer_id", ["revenue", "cost", "gap", "margin"])
    return claims, facts, evidence.period_years(answers, "answer_id", "asked"), answers, "answer_id", "answer"


# The number pattern without look-around: a word boundary does the same beside digits and letters.
_NUMBER = (r"(?:(?:\b|\B-)(?:\d{1,3}(?:,\d{3})+|\d+)|\B-?\.\d+)(?:\.\d+)?"
           r"(?:\s*(?:billion|million|thousand|[kKmMbB])\b|\s*%\B|\b)")


def _claims_sql(source: str, key: str, text: str) -> str:
    raw = r"regexp_replace(replace(regexp_extract(claim, '^-?[0-9.,]+'), ',', ''), '([.][0-9]*?)0+$', '\1')"
    scale = r"lower(trim(regexp_replace(claim, '^-?[0-9.,]+', ''), E' \t\n\r\f'))"
    return f"""
SELECT {key}, place, claim, CASE WHEN fine > 10 THEN NULL ELSE CAST(abs(CASE scale WHEN '' THEN TRY_CAST(raw AS DECIMAL(38,10))
         WHEN '%' THEN TRY_CAST(raw AS DECIMAL(26,8)) * CAST(0.01 AS DECIMAL(2,2))
         ELSE TRY_CAST(raw AS DECIMAL(24,10)) * CAST(CASE WHEN scale IN ('k', 'thousand') THEN 1000 WHEN scale IN ('m', 'million') THEN 1000000
              ELSE 1000000000 END AS DECIMAL(10,0)) END) AS DECIMAL(38,10)) END AS magnitude, scale <> '' AS scaled
FROM (SELECT *, {raw} AS raw, {scale} AS scale, length(regexp_extract({raw}, '[.]([0-9]+)$', 1)) + CASE WHEN {scale} = '%' THEN 2 ELSE 0 END AS fine
      FROM (SELECT {key}, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS place, unnest(c) AS claim
            FROM (SELECT {key}, regexp_extract_all({text}, '{_NUMBER}') AS c FROM {source})))"""


view("answers", f"""
SELECT *, CASE month(period_month) % 6 WHEN 0 THEN 'Revenue fell by ' || abs(gap) || ' while costs were ' || cost || '.'
    WHEN 1 THEN 'Sales reached ' || CAST(revenue * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(22,5)) || ' thousand; delivery cost across '
         || strftime(period_month, '%Y') || ' held.'
    WHEN 2 THEN 'The gap was ' || gap || ' and revenue fell by ' || revenue || '.'
    WHEN 3 THEN 'Margin of ' || revenue || ': cost 12,345.67 and 8% lower.'
    WHEN 4 THEN 'These figures are for the caller''s whole scope: sales ' || revenue || '; the shortfall grew by ' || abs(gap)
    ELSE 'Revenue of ' || revenue || ' against cost of ' || cost || '; margin ' || margin END AS answer,
  practice || '/' || geo_country || '/' || strftime(period_month, '%Y-%m') AS answer_id, year(period_month) AS asked_year
FROM (SELECT *, CAST(revenue - planned AS DECIMAL(18,2)) AS gap, CAST(revenue - cost AS DECIMAL(18,2)) AS margin FROM (
  SELECT practice, geo_country, period_month, CAST(coalesce(sum(CASE WHEN account IN {REV} THEN amount_functional END), 0) AS DECIMAL(18,2)) AS revenue,
         CAST(coalesce(sum(CASE WHEN account IN {DEL} THEN amount_functional END), 0) AS DECIMAL(18,2)) AS cost FROM live GROUP BY ALL)
  JOIN (SELECT practice, geo_country, period_month, CAST(coalesce(sum(CASE WHEN account IN {REV} THEN amount_functional END), 0) AS DECIMAL(18,2)) AS planned
        FROM plan WHERE scenario_id = 'base' GROUP BY ALL) USING (practice, geo_country, period_month))""")


@query("claim_grounding", f"""
SELECT answer_id, place, claim, magnitude FROM ({_claims_sql('answers', 'answer_id', 'answer')}) c JOIN answers a USING (answer_id)
WHERE NOT (NOT scaled AND magnitude = asked_year) AND magnitude NOT IN (abs(revenue), abs(cost), abs(gap), abs(margin))""")
def claim_grounding(cube):
    return evidence.ungrounded(*_claim_inputs(cube)).select("answer_id", "place", "claim", "magnitude")


@query("claim_grounding_documents", f"""
SELECT doc_id, place, claim, magnitude FROM ({_claims_sql('documents', 'doc_id', 'text')}) c
WHERE NOT EXISTS (SELECT 1 FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id = c.doc_id
                  AND (magnitude = n_chars OR magnitude = quality OR magnitude = toxic))""")
def claim_grounding_documents(cube):
    """Every number in the documents that is neither the document's length nor a label of it."""
    docs = cube.table("documents")
    facts = evidence.evidence_values(docs.join(cube.table("labels"), "doc_id", "left"), "doc_id", ["n_chars", "quality", "toxic"])
    none = evidence.period_years(docs.withColumn("q", F.lit("")), "doc_id", "q")
    return evidence.ungrounded(evidence.numbers(docs, "doc_id", "text"), facts, none, docs, "doc_id", "text").select("doc_id", "place", "claim", "magnitude")


def _word_ends(names) -> str:
    """Where the last of each kind of word ends in ``w`` (0: none), as one list of (end, size, name)."""
    def one(name, pattern):
        last = rf"length(regexp_extract(w, '(?is)^.*\b(?:{pattern})\b'))"
        return f"{{'last': {last}, 'size': {last} - length(regexp_extract(w, '(?is)^(.*)\b(?:{pattern})\b', 1)), 'name': '{name}'}}"
    return f"list_max(list_filter([{', '.join(one(n, p) for n, p in names)}], lambda x: x.last > 0)).name"


# Each claim of an answer with the words of its own window, read by patterns over that window.
view("answer_claim", rf"""
SELECT *, {_word_ends(evidence.LABELS)} AS label, {_word_ends((("down", evidence.DOWN), ("up", evidence.UP)))} AS direction,
       regexp_matches(w, '(?i)\b(by|of)\s*$') AS stated
FROM (SELECT c.*, claim LIKE '-%' AS negative, regexp_extract(regexp_split_to_array(answer, '{_NUMBER}')[place + 1], '[^.;:
]*$') AS w,
             revenue, cost, gap, margin, asked_year
      FROM ({_claims_sql('answers', 'answer_id', 'answer')}) c JOIN answers USING (answer_id))""")


@query("claim_attribution", """
SELECT answer_id, place, claim, label, direction, magnitude FROM (
  SELECT *, CASE WHEN coalesce(label IN ('revenue', 'cost', 'margin'), false) AND NOT change THEN label WHEN label = 'gap' OR change THEN 'gap' END AS named,
         CASE WHEN negative OR direction = 'down' THEN -magnitude WHEN direction = 'up' THEN magnitude END AS signed FROM (
    SELECT *, direction IS NOT NULL AND stated AS change FROM answer_claim)
  WHERE NOT (NOT scaled AND magnitude = asked_year) AND magnitude IN (abs(revenue), abs(cost), abs(gap), abs(margin)))
WHERE named IS NOT NULL AND CASE WHEN signed IS NOT NULL AND (negative OR change OR coalesce(label = 'gap', false))
  THEN signed <> CASE named WHEN 'revenue' THEN revenue WHEN 'cost' THEN cost WHEN 'margin' THEN margin ELSE gap END
  ELSE magnitude <> abs(CASE named WHEN 'revenue' THEN revenue WHEN 'cost' THEN cost WHEN 'margin' THEN margin ELSE gap END) END""")
def claim_attribution(cube):
    return evidence.misattributed(*_claim_inputs(cube))


view("answer_text", f"""
SELECT practice || '/' || geo_country || '/' || strftime(period_month, '%Y-%m') AS answer_id, month(period_month) % 6 AS kind FROM (
  SELECT practice, geo_country, period_month FROM live GROUP BY ALL) JOIN (SELECT DISTINCT practice, geo_country, period_month FROM plan)
  USING (practice, geo_country, period_month)""")


@query("scope_claim_guard", "SELECT answer_id, 'figures are for the caller''s whole scope' AS found FROM answer_text WHERE kind = 4")
def scope_claim_guard(cube):
    return evidence.overreach(_answers(cube), "answer", "asked").select("answer_id", "found")
