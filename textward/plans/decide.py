"""Policy queries bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import case_map
from ..operators import detectors as D
from ..operators import policy as P
from ..session import cut_lineage
from ..sources.planted import PLANTED_SQL, planted_parts
from ..sources.tables import conversation_parts, document_identity, document_parts, provider_of, table
from .detect import LANG_SQL, production_sql
from .registry import query
from .rules import ACTIVE, CANDIDATE, LEGACY, QUESTIONS, THRESHOLDS, TOOL_SCHEMA

PROVIDER_SQL = "CASE WHEN request_id % 2 = 0 THEN 'cloud' ELSE 'local' END"


def held_findings(spark, folder):
    """The same findings written once, for queries that read them in several branches."""
    return cut_lineage(findings(spark, folder))


def findings(spark, folder):
    """Production findings on the planted documents, with the request's provider."""
    parts = planted_parts(spark, folder).withColumn("provider", provider_of(F.col("request_id")))
    return D.scan(parts, D.PRODUCTION, keys=[*D.PART_KEYS, "provider"])


FOUND = f"{production_sql(PLANTED_SQL)}, found AS (SELECT *, {PROVIDER_SQL} AS provider FROM findings)"


def _rules_sql() -> str:
    """The rules of both policies as rows: they are settings, what is counted comes from the texts."""

    def value(v):
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    rows = [(p.id, *row) for p in (ACTIVE, LEGACY) for row in P.rule_rows(P.expand_legacy(p))]
    return ", ".join("(" + ", ".join(value(v) for v in row) + ")" for row in rows)


@query(
    "policy_rules",
    f"""WITH {FOUND}, r(policy_id, {", ".join(P.RULE_DDL_COLUMNS)}) AS (VALUES {_rules_sql()}),
seen AS (SELECT category AS c, subtype AS s, count(*) AS n FROM found GROUP BY 1, 2)
SELECT policy_id, rule, stage, category, subtype, provider, action, CAST(threshold AS DOUBLE) AS threshold, CAST(min_count AS INTEGER) AS min_count,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS findings FROM r LEFT JOIN seen ON c = category AND (subtype IS NULL OR s = subtype) GROUP BY ALL""",
)
def policy_rules(spark, folder):
    """Rule tables of the active and the legacy policy, with the findings each rule names."""
    groups = findings(spark, folder).groupBy("category", "subtype").agg(F.count("*").alias("seen"))
    rules = (
        P.policy_rules(spark, ACTIVE)
        .withColumn("policy_id", F.lit(ACTIVE.id))
        .unionByName(P.policy_rules(spark, LEGACY).withColumn("policy_id", F.lit(LEGACY.id)))
    )
    named = groups.withColumnRenamed("category", "c").withColumnRenamed("subtype", "s")
    hit = rules.join(
        named,
        (F.col("c") == F.col("category")) & (F.col("subtype").isNull() | (F.col("s") == F.col("subtype"))),
        "left",
    )
    return hit.groupBy("policy_id", *P.RULE_DDL_COLUMNS).agg(
        F.coalesce(F.sum("seen"), F.lit(0)).alias("findings")
    )


# ---- identity -------------------------------------------------------------------------------------

ORDER_POLICY = P.Policy(
    id="orders",
    version=1,
    deny=(
        {"application": "BUILDING", "tenant": "FRANCE", "action": "BLOCK"},
        {"subject": "42", "action": "BLOCK"},
        {"role": "premium", "application": "MACHINERY", "action": "REVIEW"},
        {"tenant": "CHINA", "action": "RESTRICT_TOOLS"},
        {"action": "BLOCK"},
    ),
)
ROLE_SQL = (
    "CASE WHEN c_acctbal > 9000 THEN ['user', 'premium'] WHEN c_acctbal < 0 THEN ['user', 'guest', 'intern'] "
    "ELSE ['user'] END"
)


def order_identity(spark, folder):
    """Orders as requests: tenant = nation, application = segment, subject = customer."""
    balance = F.col("c_acctbal")
    roles = (
        F.when(balance > 9000, F.array(F.lit("user"), F.lit("premium")))
        .when(balance < 0, F.array(F.lit("user"), F.lit("guest"), F.lit("intern")))
        .otherwise(F.array(F.lit("user")))
    )
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    callers = customers.select(
        "c_custkey",
        F.col("n_name").alias("tenant"),
        F.col("c_mktsegment").alias("application"),
        F.col("c_custkey").cast("string").alias("subject"),
        roles.alias("roles"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority"
    )
    return orders.join(callers, "c_custkey").drop("c_custkey")


IDENTITY_SQL = f"""who AS (SELECT o_orderkey AS request_id, n_name AS tenant, c_mktsegment AS application,
  CAST(c_custkey AS VARCHAR) AS subject, {ROLE_SQL} AS roles
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "deny_match",
    f"""WITH {IDENTITY_SQL}, hit AS (SELECT request_id,
  CASE WHEN application = 'BUILDING' AND tenant = 'FRANCE' THEN 0 WHEN subject = '42' THEN 1
    WHEN list_contains(roles, 'premium') AND application = 'MACHINERY' THEN 2 WHEN tenant = 'CHINA' THEN 3 END AS i
  FROM who)
SELECT request_id, 'deny[' || i || ']' AS rule,
  ['BLOCK', 'BLOCK', 'REVIEW', 'RESTRICT_TOOLS'][i + 1] AS action FROM hit WHERE i IS NOT NULL""",
)
def deny_match(spark, folder):
    rows = order_identity(spark, folder).withColumn(
        "rule_hit",
        P.deny_rule(
            ORDER_POLICY, F.col("application"), F.col("tenant"), F.col("subject"), F.col("roles")
        ),
    )
    return rows.filter("rule_hit IS NOT NULL").select(
        "request_id",
        F.concat(F.lit("deny["), F.col("rule_hit.position").cast("string"), F.lit("]")).alias("rule"),
        "rule_hit.action",
    )


@query(
    "role_restriction",
    f"""WITH {IDENTITY_SQL}, c AS (
  SELECT request_id, unnest(roles) AS role FROM who),
m AS (SELECT request_id, role, CASE role WHEN 'guest' THEN 'RESTRICT_TOOLS' WHEN 'admin' THEN 'ALLOW'
  WHEN 'intern' THEN 'REVIEW' END AS action FROM c)
SELECT request_id, action, 'roles.' || role AS rule FROM m WHERE action IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY
  CASE action WHEN 'RESTRICT_TOOLS' THEN 6 WHEN 'REVIEW' THEN 4 ELSE 1 END DESC, role) = 1""",
)
def role_restriction(spark, folder):
    rows = P.role_candidates(order_identity(spark, folder), ACTIVE)
    return P.best_candidates(rows, "request_id").select("request_id", "action", "rule")


# ---- findings ------------------------------------------------------------------------------------

# The active policy after the legacy expansion, spelled out per finding.
ACTION_SQL = """
CASE WHEN category = 'SECRET' AND subtype IN ('GITLAB_PAT', 'PEM_PRIVATE_KEY') THEN {'a': 'BLOCK', 'r': 'secrets.' || subtype, 'p': 10}
  WHEN subtype = 'EMAIL' AND provider = 'cloud' THEN {'a': 'TOKENIZE', 'r': 'pii.EMAIL.cloud', 'p': 10}
  WHEN category = 'PII' AND provider = 'local' THEN {'a': 'REDACT', 'r': 'targets.local', 'p': 5}
  WHEN provider = 'cloud' AND subtype = 'CREDIT_CARD' THEN {'a': 'BLOCK', 'r': 'providers.cloud.subtypes.CREDIT_CARD', 'p': 9}
  WHEN provider = 'cloud' AND subtype = 'JWT' THEN {'a': 'REVIEW', 'r': 'providers.cloud.subtypes.JWT', 'p': 9}
  WHEN category = 'PII' AND provider = 'cloud' THEN {'a': 'TOKENIZE', 'r': 'providers.cloud.categories.PII', 'p': 5}
  WHEN subtype IN ('JWT', 'GITHUB_TOKEN') THEN {'a': 'REDACT', 'r': 'subtype_actions.SECRET.' || subtype, 'p': 8}
  WHEN subtype = 'OPENAI_API_KEY' THEN {'a': 'BLOCK', 'r': 'subtype_actions.SECRET.OPENAI_API_KEY', 'p': 8}
  ELSE {'a': 'REDACT', 'r': 'category_actions.' || category, 'p': 4} END"""
GROUPS_SQL = f"""{FOUND}, acted AS (
  SELECT DISTINCT request_id, provider, category, subtype, count(*) OVER (PARTITION BY request_id, subtype) AS n,
    count(*) OVER (PARTITION BY request_id, category) AS total,
    max(confidence) OVER (PARTITION BY request_id, subtype) AS conf, {ACTION_SQL} AS x FROM found)"""
SEV_SQL = (
    "CASE action WHEN 'BLOCK' THEN 7 WHEN 'RESTRICT_TOOLS' THEN 6 WHEN 'FORCE_LOCAL_MODEL' THEN 5 "
    "WHEN 'REVIEW' THEN 4 WHEN 'TOKENIZE' THEN 3 WHEN 'REDACT' THEN 2 ELSE 1 END"
)
CONF_SQL = """SELECT request_id, category, 'BLOCK' AS action, 'confidence.sure-secret' AS rule, 1 AS priority
  FROM acted WHERE category = 'SECRET' AND conf >= 0.95
UNION ALL SELECT request_id, category, 'REVIEW', 'confidence.sure-card', 1
  FROM acted WHERE subtype = 'CREDIT_CARD' AND provider = 'local' AND conf >= 0.9"""
COUNT_SQL = """SELECT request_id, category, 'REVIEW' AS action, 'count.dense-pii' AS rule, 1 AS priority
  FROM acted WHERE category = 'PII' AND total >= 3
UNION ALL SELECT request_id, category, 'REVIEW', 'pii.MULTIPLE_PII.local', 1
  FROM acted WHERE category = 'PII' AND provider = 'local' AND total >= 3"""
BASE_SQL = "SELECT request_id, category, x.a AS action, x.r AS rule, x.p AS priority FROM acted"


@query(
    "finding_action",
    f"WITH {GROUPS_SQL} SELECT request_id, category, subtype, n, x.a AS action, x.r AS rule, x.p AS priority FROM acted",
)
def finding_action(spark, folder):
    rows = P.finding_actions(P.finding_groups(findings(spark, folder)), ACTIVE)
    return rows.select("request_id", "category", "subtype", "n", "action", "rule", "priority")


def _escalated(groups, options):
    rows = groups.select("request_id", "category", F.explode(options).alias("c"))
    return rows.select("request_id", "category", "c.*").distinct()


@query("confidence_escalation", f"WITH {GROUPS_SQL} SELECT DISTINCT * FROM ({CONF_SQL})")
def confidence_escalation(spark, folder):
    groups = P.finding_groups(findings(spark, folder))
    return _escalated(groups, P.confidence_escalations(groups, ACTIVE))


@query("count_escalation", f"WITH {GROUPS_SQL} SELECT DISTINCT * FROM ({COUNT_SQL})")
def count_escalation(spark, folder):
    groups = P.with_category_total(P.finding_groups(findings(spark, folder)))
    return _escalated(groups, P.count_escalations(groups, ACTIVE))


BEST_SQL = f"""best AS (SELECT * FROM ({BASE_SQL} UNION ALL {CONF_SQL} UNION ALL {COUNT_SQL})
QUALIFY row_number() OVER (PARTITION BY request_id, category ORDER BY {SEV_SQL} DESC, priority DESC, rule) = 1)"""


@query("best_candidate", f"WITH {GROUPS_SQL}, {BEST_SQL} SELECT * FROM best")
def best_candidate(spark, folder):
    groups = P.finding_groups(findings(spark, folder))
    return P.best_candidates(P.finding_candidates(groups, ACTIVE), "request_id", "category")


@query(
    "finding_summary",
    f"""WITH {FOUND} SELECT request_id, category, subtype, count(*) AS count,
  CASE WHEN max(confidence) >= 0.9 THEN 'very_high' WHEN max(confidence) >= 0.8 THEN 'high'
    WHEN max(confidence) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_bucket
FROM found GROUP BY 1, 2, 3""",
)
def finding_summary(spark, folder):
    return P.finding_summary(findings(spark, folder), "request_id")


# ---- the chain --------------------------------------------------------------------------------------

SIGNAL_SQL = """signals AS (
  SELECT doc_id AS request_id, 'toxic' AS question, 'high' AS risk, (doc_id % 100) / 100.0 AS confidence,
    doc_id % 100 >= 50 AS triggered FROM labels
  UNION ALL SELECT doc_id, 'quality', CASE WHEN quality = 1 THEN 'low' ELSE 'medium' END, (doc_id % 100) / 100.0,
    doc_id % 100 >= 50 FROM labels)"""
SEMANTIC_SQL = f"""risky AS (SELECT request_id, question, risk,
    CASE WHEN question = 'toxic' THEN 'REVIEW' ELSE 'REDACT' END AS action FROM signals
  WHERE triggered AND (question = 'toxic' OR risk = 'low')),
sem AS (SELECT request_id, action, 'semantic.' || question || '.' || risk AS rule,
    upper(question) || '_RISK' AS code FROM risky
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY {SEV_SQL} DESC, question) = 1)"""


def signals(spark, folder):
    """Two model answers per labelled document."""
    rows = table(spark, folder, "labels")
    score = (F.col("doc_id") % 100) / 100.0
    items = F.array(
        F.struct(F.lit("toxic").alias("question"), F.lit("high").alias("risk")),
        F.struct(
            F.lit("quality").alias("question"),
            F.when(F.col("quality") == 1, "low").otherwise("medium").alias("risk"),
        ),
    )
    return rows.select(F.col("doc_id").alias("request_id"), F.explode(items).alias("s"), score.alias("confidence")).select(
        "request_id", "s.question", "s.risk", "confidence", (F.col("confidence") >= 0.5).alias("triggered")
    )


@query("semantic_action", f"WITH {SIGNAL_SQL}, {SEMANTIC_SQL} SELECT * FROM sem")
def semantic_action(spark, folder):
    return P.semantic_actions(signals(spark, folder), ACTIVE)


DECIDE_SQL = f"""{GROUPS_SQL}, {BEST_SQL}, {SIGNAL_SQL}, {SEMANTIC_SQL},
ids AS (SELECT doc_id AS request_id, source AS tenant, lang AS application FROM documents),
chain AS (SELECT i.request_id,
  CASE WHEN tenant = 'src3' AND application = 'de' THEN {{'a': 'BLOCK', 'r': 'deny[0]', 's': 'explicit_deny', 'c': 'POLICY_DENIED'}}
    WHEN tenant = 'src11' THEN {{'a': 'REVIEW', 'r': 'deny[2]', 's': 'explicit_deny', 'c': 'POLICY_DENIED'}}
    WHEN b.rule IS NOT NULL THEN {{'a': b.action, 'r': b.rule, 's': 'secret', 'c': 'SECRET_DETECTED'}}
    WHEN tenant = 'src5' THEN {{'a': 'FORCE_LOCAL_MODEL', 'r': 'tenants.src5', 's': 'tenant', 'c': 'TENANT_RESTRICTED'}}
    WHEN application = 'es' THEN {{'a': 'REVIEW', 'r': 'applications.es', 's': 'application', 'c': 'APPLICATION_RESTRICTED'}}
    WHEN p.rule IS NOT NULL THEN {{'a': p.action, 'r': p.rule, 's': 'pii', 'c': 'PII_DETECTED'}}
    WHEN s.rule IS NOT NULL THEN {{'a': s.action, 'r': s.rule, 's': 'semantic', 'c': s.code}}
    ELSE {{'a': 'ALLOW', 'r': 'default', 's': 'default', 'c': ''}} END AS d
  FROM ids i LEFT JOIN best b ON b.request_id = i.request_id AND b.category = 'SECRET'
  LEFT JOIN best p ON p.request_id = i.request_id AND p.category = 'PII'
  LEFT JOIN sem s ON s.request_id = i.request_id),
decided AS (SELECT request_id, d.a AS action, d.r AS matched_rule, d.s AS precedence_stage, d.c AS code FROM chain)"""


def decisions(spark, folder, policy=ACTIVE, found=None):
    found = findings(spark, folder) if found is None else found
    return P.decide(document_identity(spark, folder), found, policy, signals(spark, folder))


@query(
    "decide",
    f"WITH {DECIDE_SQL} SELECT *, 'standard' AS policy_id, 3 AS policy_version FROM decided",
)
def decide(spark, folder):
    return decisions(spark, folder)


DIRECTIONS = {0: "request", 1: "tool_call", 2: "response", 3: "tool_result"}
DIRECTION_SQL = "['request', 'tool_call', 'response', 'tool_result'][1 + {0} % 4]"


@query(
    "semantic_fallback",
    """WITH r AS (SELECT event_id, CASE WHEN value > 60 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END AS risk,
  CASE event_type WHEN 'error' THEN 'response' WHEN 'view' THEN 'request' ELSE 'tool_call' END AS direction,
  CASE WHEN user_id % 2 = 0 THEN 'cloud' ELSE 'local' END AS provider FROM events)
SELECT *, CASE WHEN risk = 'high' AND direction = 'response' AND provider = 'cloud' THEN 'REDACT'
    WHEN risk = 'high' AND direction = 'response' THEN 'REVIEW' WHEN risk = 'high' THEN 'BLOCK'
    WHEN risk = 'medium' AND direction = 'request' THEN 'REVIEW'
    WHEN risk = 'medium' AND provider = 'local' THEN 'ALLOW' END AS action,
  CASE WHEN risk = 'high' OR (risk = 'medium' AND (direction = 'request' OR provider = 'local'))
    THEN 'fallback.semantic.' || risk END AS rule FROM r""",
)
def semantic_fallback(spark, folder):
    value, kind = F.col("value"), F.col("event_type")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(value > 60, "high").when(value > 20, "medium").otherwise("low").alias("risk"),
        F.when(kind == "error", "response").when(kind == "view", "request").otherwise("tool_call").alias("direction"),
        provider_of(F.col("user_id")).alias("provider"),
    )
    return P.semantic_fallback(rows, ACTIVE)


@query(
    "semantic_plan",
    f"""WITH {FOUND}, s AS (SELECT DISTINCT request_id FROM found WHERE category = 'SECRET'),
r AS (SELECT doc_id AS request_id, {DIRECTION_SQL.format('doc_id')} AS direction FROM documents),
q AS (SELECT r.request_id, s.request_id IS NOT NULL AS blocked,
  CASE direction WHEN 'request' THEN 'toxic,quality' WHEN 'response' THEN 'toxic' WHEN 'tool_result' THEN 'quality' END AS ids,
  CASE direction WHEN 'request' THEN 'high' WHEN 'response' THEN 'high' WHEN 'tool_result' THEN 'low' END AS risk
  FROM r LEFT JOIN s ON r.request_id = s.request_id)
SELECT request_id, NOT blocked AND ids IS NOT NULL AS ask,
  CASE WHEN blocked THEN 'secret' WHEN ids IS NULL THEN 'no_questions' ELSE 'required' END AS reason,
  CASE WHEN NOT blocked AND ids IS NOT NULL THEN ids ELSE '' END AS question_ids,
  CASE WHEN NOT blocked AND ids IS NOT NULL THEN risk ELSE '' END AS max_risk FROM q""",
)
def semantic_plan(spark, folder):
    requests = table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"),
        case_map(F.col("doc_id") % 4, DIRECTIONS).alias("direction"),
    )
    secrets = D.scan(planted_parts(spark, folder), D.SECRETS)
    return P.semantic_plan(requests, secrets, QUESTIONS)


@query(
    "gate_signals",
    f"""WITH {SIGNAL_SQL}, d AS (SELECT doc_id AS request_id, lang AS application,
  CASE WHEN doc_id % 2 = 0 THEN 'cloud' ELSE 'local' END AS provider, {LANG_SQL} AS language FROM documents),
j AS (SELECT s.*, d.application, d.provider, d.language FROM signals s JOIN d USING (request_id) WHERE triggered)
SELECT request_id, question, risk, confidence FROM j WHERE CASE
  WHEN question = 'toxic' AND language = 'en' AND application = 'de' THEN confidence >= 0.6
  WHEN question = 'toxic' AND language = 'en' AND provider = 'cloud' THEN confidence >= 0.7
  WHEN question = 'toxic' THEN confidence >= 0.8
  WHEN language = 'en' AND application = 'fr' THEN false ELSE confidence >= 0.55 END""",
)
def gate_signals(spark, folder):
    docs = document_parts(spark, folder).select(
        "request_id", D.language_of(F.col("text")).alias("language")
    )
    slices = docs.join(document_identity(spark, folder), "request_id")
    rows = signals(spark, folder).join(slices, "request_id")
    return P.gate_signals(rows, THRESHOLDS).select("request_id", "question", "risk", "confidence")


WANT = {"schema": "questions-v1", "checkpoint": "c7", "provider": "scorer", "model": "m1"}


@query(
    "evidence_valid",
    """SELECT doc_id AS request_id, CASE doc_id % 10 WHEN 1 THEN 'provider' WHEN 2 THEN 'schema'
  WHEN 3 THEN 'checkpoint' WHEN 4 THEN 'provider_mismatch' WHEN 5 THEN 'model_binding' WHEN 6 THEN 'unknown_question'
  WHEN 7 THEN 'missing_decision' WHEN 8 THEN 'confidence' END AS reason FROM labels""",
)
def evidence_valid(spark, folder):
    """Evidence of one kind of fault per document, by the last digit of its id."""
    k = F.col("doc_id") % 10
    score = (F.col("doc_id") % 100) / 100.0
    toxic = F.when(k == 8, F.lit(1.5)).otherwise(score)
    answers = (
        F.when(k == 6, F.create_map(F.lit("toxic"), toxic, F.lit("quality"), score, F.lit("mood"), score))
        .when(k == 7, F.create_map(F.lit("toxic"), toxic))
        .otherwise(F.create_map(F.lit("toxic"), toxic, F.lit("quality"), score))
    )
    reason = P.evidence_reason(
        F.when(k == 1, "noop").when(k == 4, "other").otherwise("Scorer"),
        F.when(k == 2, "questions-v0").otherwise("questions-v1"),
        F.when(k == 3, "c6").otherwise("c7"),
        F.when(k == 5, "m0").otherwise("m1"),
        answers,
        WANT,
        ("toxic", "quality"),
    )
    return table(spark, folder, "labels").select(F.col("doc_id").alias("request_id"), reason.alias("reason"))


@query(
    "semantic_subject",
    """WITH m AS (SELECT conv_id AS request_id, arg_max(text, turn) FILTER (role = 'user' AND text <> '') AS u,
  arg_max(text, turn) FILTER (text <> '') AS a, arg_max(role, turn) FILTER (text <> '') AS ar
  FROM conversations GROUP BY 1)
SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 'request' ELSE 'response' END AS direction,
  coalesce(CASE WHEN request_id % 2 = 0 THEN u ELSE a END, '') AS text,
  CASE WHEN request_id % 2 = 0 THEN 'user' ELSE coalesce(ar, '') END AS role FROM m""",
)
def semantic_subject(spark, folder):
    parts = conversation_parts(spark, folder)
    requests = parts.select("request_id").distinct()
    requests = requests.withColumn(
        "direction", F.when(F.col("request_id") % 2 == 0, "request").otherwise("response")
    )
    return P.semantic_subject(parts, requests)


# ---- comparison, cohorts, tools ------------------------------------------------------------------------

SLOT_SQL = "CAST('0x' || substr(sha256({0}), 1, 4) AS INTEGER) % 100"


@query(
    "cohort",
    f"""SELECT c_custkey, {SLOT_SQL.format("CAST(c_custkey AS VARCHAR) || chr(0) || n_name || chr(0) || c_mktsegment")} AS slot,
  c_acctbal >= 0 AND {SLOT_SQL.format("CAST(c_custkey AS VARCHAR) || chr(0) || n_name || chr(0) || c_mktsegment")} < 25 AS eligible
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def cohort(spark, folder):
    rows = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    ids = (F.col("c_custkey"), F.col("n_name"), F.col("c_mktsegment"))
    return rows.select(
        "c_custkey",
        P.cohort_slot(*ids).alias("slot"),
        P.in_cohort(*ids, F.col("c_acctbal") >= 0, 25).alias("eligible"),
    )


DIFF_KEY = "CAST(i.request_id AS VARCHAR) || chr(0) || tenant || chr(0) || application"


@query(
    "policy_diff",
    f"""WITH {DECIDE_SQL},
plain AS (SELECT i.request_id, tenant, application,
  CASE WHEN tenant = 'src3' AND application = 'de' THEN 'BLOCK' WHEN tenant = 'src11' THEN 'REVIEW'
    WHEN b.rule IS NOT NULL THEN b.action WHEN tenant = 'src5' THEN 'FORCE_LOCAL_MODEL'
    WHEN application = 'es' THEN 'REVIEW' WHEN p.rule IS NOT NULL THEN p.action ELSE 'ALLOW' END AS active_action
  FROM ids i LEFT JOIN best b ON b.request_id = i.request_id AND b.category = 'SECRET'
  LEFT JOIN best p ON p.request_id = i.request_id AND p.category = 'PII'),
other AS (SELECT i.request_id, CASE WHEN bool_or(category = 'SECRET') THEN 'BLOCK'
    WHEN bool_or(category = 'PII' AND subtype <> 'IP_ADDRESS') THEN 'TOKENIZE' ELSE 'ALLOW' END AS candidate_action
  FROM ids i LEFT JOIN found f ON f.request_id = i.request_id GROUP BY 1)
SELECT i.request_id, active_action, candidate_action FROM plain i JOIN other USING (request_id)
WHERE active_action <> candidate_action AND {SLOT_SQL.format(DIFF_KEY)} < 40""",
)
def policy_diff(spark, folder):
    canary = P.in_cohort(F.col("request_id"), F.col("tenant"), F.col("application"), F.lit(True), 40)
    return P.policy_diff(
        document_identity(spark, folder), held_findings(spark, folder), ACTIVE, CANDIDATE, canary
    )


@query(
    "restrict_tools",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'fs/read' || l_suppkey % 10
    ELSE 'db.' || lower(l_returnflag) || '_' || lower(l_linestatus) END AS tool FROM lineitem)
SELECT * FROM t WHERE (regexp_full_match(tool, 'fs/[^/]*') OR regexp_full_match(tool, 'db\\.[^/]_[^/]*'))
  AND NOT (tool = 'db.r_f' OR regexp_full_match(tool, '[^/]*/read[^/]') AND substr(tool, 8) IN ('1', '2', '3'))""",
)
def restrict_tools(spark, folder):
    flags = F.concat_ws("_", F.lower("l_returnflag"), F.lower("l_linestatus"))
    tool = F.when(
        F.col("l_linenumber") % 3 == 0,
        F.concat(F.lit("fs/read"), (F.col("l_suppkey") % 10).cast("string")),
    ).otherwise(F.concat(F.lit("db."), flags))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", tool.alias("tool"))
    return rows.filter(
        P.tool_allowed(F.col("tool"), ("fs/*", "db.?_*"), ("db.r_f", "*/read[123]"))
    )


@query(
    "strip_tools",
    """WITH t AS (SELECT l_orderkey, l_linenumber, 'fs/read' || l_suppkey % 10 AS a, 'db.' || lower(l_returnflag) || '_' || lower(l_linestatus) AS b FROM lineitem),
d AS (SELECT DISTINCT l_orderkey, unnest([a, b]) AS tool FROM t)
SELECT l_orderkey, count(*) AS offered, count(*) FILTER (tool NOT IN ('fs/read3', 'fs/read7', 'db.r_f')) AS kept,
  coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (tool NOT IN ('fs/read3', 'fs/read7', 'db.r_f')), '') AS tools FROM d GROUP BY 1""",
)
def strip_tools(spark, folder):
    """Orders as requests whose lines offer tools; three of the tools are restricted."""
    flags = F.concat_ws("_", F.lower("l_returnflag"), F.lower("l_linestatus"))
    names = F.array(F.concat(F.lit("fs/read"), (F.col("l_suppkey") % 10).cast("string")), F.concat(F.lit("db."), flags))
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.explode(names).alias("name"))
    offered = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("name"))).alias("tools"))
    left = P.strip_tools(F.col("tools"), ("fs/read3", "fs/read7", "db.r_f"))
    rows = offered.withColumn("left", left)
    return rows.select(
        "l_orderkey",
        F.size("tools").alias("offered"),
        F.size("left").alias("kept"),
        F.array_join(F.transform("left", lambda t: t["name"]), ",").alias("tools"),
    )


ARGS_SQL = """CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN replace(props, '}', ', "mode": "fast"}')
  WHEN 2 THEN replace(props, '}', ', "mode": "odd"}') WHEN 3 THEN replace(props, '}', ', "x": 1}')
  WHEN 4 THEN replace(props, '"k"', '"j"') WHEN 5 THEN replace(props, '}', ', "tags": ["a", "b"]}')
  WHEN 6 THEN replace(props, '}', ', "tags": ["a", 2]}') ELSE replace(props, '}', '.5}') END"""


@query("tool_args_valid", "SELECT event_id, event_id % 8 IN (0, 1, 5) AS valid FROM events")
def tool_args_valid(spark, folder):
    args = F.expr(ARGS_SQL)
    return table(spark, folder, "events").select(
        "event_id", P.tool_args_valid(args, TOOL_SCHEMA).alias("valid")
    )


@query(
    "decision_overrides",
    f"""WITH {DECIDE_SQL},
a AS (SELECT DISTINCT request_id FROM found WHERE request_id % 5 = 0),
o AS (SELECT d.request_id, d.action AS base, d.matched_rule AS r, a.request_id IS NOT NULL AS attached,
  d.request_id % 97 = 0 AS down, d.request_id % 89 = 0 AS pass, d.request_id % 2 = 0 AS enforce
  FROM decided d LEFT JOIN a ON a.request_id = d.request_id),
f AS (SELECT *, CASE WHEN pass THEN 'ALLOW' WHEN down THEN 'BLOCK'
    WHEN attached AND base IN ('REDACT', 'TOKENIZE') THEN 'BLOCK' ELSE base END AS action,
  CASE WHEN pass THEN 'passthrough' WHEN down THEN 'pii_ner_required'
    WHEN attached AND base IN ('REDACT', 'TOKENIZE') THEN 'attachment_span' ELSE r END AS matched_rule FROM o)
SELECT request_id, action, matched_rule, CASE WHEN enforce THEN action ELSE 'ALLOW' END AS applied_action FROM f""",
)
def decision_overrides(spark, folder):
    rid = F.col("request_id")
    held = held_findings(spark, folder)
    found = held.withColumn(
        "part_type", F.when(rid % 5 == 0, "attachment").otherwise("text")
    )
    base = decisions(spark, folder, found=held).select(
        "request_id",
        "action",
        "matched_rule",
        (rid % 97 == 0).alias("recognizer_down"),
        (rid % 89 == 0).alias("passthrough"),
        F.when(rid % 2 == 0, "enforce").otherwise("shadow").alias("mode"),
    )
    return P.decision_overrides(base, found)
