"""Monitoring queries bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..sources.tables import conversation_parts, decision_events, provider_of, table
from .decide import DECIDE_SQL, decisions, held_findings
from .registry import query

ACTION_SQL = """CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'signup' THEN 'TOKENIZE' WHEN 'purchase' THEN 'REDACT' ELSE 'ALLOW' END"""
EVENTS_SQL = f"""ev AS (SELECT event_id, ts, user_id, value, {ACTION_SQL} AS action, event_type AS subtype,
  ['PII', 'SECRET', 'POLICY'][1 + event_id % 3] AS category, CASE WHEN user_id % 2 = 0 THEN 'cloud' ELSE 'local' END AS provider,
  CASE WHEN value > 50 THEN 'response' ELSE 'request' END AS stage FROM events)"""
NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def events(spark, folder):
    return decision_events(spark, folder).withColumns(
        {
            "provider": provider_of(F.col("user_id")),
            "stage": F.when(F.col("value") > 50, "response").otherwise("request"),
        }
    )


@query(
    "timeseries",
    f"""WITH {EVENTS_SQL}, d AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM ev),
g AS (SELECT day, day + INTERVAL (i * 12) MINUTE AS point FROM d, (SELECT unnest(range(120)) AS i)),
c AS (SELECT time_bucket(INTERVAL 12 MINUTE, ts) AS point, action, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT day AS window_start, g.point, {', '.join(f"coalesce(sum(n) FILTER (action = '{a}'), 0)::BIGINT AS {a.lower()}" for a in M.ACTIONS)},
  coalesce(sum(n), 0)::BIGINT AS findings, coalesce(sum(n) FILTER (action <> 'ALLOW'), 0)::BIGINT AS protected,
  coalesce(sum(n) FILTER (action = 'ALLOW'), 0)::BIGINT AS forwarded
FROM g LEFT JOIN c ON c.point = g.point GROUP BY 1, 2""",
)
def timeseries(spark, folder):
    return M.timeseries(events(spark, folder))


DIMENSIONS = ("action", "category", "subtype", "provider", "stage")


@query(
    "breakdown",
    f"""WITH {EVENTS_SQL}, c AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, {d} AS key, count(*) AS count FROM ev GROUP BY 2" for d in DIMENSIONS)})
SELECT dimension, key, count, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, key) AS rank FROM c
WHERE dimension <> 'provider' OR key = 'cloud'""",
)
def breakdown(spark, folder):
    return M.breakdown(events(spark, folder), DIMENSIONS, {"provider": "cloud"})


@query(
    "kpis",
    f"""WITH {EVENTS_SQL}, d AS (SELECT date_trunc('day', ts) AS w,
  count(*) FILTER (action IN ('BLOCK', 'TOKENIZE', 'REDACT')) AS protected_events, count(*) FILTER (action = 'BLOCK') AS blocked_high_risk,
  count(*) FILTER (action IN ('TOKENIZE', 'REDACT')) AS tokenized_redacted, count(*) FILTER (action = 'BLOCK') AS requests_prevented FROM ev GROUP BY 1),
u AS (UNPIVOT d ON protected_events, blocked_high_risk, tokenized_redacted, requests_prevented INTO NAME kpi VALUE value),
p AS (SELECT u.w, u.kpi, u.value, coalesce(q.value, 0) AS previous FROM u LEFT JOIN u q ON q.kpi = u.kpi AND q.w + INTERVAL 1 DAY = u.w)
SELECT w AS window_start, kpi, value, previous, CAST(CASE WHEN previous = 0 THEN CASE WHEN value > 0 THEN 100 ELSE 0 END
    ELSE trunc(value * 100.0 / previous - 100) END AS BIGINT) AS delta_percent,
  CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS trend FROM p""",
)
def kpis(spark, folder):
    return M.kpis(events(spark, folder))


@query(
    "funnel",
    f"""WITH {EVENTS_SQL} SELECT provider, count(*) AS inspected, count(category) AS findings,
  count(*) FILTER (action <> 'ALLOW') AS transformed_or_blocked, count(*) FILTER (action = 'ALLOW') AS forwarded FROM ev GROUP BY 1""",
)
def funnel(spark, folder):
    return M.funnel(events(spark, folder), "provider")


@query(
    "leaderboard",
    f"""WITH {DECIDE_SQL}, c AS (SELECT category, subtype, count(*) AS count FROM found GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY count DESC, category, subtype) AS rank, CAST(sum(count) OVER () AS BIGINT) AS total,
  (SELECT count(*) FROM decided WHERE action IN ('BLOCK', 'TOKENIZE', 'REDACT', 'REVIEW')) AS prevented FROM c""",
)
def leaderboard(spark, folder):
    held = held_findings(spark, folder)
    return M.leaderboard(held, decisions(spark, folder, found=held))


@query(
    "capped_dimension",
    """WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS bucket, 'SUPP-' || l_suppkey AS label, l_orderkey, l_linenumber FROM lineitem),
c AS (SELECT bucket, label, count(*) AS n, min({'a': l_orderkey, 'b': l_linenumber}) AS seen FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seen) AS rank FROM c)
SELECT bucket, CASE WHEN rank <= 31 THEN label ELSE 'other' END AS label, CAST(sum(n) AS BIGINT) AS count FROM k GROUP BY 1, 2""",
)
def capped_dimension(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("bucket"),
        M.bounded_label(F.concat(F.lit(" supp-"), F.col("l_suppkey").cast("string")), "UNKNOWN").alias("label"),
        "l_orderkey",
        "l_linenumber",
    )
    return M.capped_dimension(rows, "bucket", "label", ["l_orderkey", "l_linenumber"])


@query(
    "counters",
    f"""WITH {DECIDE_SQL}
SELECT 'requests' AS counter, action AS label_a, 'enforce' AS label_b, '' AS label_c, count(*) AS value FROM decided GROUP BY 2
UNION ALL SELECT 'findings', category, subtype, '', count(DISTINCT request_id) FROM found GROUP BY 2, 3""",
)
def counters(spark, folder):
    held = held_findings(spark, folder)
    return M.counters(decisions(spark, folder, found=held), held, "enforce")


@query(
    "latency_histogram",
    " UNION ALL ".join(
        f"SELECT '{name}' AS histogram, event_type, le, count FROM (SELECT event_type, unnest(["
        + ", ".join(f"{{'le': '{float(b):g}', 'count': count(*) FILTER (value <= {b})}}" for b in bounds)
        + ", {'le': '+Inf', 'count': count(value)}], recursive := true) FROM events GROUP BY 1)"
        for name, bounds in M.LATENCY_BOUNDS.items()
    ),
)
def latency_histogram(spark, folder):
    rows = table(spark, folder, "events").select("event_type", "value")
    out = None
    for name, bounds in M.LATENCY_BOUNDS.items():
        one = M.latency_histogram(rows, "value", bounds, "event_type").withColumn("histogram", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "shadow_rates",
    f"""WITH {DECIDE_SQL}, hit AS (SELECT DISTINCT request_id FROM found)
SELECT count(*) AS requests, count(*) FILTER (action <> 'ALLOW') AS disagreements,
  count(*) FILTER (action IN ('BLOCK', 'REVIEW') AND h.request_id IS NULL) AS false_positive_samples
FROM decided d LEFT JOIN hit h ON h.request_id = d.request_id""",
)
def shadow_rates(spark, folder):
    held = held_findings(spark, folder)
    return M.shadow_rates(decisions(spark, folder, found=held), held)


AGE_SQL = f"epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(max(ts)))::BIGINT"


@query(
    "freshness",
    f"""WITH f AS (SELECT user_id, max(ts) AS last_event, {AGE_SQL} AS age FROM events GROUP BY 1)
SELECT user_id, last_event, greatest(0, age) AS age_seconds, CASE WHEN age > 3600 THEN 'stale' ELSE 'fresh' END AS status FROM f""",
)
def freshness(spark, folder):
    return M.freshness(table(spark, folder, "events"), now(), "user_id", limit=3600)


def heartbeats(spark, folder):
    """Events as heartbeats; digests and states follow from the event."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("node"),
        F.col("event_id").alias("heartbeat_id"),
        F.col("ts").alias("sent_at"),
        F.when(kind == "error", "degraded").otherwise("ready").alias("readiness"),
        F.when(value > 90, "failing").otherwise("healthy").alias("health"),
        F.when(kind == "click", "p0").otherwise("p1").alias("policy_digest"),
        F.lit("c1").alias("config_digest"),
        F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")).alias("build_digest"),
        F.lit("s1").alias("sbom_digest"),
        F.when(kind == "view", "noncompliant").otherwise("compliant").alias("drift"),
        F.when(F.col("event_id") % 3 == 0, "external_attested").otherwise("self").alias("claim_class"),
    )


@query(
    "fleet_compliance",
    f"""WITH h AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS v,
  arg_max(event_id, (ts, event_id)) AS e, max(ts) AS sent FROM events GROUP BY 1),
s AS (SELECT s_nationkey, h.user_id IS NOT NULL AS enrolled, coalesce(e % 3 = 0, false) AS ext,
  coalesce(kind = 'error' OR v > 90, false) AS degraded, coalesce(kind IN ('error', 'signup', 'purchase') AND s_suppkey % 7 <> 6, false) AS ok,
  coalesce(epoch(TIMESTAMP '{NOW}') - floor(epoch(sent)) > 7200, true) AS stale
  FROM supplier LEFT JOIN h ON h.user_id = s_suppkey)
SELECT s_nationkey AS region, count(*) AS total, count(*) FILTER (enrolled) AS enrolled, count(*) FILTER (enrolled AND ext) AS external_proof,
  count(*) FILTER (enrolled AND NOT ext) AS claims_only, count(*) FILTER (degraded) AS degraded, count(*) FILTER (enrolled AND ok) AS compliant,
  count(*) FILTER (enrolled AND NOT ok) AS noncompliant, count(*) FILTER (stale) AS stale FROM s GROUP BY 1""",
)
def fleet_compliance(spark, folder):
    node = F.col("s_suppkey")
    nodes = table(spark, folder, "supplier").select(
        node.alias("node"),
        F.col("s_nationkey").alias("region"),
        F.lit("p1").alias("desired_policy"),
        F.lit("c1").alias("desired_config"),
        F.when(node % 7 == 6, "other").otherwise(F.concat(F.lit("b"), (node % 7).cast("string"))).alias("build_digest"),
        F.lit("s1").alias("sbom_digest"),
    )
    states = M.fleet_compliance(nodes, heartbeats(spark, folder), now(), 7200)
    return M.compliance_summary(states, "region")


@query(
    "tool_activity",
    f"""WITH {EVENTS_SQL}, t AS (SELECT action, CASE WHEN action = 'BLOCK' THEN 'denied' WHEN value > 80 THEN 'timeout' ELSE 'ok' END AS s FROM ev)
SELECT 'action' AS kind, action AS label, count(*) AS count FROM t GROUP BY 2
UNION ALL SELECT 'result_status', s, count(*) FROM t GROUP BY 2""",
)
def tool_activity(spark, folder):
    status = F.when(F.col("action") == "BLOCK", "denied").when(F.col("value") > 80, "timeout").otherwise("ok")
    return M.tool_activity(events(spark, folder).select("action", status.alias("result_status")))


@query(
    "prompt_budget",
    """SELECT conv_id AS request_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
  sum(length(text)) > 2000 AS over_budget FROM conversations GROUP BY 1""",
)
def prompt_budget(spark, folder):
    return M.prompt_budget(conversation_parts(spark, folder), 2000)


@query(
    "alerts",
    f"""WITH c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, {AGE_SQL} AS age FROM events GROUP BY 1),
s AS (SELECT user_id, age, user_id % 2 = 0 AS required, CASE kind WHEN 'error' THEN 'failed' WHEN 'click' THEN 'disabled'
  WHEN 'view' THEN 'healthy' WHEN 'signup' THEN 'ready' ELSE 'degraded' END AS state FROM c)
SELECT user_id AS component, 'readiness' AS alert, 'high' AS severity, state AS status FROM s WHERE required AND state NOT IN ('healthy', 'ready')
UNION ALL SELECT user_id, 'freshness', 'medium', 'stale' FROM s WHERE age > 7200
UNION ALL SELECT user_id, 'component', 'medium', state FROM s WHERE NOT required AND state NOT IN ('healthy', 'ready', 'disabled')""",
)
def alerts(spark, folder):
    """The newest event of each user gives the state of one component."""
    last = table(spark, folder, "events").groupBy(F.col("user_id").alias("component")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("last_event")
    )
    kind = F.col("kind")
    state = (
        F.when(kind == "error", "failed")
        .when(kind == "click", "disabled")
        .when(kind == "view", "healthy")
        .when(kind == "signup", "ready")
        .otherwise("degraded")
    )
    rows = last.select("component", "last_event", state.alias("state"), (F.col("component") % 2 == 0).alias("required"))
    return M.alerts(rows, now(), 7200)
