"""Retrieval, routing, shape, lifecycle and rollout queries bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as G
from ..operators import routing as R
from ..session import cut_lineage
from ..sources.tables import spread, table
from .decide import SLOT_SQL
from .ingest import talk
from .registry import query

# ---- retrieval: every document is asked for by a caller and returned with a neighbour chunk --------------


def retrieval_bodies(spark, folder):
    d = F.col("doc_id")
    roles = F.when(d % 5 == 0, F.array(F.lit("admin"))).otherwise(F.array(F.lit("reader")))
    first = F.struct(
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit("c0").alias("chunk_id"),
        F.col("source").alias("tenant"),
        F.col("lang").alias("application"),
        roles.alias("roles"),
        F.when(d % 11 == 0, "someone").alias("subject"),
        F.lit("public").alias("classification"),
        F.col("text").alias("content"),
    )
    second = F.struct(
        F.when(d % 13 == 0, "").otherwise("extra").alias("id"),
        F.struct(
            F.when(d % 7 == 0, "other").otherwise(F.col("source")).alias("tenant_id"),
            F.col("lang").alias("application_id"),
            F.lit("group-a").alias("group"),
            F.lit("s1").alias("segment_id"),
        ).alias("metadata"),
        F.lit("short").alias("snippet"),
    )
    flat = F.to_json(
        F.struct(
            F.lit("retrieve").alias("operation"),
            F.lit("kb").alias("collection_id"),
            F.lit("i1").alias("index"),
            F.lit("search").alias("purpose"),
            F.concat(F.lit("q"), d.cast("string")).alias("search_query"),
        )
    )
    one, two = F.to_json(first), F.to_json(second)
    head = F.expr("substr(flat, 1, length(flat) - 1)")
    docs = spread(table(spark, folder, "documents"), "doc_id")
    rows = docs.select(
        d.alias("request_id"), flat.alias("flat"), one.alias("one"), two.alias("two")
    )
    listed = F.concat(head, F.lit(',"results":['), "one", F.lit(","), "two", F.lit("]}"))
    rid = F.col("request_id")
    body = (
        F.when(rid % 3 == 0, F.concat(F.lit('{"rag":'), listed, F.lit("}")))
        .when(rid % 3 == 1, F.concat(F.lit('{"model":"m","extra":[{"payload":{"retrieval":'), listed, F.lit("}}]}")))
        .otherwise(listed)
    )
    return rows.select("request_id", wrapped(rid, body).alias("body"))


def wrapped(rid, body):
    """Some bodies nested 9, 12 and 200 levels deep, one cut off, one whose list is empty."""

    def nested(left, right, n):
        return F.concat(F.lit(left * n), body, F.lit(right * n))

    return (
        F.when(rid % 10 == 3, nested('{"a":', "}", 9))
        .when(rid % 20 == 7, nested("[", "]", 12))
        .when(rid % 20 == 17, nested("[", "]", 200))
        .when(rid % 20 == 9, F.substring(body, 1, 60))
        .when(rid % 20 == 19, F.lit('{"rag":{"operation":"retrieve","results":[]}}'))
        .otherwise(body)
    )


REFUSED_SQL = "(request_id % 10 IN (3, 7, 9))"


def extracted(spark, folder):
    return G.extract(retrieval_bodies(spark, folder))


RESULT_SQL = f"""results AS (SELECT * FROM (
  SELECT doc_id AS request_id, 0 AS position, CAST(doc_id AS VARCHAR) AS document_id, 'c0' AS chunk_id, source AS tenant, lang AS application,
    CASE WHEN doc_id % 11 = 0 THEN 'someone' ELSE '' END AS subject, CASE WHEN doc_id % 5 = 0 THEN 'admin' ELSE 'reader' END AS roles, '' AS groups,
    'public' AS classification, 'sha256:' || sha256(trim(text, ' ')) AS content_digest, source, lang FROM documents
  UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'extra' END, 's1', CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE source END, lang,
    '', '', 'group-a', '', 'sha256:' || sha256('short'), source, lang FROM documents) WHERE NOT {REFUSED_SQL}
  UNION ALL SELECT request_id, 0, '', '', '', '', '', '', '', '', 'sha256:' || sha256(''), source, lang
  FROM (SELECT doc_id AS request_id, source, lang FROM documents) WHERE {REFUSED_SQL})"""


@query(
    "retrieval_extract",
    f"""WITH {RESULT_SQL} SELECT request_id, position, document_id, chunk_id, tenant, application, subject, roles, groups, content_digest,
  CASE WHEN no THEN '' ELSE 'kb' END AS collection, CASE WHEN no THEN '' ELSE 'i1' END AS index, CASE WHEN no THEN '' ELSE 'search' END AS purpose, 'retrieve' AS operation,
  CASE WHEN no THEN '' ELSE 'sha256:' || sha256('q' || request_id) END AS query_digest, no AS malformed FROM (SELECT *, {REFUSED_SQL} AS no FROM results)""",
)
def retrieval_extract(spark, folder):
    rows = extracted(spark, folder)
    return rows.select(
        "request_id", "position", "document_id", "chunk_id", "tenant", "application", "subject",
        F.array_join("roles", ",").alias("roles"), F.array_join("groups", ",").alias("groups"), "content_digest",
        "collection", "index", "purpose", "operation", "query_digest", "malformed",
    )


def callers(spark, folder):
    d = F.col("doc_id")
    return table(spark, folder, "documents").select(
        d.alias("request_id"),
        F.col("source").alias("tenant"),
        F.col("lang").alias("application"),
        F.lit("me").alias("subject"),
        F.when(d % 10 == 0, F.array(F.lit("admin"), F.lit("reader"))).otherwise(F.array(F.lit("reader"))).alias("roles"),
        F.when(d % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("group-a"))).alias("groups"),
    )


FAULT_SQL = f"""{RESULT_SQL}, judged AS (SELECT *, CASE WHEN document_id = '' THEN 'metadata' WHEN tenant <> source THEN 'identity'
  WHEN subject <> '' THEN 'subject' WHEN roles = 'admin' AND request_id % 10 <> 0 THEN 'role'
  WHEN groups = 'group-a' AND request_id % 17 = 0 THEN 'group' ELSE '' END AS fault FROM results)"""


@query("retrieval_acl", f"WITH {FAULT_SQL} SELECT request_id, position, fault, fault = '' AS allowed FROM judged")
def retrieval_acl(spark, folder):
    rows = G.retrieval_acl(extracted(spark, folder), callers(spark, folder))
    return rows.select("request_id", "position", "fault", (F.col("fault") == "").alias("allowed"))


@query(
    "retrieval_batch",
    f"""WITH {FAULT_SQL}, r AS (SELECT request_id, CASE WHEN fault = 'metadata' THEN 0 WHEN fault <> '' THEN 1
    WHEN request_id % 19 = 0 AND position = 1 THEN 5 WHEN request_id % 23 = 0 AND position = 0 THEN 6 ELSE 7 END AS k FROM judged)
SELECT request_id, count(*) AS chunks, min(k) = 7 AS allowed, ['RAG_MALFORMED', 'RAG_METADATA_REJECTED', 'RAG_CLASSIFICATION_REQUIRED',
  'RAG_OPERATION_DENIED', 'RAG_DECISION_MALFORMED', 'RAG_DECISION_STALE', 'RAG_DECISION_MISMATCH', 'RAG_AUTH_ALLOWED'][1 + min(k)] AS code
FROM r GROUP BY 1""",
)
def retrieval_batch(spark, folder):
    rid, position = F.col("request_id"), F.col("position")
    judged = G.retrieval_acl(extracted(spark, folder), callers(spark, folder)).withColumn(
        "decision",
        F.when((rid % 19 == 0) & (position == 1), "stale")
        .when((rid % 23 == 0) & (position == 0), "denied")
        .otherwise(""),
    )
    return G.retrieval_batch(judged, G.RetrievalLimits(allowed_operations=("retrieve",)))


def bound_columns():
    d = F.col("doc_id").cast("string")
    return {
        "request_id": d,
        "tenant": F.col("source"),
        "application": F.col("lang"),
        "subject": F.lit("me"),
        "policy_id": F.lit("standard"),
        "policy_version": F.lit(3),
        "operation": F.lit("retrieve_result"),
        "collection": F.lit("kb"),
        "index": F.lit("i1"),
        "purpose": F.lit("search"),
        "query_digest": F.sha2(d, 256),
        "document_id": d,
        "chunk_id": F.lit("c0"),
        "content_digest": F.sha2("text", 256),
        "decision_id": F.when(F.col("doc_id") % 6 == 1, "").otherwise(F.concat(F.lit("d"), d)),
        "action": F.when(F.col("doc_id") % 6 == 2, "DENY").otherwise("ALLOW"),
        "expires_at": F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 500),
    }


BOUND_SQL = """sha256('v1|' || doc_id || '|' || source || '|' || lang || '|me|standard|3|retrieve_result|kb|i1|search|' || sha256(CAST(doc_id AS VARCHAR))
  || '|' || doc_id || '|c0|' || sha256(text) || '|' || ((1704067200 + doc_id % 500) * 1000000) || '|'
  || CASE WHEN doc_id % 6 = 1 THEN '' ELSE 'd' || doc_id END || '|' || CASE WHEN doc_id % 6 = 2 THEN 'DENY' ELSE 'ALLOW' END)"""


@query(
    "decision_binding",
    f"""SELECT doc_id, {BOUND_SQL} AS binding, CASE WHEN doc_id % 6 = 1 THEN 'malformed' WHEN doc_id % 500 < 100 OR doc_id % 500 > 400 THEN 'stale'
  WHEN doc_id % 6 = 3 THEN 'mismatch' WHEN doc_id % 6 = 2 THEN 'denied' ELSE '' END AS fault FROM documents""",
)
def decision_binding(spark, folder):
    """Decisions checked 100 seconds in with a maximal age of 300; some bindings are foreign."""
    c = bound_columns()
    given = F.when(F.col("doc_id") % 6 == 3, F.sha2(F.lit("x"), 256)).otherwise(F.upper(G.binding(c)))
    at = F.timestamp_seconds(F.lit(1704067200 + 100))
    return table(spark, folder, "documents").select(
        "doc_id", G.binding(c).alias("binding"), G.decision_fault(c, given, at, 300).alias("fault")
    )


# ---- routes ---------------------------------------------------------------------------------------------

ROUTES = (
    {"id": "cloud-a", "class": "cloud", "provider": "alpha", "family": "openai", "priority": 10,
     "allow": ("gpt-*", "big-?"), "deny": ("gpt-old*",), "aliases": {"fast": "gpt-mini"}, "capabilities": ("chat", "streaming", "tools", "embeddings")},
    {"id": "cloud-b", "class": "cloud", "provider": "beta", "family": "anthropic", "priority": 5, "capabilities": ("messages", "streaming")},
    {"id": "local-a", "class": "local", "provider": "inhouse", "family": "*", "priority": 20, "allow": ("small*", "gpt-*"), "capabilities": ("chat", "messages")},
    {"id": "off", "class": "cloud", "provider": "alpha", "priority": 1, "enabled": False, "capabilities": ("chat",)},
)
ROUTE_SQL = """r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'FORCE_LOCAL_MODEL' ELSE 'ALLOW' END AS action,
  CASE WHEN o_custkey % 3 = 0 THEN 'anthropic' WHEN o_custkey % 3 = 1 THEN 'openai' ELSE '' END AS family,
  CASE WHEN o_custkey % 3 = 0 THEN 'messages' WHEN o_custkey % 3 = 1 THEN 'chat' ELSE '' END AS capability,
  o_orderkey % 2 = 0 AS streaming, o_orderkey % 5 = 0 AS tools,
  CASE WHEN o_orderkey % 7 = 0 THEN 'beta' WHEN o_orderkey % 7 = 1 THEN 'local' ELSE '' END AS requested_provider,
  CASE WHEN o_orderkey % 11 = 0 THEN 'alpha' ELSE '' END AS verified_provider,
  ['gpt-4', 'fast', 'gpt-old-1', 'small-1', '', 'other'][1 + o_orderkey % 6] AS model FROM orders)"""


def route_requests(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    models = F.array(*[F.lit(m) for m in ("gpt-4", "fast", "gpt-old-1", "small-1", "", "other")])
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "FORCE_LOCAL_MODEL").otherwise("ALLOW").alias("action"),
        F.when(c % 3 == 0, "anthropic").when(c % 3 == 1, "openai").otherwise("").alias("family"),
        F.when(c % 3 == 0, "messages").when(c % 3 == 1, "chat").otherwise("").alias("capability"),
        (k % 2 == 0).alias("streaming"),
        (k % 5 == 0).alias("tools"),
        F.when(k % 7 == 0, "beta").when(k % 7 == 1, "local").otherwise("").alias("requested_provider"),
        F.when(k % 11 == 0, "alpha").otherwise("").alias("verified_provider"),
        F.get(models, (k % 6).cast("int")).alias("model"),
    )


def _routes_sql() -> str:
    rows = (
        "('cloud-a', 'cloud', 'alpha', 'openai', 10, true, true, true, false, true, false)",
        "('cloud-b', 'cloud', 'beta', 'anthropic', 5, true, false, false, false, false, true)",
        "('local-a', 'local', 'inhouse', '*', 20, false, false, true, false, false, true)",
    )
    return (
        "routes(id, class, provider, fam, priority, streams, tooled, chat, responses, embeds, messages) AS (VALUES "
        + ", ".join(rows)
        + ")"
    )


@query(
    "route_select",
    f"""WITH {ROUTE_SQL}, {_routes_sql()},
j AS (SELECT r.*, id, priority, CASE WHEN id = 'cloud-a' AND model = 'fast' THEN 'gpt-mini' ELSE model END AS routed, CASE
    WHEN (verified_provider <> '' AND verified_provider NOT IN (provider, class))
      OR (action <> 'FORCE_LOCAL_MODEL' AND verified_provider = '' AND requested_provider <> '' AND requested_provider NOT IN (provider, class)) THEN 'provider'
    WHEN (family <> '' AND fam <> '*' AND fam <> family) OR (streaming AND NOT streams) OR (tools AND NOT tooled)
      OR NOT CASE capability WHEN 'chat' THEN chat WHEN 'messages' THEN messages ELSE chat OR responses OR messages END THEN 'capability'
    WHEN model <> '' AND (CASE id WHEN 'cloud-a' THEN starts_with(model, 'gpt-old') OR NOT (starts_with(model, 'gpt-') OR model = 'fast')
      WHEN 'local-a' THEN NOT (starts_with(model, 'small') OR starts_with(model, 'gpt-')) ELSE false END) THEN 'model' ELSE '' END AS state
  FROM r, routes WHERE action <> 'FORCE_LOCAL_MODEL' OR class = 'local'),
a AS (SELECT o_orderkey, arg_min(id, priority) FILTER (state = '') AS route, arg_min(routed, priority) FILTER (state = '') AS routed_model,
  bool_or(state = 'model') AS m, bool_or(state = 'capability') AS c, bool_or(state = 'provider') AS p, any_value(action) AS action FROM j GROUP BY 1)
SELECT o_orderkey, coalesce(route, '') AS route, coalesce(routed_model, '') AS routed_model, CASE WHEN route IS NOT NULL THEN ''
  WHEN m THEN 'ROUTE_MODEL_REJECTED' WHEN c THEN 'ROUTE_CAPABILITY_REJECTED' WHEN action = 'FORCE_LOCAL_MODEL' THEN 'ROUTE_LOCAL_UNAVAILABLE'
  WHEN p THEN 'ROUTE_PROVIDER_REJECTED' ELSE 'ROUTE_UNAVAILABLE' END AS reject FROM a""",
)
def route_select(spark, folder):
    rows = R.select_route(route_requests(spark, folder), ROUTES)
    return rows.select("o_orderkey", "route", "routed_model", "reject")


# ---- shapes ---------------------------------------------------------------------------------------------


def shape_bodies(spark, folder):
    j, kind = F.col("j"), F.col("turn") % 3

    def cat(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    body = (
        F.when(
            kind == 0,
            cat('{"object":"chat.completion","model":"m1","usage":{"n":1},"choices":[{"finish_reason":"stop","message":{"content":', j, ',"tool_calls":[{},{}]}},{"finish_reason":"length","message":{"content":"ab"}}]}'),
        )
        .when(kind == 1, cat('{"model":"m2","stop_reason":"end","content":[{"type":"text","text":', j, '},{"type":"tool_use"}]}'))
        .otherwise(
            cat('data: {"model":"m3","choices":[{"message":{"content":', j, '}}]}\n\ndata: {"choices":[{"finish_reason":"stop"}],"usage":{}}\n\ndata: [DONE]\n\n')
        )
    )
    return talk(spark, folder).select(
        "request_id", F.when(kind == 2, "sse").otherwise("json").alias("kind"), body.alias("body")
    )


@query(
    "response_shape",
    """WITH t AS (SELECT conv_id || '-' || turn AS request_id, turn % 3 AS k, strlen(text) AS n FROM conversations)
SELECT request_id, CASE WHEN k = 2 THEN 'sse' ELSE 'json' END AS kind, CASE WHEN k = 2 THEN 2 ELSE 1 END AS events,
  [2, 0, 2][1 + k] AS choices, n + CASE WHEN k = 0 THEN 2 ELSE 0 END AS text_bytes, [2, 1, 0][1 + k] AS tool_calls, 'm' || (k + 1) AS model,
  ['length', '', 'stop'][1 + k] AS finish, CASE WHEN k = 1 THEN 'end' ELSE '' END AS stop, k <> 1 AS usage, k = 2 AS done FROM t""",
)
def response_shape(spark, folder):
    return R.response_shape(shape_bodies(spark, folder))


def report(spark, folder, late):
    d = F.col("doc_id")
    n = F.col("n_chars") + (F.when(d % 10 == 0, 1).otherwise(0) if late else F.lit(0))
    status = F.when(n > 5000, "fail").when(n < 200, "skip").otherwise("pass")
    rows = table(spark, folder, "documents").filter(d % 9 != (1 if late else 2))
    return rows.select(
        d.alias("case_id"),
        (F.when(d % 6 == 0, "skip").otherwise(status) if late else status).alias("status"),
        F.concat_ws("/", "lang", F.floor(n / 100).cast("string")).alias("shape"),
        (d % 4 != 0).alias("required"),
        n.alias("duration_ms"),
    )


def _report_sql(name, late):
    n = "n_chars + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END" if late else "n_chars"
    status = f"CASE WHEN {n} > 5000 THEN 'fail' WHEN {n} < 200 THEN 'skip' ELSE 'pass' END"
    if late:
        status = f"CASE WHEN doc_id % 6 = 0 THEN 'skip' ELSE {status} END"
    return f"""{name} AS (SELECT doc_id AS case_id, {status} AS status, lang || '/' || (({n}) // 100) AS shape, doc_id % 4 <> 0 AS required, {n} AS duration_ms
  FROM documents WHERE doc_id % 9 <> {1 if late else 2})"""


@query(
    "report_compare",
    f"""WITH {_report_sql('b', False)}, {_report_sql('c', True)}, j AS (SELECT coalesce(b.case_id, c.case_id) AS id, b.case_id AS x, c.case_id AS y,
  b.status AS bs, c.status AS cs, b.shape AS bh, c.shape AS ch FROM b FULL JOIN c ON b.case_id = c.case_id)
SELECT CAST(id AS VARCHAR) AS item, 'case_presence' AS kind, '' AS baseline, '' AS candidate FROM j WHERE x IS NULL OR y IS NULL
UNION ALL SELECT CAST(id AS VARCHAR), 'status', bs, cs FROM j WHERE bs <> cs
UNION ALL SELECT CAST(id AS VARCHAR), 'semantic_shape', '', '' FROM j WHERE bh <> ch
UNION ALL SELECT 'required=' || required, 'totals', count(*) || '', count(*) FILTER (status = 'pass') || '/' || count(*) FILTER (status = 'fail') || '/' || count(*) FILTER (status = 'skip')
  FROM c GROUP BY required
UNION ALL SELECT 'all', 'latency_delta_ms', '', CAST((SELECT CAST(sum(duration_ms) AS BIGINT) FROM c) - (SELECT CAST(sum(duration_ms) AS BIGINT) FROM b) AS VARCHAR)""",
)
def report_compare(spark, folder):
    """Case differences between two snapshots, and the totals of the newer one."""
    older, newer = report(spark, folder, False), report(spark, folder, True)
    diffs = R.report_compare(older, newer)
    delta = R.latency_delta(older, newer, "duration_ms").select(
        F.lit("all").alias("item"), F.lit("latency_delta_ms").alias("kind"), F.lit("").alias("baseline"), F.col("latency_delta_ms").cast("string").alias("candidate")
    )
    totals = R.report_totals(newer)
    shown = totals.select(
        F.concat(F.lit("required="), F.col("required").cast("string")).alias("item"),
        F.lit("totals").alias("kind"),
        F.col("total").cast("string").alias("baseline"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("passed", "failed", "skipped")]).alias("candidate"),
    )
    return diffs.select(F.col("case_id").cast("string").alias("item"), "kind", "baseline", "candidate").unionByName(shown).unionByName(delta)


# ---- lifecycle and rollout ------------------------------------------------------------------------------

STEP_SQL = """CASE event_id % 9 WHEN 0 THEN 'registered' WHEN 1 THEN 'validated' WHEN 2 THEN 'shadow' WHEN 3 THEN 'canary' WHEN 4 THEN 'promoted'
  WHEN 5 THEN 'paused' WHEN 6 THEN 'rolled_back' WHEN 7 THEN 'retired' ELSE 'validated' END"""


def _edges_sql() -> str:
    pairs = [f"('{a}', '{b}')" for a, targets in R.TRANSITIONS.items() for b in targets]
    return f"edges(a, b) AS (VALUES {', '.join(pairs)})"


LIFE_SQL = f"""{_edges_sql()}, e AS (SELECT event_id, ts, user_id, {STEP_SQL} AS to_state, 'k' || (event_id // 2 * 2 + CASE WHEN event_id % 14 = 1 THEN 0 ELSE event_id % 2 END) AS k FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, event_id) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM f),
walk(user_id, seq, event_id, from_state, state) AS (
  SELECT user_id, seq, event_id, '', CASE WHEN to_state = 'registered' THEN to_state ELSE '' END FROM n WHERE seq = 1
  UNION ALL SELECT n.user_id, n.seq, n.event_id, w.state, CASE WHEN g.a IS NULL THEN w.state ELSE n.to_state END
  FROM walk w JOIN n ON n.user_id = w.user_id AND n.seq = w.seq + 1 LEFT JOIN edges g ON g.a = w.state AND g.b = n.to_state)"""


@query(
    "lifecycle_check",
    f"WITH RECURSIVE {LIFE_SQL} SELECT user_id, seq, event_id, from_state, from_state <> state AS allowed, state FROM walk",
)
def lifecycle_check(spark, folder):
    return lifecycle_rows(spark, folder).select("user_id", "seq", "event_id", "from_state", "allowed", "state")


def lifecycle_rows(spark, folder):
    """Events of a user as requests to move one model; some idempotency keys repeat."""
    e = F.col("event_id")
    steps = ("registered", "validated", "shadow", "canary", "promoted", "paused", "rolled_back", "retired", "validated")
    to = F.get(F.array(*[F.lit(s) for s in steps]), (e % 9).cast("int"))
    key = F.floor(e / 2) * 2 + F.when(e % 14 == 1, 0).otherwise(e % 2)
    rows = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", to.alias("to_state"), F.concat(F.lit("k"), key.cast("string")).alias("k")
    )
    return R.lifecycle_check(rows, "user_id", F.floor(F.unix_timestamp("ts") / 3600), ["ts", "event_id"], "k")


@query(
    "champion_history",
    f"""WITH RECURSIVE {LIFE_SQL}, w AS (SELECT walk.*, n.ts, n.to_state, walk.user_id % 5 AS registry, from_state <> state AS allowed
  FROM walk JOIN n ON n.user_id = walk.user_id AND n.seq = walk.seq),
a AS (SELECT *, CASE WHEN allowed AND to_state IN ('promoted', 'rolled_back') THEN user_id END AS sets FROM w),
b AS (SELECT *, last_value(sets IGNORE NULLS) OVER (PARTITION BY registry ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
c AS (SELECT *, coalesce(sets, before) AS active, CASE WHEN allowed AND to_state = 'promoted' AND before <> user_id THEN before END AS parent FROM b),
p AS (SELECT user_id, ts, event_id, parent FROM c WHERE parent IS NOT NULL)
SELECT c.event_id, registry, c.user_id, active, c.parent, arg_max(p.parent, {{'t': p.ts, 'e': p.event_id}}) AS rollback_target
FROM c LEFT JOIN p ON p.user_id = c.active AND (p.ts < c.ts OR (p.ts = c.ts AND p.event_id <= c.event_id)) GROUP BY ALL""",
)
def champion_history(spark, folder):
    """The champion of each of five registries after every request, and where a rollback would go."""
    rows = cut_lineage(lifecycle_rows(spark, folder).withColumn("registry", F.col("user_id") % 5))
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    out = R.champions(rows, "registry", "user_id", hour, ["ts", "event_id"])
    return out.select("event_id", "registry", "user_id", "active", "parent", "rollback_target")


WANTED = {
    "tenants": ("FRANCE", "GERMANY", "CHINA", "JAPAN", "BRAZIL", "CANADA"),
    "environments": ("*",),
    "regions": ("EUROPE", "ASIA", "AMERICA"),
    "capabilities": ("redact",),
    "minimum_version": "v1.4",
}


@query(
    "rollout_eligible",
    f"""WITH n AS (SELECT s_suppkey AS node, n_name AS tenant, r_name AS region, CASE WHEN s_acctbal > 5000 THEN 'prod' ELSE 'test' END AS environment,
    s_suppkey % 4 <> 0 AS redact, s_suppkey % 3 AS major, s_suppkey % 10 AS minor FROM supplier
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT *, tenant IN ('FRANCE', 'GERMANY', 'CHINA', 'JAPAN', 'BRAZIL', 'CANADA') AND region IN ('EUROPE', 'ASIA', 'AMERICA') AND redact
    AND (major > 1 OR (major = 1 AND minor >= 4)) AS eligible FROM n)
SELECT region, count(*) AS nodes, count(*) FILTER (eligible) AS eligible,
  count(*) FILTER (eligible AND {SLOT_SQL.format("CAST(node AS VARCHAR) || chr(0) || tenant || chr(0) || environment")} < 60) AS assigned FROM e GROUP BY 1""",
)
def rollout_eligible(spark, folder):
    k = F.col("s_suppkey")
    nodes = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k.alias("node"),
            F.col("n_name").alias("tenant"),
            F.col("r_name").alias("region"),
            F.when(F.col("s_acctbal") > 5000, "prod").otherwise("test").alias("environment"),
            F.when(k % 4 == 0, F.array(F.lit("audit"))).otherwise(F.array(F.lit("redact"), F.lit("audit"))).alias("capabilities"),
            F.concat(F.lit("v"), (k % 3).cast("string"), F.lit("."), (k % 10).cast("string")).alias("version"),
        )
    )
    out = R.rollout_eligible(nodes, WANTED, 60)
    return out.groupBy("region").agg(
        F.count("*").alias("nodes"), F.count_if("eligible").alias("eligible"), F.count_if("assigned").alias("assigned")
    )
