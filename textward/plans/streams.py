"""Batch twins of the streaming operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timing import micros
from ..operators import detectors as D
from ..operators import monitor as M
from ..session import cut_lineage
from ..sources.planted import PLANTED_SQL, planted_parts
from ..sources.tables import table
from ..streaming import deltas as S
from ..streaming import jobs as J
from ..streaming import limits as L
from ..streaming import quarantine as Q
from .decide import DECIDE_SQL, decisions, held_findings
from .detect import production_sql
from .ingest import talk
from .registry import query
from .rewrite import redact_sql

LATE_SQL = "CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 30 HOUR ELSE ts END"


def arrivals(spark, folder):
    """Events as they arrive; every fiftieth one reports a time 30 hours back."""
    late = F.col("ts") - F.expr("INTERVAL 30 HOURS")
    return table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.col("ts").alias("arrived_at"),
        F.when(F.col("event_id") % 50 == 0, late).otherwise(F.col("ts")).alias("at"),
    )


@query(
    "stream_minute_counts",
    f"""SELECT date_trunc('minute', {LATE_SQL}) AS minute, event_type, count(*) AS n FROM events
WHERE {LATE_SQL} >= ts - INTERVAL 24 HOUR GROUP BY 1, 2""",
)
def stream_minute_counts(spark, folder):
    return J.minute_counts(arrivals(spark, folder)).select(
        F.col("window.start").alias("minute"), "event_type", "n"
    )


def provider_events(spark, folder):
    """One event per conversation turn, shaped by family."""
    j, kind = F.col("j"), F.col("turn") % 9

    def cat(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    shapes = (
        ("chat", cat('{"choices":[{"delta":{"content":', j, '}},{"delta":{"tool_calls":[{"function":{"arguments":"{}"}}]}}]}')),
        ("responses", cat('{"type":"response.output_text.delta","delta":', j, "}")),
        ("responses", cat('{"type":"response.function_call_arguments.done","arguments":', j, ',"item":{"arguments":"x"}}')),
        ("responses", cat('{"type":"other","delta":', j, ',"text":"t"}')),
        ("messages", cat('{"type":"content_block_delta","delta":{"text":', j, ',"partial_json":"p"}}')),
        ("messages", cat('{"type":"ping","delta":{"text":', j, "}}")),
        ("generic", cat('{"z":{"text":', j, '},"b":[{"args_arguments":"no"},{"arguments":"a1"}],"image_url":"u","zz":[[[[[{"y":{"text":"deep"}}]]]]]}')),
        ("generic", cat("not json ", j)),
        ("chat", cat("{broken ", j)),
    )
    family = data = None
    for i, (name, text) in enumerate(shapes):
        cond = kind == i
        family = F.when(cond, name) if family is None else family.when(cond, name)
        data = F.when(cond, text) if data is None else data.when(cond, text)
    return talk(spark, folder).select("request_id", family.alias("family"), data.alias("data"), "j")


@query(
    "sse_deltas",
    """WITH b AS (SELECT conv_id || '-' || turn AS request_id, turn % 9 AS k, text FROM conversations), f AS (
  SELECT request_id, k, 0 AS fragment, text, 'text' AS kind FROM b WHERE k IN (0, 1, 4)
  UNION ALL SELECT request_id, k, 1, '{}', 'tool_arguments' FROM b WHERE k = 0
  UNION ALL SELECT request_id, k, 0, text, 'tool_arguments' FROM b WHERE k = 2 UNION ALL SELECT request_id, k, 1, 'x', 'tool_arguments' FROM b WHERE k = 2
  UNION ALL SELECT request_id, k, 0, 't', 'text' FROM b WHERE k = 3 UNION ALL SELECT request_id, k, 1, 'p', 'tool_arguments' FROM b WHERE k = 4
  UNION ALL SELECT request_id, k, NULL, NULL, NULL FROM b WHERE k IN (5, 8)
  UNION ALL SELECT request_id, k, 0, 'a1', 'tool_arguments' FROM b WHERE k = 6 UNION ALL SELECT request_id, k, 1, text, 'text' FROM b WHERE k = 6
  UNION ALL SELECT request_id, k, 2, 'deep', 'text' FROM b WHERE k = 6)
SELECT request_id, fragment, text, kind, k = 8 AS malformed, k = 6 AS attachment FROM f
UNION ALL SELECT request_id, 0, 'not json ' || to_json(text), 'text', false, false FROM b WHERE k = 7""",
)
def sse_deltas(spark, folder):
    rows = S.sse_fragments(provider_events(spark, folder), ["request_id"])
    return rows.select("request_id", "fragment", "text", "kind", "malformed", "attachment")


# ---- release ----------------------------------------------------------------------------------------------

HOLD = 16_384
#: Of five documents, one ends in a key block of 12,000 characters, and one in a block that never closes.
STREAMED_SQL = f"""SELECT request_id, text || CASE request_id % 5
    WHEN 0 THEN ' | -----BEGIN RSA PRIVATE KEY-----' || chr(10) || repeat(sha256(CAST(request_id AS VARCHAR)), 188) || chr(10) || '-----END RSA PRIVATE KEY----- | end'
    WHEN 1 THEN ' | ' ELSE '' END AS text FROM ({PLANTED_SQL})"""


def stream_deltas(spark, folder):
    """Planted documents as streams, each cut into deltas of its own size."""
    rows = planted_parts(spark, folder)
    rid = F.col("request_id")
    digest = F.sha2(rid.cast("string"), 256)
    begin = F.lit(" | -----BEGIN RSA PRIVATE KEY-----\n")
    closed = F.concat(begin, F.repeat(digest, 188), F.lit("\n-----END RSA PRIVATE KEY----- | end"))
    tail = F.when(rid % 5 == 0, closed).when(rid % 5 == 1, F.concat(begin, F.repeat(digest, 300))).otherwise("")
    rows = rows.select(rid.alias("stream_id"), F.concat("text", tail).alias("text"), (rid * 7919 % 997 + 16).cast("int").alias("size"))
    # One pass over a text makes all its deltas.
    pieces = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), F.col("size").cast("string"), F.lit("}")), F.lit(0))
    cut = rows.select("stream_id", F.posexplode(pieces).alias("seq", "data"))
    return cut.select("stream_id", F.col("seq").cast("long").alias("seq"), "data")


@query(
    "stream_holdback",
    f"""WITH RECURSIVE {redact_sql(STREAMED_SQL)}
SELECT t.request_id AS stream_id, sha256(coalesce(redacted, text)) AS digest, length(coalesce(redacted, text)) AS n_chars,
  t.request_id % 5 = 1 AS terminated FROM texts t LEFT JOIN joined USING (request_id)""",
)
def stream_holdback(spark, folder):
    """Streams of deltas, released under all detectors; a block over the limit ends its stream."""
    out = S.stream_release(stream_deltas(spark, folder), D.PRODUCTION, chunk=4000, limit=HOLD)
    parts = F.array_sort(F.collect_list(F.struct("block", "part", "released")))
    whole = out.groupBy("stream_id").agg(
        F.array_join(F.transform(parts, lambda p: p["released"]), "").alias("text"), F.bool_or("terminated").alias("terminated")
    )
    return whole.select("stream_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"), "terminated")


@query(
    "counters_streams",
    f"""WITH RECURSIVE {redact_sql(STREAMED_SQL)}
SELECT 'transformations' AS counter, subtype AS label, count(*) AS value FROM ordered JOIN kept USING (request_id, n) GROUP BY 2
UNION ALL SELECT 'stream_actions', CASE WHEN request_id % 5 = 1 THEN 'terminate' ELSE 'release' END, count(*) FROM texts GROUP BY 2""",
)
def counters_streams(spark, folder):
    return M.stream_counters(cut_lineage(S.stream_release(stream_deltas(spark, folder), D.PRODUCTION, chunk=4000, limit=HOLD)))


# ---- limits -------------------------------------------------------------------------------------------------

RATE, BURST = 2, 3
STRETCH = 20_000


def calls(spark, folder):
    """Events with time compressed, so that users run into their limits."""
    us = micros("ts") - F.lit(1704067200000000)
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value", F.timestamp_micros(F.floor(us / STRETCH)).alias("at")
    )


CALLS_SQL = f"calls AS (SELECT *, (epoch_us(ts) - 1704067200000000) // {STRETCH} AS us FROM events)"


@query(
    "token_bucket",
    f"""WITH RECURSIVE {CALLS_SQL}, n AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS seq FROM calls),
walk(user_id, seq, event_id, us, tokens, allowed, before) AS (
  SELECT user_id, seq, event_id, us, CAST({BURST} * 1000000 - 1000000 AS BIGINT), true, CAST({BURST} * 1000000 AS BIGINT) FROM n WHERE seq = 1
  UNION ALL SELECT user_id, seq, event_id, us, CASE WHEN t >= 1000000 THEN t - 1000000 ELSE t END, t >= 1000000, t FROM (
    SELECT n.user_id, n.seq, n.event_id, n.us, least({BURST} * 1000000, w.tokens + (n.us - w.us) * {RATE}) AS t
    FROM walk w JOIN n ON n.user_id = w.user_id AND n.seq = w.seq + 1))
SELECT user_id, event_id, seq, allowed, tokens, CASE WHEN allowed THEN 0 ELSE CAST(ceil((1000000 - before) / {RATE}.0) AS BIGINT) END AS retry_after_us FROM walk""",
)
def token_bucket(spark, folder):
    return L.token_bucket(calls(spark, folder), "user_id", "event_id", "at", RATE, BURST)


@query(
    "concurrency_sweep",
    f"""WITH {CALLS_SQL}, c AS (SELECT user_id, event_id, us AS s, us + CAST(floor(value * 1000) AS BIGINT) + 1 AS e FROM calls)
SELECT a.user_id, a.event_id, count(*) AS in_flight, count(*) > 2 AS over_limit FROM c a JOIN c b ON b.user_id = a.user_id
  AND b.e > a.s AND (b.s < a.s OR (b.s = a.s AND b.event_id <= a.event_id)) GROUP BY 1, 2""",
)
def concurrency_sweep(spark, folder):
    rows = calls(spark, folder)
    end = F.timestamp_micros(micros("at") + F.floor(F.col("value") * 1000) + 1)
    return L.concurrency_sweep(rows, "user_id", "event_id", F.col("at"), end, 2)


@query(
    "breaker_timeline",
    """WITH n AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
l AS (SELECT *, seq - 1 - coalesce(max(CASE WHEN ok THEN seq END) OVER w, 0) AS failures_before,
    max(CASE WHEN NOT ok THEN ts END) OVER w AS failed_at FROM n
  WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, seq, failures_before, CASE WHEN failures_before < 2 THEN 'closed' WHEN ts >= failed_at + INTERVAL 2 HOUR THEN 'half_open' ELSE 'open' END AS state_before,
  NOT ok AND failures_before + 1 >= 2 AS opens FROM l""",
)
def breaker_timeline(spark, folder):
    rows = table(spark, folder, "events").select(
        "user_id", "event_id", "ts", (F.col("event_type") != "error").alias("success")
    )
    return L.breaker_timeline(rows, "user_id", "event_id", "ts", 2, 7200)


# ---- quarantine ---------------------------------------------------------------------------------------------

RULE = Q.QuarantineRule(threshold=3, window=8 * 3600, cooldown=1800, ttl=4 * 3600, max_ttl=6 * 3600)


@query(
    "incident_signals",
    f"""WITH {DECIDE_SQL}, f AS (SELECT *, 'finding-' || request_id || '-' || (row_number() OVER (
     PARTITION BY request_id ORDER BY detector_order, "start", "end") - 1) AS finding_id FROM findings)
SELECT f.request_id, 'secret_exfiltration' AS reason, sha256(category || chr(0) || subtype || chr(0) || 'pattern' || chr(0) || chr(0) || ':' || chr(0)) AS evidence,
  f.request_id || ':secret_exfiltration:' || finding_id AS idempotency_key
FROM f JOIN decided d ON d.request_id = f.request_id WHERE f.request_id % 3 <> 0 AND (category = 'SECRET' OR d.action IN ('BLOCK', 'REVIEW'))""",
)
def incident_signals(spark, folder):
    held = held_findings(spark, folder)
    found = D.number_findings(held)
    made = decisions(spark, folder, found=held).withColumn("verified", F.col("request_id") % 3 != 0)
    out = Q.incident_signals(made, found)
    return out.select("request_id", "reason", "evidence", "idempotency_key")


def error_signals(spark, folder):
    """Errors of a user as trusted signals; every tenth one is delivered twice."""
    rows = table(spark, folder, "events").filter("event_type = 'error'")
    keyed = rows.select(
        "user_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("signal"), F.col("ts").alias("at"), "event_id"
    )
    again = keyed.filter(F.col("event_id") % 10 == 0).withColumn("at", F.col("at") + F.expr("INTERVAL 1 SECOND"))
    return keyed.unionByName(again).select(F.col("user_id").alias("key"), "signal", "at")


SIGNAL_SQL = """sig AS (SELECT user_id AS key, 'e' || event_id AS signal, ts AS t, event_id, 0 AS again FROM events WHERE event_type = 'error'
  UNION ALL SELECT user_id, 'e' || event_id, ts + INTERVAL 1 SECOND, event_id, 1 FROM events WHERE event_type = 'error' AND event_id % 10 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, signal) AS seq FROM sig),
walk(key, seq, signal, t, cnt, started, prev, expires, activated) AS (
  SELECT key, seq, signal, t, 1, t, t, TIMESTAMP '1970-01-01', false FROM n WHERE seq = 1
  UNION ALL SELECT key, seq, signal, t, cnt2 + CASE WHEN skip THEN 0 ELSE 1 END, started2, CASE WHEN again = 1 THEN prev ELSE t END,
    CASE WHEN NOT skip AND cnt2 + 1 >= 3 AND expires <= t THEN t + INTERVAL 4 HOUR ELSE expires END, NOT skip AND cnt2 + 1 >= 3 AND expires <= t
  FROM (SELECT *, again = 1 OR (cnt2 >= 3 AND t - prev < INTERVAL 30 MINUTE) AS skip FROM (
    SELECT n.key, n.seq, n.signal, n.t, n.again, w.prev, w.expires, CASE WHEN n.again = 0 AND n.t - w.started > INTERVAL 8 HOUR THEN 0 ELSE w.cnt END AS cnt2,
      CASE WHEN n.again = 0 AND n.t - w.started > INTERVAL 8 HOUR THEN n.t ELSE w.started END AS started2
    FROM walk w JOIN n ON n.key = w.key AND n.seq = w.seq + 1)))"""


@query(
    "quarantine_state",
    f"""WITH RECURSIVE {SIGNAL_SQL} SELECT key, signal, t AS signal_at, cnt AS signal_count, activated,
  CASE WHEN expires > TIMESTAMP '1970-01-01' THEN expires END AS expires_at FROM walk""",
)
def quarantine_state(spark, folder):
    return Q.quarantine_states(error_signals(spark, folder), RULE).withColumnRenamed("at", "signal_at")


def contained(spark, folder):
    return Q.containments(Q.quarantine_states(error_signals(spark, folder), RULE), RULE)


HELD_SQL = f"{SIGNAL_SQL}, held AS (SELECT key, t AS started_at, expires AS expires_at, cnt AS signal_count FROM walk WHERE activated)"


@query(
    "quarantine_check",
    f"""WITH RECURSIVE {HELD_SQL}, u AS (SELECT DISTINCT e.event_id FROM events e JOIN held h ON h.key = e.user_id AND e.ts >= h.started_at AND e.ts < h.expires_at),
p AS (SELECT e.event_id, bool_or(e.ts < h.expires_at) AS active FROM events e JOIN held h ON h.key = e.user_id % 20 AND e.ts >= h.started_at
  AND e.ts < h.expires_at + INTERVAL 10 MINUTE GROUP BY 1)
SELECT e.event_id, u.event_id IS NULL AND p.event_id IS NULL AS allowed, CASE WHEN p.event_id IS NOT NULL THEN CASE WHEN active THEN 'QUARANTINED' ELSE 'QUARANTINE_PROBATION' END
    WHEN u.event_id IS NOT NULL THEN 'QUARANTINED' ELSE '' END AS code,
  CASE WHEN p.event_id IS NOT NULL THEN 'provider' WHEN u.event_id IS NOT NULL THEN 'user' ELSE '' END AS scope,
  CASE WHEN p.event_id IS NOT NULL THEN 'disable' WHEN u.event_id IS NOT NULL THEN 'isolate' ELSE '' END AS level
FROM events e LEFT JOIN u ON u.event_id = e.event_id LEFT JOIN p ON p.event_id = e.event_id""",
)
def quarantine_check(spark, folder):
    """Every event as a request of its user through provider `user_id % 20`."""
    own = contained(spark, folder)
    wide = own.withColumn("scope", F.lit("provider")).withColumn("level", F.lit("disable"))
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    scopes = {"user": F.col("user_id"), "provider": F.col("user_id") % 20}
    return Q.quarantine_check(events, own.unionByName(wide), scopes, "event_id", "ts")


@query(
    "quarantine_summary",
    f"""WITH RECURSIVE {HELD_SQL}, l AS (SELECT key, max(expires_at) AS expires_at FROM held GROUP BY 1),
s AS (SELECT CASE WHEN key % 7 = 0 THEN 'released' WHEN expires_at > TIMESTAMP '2024-01-30 12:00:00' THEN 'active' ELSE 'probation' END AS status,
  CASE WHEN key % 2 = 0 THEN 'secret_exfiltration' ELSE 'auth_anomaly' END AS reason FROM l)
SELECT 'status' AS kind, status AS label, count(*) AS count FROM s GROUP BY 2
UNION ALL SELECT 'reason', reason, count(*) FROM s WHERE status <> 'released' GROUP BY 2
UNION ALL SELECT 'scope', 'user', count(*) FROM s WHERE status <> 'released'""",
)
def quarantine_summary(spark, folder):
    last = Q.latest_states(contained(spark, folder))
    status = (
        F.when(F.col("key") % 7 == 0, "released")
        .when(F.col("expires_at") > F.lit("2024-01-30 12:00:00").cast("timestamp"), "active")
        .otherwise("probation")
    )
    reason = F.when(F.col("key") % 2 == 0, "secret_exfiltration").otherwise("auth_anomaly")
    return Q.quarantine_summary(last.select(status.alias("status"), reason.alias("reason"), "scope"))


@query(
    "stream_findings",
    f"""WITH {production_sql(PLANTED_SQL)} SELECT DISTINCT request_id, category, subtype, "start", "end" FROM findings""",
)
def stream_findings(spark, folder):
    """The streaming scan on bounded input: the same projection and deduplication."""
    rows = J.stream_findings(planted_parts(spark, folder))
    return rows.select("request_id", "category", "subtype", "start", "end")
