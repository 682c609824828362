"""Audit and export queries bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.tables import document_identity, table
from .decide import DECIDE_SQL, decisions, held_findings
from .measures import NOW, now
from .registry import query
from .rewrite import hmac_sql

AUDIT_SQL = f"""{DECIDE_SQL},
t AS (SELECT request_id, subtype, count(*) AS n, min({{'o': detector_order, 's': "start"}}) AS first FROM found GROUP BY 1, 2),
g AS (SELECT request_id, string_agg(subtype, ',' ORDER BY first) AS finding_types, CAST(sum(n) AS BIGINT) AS finding_count FROM t GROUP BY 1),
events_ AS (SELECT d.request_id, tenant, application, CASE WHEN d.request_id % 2 = 0 THEN 'cloud' ELSE 'local' END AS provider,
  action, matched_rule, code, 'ALLOW' AS applied_action, coalesce(finding_types, '') AS finding_types, coalesce(finding_count, 0) AS finding_count
  FROM decided d JOIN ids i ON i.request_id = d.request_id LEFT JOIN g ON g.request_id = d.request_id)"""


def audit_rows(spark, folder, mode="shadow"):
    held = held_findings(spark, folder)
    made = decisions(spark, folder, found=held)
    return A.audit_events(made, held, document_identity(spark, folder), mode)


@query("audit_events", f"WITH {AUDIT_SQL} SELECT *, action AS predicted_action FROM events_")
def audit_events(spark, folder):
    rows = audit_rows(spark, folder)
    return rows.select(
        "request_id", "tenant", "application", "provider", "action", "matched_rule", "code", "applied_action",
        F.array_join("finding_types", ",").alias("finding_types"), "finding_count", "predicted_action",
    )


def dirty_events(spark, folder):
    """Audit events with labels, lists and numbers outside their bounds."""
    rid = F.col("request_id")
    many = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("role "), i.cast("string")))
    return audit_rows(spark, folder).withColumns(
        {
            "tenant": F.concat(F.lit("  "), F.col("tenant"), F.lit("/é x")),
            "user": F.when(rid % 4 == 0, "").otherwise(F.concat(F.lit("user#"), rid.cast("string"))),
            "reason_id": F.when(rid % 2 == 0, "custom reason"),
            "deterministic_ms": rid % 7 - 3,
            "rag_chunks": rid * 97 - 500,
            "roles": F.when(rid % 3 == 0, many).otherwise(F.array(F.lit("ok"), F.lit(" "))),
        }
    )


@query(
    "audit_sanitize",
    f"""WITH {AUDIT_SQL}, l AS (SELECT *, tenant || '/___x' AS t, CASE WHEN request_id % 4 = 0 THEN '' ELSE 'user_' || request_id END AS u FROM events_)
SELECT CAST(request_id AS VARCHAR) AS request_id, 'sha256:' || left(sha256('pepper' || chr(0) || t), 32) AS tenant,
  CASE WHEN u = '' THEN '' ELSE 'sha256:' || left(sha256('pepper' || chr(0) || u), 32) END AS user,
  regexp_replace(matched_rule, '[^A-Za-z0-9._:/-]', '_', 'g') AS matched_rule,
  CASE WHEN request_id % 2 = 0 THEN 'custom_reason' ELSE code END AS reason_id, greatest(0, request_id % 7 - 3) AS deterministic_ms,
  least(10000, greatest(0, request_id * 97 - 500)) AS rag_chunks,
  CASE WHEN request_id % 3 = 0 THEN (SELECT string_agg('role_' || i, ',' ORDER BY i) FROM range(1, 17) r(i)) ELSE 'ok' END AS roles,
  concat_ws(',', CASE WHEN request_id % 3 = 0 THEN 'roles' END, CASE WHEN request_id * 97 - 500 > 10000 THEN 'rag_chunks' END) AS truncated FROM l""",
)
def audit_sanitize(spark, folder):
    rows = A.sanitize(dirty_events(spark, folder), "pepper")
    return rows.select(
        "request_id", "tenant", "user", "matched_rule", "reason_id", "deterministic_ms", "rag_chunks",
        F.array_join("roles", ",").alias("roles"), F.array_join("truncated", ",").alias("truncated"),
    )


@query(
    "audit_event_sink",
    f"""WITH {AUDIT_SQL} SELECT date '2024-01-01' + CAST(request_id % 5 AS INTEGER) AS day, action, count(*) AS events,
  CAST(sum(finding_count) AS BIGINT) AS findings FROM events_ GROUP BY 1, 2""",
)
def audit_event_sink(spark, folder):
    """Events written as JSON by day through the allowlist and read back with a fixed schema."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    rows = audit_rows(spark, folder)
    A.write_events(rows, path, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("request_id").cast("long") % 5).cast("int")))
    back = spark.read.schema("request_id string, action string, finding_count long, day date").json(path)
    return back.groupBy("day", "action").agg(
        F.count("*").alias("events"), F.sum("finding_count").alias("findings")
    )


def _work_folder(spark, name):
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "audit_event_stream",
    f"""WITH {AUDIT_SQL} SELECT date '2024-01-01' + CAST(request_id % 5 AS INTEGER) AS day, action, count(*) AS events, count(DISTINCT request_id) AS requests,
  CAST(sum(finding_count) AS BIGINT) AS findings FROM events_ GROUP BY 1, 2""",
)
def audit_event_stream(spark, folder):
    """Events that arrive in four files, through the streaming sink, which is restarted after each, and read back."""
    from ..streaming.export import event_sink

    source, path, checkpoint = (_work_folder(spark, n) for n in ("audit-in", "audit-out", "audit-ck"))
    rows = cut_lineage(audit_rows(spark, folder).withColumn("request_id", F.col("request_id").cast("string")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("request_id").cast("long") % 5).cast("int"))
    for part in range(4):
        rows.where(F.pmod(F.xxhash64("request_id"), F.lit(4)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        event_sink(stream, path, checkpoint, day).awaitTermination()
    back = spark.read.schema("request_id string, action string, finding_count long, day date").json(path)
    return back.groupBy("day", "action").agg(
        F.count("*").alias("events"), F.count_distinct("request_id").alias("requests"), F.sum("finding_count").alias("findings")
    )


# ---- chains ---------------------------------------------------------------------------------------------

MAC_KEY = "audit-mac"


def payload():
    return F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")


def chained(spark, folder):
    """One chain per user, in event order."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "props")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return A.chain_build(events, "user_id", hour, ["ts", "event_id"], payload(), MAC_KEY)


CHAIN_SQL = """numbered AS (SELECT user_id, event_id || '|' || event_type || '|' || props AS payload, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id FROM events),
walk(user_id, sequence, previous, record_hash) AS (
  SELECT user_id, sequence, repeat('0', 64), sha256(unhex(lpad(hex(sequence), 16, '0')) || unhex(repeat('0', 64)) || encode(payload))
  FROM numbered WHERE sequence = 1
  UNION ALL SELECT n.user_id, n.sequence, p.prev,
    sha256(unhex(lpad(hex(n.sequence), 16, '0')) || unhex(p.prev) || encode(n.payload))
  FROM (SELECT w.user_id, w.sequence + 1 AS sequence, w.record_hash AS prev FROM walk w) p
  JOIN numbered n ON n.user_id = p.user_id AND n.sequence = p.sequence)"""


@query(
    "audit_chain_build",
    f"WITH RECURSIVE {CHAIN_SQL} SELECT user_id, sequence, previous, record_hash, {hmac_sql(MAC_KEY, 'record_hash')} AS mac FROM walk",
)
def audit_chain_build(spark, folder):
    return chained(spark, folder).select("user_id", "sequence", "previous", "record_hash", "mac")


def damaged(records):
    """Payloads altered, MACs wrong; single records, whole ranges, the first and the last ones missing."""
    seq, user, last = F.col("sequence"), F.col("user_id"), F.col("sealed")
    gone = (
        ((user % 7 == 1) & (seq % 32 == 9))
        | ((user % 7 == 4) & seq.between(33, 64))
        | ((user % 7 == 5) & (seq > last - 3))
        | ((user % 7 == 6) & (seq <= 2))
    )
    counts = records.groupBy("user_id").agg(F.count("*").alias("sealed"))
    rows = records.join(counts, "user_id").filter(~gone).drop("sealed")
    rows = rows.withColumn("payload", F.when((user % 7 == 2) & (seq == 7), F.lit("altered")).otherwise(F.col("payload")))
    return rows.withColumn("mac", F.when((user % 7 == 3) & (seq == 12), F.lit("00")).otherwise(F.col("mac")))


DAMAGE_SQL = """n AS (SELECT user_id, ts, event_id, octet_length(encode(event_id || '|' || event_type || '|' || props)) AS bytes,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, count(*) OVER (PARTITION BY user_id) AS total FROM events),
here AS (SELECT * FROM n WHERE NOT (user_id % 7 = 1 AND sequence % 32 = 9) AND NOT (user_id % 7 = 4 AND sequence BETWEEN 33 AND 64)
  AND NOT (user_id % 7 = 5 AND sequence > total - 3) AND NOT (user_id % 7 = 6 AND sequence <= 2)),
bad AS (
  SELECT user_id, sequence, CASE WHEN sequence <> coalesce(lag(sequence) OVER (PARTITION BY user_id ORDER BY sequence), 0) + 1 THEN 'gap'
    WHEN user_id % 7 = 2 AND sequence = 7 THEN 'hash' WHEN user_id % 7 = 3 AND sequence = 12 THEN 'mac' ELSE '' END AS fault FROM here
  UNION ALL SELECT t.user_id, coalesce(h.last, 0) + 1, 'end' FROM (SELECT DISTINCT user_id, total FROM n) t
    LEFT JOIN (SELECT user_id, max(sequence) AS last FROM here GROUP BY 1) h ON h.user_id = t.user_id WHERE coalesce(h.last, 0) <> t.total)"""


def damaged_chain(spark, folder):
    """The damaged records, and where their ends miss the seals of the whole chains."""
    whole = cut_lineage(chained(spark, folder))
    records = damaged(whole)
    return records, A.cut_ends(records, A.chain_seals(whole, "user_id", MAC_KEY), "user_id", MAC_KEY)


@query(
    "audit_chain_verify",
    f"""WITH {DAMAGE_SQL} SELECT user_id, min(sequence) AS first_bad, arg_min(fault, sequence) AS fault, count(*) AS faults FROM bad WHERE fault <> '' GROUP BY 1""",
)
def audit_chain_verify(spark, folder):
    records, ends = damaged_chain(spark, folder)
    return A.chain_faults(A.chain_verify(records, "user_id", MAC_KEY), "user_id", ends)


@query(
    "audit_status",
    f"""WITH {DAMAGE_SQL}, s AS (SELECT user_id, count(*) AS records, CAST(sum(CASE WHEN user_id % 7 = 2 AND sequence = 7 THEN 7 ELSE bytes END) AS BIGINT) AS payload_bytes,
  max(sequence) + 1 AS next_sequence FROM here GROUP BY 1), o AS (SELECT user_id, min(ts) AS oldest FROM events GROUP BY 1)
SELECT user_id, records, payload_bytes, next_sequence, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(oldest)) AS BIGINT) AS oldest_age_seconds,
  user_id NOT IN (SELECT user_id FROM bad WHERE fault <> '') AS ready FROM s JOIN o USING (user_id)""",
)
def audit_status(spark, folder):
    records, ends = damaged_chain(spark, folder)
    verified = A.chain_verify(records, "user_id", MAC_KEY)
    at = table(spark, folder, "events").select("user_id", "ts")
    oldest = at.groupBy("user_id").agg(F.min("ts").alias("ts"))
    return A.chain_status(records.join(oldest, "user_id"), verified, "user_id", now(), "ts", ends)


@query(
    "siem_batches",
    """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS s FROM events), k AS (SELECT * FROM n WHERE s > 100)
SELECT (s - 101) // 500 AS batch, count(*) AS events, min(s) AS first_sequence, max(s) AS last_sequence,
  left(sha256(string_agg(CAST(event_id AS VARCHAR), chr(0) ORDER BY s)), 32) AS idempotency_key FROM k GROUP BY 1""",
)
def siem_batches(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return A.export_batches(events, hour, ["ts", "event_id"], "event_id", 500, after=100)


# ---- export as a stream ----------------------------------------------------------------------------------

ARRIVALS = 3


def receiver(key, payloads):
    """Refuses batches that hold a certain event, answers others after two failures, and some never."""
    ids = [int(p.split("|")[0]) for p in payloads]
    if any(i % 1500 == 7 for i in ids):
        return 400
    seen = _TRIES[key] = _TRIES.get(key, 0) + 1
    if ids[0] % 5 == 0:
        raise TimeoutError
    return 503 if ids[0] % 3 == 0 and seen < 3 else 202


_TRIES: dict = {}


@query(
    "siem_export",
    f"""WITH n AS (SELECT event_id, event_id % {ARRIVALS} AS epoch, row_number() OVER (PARTITION BY event_id % {ARRIVALS} ORDER BY ts, event_id) AS r,
    row_number() OVER (ORDER BY event_id % {ARRIVALS}, ts, event_id) AS s FROM events),
b AS (SELECT epoch, (r - 1) // 200 AS batch, count(*) AS events, min(s) AS first_sequence, max(s) AS last_sequence, arg_min(event_id, s) AS head,
    left(sha256(string_agg(CAST(event_id AS VARCHAR), chr(0) ORDER BY s)), 32) AS idempotency_key, bool_or(event_id % 1500 = 7) AS refused FROM n GROUP BY 1, 2)
SELECT epoch, batch, events, first_sequence, last_sequence, idempotency_key, CASE WHEN refused OR head % 5 = 0 THEN 'dead' ELSE 'sent' END AS outcome,
  CASE WHEN refused THEN 1 WHEN head % 5 = 0 THEN 4 WHEN head % 3 = 0 THEN 3 ELSE 1 END AS attempts,
  CASE WHEN refused THEN 'status 400' WHEN head % 5 = 0 THEN 'TimeoutError' ELSE '' END AS reason,
  CASE WHEN refused OR head % 5 = 0 THEN events ELSE 0 END AS dead_letters FROM b""",
)
def siem_export(spark, folder):
    """Events that arrive in three parts, sent in batches by an export that is restarted for each."""
    from ..streaming.export import Export

    source, path, checkpoint = (_work_folder(spark, n) for n in ("siem-in", "siem-out", "siem-ck"))
    events = table(spark, folder, "events").select("event_id", "ts", "event_type")
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    out = Export(path, receiver, "event_id", payload, ["ts", "event_id"], hour, size=200, base=0.0)
    for part in range(ARRIVALS):
        events.where(F.col("event_id") % ARRIVALS == part).write.mode("append").parquet(source)
        out.start(spark.readStream.schema(events.schema).parquet(source), checkpoint).awaitTermination()
    dead = out.dead_letters(spark).groupBy("epoch", "batch").agg(F.count("*").alias("dead_letters"))
    return out.outcomes(spark).join(dead, ["epoch", "batch"], "left").select(
        "epoch", "batch", "events", "first_sequence", "last_sequence", "idempotency_key", "outcome", "attempts", "reason",
        F.coalesce("dead_letters", F.lit(0)).alias("dead_letters"),
    )
