"""Redaction, tokenization and vault queries bound to the driver tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions.hashing import hmac_pads
from ..operators import detectors as D
from ..operators import transform as T
from ..operators import vault as V
from ..sources.planted import PLANTED_SQL, planted_parts
from ..sources.tables import conversation_parts, table
from . import sqlkit as K
from .detect import production_sql
from .registry import query

# Greedy planning as a walk over the ordered findings, one step per finding.
PLAN_STEPS_SQL = """
ordered AS MATERIALIZED (SELECT *, CASE category WHEN 'SECRET' THEN 3 ELSE 2 END AS priority, row_number() OVER (
    PARTITION BY request_id ORDER BY "start", "end" DESC, category DESC, detector_order) AS n FROM findings),
walk(request_id, n, open_n, open_end, open_prio, closed_n) AS (
  SELECT request_id, n, n, "end", priority, CAST(NULL AS BIGINT) FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.request_id, o.n,
    CASE WHEN w.open_end <= o."start" OR o.priority > w.open_prio THEN o.n ELSE w.open_n END,
    CASE WHEN w.open_end <= o."start" OR o.priority > w.open_prio THEN o."end" ELSE w.open_end END,
    CASE WHEN w.open_end <= o."start" OR o.priority > w.open_prio THEN o.priority ELSE w.open_prio END,
    CASE WHEN w.open_end <= o."start" THEN w.open_n END
  FROM walk w JOIN ordered o ON o.request_id = w.request_id AND o.n = w.n + 1),
kept AS (SELECT request_id, closed_n AS n FROM walk WHERE closed_n IS NOT NULL
  UNION ALL SELECT request_id, arg_max(open_n, n) FROM walk GROUP BY 1)"""
REDACT_STEPS_SQL = """spans AS (SELECT o.*, coalesce(lag(char_end) OVER (
    PARTITION BY request_id ORDER BY "start"), 0) AS prev FROM ordered o JOIN kept USING (request_id, n)),
joined AS (SELECT s.request_id, string_agg(substr(t.text, prev + 1, char_start - prev)
    || '[REDACTED:' || subtype || ']', '' ORDER BY "start") || substr(any_value(t.text), max(char_end) + 1) AS redacted
  FROM spans s JOIN texts t USING (request_id) GROUP BY 1)"""


def redact_sql(src: str) -> str:
    """CTE text `texts`, `findings`, `ordered`, `kept`, `joined` (request_id, redacted) over a source of texts."""
    return f"{production_sql(src)},{PLAN_STEPS_SQL}, {REDACT_STEPS_SQL}"


PLAN_SQL = f"WITH RECURSIVE {production_sql(PLANTED_SQL)},{PLAN_STEPS_SQL}"


@query(
    "span_plan",
    f"""{PLAN_SQL} SELECT request_id, "start", "end", char_start, char_end, subtype, priority
FROM ordered JOIN kept USING (request_id, n)""",
)
def span_plan(spark, folder):
    rows = T.plan_rows(T.plan_parts(planted_parts(spark, folder), D.PRODUCTION))
    return rows.select("request_id", "start", "end", "char_start", "char_end", "subtype", "priority")


@query(
    "redact_text",
    f"""WITH RECURSIVE {redact_sql(PLANTED_SQL)}
SELECT t.request_id, sha256(coalesce(redacted, text)) AS digest, length(coalesce(redacted, text)) AS n_chars
FROM texts t LEFT JOIN joined USING (request_id)""",
)
def redact_text(spark, folder):
    rows = T.redact_parts(T.plan_parts(planted_parts(spark, folder), D.PRODUCTION))
    return rows.select(
        "request_id", F.sha2("redacted", 256).alias("digest"), F.length("redacted").alias("n_chars")
    )


TOKENS_SQL = f"""{redact_sql(PLANTED_SQL)},
valued AS (SELECT o.request_id, o.n, o.subtype, o."start", o.char_start, o.char_end, o.value FROM ordered o JOIN kept USING (request_id, n)),
numbered AS (SELECT request_id, subtype, value, row_number() OVER (PARTITION BY request_id, subtype ORDER BY min("start")) AS ordinal FROM valued GROUP BY 1, 2, 3),
tokens AS (SELECT v.*, ordinal, subtype || '_' || lpad(CAST(ordinal AS VARCHAR), 3, '0') AS token FROM valued v JOIN numbered USING (request_id, subtype, value))"""


@query(
    "tokenize_all",
    f"""WITH RECURSIVE {TOKENS_SQL}, gaps AS (SELECT *, coalesce(lag(char_end) OVER (PARTITION BY request_id ORDER BY "start"), 0) AS prev FROM tokens),
shown AS (SELECT g.request_id, count(*) AS tokens, string_agg(substr(t.text, prev + 1, char_start - prev) || '<' || token || '>', '' ORDER BY "start")
    || substr(any_value(t.text), max(char_end) + 1) AS text FROM gaps g JOIN texts t USING (request_id) GROUP BY 1)
SELECT request_id, tokens, sha256(text) AS digest, length(text) AS n_chars FROM shown""",
)
def tokenize_all(spark, folder):
    """Every production detector: documents with findings, their values replaced by numbered tokens."""
    parts, tokens = T.tokenize_parts(planted_parts(spark, folder), D.PRODUCTION)
    counted = tokens.groupBy("request_id").agg(F.count("*").alias("tokens"))
    return parts.join(counted, "request_id").select(
        "request_id", "tokens", F.sha2("tokenized", 256).alias("digest"), F.length("tokenized").alias("n_chars")
    )


@query(
    "placeholder_all",
    f"""WITH RECURSIVE {TOKENS_SQL} SELECT request_id, subtype, count(*) AS placeholders, count(DISTINCT token) AS labels, max(ordinal) AS highest FROM tokens GROUP BY 1, 2""",
)
def placeholder_all(spark, folder):
    """The placeholders of all detectors read back from the tokenized texts."""
    parts, _ = T.tokenize_parts(planted_parts(spark, folder), D.PRODUCTION)
    found = V.placeholder_rows(parts.select("request_id", F.col("tokenized").alias("text")), ["request_id"])
    cut = found.where("valid").select(
        "request_id",
        F.regexp_extract("label", "^(.*)_[0-9]+$", 1).alias("subtype"),
        "label",
        F.regexp_extract("label", "_([0-9]+)$", 1).cast("long").alias("ordinal"),
    )
    return cut.groupBy("request_id", "subtype").agg(
        F.count("*").alias("placeholders"), F.count_distinct("label").alias("labels"), F.max("ordinal").alias("highest")
    )


# ---- conversations with addresses that repeat over turns -----------------------------------------------

TALK_SQL = """SELECT conv_id AS request_id, CAST(turn AS INTEGER) AS message_index,
  text || ' write to user' || (turn % 3) || '@example.com or ops' || conv_id || '@mail.example.org now' AS text
  FROM conversations"""


def talk_parts(spark, folder):
    parts = conversation_parts(spark, folder)
    turn = F.col("message_index")
    suffix = F.concat(
        F.lit(" write to user"),
        (turn % 3).cast("string"),
        F.lit("@example.com or ops"),
        F.col("request_id").cast("string"),
        F.lit("@mail.example.org now"),
    )
    return parts.withColumn("text", F.concat("text", suffix))


TALK_TOKENS_SQL = f"""{K.scan_ctes('m', K.RE_EMAIL, TALK_SQL, 'request_id, message_index')},
hits AS (SELECT * FROM m WHERE {K.EMAIL_OK}),
firsts AS (SELECT request_id, v, min({{'m': message_index, 's': bs}}) AS first FROM hits GROUP BY 1, 2),
numbered AS (SELECT request_id, v, row_number() OVER (PARTITION BY request_id ORDER BY first) AS ordinal FROM firsts),
tokens AS (SELECT h.*, n.ordinal, 'EMAIL_' || lpad(CAST(n.ordinal AS VARCHAR), 3, '0') AS token
  FROM hits h JOIN numbered n USING (request_id, v))"""
TALK_TEXT_SQL = """spans AS (SELECT *, coalesce(lag(cs + length(v)) OVER (
    PARTITION BY request_id, message_index ORDER BY cs), 0) AS prev FROM tokens),
tokenized AS (SELECT request_id, message_index, string_agg(substr(text, prev + 1, cs - prev) || '<' || token || '>', ''
    ORDER BY cs) || substr(any_value(text), max(cs + length(v)) + 1) AS text FROM spans GROUP BY 1, 2)"""


@query(
    "token_ordinals",
    f"""WITH {TALK_TOKENS_SQL} SELECT request_id, message_index, CAST(bs AS INTEGER) AS "start",
  'EMAIL' AS subtype, ordinal FROM tokens""",
)
def token_ordinals(spark, folder):
    _, tokens = T.tokenize_parts(talk_parts(spark, folder), [D.MAIL])
    return tokens.select("request_id", "message_index", "start", "subtype", "ordinal")


@query(
    "tokenize_text",
    f"WITH {TALK_TOKENS_SQL}, {TALK_TEXT_SQL} SELECT request_id, message_index, text AS tokenized FROM tokenized",
)
def tokenize_text(spark, folder):
    parts, _ = T.tokenize_parts(talk_parts(spark, folder), [D.MAIL])
    return parts.select("request_id", "message_index", "tokenized")


# ---- vault ---------------------------------------------------------------------------------------------

OPTIONS = V.VaultOptions(mac_key="vault-mac", data_key=b"0123456789abcdef", per_user=3)
START = datetime.datetime(2024, 1, 1)


def hmac_sql(key: str, value: str) -> str:
    inner, outer = (p.hex() for p in hmac_pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


def _digest_sql(label: str, value: str) -> str:
    return hmac_sql("vault-mac", f"'{label}' || chr(0) || {value}")


Z = " || chr(0) || "
PRINCIPALS_SQL = f"{_digest_sql('subject', 'subject')}{Z}{_digest_sql('session', 'session')}"
SCOPE_SQL = f"chr(1){Z}tenant{Z}application{Z}{PRINCIPALS_SQL}{Z}'standard'{Z}'3'{Z}'support'{Z}"
DOC_TOKENS_SQL = f"""{K.scan_ctes('a', K.RE_EMAIL, PLANTED_SQL)},
{K.scan_ctes('b', r'\bglpat-[A-Za-z0-9_-]{20,}', PLANTED_SQL)},
hits AS (SELECT request_id, bs, v, 'EMAIL' AS subtype FROM a WHERE {K.EMAIL_OK}
  UNION ALL SELECT request_id, bs, v, 'GITLAB_PAT' FROM b),
firsts AS (SELECT request_id, subtype, v, min(bs) AS bs FROM hits GROUP BY 1, 2, 3),
issued AS (SELECT f.request_id, bs, v, subtype AS data_category, source AS tenant, lang AS application,
    'u' || (doc_id % 20) AS subject, 's' || doc_id AS session, subtype || '_' || lpad(CAST(row_number() OVER (
      PARTITION BY request_id, subtype ORDER BY bs) AS VARCHAR), 3, '0') AS token
  FROM firsts f JOIN documents ON doc_id = request_id),
vault AS (SELECT *, {hmac_sql('vault-mac', SCOPE_SQL + "''")} AS namespace,
    {hmac_sql('vault-mac', SCOPE_SQL + 'data_category')} AS scope_digest,
    {hmac_sql('vault-mac', f"'session-index'{Z}tenant{Z}application{Z}{PRINCIPALS_SQL}")} AS session_index
  FROM issued QUALIFY row_number() OVER (PARTITION BY subject ORDER BY request_id, bs) <= 3)"""


def document_vault(spark, folder):
    """One record per distinct token of each planted document."""
    detectors = [D.MAIL, D.PREFIXED[0]]
    _, tokens = T.tokenize_parts(planted_parts(spark, folder), detectors, with_value=True)
    first = tokens.groupBy("request_id", "token", "subtype").agg(
        F.min("start").alias("start"), F.min("value").alias("value")
    )
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("source").alias("tenant"), F.col("lang").alias("application")
    )
    rid = F.col("request_id")
    rows = first.join(docs, "request_id").select(
        "request_id",
        "start",
        "token",
        "value",
        "tenant",
        "application",
        F.concat(F.lit("u"), (rid % 20).cast("string")).alias("subject"),
        F.concat(F.lit("s"), rid.cast("string")).alias("session"),
        F.lit("standard").alias("policy_id"),
        F.lit(3).alias("policy_version"),
        F.lit("support").alias("purpose"),
        F.col("subtype").alias("data_category"),
        F.lit(START).alias("issued_at"),
    )
    return V.issue(rows, OPTIONS, ["request_id", "start"])


@query(
    "vault_issue",
    f"""WITH {DOC_TOKENS_SQL} SELECT namespace, token, data_category, scope_digest, session_index,
  TIMESTAMP '2024-01-02 00:00:00' AS expires_at, 10 AS max_retrievals, sha256(v) AS opened_digest FROM vault""",
)
def vault_issue(spark, folder):
    vault = document_vault(spark, folder)
    return vault.select(
        "namespace",
        "token",
        "data_category",
        "scope_digest",
        "session_index",
        "expires_at",
        "max_retrievals",
        F.sha2(V.open_value(OPTIONS), 256).alias("opened_digest"),
    )


@query(
    "revoke_session",
    f"""WITH {DOC_TOKENS_SQL} SELECT namespace, token, session_index FROM vault
WHERE NOT CAST(substr(session, 2) AS BIGINT) % 3 = 0""",
)
def revoke_session(spark, folder):
    docs = table(spark, folder, "documents").filter(F.col("doc_id") % 3 == 0)
    sessions = docs.select(
        F.col("source").alias("tenant"),
        F.col("lang").alias("application"),
        F.concat(F.lit("u"), (F.col("doc_id") % 20).cast("string")).alias("subject"),
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session"),
    ).select(V.session_index(OPTIONS).alias("session_index"))
    return V.revoke_session(document_vault(spark, folder), sessions).select(
        "namespace", "token", "session_index"
    )


SIGNED_KEY = "label-key"


@query(
    "placeholder_extract",
    f"""WITH {TALK_TOKENS_SQL}
SELECT request_id, message_index, token AS shown, true AS valid FROM tokens
UNION ALL SELECT conv_id, CAST(turn AS INTEGER),
  'v1.EMAIL.' || substr(sha256(conv_id || '-' || turn), 1, 36), turn % 3 <> 0 FROM conversations""",
)
def placeholder_extract(spark, folder):
    """Simple and signed placeholders; every third turn carries a label with a wrong MAC."""
    tokenized, _ = T.tokenize_parts(talk_parts(spark, folder), [D.MAIL])
    token_id = F.substring(
        F.sha2(F.concat_ws("-", F.col("request_id").cast("string"), F.col("message_index").cast("string")), 256), 1, 36
    )
    good = V.sign_label(SIGNED_KEY, token_id, F.lit("EMAIL"))
    bad = V.sign_label("other-key", token_id, F.lit("EMAIL"))
    label = F.when(F.col("message_index") % 3 == 0, bad).otherwise(good)
    parts = tokenized.select(
        "request_id",
        "message_index",
        F.concat("tokenized", F.lit(" ref <"), label, F.lit("> end")).alias("text"),
    )
    rows = V.placeholder_rows(parts, ["request_id", "message_index"], ("older", SIGNED_KEY))
    return rows.select(
        "request_id",
        "message_index",
        F.regexp_replace("label", r"\.[0-9a-f]{8}\.[0-9a-f]{32}$", "").alias("shown"),
        "valid",
    )


@query(
    "reidentify",
    f"""WITH {TALK_TOKENS_SQL}, {TALK_TEXT_SQL},
used AS (SELECT *, row_number() OVER (PARTITION BY request_id, token ORDER BY message_index, cs) AS r FROM tokens
  WHERE message_index % 4 <> 3),
shown AS (SELECT s.request_id, s.message_index, s.cs, s.prev, s.v, s.text, CASE WHEN u.r <= 3
    AND s.request_id % 5 <> 0 AND s.request_id % 7 <> 0 THEN s.v ELSE '<' || s.token || '>' END AS piece
  FROM spans s LEFT JOIN used u ON u.request_id = s.request_id AND u.message_index = s.message_index AND u.cs = s.cs)
SELECT request_id, message_index, string_agg(substr(text, prev + 1, cs - prev) || piece, '' ORDER BY cs)
  || substr(any_value(text), max(cs + length(v)) + 1) AS text FROM shown GROUP BY 1, 2""",
)
def reidentify(spark, folder):
    """Tokenized conversations resolved again: some records expired, some purposes differ,
    messages with tool calls are left alone, three retrievals per token."""
    tokenized, tokens = T.tokenize_parts(talk_parts(spark, folder), [D.MAIL], with_value=True)
    rid = F.col("request_id")
    vault = tokens.groupBy("request_id", "token").agg(F.min("value").alias("value")).select(
        rid.cast("string").alias("namespace"),
        "token",
        F.lit("EMAIL").alias("data_category"),
        F.when(rid % 7 == 0, "audit").otherwise("support").alias("purpose"),
        F.concat(F.lit("scope-"), rid.cast("string")).alias("scope_digest"),
        F.when(rid % 5 == 0, F.lit(START)).otherwise(F.lit(START + datetime.timedelta(days=2))).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("idle_expires_at"),
        F.lit(False).alias("single_use"),
        F.lit(3).alias("max_retrievals"),
        "value",
    )
    parts = tokenized.select(
        "request_id",
        "message_index",
        F.col("tokenized").alias("text"),
        rid.cast("string").alias("namespace"),
        F.create_map(F.lit("EMAIL"), F.concat(F.lit("scope-"), rid.cast("string"))).alias("scope_digests"),
        F.lit("support").alias("purpose"),
        (F.col("message_index") % 4 == 3).alias("has_tool_calls"),
    )
    at = F.lit(START + datetime.timedelta(days=1))
    out = V.reidentify(parts, vault, ["request_id", "message_index"], at, F.col("value"), 3)
    return out.select("request_id", "message_index", "text")


@query(
    "pseudonymize",
    r"""WITH p AS (SELECT c_custkey, left(regexp_replace(trim(c_name || ' / ' || c_mktsegment || ' é'),
    'é', '__', 'g'), 96) AS raw FROM customer),
l AS (SELECT c_custkey, regexp_replace(raw, '[^A-Za-z0-9._:/-]', '_', 'g') AS label FROM p)
SELECT c_custkey, label, 'sha256:' || left(sha256('pepper' || chr(0) || label), 32) AS principal FROM l""",
)
def pseudonymize(spark, folder):
    name = F.concat(F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"), F.lit(" é "))
    return table(spark, folder, "customer").select(
        "c_custkey",
        V.bounded_label(name).alias("label"),
        V.principal(name, "pepper").alias("principal"),
    )
