"""Evasion queries bound to documents and conversations with hidden secrets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.unicode import CONTROL_CLASS, LETTERS, LOOKALIKES
from ..operators import audit as A
from ..operators import detectors as D
from ..operators import evasion as E
from ..operators import monitor as M
from ..operators import policy as P
from ..session import cut_lineage
from ..sources.planted import HIDDEN_SQL, PLAIN_WORDS, hidden_parts
from ..sources.tables import conversation_parts, document_identity, provider_of, spread, table
from ..streaming import quarantine as Q
from . import sqlkit as K
from .decide import DECIDE_SQL, FOUND, PROVIDER_SQL, SEV_SQL, signals
from .detect import ENTROPY_OK, RE_ENTROPY, production_sql
from .registry import query
from .rules import ACTIVE

HIDDEN = f"SELECT request_id, text FROM ({HIDDEN_SQL})"
SPANS = ("request_id", "category", "subtype", "start", "end")


@query(
    "scan_controls",
    f"""WITH {K.scan_ctes('m', CONTROL_CLASS, HIDDEN)}
SELECT request_id, 'ZERO_WIDTH_OR_BIDI_CONTROL' AS subtype, CAST(bs AS INTEGER) AS "start",
  CAST(bs + strlen(v) AS INTEGER) AS "end", cs AS char_start FROM m""",
)
def scan_controls(spark, folder):
    rows = E.control_findings(hidden_parts(spark, folder))
    return rows.select("request_id", "subtype", "start", "end", "char_start")


# The documents hold no other character that canonicalization changes.
CANON = (
    f"replace(translate(translate(text, '{LOOKALIKES}', '{LETTERS}'), "
    "chr(65313) || chr(65323) || chr(65321), 'AKI'), chr(8203), '')"
)


@query(
    "canonical_text",
    f"SELECT request_id, sha256({CANON}) AS digest, length({CANON}) AS n_chars FROM ({HIDDEN_SQL})",
)
def canonical_text(spark, folder):
    rows = E.canonical_parts(hidden_parts(spark, folder))
    return rows.select("request_id", F.sha2("canon", 256).alias("digest"), F.length("canon").alias("n_chars"))


CANON_SRC = f"SELECT request_id, {CANON} AS text FROM ({HIDDEN_SQL})"
NOT_SHOWN = r"[^\pL\pM\pN\pP\pS \t\n\f\r]"
MIXED = "(regexp_matches(v, '[-_]') AND regexp_matches(v, '[+/]'))"
PAD = "repeat('=', CAST((4 - length(rtrim(v, '=')) % 4) % 4 AS INTEGER))"
DECODERS = {
    "base64": (
        E.BASE64,
        f"{K.entropy('v')} >= 3.25 AND NOT {MIXED} AND regexp_full_match(v, '[A-Za-z0-9+/_-]+={{0,2}}') "
        "AND (length(v) % 4 = 0 OR NOT contains(v, '=')) AND length(rtrim(v, '=')) % 4 <> 1",
        f"TRY(decode(from_base64(translate(rtrim(v, '='), '-_', '+/') || {PAD})))",
    ),
    "percent": (
        r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~+/-]){8,}",
        "length(v) - length(replace(v, '%', '')) >= 2",
        "TRY(url_decode(replace(v, '+', '%2B')))",
    ),
    "json_unicode": (
        r"(?:\\u[0-9A-Fa-f]{4}){2,}",
        r"NOT regexp_matches(v, '(?i)\\ud[89a-f]')",
        """json_extract_string('["' || v || '"]', '$[0]')""",
    ),
    "hex": (r"(?:[0-9A-Fa-f]{2}){8,}", "true", "TRY(decode(unhex(v)))"),
}


def decoded_sql(name: str, kind: str, src: str) -> str:
    """CTE text ending in `name` (request_id, cs, bs, v, d): decoded candidates of a source of texts that are worth scanning."""
    pattern, worth, decoded = DECODERS[kind]
    return f"""{K.scan_ctes(f'{name}_cand', pattern, src)},
{name}_dec AS (SELECT request_id, cs, bs, v, {decoded} AS d FROM {name}_cand WHERE {worth}),
{name} AS MATERIALIZED (SELECT * FROM {name}_dec WHERE d IS NOT NULL AND strlen(d) >= 6
  AND length(regexp_replace(d, '{NOT_SHOWN}', '', 'g')) * 100 >= length(d) * 82
  AND (contains(d, 'sk-') OR contains(d, 'eyJ') OR {K.entropy('d')} >= 2.0))"""


def encoded_sql(kind: str) -> str:
    """CTE text ending in `encoded`: distinct findings inside decoded candidates."""
    views = "SELECT request_id || ':' || bs || ':' || (bs + strlen(v)) AS request_id, d AS text FROM views"
    return f"""{decoded_sql('views', kind, CANON_SRC)}, {production_sql(views)},
encoded AS (SELECT DISTINCT CAST(split_part(request_id, ':', 1) AS BIGINT) AS request_id, category, subtype,
  CAST(split_part(request_id, ':', 2) AS INTEGER) AS "start", CAST(split_part(request_id, ':', 3) AS INTEGER) AS "end"
  FROM findings)"""


def _encoded(spark, folder, kind):
    parts = E.canonical_parts(hidden_parts(spark, folder))
    rows = E.encoded_findings(parts, E.EvasionConfig(transforms=(kind,)))
    return E.dedupe(rows).select(*SPANS)


def _register(kind: str, key: str) -> None:
    @query(key, f"WITH {encoded_sql(kind)} SELECT * FROM encoded")
    def run(spark, folder):
        return _encoded(spark, folder, kind)


_register("base64", "scan_base64")
_register("percent", "scan_percent")
_register("json_unicode", "scan_json_unicode")
_register("hex", "scan_hex")


# ---- JSON -----------------------------------------------------------------------------------------

JSON_TEXT = """CASE WHEN event_id % 4 = 0 THEN replace(props, '}', concat(', "auth": {"password": "', h,
    '", "deep": [{"x": ["', CASE WHEN event_id % 8 = 4 THEN 'token ' ELSE '' END, h, '"]}]}, "binary_token": "', h,
    '"}')) ELSE props END"""
JSON_SRC = f"SELECT event_id AS request_id, {JSON_TEXT} AS text FROM (SELECT *, substr(sha256(CAST(event_id AS VARCHAR)), 1, 32) AS h FROM events)"


@query(
    "scan_json_strings",
    f"""WITH texts AS ({JSON_SRC}),
leaves AS (SELECT request_id, 'password=' || json_extract_string(text, '$.auth.password') AS text FROM texts
    WHERE json_extract_string(text, '$.auth.password') IS NOT NULL),
{K.scan_ctes('m', RE_ENTROPY, 'SELECT * FROM leaves')},
hits AS (SELECT DISTINCT request_id FROM m WHERE {ENTROPY_OK})
SELECT request_id, 'SECRET' AS category, 'HIGH_ENTROPY_SECRET' AS subtype, 0 AS "start",
  CAST(strlen(text) AS INTEGER) AS "end" FROM hits JOIN texts USING (request_id)
WHERE request_id % 8 <> 4""",
)
def scan_json_strings(spark, folder):
    """Event properties with a nested password; half of them also show it in plain sight."""
    rows = table(spark, folder, "events").withColumn(
        "h", F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 32)
    )
    parts = rows.select(
        F.col("event_id").alias("request_id"),
        F.lit(0).alias("message_index"),
        F.lit(0).alias("part_index"),
        F.expr(JSON_TEXT).alias("text"),
    )
    canon = parts.withColumn("canon", F.col("text")).withColumn("source", F.lit(None).cast("array<int>"))
    cfg = E.EvasionConfig(transforms=("structured",))
    found = E.view_findings(E.views(canon, cfg, with_canonical=True))
    rows = E.dedupe(E.drop_shown(found)).filter("evasion_type = 'structured_json'")
    return rows.select(*SPANS)


# ---- parts ------------------------------------------------------------------------------------------

SPLIT_SQL = """SELECT conv_id, turn, CASE WHEN turn > 0 THEN substr(sha256(conv_id || '-' || (turn - 1)), 13, 12) || ' ' ELSE '' END
  || text || ' glpat-' || substr(sha256(conv_id || '-' || turn), 1, 12) AS text FROM conversations"""


def split_parts(spark, folder):
    """Conversations whose tokens are cut between one turn's end and the next one's start."""
    parts = conversation_parts(spark, folder)

    def digest(turn):
        return F.sha2(F.concat_ws("-", F.col("request_id").cast("string"), turn.cast("string")), 256)

    turn = F.col("message_index")
    head = F.when(turn > 0, F.concat(F.substring(digest(turn - 1), 13, 12), F.lit(" "))).otherwise("")
    tail = F.concat(F.lit(" glpat-"), F.substring(digest(turn), 1, 12))
    return parts.withColumn("text", F.concat(head, "text", tail))


@query(
    "scan_cross_part",
    f"""WITH p AS ({SPLIT_SQL})
SELECT a.conv_id AS request_id, CAST(a.turn AS INTEGER) AS message_index, CAST(b.turn AS INTEGER) AS end_message_index,
  'SECRET' AS category, 'GITLAB_PAT' AS subtype, CAST(length(a.text) - 18 AS INTEGER) AS char_start, 12 AS char_end
FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def scan_cross_part(spark, folder):
    parts = E.canonical_parts(split_parts(spark, folder))
    plain = E.canonical_findings(parts)
    rows = E.cross_part_findings(parts, plain, E.EvasionConfig())
    return rows.select(
        "request_id", "message_index", "end_message_index", "category", "subtype", "char_start", "char_end"
    )


# ---- everything together --------------------------------------------------------------------------------

UNION_SQL = f"""
plain AS (SELECT request_id, category, subtype, char_start AS cs, char_end AS ce FROM findings),
home AS (SELECT request_id, CASE WHEN request_id % 8 = 1 THEN base_chars + 4 ELSE 1000000000 END AS gap FROM ({HIDDEN_SQL})),
mapped AS (SELECT request_id, category, subtype,
    CAST(cs + CASE WHEN cs >= gap THEN 1 ELSE 0 END AS INTEGER) AS char_start,
    CAST(ce + CASE WHEN ce - 1 >= gap THEN 1 ELSE 0 END AS INTEGER) AS char_end, '' AS evasion_type, '' AS encoding_chain
  FROM plain JOIN home USING (request_id))"""


def _all_sql() -> str:
    parts = []
    for kind in ("base64", "percent", "json_unicode"):
        parts.append(
            f"SELECT request_id, category, subtype, 'encoded' AS evasion_type, '{kind}' AS encoding_chain, "
            f"n FROM (SELECT request_id, category, subtype, count(*) AS n FROM "
            f"(WITH {encoded_sql(kind)} SELECT * FROM encoded) GROUP BY ALL)"
        )
    return f"""WITH {production_sql(CANON_SRC)}, {UNION_SQL},
every AS (SELECT request_id, category, subtype, evasion_type, encoding_chain, count(*) AS n FROM mapped GROUP BY ALL
  UNION ALL {' UNION ALL '.join(parts)})"""


@query("evasion_dedupe", f"{_all_sql()} SELECT * FROM every")
def evasion_dedupe(spark, folder):
    """All views of every document, controls allow-listed; findings per type and chain."""
    rows = E.evasion_findings(hidden_parts(spark, folder), allow=["zero_width_control"])
    return rows.groupBy("request_id", "category", "subtype", "evasion_type", "encoding_chain").agg(
        F.count("*").alias("n")
    )


@query(
    "evasion_action",
    f"""{_all_sql()}, c AS (
  SELECT request_id, CASE WHEN category = 'PII' THEN 'REDACT' ELSE 'BLOCK' END AS action, 'evasion.encoded' AS rule
  FROM every WHERE evasion_type = 'encoded'
  UNION ALL SELECT request_id, 'REVIEW', 'evasion.zero_width_control' FROM ({HIDDEN_SQL}) WHERE regexp_matches(text, '{CONTROL_CLASS}'))
SELECT request_id, action, rule FROM c QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY {SEV_SQL} DESC, rule) = 1""",
)
def evasion_action(spark, folder):
    rows = E.evasion_findings(hidden_parts(spark, folder))
    best = P.best_candidates(P.evasion_candidates(rows, ACTIVE), "request_id")
    return best.select("request_id", "action", "rule")


@query(
    "work_budget",
    """WITH r AS (SELECT lang AS request_id, doc_id AS position, strlen(text) AS n_bytes,
  sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id) AS work FROM documents)
SELECT request_id, 'EVASION_BUDGET_EXCEEDED' AS subtype, 'budget_exceeded' AS evasion_type,
  sum(CASE WHEN work <= 262144 THEN n_bytes ELSE 0 END)::BIGINT AS used_bytes,
  count(*) FILTER (work <= 262144) AS kept FROM r GROUP BY 1 HAVING max(work) > 262144""",
)
def work_budget(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("lang").alias("request_id"),
        F.col("doc_id").alias("position"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    budgeted = E.work_budget(docs, E.EvasionConfig())
    used = budgeted.groupBy("request_id").agg(
        F.sum(F.when(F.col("within"), F.col("n_bytes")).otherwise(0)).alias("used_bytes"),
        F.count_if("within").alias("kept"),
    )
    over = E.budget_findings(budgeted).select("request_id", "subtype", "evasion_type")
    return over.join(used, "request_id")


# ---- chains of encodings under a budget -----------------------------------------------------------------

NESTED = E.EvasionConfig(decode_depth=2, max_work_bytes=12_000)
STRICT = replace(ACTIVE, evasion=ACTIVE.evasion | {"budget_exceeded": "REVIEW"})
FORMS = 6


def _percent(text):
    return F.regexp_replace(F.hex(F.encode(text, "utf-8")), "(..)", r"%$1")


def nested_parts(spark, folder):
    """Documents ending in a token under up to two encodings."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    token = F.concat(F.lit("glpat-"), F.substring(h, 1, 24))
    slot = F.col("doc_id") % FORMS
    hidden = (
        F.when(slot == 0, F.base64(F.encode(_percent(token), "utf-8")))
        .when(slot == 1, _percent(F.base64(F.encode(token, "utf-8"))))
        .when(slot == 2, F.base64(F.encode(F.base64(F.encode(token, "utf-8")), "utf-8")))
        .when(slot == 3, _percent(token))
        .when(slot == 4, F.base64(F.encode(F.lit(PLAIN_WORDS), "utf-8")))
        .otherwise("")
    )
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.lit(0).alias("message_index"),
        F.lit(0).alias("part_index"),
        F.concat("text", F.lit(" "), hidden).alias("text"),
    )
    return spread(rows, "request_id")


NESTED_SQL = f"""SELECT request_id, text || ' ' || CASE request_id % {FORMS}
    WHEN 0 THEN to_base64(encode(regexp_replace(hex(t), '(..)', '%\\1', 'g')))
    WHEN 1 THEN regexp_replace(hex(to_base64(encode(t))), '(..)', '%\\1', 'g')
    WHEN 2 THEN to_base64(encode(to_base64(encode(t)))) WHEN 3 THEN regexp_replace(hex(t), '(..)', '%\\1', 'g')
    WHEN 4 THEN to_base64(encode('{PLAIN_WORDS}')) ELSE '' END AS text
  FROM (SELECT doc_id AS request_id, text, 'glpat-' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 24) AS t FROM documents)"""
KINDS = ("base64", "percent", "json_unicode")


def _level_sql() -> str:
    """CTE text: `kept1` and `kept2` (request_id, bs, be, chain, d) within the budget, `over` requests beyond it."""
    top = NESTED.max_work_bytes
    first = ",\n".join(decoded_sql(f"l1_{k}", k, "SELECT * FROM nested") for k in KINDS)
    second = ",\n".join(decoded_sql(f"l2_{k}", k, "SELECT id AS request_id, d AS text FROM kept1") for k in KINDS)
    rows1 = " UNION ALL ".join(f"SELECT request_id, cs, bs, bs + strlen(v) AS be, '{k}' AS chain, d FROM l1_{k}" for k in KINDS)
    rows2 = " UNION ALL ".join(f"SELECT request_id AS id, d, '{k}' AS kind FROM l2_{k}" for k in KINDS)
    return f"""nested AS MATERIALIZED ({NESTED_SQL}), {first},
level1 AS (SELECT *, 2 * strlen(d) AS cost FROM ({rows1})),
spent1 AS (SELECT n.request_id, strlen(any_value(text)) AS base, strlen(any_value(text)) + coalesce(sum(cost), 0) AS work
  FROM nested n LEFT JOIN level1 USING (request_id) GROUP BY 1),
kept1 AS MATERIALIZED (SELECT request_id || ':' || bs || ':' || be || ':' || chain AS id, request_id, cs, bs, be, chain, d FROM (
  SELECT l.*, base + sum(cost) OVER (PARTITION BY request_id ORDER BY cs, chain) AS upto FROM level1 l JOIN spent1 USING (request_id)) WHERE upto <= {top}),
{second},
level2 AS (SELECT k.request_id, cs, bs, be, k.chain || '>' || kind AS chain, x.d, strlen(x.d) AS cost FROM ({rows2}) x JOIN kept1 k USING (id)),
spent2 AS (SELECT s.request_id, any_value(work) AS before, any_value(work) + coalesce(sum(cost), 0) AS work FROM spent1 s LEFT JOIN level2 USING (request_id) GROUP BY 1),
kept2 AS (SELECT request_id, bs, be, chain, d FROM (
  SELECT l.*, before + sum(cost) OVER (PARTITION BY request_id ORDER BY cs, l.chain) AS upto FROM level2 l JOIN spent2 USING (request_id)) WHERE upto <= {top}),
over AS (SELECT request_id FROM spent2 WHERE work > {top})"""


def nested_sql() -> str:
    """CTE text ending in `hidden` (request_id, category, subtype, confidence, start, chain), `over` and `findings` of the plain texts."""
    views = """SELECT request_id || ':' || bs || ':' || be || ':' || chain AS request_id, d AS text FROM (
      SELECT request_id, bs, be, chain, d FROM kept1 UNION ALL SELECT * FROM kept2)"""
    inner = f"""WITH {production_sql(views)} SELECT DISTINCT CAST(split_part(request_id, ':', 1) AS BIGINT) AS request_id, category, subtype, confidence,
      CAST(split_part(request_id, ':', 2) AS INTEGER) AS "start", CAST(split_part(request_id, ':', 3) AS INTEGER) AS "end", split_part(request_id, ':', 4) AS chain FROM findings"""
    return f"""{_level_sql()}, hidden AS MATERIALIZED ({inner})"""


def nested_findings(spark, folder):
    return E.evasion_findings(nested_parts(spark, folder), NESTED)


@query(
    "evasion_chains",
    f"""WITH {nested_sql()} SELECT request_id, category, subtype, "start", "end", 'encoded' AS evasion_type, chain AS encoding_chain FROM hidden
UNION ALL SELECT request_id, 'POLICY', 'EVASION_BUDGET_EXCEEDED', 0, 0, 'budget_exceeded', '' FROM over""",
)
def evasion_chains(spark, folder):
    """Tokens under one and two encodings; requests whose decode work goes over the budget say so."""
    rows = nested_findings(spark, folder).filter("evasion_type <> ''")
    return rows.select("request_id", "category", "subtype", "start", "end", "evasion_type", "encoding_chain")


NESTED_FOUND = f"""{nested_sql()}, {production_sql('SELECT * FROM nested')},
found AS (SELECT *, {PROVIDER_SQL} AS provider FROM (
  SELECT request_id, category, subtype, confidence, "start", '' AS evasion_type, '' AS chain FROM findings
  UNION ALL SELECT request_id, category, subtype, confidence, "start", 'encoded', chain FROM hidden
  UNION ALL SELECT request_id, 'POLICY', 'EVASION_BUDGET_EXCEEDED', 1.0, 0, 'budget_exceeded', '' FROM over))"""
ROLED_SQL = f"""{DECIDE_SQL.replace(FOUND, NESTED_FOUND)},
evasive AS (SELECT request_id, {{'a': action, 'r': rule, 's': 'canonicalization', 'c': 'EVASION_REJECTED'}} AS e FROM (
    SELECT request_id, CASE evasion_type WHEN 'budget_exceeded' THEN 'REVIEW' ELSE CASE category WHEN 'PII' THEN 'REDACT' ELSE 'BLOCK' END END AS action,
      'evasion.' || evasion_type AS rule FROM found WHERE evasion_type <> '')
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY {SEV_SQL} DESC, rule) = 1),
roled AS (SELECT c.request_id, CASE WHEN d.s = 'explicit_deny' THEN d WHEN e IS NOT NULL THEN e
    WHEN d.s IN ('secret', 'tenant', 'application') THEN d
    WHEN c.request_id % 4 = 0 THEN {{'a': 'RESTRICT_TOOLS', 'r': 'roles.guest', 's': 'role', 'c': 'ROLE_RESTRICTED'}}
    WHEN c.request_id % 4 = 1 THEN {{'a': 'REVIEW', 'r': 'roles.intern', 's': 'role', 'c': 'ROLE_RESTRICTED'}} ELSE d END AS d
  FROM chain c LEFT JOIN evasive v ON v.request_id = c.request_id)"""


def roled_decisions(spark, folder):
    """Findings of the evasion scan, and decisions over them for callers with roles."""
    found = cut_lineage(nested_findings(spark, folder)).withColumn("provider", provider_of(F.col("request_id")))
    roles = F.when(F.col("request_id") % 4 == 0, F.array(F.lit("guest"))).when(F.col("request_id") % 4 == 1, F.array(F.lit("intern")))
    who = document_identity(spark, folder).withColumn("roles", F.coalesce(roles, F.array().cast("array<string>")))
    return found.withColumn("detector_order", F.lit(0)), cut_lineage(P.decide(who, found, STRICT, signals(spark, folder)))


@query(
    "decide_evasion",
    f"WITH {ROLED_SQL} SELECT request_id, d.a AS action, d.r AS matched_rule, d.s AS precedence_stage, d.c AS code FROM roled",
)
def decide_evasion(spark, folder):
    """All nine stages: roles, and findings in canonical, decoded and doubly decoded text."""
    _, made = roled_decisions(spark, folder)
    return made.select("request_id", "action", "matched_rule", "precedence_stage", "code")


@query(
    "audit_evasion",
    f"""WITH {ROLED_SQL}, per AS (SELECT request_id, count(*) AS finding_count, coalesce(string_agg(DISTINCT evasion_type, ',' ORDER BY evasion_type) FILTER (evasion_type <> ''), '') AS kinds,
    max(CASE WHEN chain <> '' THEN 1 + length(chain) - length(replace(chain, '>', '')) ELSE 0 END) AS depth, bool_or(evasion_type = 'budget_exceeded') AS rejected FROM found GROUP BY 1)
SELECT r.request_id, d.a AS action, coalesce(finding_count, 0) AS finding_count, coalesce(kinds, '') AS evasion_types, coalesce(depth, 0) AS encoding_depth,
  coalesce(rejected, false) AS budget_rejected FROM roled r LEFT JOIN per p ON p.request_id = r.request_id""",
)
def audit_evasion(spark, folder):
    """Audit events with their evasion fields."""
    found, made = roled_decisions(spark, folder)
    events = A.audit_events(made, found, document_identity(spark, folder), "enforce")
    return events.select(
        "request_id", "action", "finding_count", F.array_join("evasion_types", ",").alias("evasion_types"), "encoding_depth", "budget_rejected"
    )


@query(
    "counters_evasion",
    f"""WITH {ROLED_SQL}
SELECT 'requests' AS counter, d.a AS label_a, 'enforce' AS label_b, '' AS label_c, count(*) AS value FROM roled GROUP BY 2
UNION ALL SELECT 'findings', category, subtype, '', count(DISTINCT request_id) FROM found GROUP BY 2, 3
UNION ALL SELECT 'evasion', evasion_type, CAST(CASE WHEN chain <> '' THEN 1 + length(chain) - length(replace(chain, '>', '')) ELSE 0 END AS VARCHAR), d.a, count(*)
  FROM found JOIN roled USING (request_id) WHERE evasion_type <> '' GROUP BY 2, 3, 4""",
)
def counters_evasion(spark, folder):
    found, made = roled_decisions(spark, folder)
    return M.counters(made, found, "enforce")


@query(
    "incident_evasion",
    f"""WITH {ROLED_SQL} SELECT f.request_id, CASE WHEN category = 'SECRET' OR (category = 'PII' AND d.a IN ('BLOCK', 'REVIEW')) THEN 'secret_exfiltration'
    WHEN evasion_type <> '' THEN 'detector_evasion' END AS reason, count(*) AS signals FROM found f JOIN roled r ON r.request_id = f.request_id
WHERE f.request_id % 3 <> 0 GROUP BY 1, 2 HAVING reason IS NOT NULL""",
)
def incident_evasion(spark, folder):
    """Signals of verified requests; a finding of the evasion stage that is no secret counts as evasion."""
    found, made = roled_decisions(spark, folder)
    verified = made.withColumn("verified", F.col("request_id") % 3 != 0)
    out = Q.incident_signals(verified, D.number_findings(found))
    return out.groupBy("request_id", "reason").agg(F.count("*").alias("signals"))
