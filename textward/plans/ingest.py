"""Source queries: bodies, paths, evaluation sets and attachments built from the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import transform as T
from ..sources import attachments as A
from ..sources import normalize as N
from ..sources.planted import PLANTED_SQL, planted_parts
from ..sources.tables import conversation_parts, table
from . import sqlkit as K
from .detect import LANG_SQL
from .registry import query

KEYS = ("request_id",)


def talk(spark, folder):
    """Conversation rows with a request id and their text as a JSON string."""
    rows = table(spark, folder, "conversations")
    shown = F.to_json(F.struct(F.col("text").alias("v")))
    return rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        "turn",
        "role",
        "text",
        shown.alias("_j"),
    ).withColumn("j", F.expr("substr(_j, 6, length(_j) - 6)"))


def chat_bodies(spark, folder):
    """One chat body per turn; its shape follows the turn, every eighth one is malformed."""
    j, kind = F.col("j"), F.col("turn") % 8

    def body(*parts):
        return F.concat(
            F.lit('{"model":"m1","messages":[{"role":"system","content":"be brief"},'),
            *[p if not isinstance(p, str) else F.lit(p) for p in parts],
            F.lit("]}"),
        )

    text = F.when(kind == 0, body('{"role":"user","content":', j, "}"))
    text = text.when(
        kind == 1,
        body('{"role":"user","content":[{"type":"text","text":', j, '},{"type":"image_url","image_url":{"url":"u"}},{"type":"odd"},{"file_data":"x"}]}'),
    )
    text = text.when(
        kind == 2,
        body('{"role":"assistant","content":null,"tool_calls":[{"id":"c1","type":"function","function":{"name":"find","arguments":', j, "}}]}"),
    )
    text = text.when(kind == 3, body('{"role":"tool","tool_call_id":"c1","content":[{"type":"input_text","input_text":', j, "}]}"))
    text = text.when(kind == 4, body('{"content":', j, "}"))
    text = text.when(
        kind == 5,
        body('{"role":"user","content":[{"type":"tool_result","content":[{"type":"text","text":', j, '},{"type":"text","text":"b"}]},{"type":"tool_use","name":"run","input":{"a":1}}]}'),
    )
    text = text.when(kind == 6, F.concat(F.lit('{"model":"","messages":[{"role":"user","content":'), j, F.lit("}]}")))
    text = text.otherwise(body('{"role":"user","content":"', F.lit("x"), '"},{"role":"user","content":{"no":1}}'))
    return talk(spark, folder).select("request_id", F.lit("chat").alias("family"), text.alias("body"))


CHAT_SQL = """b AS (SELECT conv_id || '-' || turn AS request_id, turn % 8 AS k, text FROM conversations),
parts AS (SELECT request_id, 0 AS message_index, 0 AS part_index, 'system' AS role, 'text' AS part_type, NULL AS tool_name, 'be brief' AS text
    FROM b WHERE k IN (0, 1, 2, 3, 5)
  UNION ALL SELECT request_id, 1, 0, 'user', 'text', NULL, text FROM b WHERE k = 0 AND text <> ''
  UNION ALL SELECT request_id, 1, 0, 'user', 'text', NULL, text FROM b WHERE k = 1
  UNION ALL SELECT request_id, 1, 1, 'user', 'image_ref', NULL, '' FROM b WHERE k = 1
  UNION ALL SELECT request_id, 1, 2, 'user', 'json', NULL, '' FROM b WHERE k = 1
  UNION ALL SELECT request_id, 1, 3, 'user', 'attachment', NULL, '' FROM b WHERE k = 1
  UNION ALL SELECT request_id, 1, 0, 'assistant', 'tool_call', 'find', text FROM b WHERE k = 2
  UNION ALL SELECT request_id, 1, 0, 'tool', 'tool_result', NULL, text FROM b WHERE k = 3
  UNION ALL SELECT request_id, 1, 0, 'user', 'tool_result', NULL, text FROM b WHERE k = 5
  UNION ALL SELECT request_id, 1, 1, 'user', 'tool_result', NULL, 'b' FROM b WHERE k = 5
  UNION ALL SELECT request_id, 1, 2, 'user', 'tool_call', 'run', '{"a":1}' FROM b WHERE k = 5)"""
PART_COLUMNS = ("request_id", "message_index", "part_index", "role", "part_type", "tool_name", "text")


@query(
    "norm_chat_requests",
    f"""WITH {CHAT_SQL} SELECT *, false AS malformed FROM parts
UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, true FROM b WHERE k IN (4, 6, 7)""",
)
def norm_chat_requests(spark, folder):
    rows = N.normalize_requests(chat_bodies(spark, folder), families=("chat",))
    parts = N.request_parts(rows).select(*PART_COLUMNS, F.lit(False).alias("malformed"))
    bad = rows.filter("malformed").select("request_id", F.lit(True).alias("malformed"))
    return parts.unionByName(bad, allowMissingColumns=True)


def other_bodies(spark, folder):
    """Bodies of the other endpoint families, by turn."""
    j, kind = F.col("j"), F.col("turn") % 8

    def cat(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    shapes = (
        ("completions", cat('{"model":"m","prompt":[', j, ',"second"]}')),
        ("embeddings", cat('{"model":"m","input":', j, "}")),
        ("responses", cat('{"model":"m","instructions":"sys","input":[{"content":[{"type":"input_text","text":', j, "}]}]}")),
        ("messages", cat('{"model":"m","system":"sys","messages":[{"role":"user","content":', j, "}]}")),
        ("complete", cat('{"model":"m","prompt":', j, "}")),
        ("generic", cat('{"model":"m","max_tokens":5,"system":"s","messages":[{"role":"user","content":', j, "}]}")),
        ("generic", cat('{"text":', j, "}")),
        ("completions", cat('{"model":"m","prompt":["",', j, "]}")),
    )
    family = body = None
    for i, (name, text) in enumerate(shapes):
        cond = kind == i
        family = F.when(cond, name) if family is None else family.when(cond, name)
        body = F.when(cond, text) if body is None else body.when(cond, text)
    return talk(spark, folder).select("request_id", family.alias("family"), body.alias("body"))


OTHER_SQL = """b AS (SELECT conv_id || '-' || turn AS request_id, turn % 8 AS k, text FROM conversations),
parts AS (SELECT request_id, 'completions' AS family, 0 AS message_index, 'user' AS role, text FROM b WHERE k = 0
  UNION ALL SELECT request_id, 'completions', 1, 'user', 'second' FROM b WHERE k = 0
  UNION ALL SELECT request_id, 'embeddings', 0, 'user', text FROM b WHERE k = 1
  UNION ALL SELECT request_id, 'responses', 0, 'system', 'sys' FROM b WHERE k = 2
  UNION ALL SELECT request_id, 'responses', 1, 'user', text FROM b WHERE k = 2
  UNION ALL SELECT request_id, 'messages', 0, 'system', 'sys' FROM b WHERE k = 3
  UNION ALL SELECT request_id, 'messages', 1, 'user', text FROM b WHERE k = 3
  UNION ALL SELECT request_id, 'complete', 0, 'user', text FROM b WHERE k = 4
  UNION ALL SELECT request_id, 'generic', 0, 'system', 's' FROM b WHERE k = 5
  UNION ALL SELECT request_id, 'generic', 1, 'user', text FROM b WHERE k = 5
  UNION ALL SELECT request_id, 'generic', 0, 'user', text FROM b WHERE k = 6)"""


@query("norm_other_requests", f"WITH {OTHER_SQL} SELECT * FROM parts")
def norm_other_requests(spark, folder):
    families = ("completions", "embeddings", "responses", "messages", "complete", "generic")
    rows = N.normalize_requests(other_bodies(spark, folder), families=families)
    parts = N.request_parts(rows)
    return parts.join(rows.select("request_id", "family"), "request_id").select(
        "request_id", "family", "message_index", "role", "text"
    )


def response_bodies(spark, folder):
    j, kind = F.col("j"), F.col("turn") % 6

    def cat(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    shapes = (
        ("chat", cat('{"model":"m","choices":[{"message":{"role":"assistant","content":', j, '}},{"message":{"role":"assistant","content":null,"tool_calls":[{"function":{"name":"f","arguments":"{}"}}]}}]}')),
        ("completions", cat('{"choices":[{"text":', j, '},{"text":"two"}]}')),
        ("complete", cat('{"completion":', j, "}")),
        ("responses", cat('{"output":[{"type":"message","content":[{"type":"output_text","text":', j, '}]},{"type":"reasoning"},{"text":"tail"}]}')),
        ("messages", cat('{"content":[{"type":"text","text":', j, '},{"type":"tool_use","name":"go","input":{}}]}')),
        ("chat", cat('{"choices":[{"message":{"role":"assistant","content":7}}],"t":', j, "}")),
    )
    family = body = None
    for i, (name, text) in enumerate(shapes):
        cond = kind == i
        family = F.when(cond, name) if family is None else family.when(cond, name)
        body = F.when(cond, text) if body is None else body.when(cond, text)
    return talk(spark, folder).select("request_id", family.alias("family"), body.alias("body"))


@query(
    "norm_responses",
    """WITH b AS (SELECT conv_id || '-' || turn AS request_id, turn % 6 AS k, text FROM conversations)
SELECT request_id, 0 AS message_index, 0 AS part_index, 'text' AS part_type, NULL AS tool_name, text FROM b WHERE k IN (0, 1, 2, 3, 4)
UNION ALL SELECT request_id, 1, 0, 'tool_call', 'f', '{}' FROM b WHERE k = 0
UNION ALL SELECT request_id, 1, 0, 'text', NULL, 'two' FROM b WHERE k = 1
UNION ALL SELECT request_id, 1, 0, 'text', NULL, 'tail' FROM b WHERE k = 3
UNION ALL SELECT request_id, 0, 1, 'tool_call', 'go', '{}' FROM b WHERE k = 4""",
)
def norm_responses(spark, folder):
    families = ("chat", "completions", "complete", "responses", "messages")
    rows = N.normalize_responses(response_bodies(spark, folder), families=families)
    return N.request_parts(rows).select(
        "request_id", "message_index", "part_index", "part_type", "tool_name", "text"
    )


PATH_SQL = r"""CASE page_id % 10 WHEN 0 THEN '/v1/chat/completions' WHEN 1 THEN '/v1/responses/' WHEN 2 THEN '/v1/embeddings'
  WHEN 3 THEN '/anthropic/v1/messages' WHEN 4 THEN '/v1/complete' WHEN 5 THEN '/tenant/chat/completions' WHEN 6 THEN '/v1/message'
  WHEN 7 THEN '/x/responses' ELSE regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') END"""


@query(
    "endpoint_family",
    f"""WITH p AS (SELECT page_id, regexp_replace({PATH_SQL}, '/$', '') AS p FROM pages)
SELECT page_id, CASE WHEN p = '/v1/chat/completions' THEN 'chat' WHEN p = '/v1/responses' THEN 'responses'
  WHEN p = '/v1/completions' THEN 'completions' WHEN p = '/v1/embeddings' THEN 'embeddings'
  WHEN p IN ('/v1/messages', '/anthropic/v1/messages') THEN 'messages' WHEN p = '/v1/complete' THEN 'complete'
  WHEN regexp_matches(p, '(/chat/completions|/chatcompletion|/messages?|/responses?)$') THEN 'generic' END AS family,
  CASE WHEN regexp_matches(p, '/responses$') THEN 'responses' WHEN regexp_matches(p, '/messages$') THEN 'messages'
    WHEN regexp_matches(p, '/chat/completions$') THEN 'chat' ELSE 'generic' END AS stream_family FROM p""",
)
def endpoint_family(spark, folder):
    path = F.expr(PATH_SQL)
    return table(spark, folder, "pages").select(
        "page_id", N.endpoint_family(path).alias("family"), N.stream_family(path).alias("stream_family")
    )


KIND_SQL = "['text', 'json', 'tool_call', 'odd', 'tool_result'][1 + turn % 5]"


@query(
    "text_parts",
    f"""SELECT conv_id AS request_id, CAST(turn AS INTEGER) AS message_index, {KIND_SQL} AS part_type, length(text) AS n_chars
FROM conversations WHERE text <> '' AND {KIND_SQL} IN ('text', 'tool_call', 'tool_result')""",
)
def text_parts(spark, folder):
    kinds = F.array(*[F.lit(k) for k in ("text", "json", "tool_call", "odd", "tool_result")])
    parts = conversation_parts(spark, folder).withColumn(
        "part_type", F.get(kinds, F.col("message_index") % 5)
    )
    return D.text_parts(parts).select(
        "request_id", "message_index", "part_type", F.length("text").alias("n_chars")
    )


EVAL_LINE = """concat('{"id":"', CASE WHEN doc_id % 29 = 0 THEN '' ELSE concat('d', doc_id) END, '","language":"',
  CASE WHEN doc_id % 3 = 0 THEN 'th' WHEN doc_id % 3 = 1 THEN 'en' WHEN doc_id % 5 = 0 THEN 'xx' ELSE 'mixed' END,
  '","direction":"', CASE WHEN doc_id % 31 = 0 THEN 'sideways' ELSE 'request' END, '","risk":"',
  CASE WHEN doc_id % 4 = 0 THEN 'pii' WHEN doc_id % 23 = 0 THEN 'odd' ELSE 'clean' END, '","state":"s', doc_id,
  '","expected":', CASE WHEN doc_id % 37 = 0 THEN 'null' ELSE concat('{"findings":["EMAIL","A', doc_id % 7, '"],"toxic":',
    CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END, ',"note":"n"}') END, CASE WHEN doc_id % 41 = 0 THEN '' ELSE '}' END)"""


@query(
    "eval_rows_valid",
    """SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'json' WHEN doc_id % 29 = 0 THEN 'id' WHEN doc_id % 3 = 2 AND doc_id % 5 = 0 THEN 'language'
  WHEN doc_id % 4 <> 0 AND doc_id % 23 = 0 THEN 'risk' WHEN doc_id % 31 = 0 THEN 'direction' WHEN doc_id % 37 = 0 THEN 'expected' ELSE '' END AS fault,
  CASE WHEN doc_id % 41 = 0 OR doc_id % 37 = 0 THEN '' ELSE 'EMAIL,A' || doc_id % 7 END AS findings,
  CASE WHEN doc_id % 41 = 0 OR doc_id % 37 = 0 THEN NULL ELSE toxic = 1 END AS toxic FROM labels""",
)
def eval_rows_valid(spark, folder):
    lines = table(spark, folder, "labels").select("doc_id", F.expr(EVAL_LINE).alias("line"))
    rows = N.eval_rows(lines)
    broken = F.col("fault") == "json"
    answer = F.get(F.filter("answers_expected", lambda a: a["question"] == "toxic"), F.lit(0))["answer"]
    return rows.select(
        "doc_id",
        "fault",
        F.when(broken, "").otherwise(F.array_join("findings_expected", ",")).alias("findings"),
        F.when(~broken, answer).alias("toxic"),
    )


@query(
    "pii_gold_spans",
    f"""WITH {K.scan_ctes('m', K.RE_EMAIL, PLANTED_SQL)}
SELECT CAST(request_id AS VARCHAR) AS id, {LANG_SQL} AS language, 'EMAIL' AS entity, CAST(bs AS INTEGER) AS "start",
  CAST(bs + strlen(v) AS INTEGER) AS "end", true AS valid FROM m WHERE {K.EMAIL_OK}""",
)
def pii_gold_spans(spark, folder):
    """Gold examples as JSON lines, read back into spans."""
    parts = T.plan_parts(planted_parts(spark, folder), [D.MAIL])
    spans = F.transform(
        "plan", lambda p: F.struct(p["subtype"].alias("entity"), p["start"].alias("start"), p["end"].alias("end"))
    )
    lines = parts.select(
        F.to_json(
            F.struct(
                F.col("request_id").cast("string").alias("id"),
                D.language_of(F.col("text")).alias("language"),
                "text",
                spans.alias("spans"),
            )
        ).alias("line")
    )
    return N.gold_spans(lines)


@query(
    "attachment_scan",
    """WITH p AS (SELECT page_id, page_id % 9 AS k, html FROM pages)
SELECT page_id, CASE k WHEN 1 THEN 'ATTACHMENT_MIME_MISMATCH' WHEN 4 THEN 'ATTACHMENT_BASE64_INVALID' WHEN 5 THEN 'ATTACHMENT_MIME_NOT_ALLOWED'
    WHEN 6 THEN 'ATTACHMENT_MIME_MISMATCH' WHEN 7 THEN 'ATTACHMENT_BASE64_INVALID' ELSE '' END AS code,
  CASE k WHEN 0 THEN 'text/plain' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'application/pdf' WHEN 8 THEN 'text/plain' ELSE '' END AS mime,
  CASE WHEN k = 3 THEN 2 ELSE 0 END AS pages,
  CASE k WHEN 0 THEN substr(sha256(html), 1, 16) WHEN 2 THEN substr(sha256('GIF89a' || html), 1, 16)
    WHEN 3 THEN substr(sha256('%PDF-1.4 /Type /Page x /Type /Page' || html), 1, 16) WHEN 8 THEN substr(sha256(html), 1, 16) ELSE '' END AS hash,
  CASE WHEN k IN (0, 8) THEN length(html) ELSE 0 END AS n_chars FROM p""",
)
def attachment_scan(spark, folder):
    kind = F.col("page_id") % 9

    def b64(*parts):
        return F.base64(F.encode(F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]), "utf-8"))

    def url(mime, value):
        return F.concat(F.lit(f"data:{mime};base64,"), value)

    html = F.col("html")
    raw = (
        F.when(kind == 0, url("text/plain", b64(html)))
        .when(kind == 1, url("application/json", b64(html)))
        .when(kind == 2, url("image/gif", b64("GIF89a", html)))
        .when(kind == 3, url("application/pdf", b64("%PDF-1.4 /Type /Page x /Type /Page", html)))
        .when(kind == 4, F.concat(F.lit("***"), b64(html)))
        .when(kind == 5, url("text/html", b64(html)))
        .when(kind == 6, url("text/plain", b64(html)))
        .when(kind == 7, F.concat(F.lit("data:text/plain,"), b64(html)))
        .otherwise(F.rtrim(b64(html), F.lit("=")))
    )
    declared = F.when(kind == 6, "image/png").when(kind == 8, "Text/Plain; charset=utf-8")
    rows = table(spark, folder, "pages").select("page_id", raw.alias("raw"), declared.alias("declared"))
    out = A.scan_attachments(rows, archives=False)
    return out.select("page_id", "code", "mime", "pages", "hash", F.length("text").alias("n_chars"))


FORMS = 12


def _zipped(blob, flag=False, lie=None, n=1):
    """A zip of one text, or of that zip and so on; `flag` marks it encrypted, `lie` is a false size."""
    import io
    import zipfile

    for _ in range(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("a.txt", (2024, 1, 1, 0, 0, 0)), blob, zipfile.ZIP_DEFLATED)
        blob = bytearray(out.getvalue())
    centre = blob.rindex(b"PK\x01\x02")
    if flag:
        blob[6] |= 1
        blob[centre + 8] |= 1
    if lie is not None:
        blob[centre + 24 : centre + 28] = lie.to_bytes(4, "little")
    return bytes(blob)


def _blob(kind, html):
    """One attachment of each kind, made from a page."""
    text = html.encode()
    return (
        lambda: b"\x89PNG\r\n\x1a\n" + text,
        lambda: b"\xff\xd8\xff" + text,
        lambda: b"RIFF\x00\x00\x00\x00WEBP" + text,
        lambda: _zipped(text),
        lambda: _zipped(text, n=3),
        lambda: _zipped(b"0" * (5 << 20)),
        lambda: _zipped(b"0" * (5 << 20), lie=10),
        lambda: _zipped(text, flag=True),
        lambda: _zipped(b"0" * (5 << 20), n=2),
        lambda: _zipped(text)[:-10],
        lambda: _zipped(text, n=6),
        lambda: text,
    )[kind]()


MIMES = ("image/png", "image/jpeg", "image/webp", *["application/zip"] * 8, "image/png")


@query(
    "attachment_archives",
    f"""SELECT page_id, CASE WHEN k IN (5, 6, 8, 10) THEN 'ATTACHMENT_EXPANSION_LIMIT_EXCEEDED' WHEN k IN (7, 9) THEN 'ATTACHMENT_ARCHIVE_INVALID'
    WHEN k = 11 THEN 'ATTACHMENT_MIME_MISMATCH' ELSE '' END AS code,
  CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'application/zip' WHEN 4 THEN 'application/zip' ELSE '' END AS mime,
  CASE k WHEN 0 THEN substr(sha256('\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB || encode(html)), 1, 16) WHEN 1 THEN substr(sha256('\\xFF\\xD8\\xFF'::BLOB || encode(html)), 1, 16)
    WHEN 2 THEN substr(sha256('RIFF\\x00\\x00\\x00\\x00WEBP'::BLOB || encode(html)), 1, 16) ELSE '' END AS image_hash
FROM (SELECT *, page_id % {FORMS} AS k FROM pages)""",
)
def attachment_archives(spark, folder):
    """Images and archives made from every page: plain, nested, encrypted, cut off, and bombs that say so or not."""
    made = F.pandas_udf(lambda k, h: pd.Series([_blob(*x) for x in zip(k, h)]), "binary")
    kind = (F.col("page_id") % FORMS).cast("int")
    mime = F.get(F.array(*[F.lit(m) for m in MIMES]), kind)
    rows = table(spark, folder, "pages").select(
        "page_id", F.base64(made(kind, "html")).alias("raw"), mime.alias("declared")
    )
    out = A.scan_attachments(rows, A.AttachmentLimits(max_expansion=1000))
    return out.select("page_id", "code", "mime", F.when(F.startswith("mime", F.lit("image/")), F.col("hash")).otherwise("").alias("image_hash"))


@query(
    "rewrite_json_body",
    f"""WITH t AS (SELECT conv_id || '-' || turn AS request_id, text || ' mail ops' || conv_id || '@example.com' AS text,
  text || ' mail [REDACTED:EMAIL]' AS shown FROM conversations)
SELECT request_id, to_json({{'messages': [{{'role': 'system', 'content': [{{'type': 'text', 'text': 'be brief'}}]}},
  {{'role': 'user', 'content': [{{'type': 'text', 'text': shown}}]}}]}}) AS body FROM t""",
)
def rewrite_json_body(spark, folder):
    """Chat bodies parsed, redacted part by part, and rebuilt at the same coordinates."""
    rows = table(spark, folder, "conversations")
    text = F.concat("text", F.lit(" mail ops"), F.col("conv_id").cast("string"), F.lit("@example.com"))
    content = F.array(
        F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content")),
        F.struct(F.lit("user").alias("role"), text.alias("content")),
    )
    bodies = rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.lit("chat").alias("family"),
        F.to_json(F.struct(F.lit("m").alias("model"), content.alias("messages"))).alias("body"),
    )
    parts = N.request_parts(N.normalize_requests(bodies, families=("chat",)))
    redacted = T.redact_parts(T.plan_parts(parts, [D.MAIL]))
    return N.rebuild_bodies(redacted, text="redacted")
