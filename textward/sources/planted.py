"""Texts derived from the given tables that carry known secrets, identifiers and names.

Each document keeps its whole text and gains one suffix computed from its id, so the input
of the operators that need such shapes grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table

KINDS = 16
THAI_NAME = "นายสมชาย ใจดี"
THAI_LEAD = "เลขบัตร"
THAI_TAIL = "ค่ะ"
THAI_ADDRESS = "ที่อยู่ 99 ถนนสุขุมวิท"


def hex_of(doc_id: Column) -> Column:
    return F.sha2(doc_id.cast("string"), 256)


def national_id(doc_id: Column) -> Column:
    """Twelve digits from the id plus the computed check digit."""
    body = F.lpad((doc_id % 1000000000000).cast("string"), 12, "7")
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(11)),
        F.lit(0),
        lambda acc, i: acc + F.substr(body, i + 1, F.lit(1)).cast("int") * (F.lit(13) - i),
    )
    return F.concat(body, ((F.lit(11) - total % 11) % 10).cast("string"))


def secret_suffix(doc_id: Column) -> Column:
    h = hex_of(doc_id)

    def cut(a: int, n: int) -> Column:
        return F.substring(h, a, n)

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    forms = (
        text(" use glpat-", cut(1, 20), " please"),
        text(" oauth ghp_", cut(1, 36)),
        text(" key AKIA", F.translate(cut(1, 16), "abcdef", "ABCDEF"), " end"),
        text(" key=sk-", cut(1, 32)),
        text(" key=sk-ant-", cut(1, 32)),
        text(" xoxb-", cut(1, 24)),
        text(" AIza", cut(1, 34)),
        text(
            "\n-----BEGIN RSA PRIVATE KEY-----\n", cut(1, 40), "\n", cut(41, 24),
            "\n-----END RSA PRIVATE KEY-----",
        ),
        text(" auth eyJ", cut(1, 20), ".eyJ", cut(21, 20), ".", cut(41, 24), " end"),
        text(" Authorization: BeArEr ", cut(1, 32)),
        text(" conn postgres://admin:", cut(1, 10), "@db.internal:5432/app end"),
        text(" AWS_SECRET_ACCESS_KEY=", cut(1, 40)),
        text(" api_key: ", cut(1, 24)),
        text(" password: ", cut(1, 32), " (rotate soon)"),
        text(
            " glpat-short ghp_123 AKIA123 -----BEGIN CERTIFICATE-----x-----END CERTIFICATE-----"
            " bearer tokens postgres://db.internal:5432/app password aaaaaaaaaaaaaaaaaaaaaaaaaaaa"
        ),
        text(
            " ", THAI_LEAD, national_id(doc_id), THAI_TAIL, " ", THAI_NAME, " 081-234-5678 ",
            "Dr. Anna Lind at 2001:db8::1 and 10.0.0.7 ", THAI_ADDRESS, " ", cut(1, 8),
        ),
    )
    slot = doc_id % KINDS
    out = F.when(slot == 0, forms[0])
    for k, form in enumerate(forms[1:], start=1):
        out = out.when(slot == k, form)
    return out


def planted_parts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select(
        F.col("doc_id").alias("request_id"),
        F.lit(0).alias("message_index"),
        F.lit(0).alias("part_index"),
        F.lit("user").alias("role"),
        F.lit("text").alias("part_type"),
        F.concat("text", secret_suffix(F.col("doc_id"))).alias("text"),
    )
    return spread(rows, "request_id")


def _sql_id() -> str:
    body = "lpad(CAST(doc_id % 1000000000000 AS VARCHAR), 12, '7')"
    total = " + ".join(f"CAST(substr({body}, {i + 1}, 1) AS INTEGER) * {13 - i}" for i in range(12))
    return f"{body} || CAST((11 - ({total}) % 11) % 10 AS VARCHAR)"


PLANTED_SQL = f"""
SELECT doc_id AS request_id, text || CASE doc_id % {KINDS}
  WHEN 0 THEN ' use glpat-' || substr(h, 1, 20) || ' please'
  WHEN 1 THEN ' oauth ghp_' || substr(h, 1, 36)
  WHEN 2 THEN ' key AKIA' || upper(substr(h, 1, 16)) || ' end'
  WHEN 3 THEN ' key=sk-' || substr(h, 1, 32)
  WHEN 4 THEN ' key=sk-ant-' || substr(h, 1, 32)
  WHEN 5 THEN ' xoxb-' || substr(h, 1, 24)
  WHEN 6 THEN ' AIza' || substr(h, 1, 34)
  WHEN 7 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || substr(h, 1, 40) || chr(10)
    || substr(h, 41, 24) || chr(10) || '-----END RSA PRIVATE KEY-----'
  WHEN 8 THEN ' auth eyJ' || substr(h, 1, 20) || '.eyJ' || substr(h, 21, 20) || '.' || substr(h, 41, 24) || ' end'
  WHEN 9 THEN ' Authorization: BeArEr ' || substr(h, 1, 32)
  WHEN 10 THEN ' conn postgres://admin:' || substr(h, 1, 10) || '@db.internal:5432/app end'
  WHEN 11 THEN ' AWS_SECRET_ACCESS_KEY=' || substr(h, 1, 40)
  WHEN 12 THEN ' api_key: ' || substr(h, 1, 24)
  WHEN 13 THEN ' password: ' || substr(h, 1, 32) || ' (rotate soon)'
  WHEN 14 THEN ' glpat-short ghp_123 AKIA123 -----BEGIN CERTIFICATE-----x-----END CERTIFICATE-----'
    || ' bearer tokens postgres://db.internal:5432/app password aaaaaaaaaaaaaaaaaaaaaaaaaaaa'
  ELSE ' {THAI_LEAD}' || {_sql_id()} || '{THAI_TAIL} {THAI_NAME} 081-234-5678 '
    || 'Dr. Anna Lind at 2001:db8::1 and 10.0.0.7 {THAI_ADDRESS} ' || substr(h, 1, 8)
  END AS text
FROM (SELECT doc_id, text, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)"""


# ---- hidden secrets ------------------------------------------------------------------------

HIDDEN_KINDS = 8
ESCAPED = "%67%6C%70%61%74%2D"
PLAIN_WORDS = "only plain harmless words in here"


def hidden_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents ending in a token hidden by look-alikes, controls, width or an encoding."""
    h = hex_of(F.col("doc_id"))
    token = F.concat(F.lit("glpat-"), F.substring(h, 1, 24))
    slot = F.col("doc_id") % HIDDEN_KINDS
    escapes = F.array_join(
        F.transform(
            F.filter(F.split(token, ""), lambda c: c != ""),
            lambda c: F.concat(F.lit("\\u00"), F.translate(F.hex(F.ascii(c)), "ABCDEF", "abcdef")),
        ),
        "",
    )
    suffix = (
        F.when(slot == 0, F.concat(F.lit("ѕk-"), F.substring(h, 1, 32)))
        .when(slot == 1, F.concat(F.lit("glp​at-"), F.substring(h, 1, 24)))
        .when(slot == 2, F.concat(F.lit("ＡＫＩＡ"), F.translate(F.substring(h, 1, 16), "abcdef", "ABCDEF"), F.lit(" end")))
        .when(slot == 3, F.base64(F.encode(token, "utf-8")))
        .when(slot == 4, F.concat(F.lit(ESCAPED), F.substring(h, 1, 24)))
        .when(slot == 5, escapes)
        .when(slot == 6, F.translate(F.hex(F.encode(token, "utf-8")), "ABCDEF", "abcdef"))
        .otherwise(F.base64(F.encode(F.lit(PLAIN_WORDS), "utf-8")))
    )
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.lit(0).alias("message_index"),
        F.lit(0).alias("part_index"),
        F.lit("user").alias("role"),
        F.lit("text").alias("part_type"),
        F.concat("text", F.lit(" "), suffix).alias("text"),
    )
    return spread(rows, "request_id")


HIDDEN_SQL = f"""
SELECT doc_id AS request_id, text || ' ' || CASE doc_id % {HIDDEN_KINDS}
  WHEN 0 THEN chr(1109) || 'k-' || substr(h, 1, 32)
  WHEN 1 THEN 'glp' || chr(8203) || 'at-' || substr(h, 1, 24)
  WHEN 2 THEN chr(65313) || chr(65323) || chr(65321) || chr(65313) || upper(substr(h, 1, 16)) || ' end'
  WHEN 3 THEN to_base64(encode('glpat-' || substr(h, 1, 24)))
  WHEN 4 THEN '{ESCAPED}' || substr(h, 1, 24)
  WHEN 5 THEN list_aggregate(list_transform(string_split('glpat-' || substr(h, 1, 24), ''),
    lambda c: chr(92) || 'u00' || lower(hex(c))), 'string_agg', '')
  WHEN 6 THEN lower(hex('glpat-' || substr(h, 1, 24)))
  ELSE to_base64(encode('{PLAIN_WORDS}')) END AS text, length(text) AS base_chars
FROM (SELECT doc_id, text, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)"""
