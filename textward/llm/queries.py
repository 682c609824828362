"""The registered queries: each operator on its whole table, digested to the agreed columns."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bitslice,
    contamination,
    langid,
    packing,
    pagediff,
    periodic,
    repeats,
    secretscan,
    simhash,
    spelling,
    surrogates,
    toxicity,
    warc,
)
from .registry import ORACLES, QUERIES, query


#: The key of the surrogates; whoever holds it can match guessed values, so a deployment sets its own.
PSEUDONYM_KEY = os.environ.get("TEXTWARD_PSEUDONYM_KEY", "public test key").encode()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


WINNOWING_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS window
  FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM words WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS window
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE side = 'd')),
hits AS (
  SELECT doc_id, d.size, i, item_id FROM doc_windows d JOIN item_windows b ON d.size = b.size AND d.window = b.window),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words h ON h.doc_id = id LEFT JOIN hit_items t ON t.doc_id = id WHERE side = 'd'
"""


@query("op7_winnowing", WINNOWING_SQL)
def winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = contamination.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("found.items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        contamination.hit_words().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


@query("op2_simhash")
def near_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprints of every document and the components they form."""
    found = simhash.linked_fingerprints(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op1_packing")
def packing_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_toxicity")
def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(toxicity.labelled_documents(docs, table(spark, folder, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op5_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    found = secretscan.scan(table(spark, folder, "documents"))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secretscan.BASE))
    return found.select(
        "doc_id",
        *[number(kind) for kind in secretscan.BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query("op10_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    found = langid.identify(table(spark, folder, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


TOP_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


@query("op9_bitslice", TOP_SQL)
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    return bitslice.top_k(table(spark, folder, "embeddings"))


ARCHIVE_SQL = """
WITH digests AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM digests GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests JOIN firsts USING (html)
"""


@query("op4_archives", ARCHIVE_SQL)
def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to web archives and read back."""
    found = warc.round_trip(spark, table(spark, folder, "pages"))
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


@query("op8_pagediff")
def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    found = pagediff.extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op3_surrogates")
def pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    found = surrogates.pseudonymized(table(spark, folder, "documents"), PSEUDONYM_KEY)
    listed = F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["stop"]))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.concat_ws(",", listed).alias("entities"))


@query("op11_spelling")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with the form that its spelling suggests."""
    vocab = spelling.vocabulary(table(spark, folder, "documents"), marked=spelling.MARKED)
    return spelling.variants(vocab)


@query("op12_periodic")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them with one planted."""
    found = periodic.find(table(spark, folder, "documents").select("doc_id", "text"), plant="doc_id")
    runs = F.col("periodic.runs")
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = F.col("periodic.strongest")
    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("periodic.strongest.length * 1000 div periodic.strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_repeats")
def repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of earlier twenty-word windows."""
    found = repeats.find(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))
