"""Evaluation, calibration and drift queries bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import case_map
from ..operators import detectors as D
from ..operators import drift as R
from ..operators import evals as V
from ..session import cut_lineage
from ..sources.planted import KINDS, PLANTED_SQL, planted_parts
from ..sources.tables import table
from .decide import findings
from .detect import LANG_SQL, production_sql
from .registry import query

# What the planted suffix of each document must yield, by its kind.
EXPECTED = {
    0: "GITLAB_PAT",
    1: "GITHUB_TOKEN",
    2: "AWS_ACCESS_KEY",
    3: "OPENAI_API_KEY",
    4: "ANTHROPIC_API_KEY",
    5: "SLACK_TOKEN",
    6: "GOOGLE_API_KEY",
    7: "PEM_PRIVATE_KEY",
    8: "JWT",
    9: "BEARER_TOKEN",
    10: "CONNECTION_STRING",
    11: "AWS_SECRET_ACCESS_KEY",
    12: "GENERIC_API_KEY",
    13: "HIGH_ENTROPY_SECRET",
    15: "TH_CITIZEN_ID",
}
EXPECTED_SQL = "CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EXPECTED.items()) + " END"


@query(
    "detector_eval",
    f"""WITH {production_sql(PLANTED_SQL)}, got AS (SELECT DISTINCT request_id, subtype FROM findings),
want AS (SELECT doc_id AS request_id, {EXPECTED_SQL} AS subtype FROM documents WHERE doc_id % 16 <> 14),
j AS (SELECT coalesce(g.request_id, w.request_id) AS request_id, g.subtype AS g, w.subtype AS w
  FROM got g FULL JOIN want w ON g.request_id = w.request_id AND g.subtype = w.subtype)
SELECT (SELECT count(*) FROM documents) AS rows, count(*) FILTER (g = w) AS true_positives,
  count(*) FILTER (w IS NULL) AS false_positives, count(*) FILTER (g IS NULL) AS false_negatives,
  (SELECT count(*) FROM documents) - count(DISTINCT request_id) AS true_negatives FROM j""",
)
def detector_eval(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("request_id"))
    want = docs.withColumn("subtype", case_map(F.col("request_id") % KINDS, EXPECTED)).filter("subtype IS NOT NULL")
    got = D.scan(planted_parts(spark, folder), D.PRODUCTION)
    return V.detector_eval(docs, got, want)


# ---- model answers ------------------------------------------------------------------------------------


def answers(spark, folder, cut=0.5):
    """Rule scores against the labels: two questions per labelled document."""
    rows = table(spark, folder, "labels")
    score = (F.col("doc_id") % 100) / 100.0
    items = F.array(
        F.struct(F.lit("toxic").alias("question"), (F.col("toxic") == 1).alias("want")),
        F.struct(F.lit("quality").alias("question"), (F.col("quality") == 1).alias("want")),
    )
    out = rows.select("doc_id", score.alias("confidence"), F.explode(items).alias("i"))
    return out.select(
        "doc_id",
        "i.question",
        "i.want",
        "confidence",
        (F.col("confidence") >= cut).alias("got"),
        (F.col("doc_id") % 37 == 0).alias("failed"),
        (F.col("doc_id") % 50).alias("latency_ms"),
    )


def answers_sql(name="answers", cut=0.5):
    return f"""{name} AS (SELECT doc_id, question, want, (doc_id % 100) / 100.0 AS confidence,
    (doc_id % 100) / 100.0 >= {cut} AS got, doc_id % 37 = 0 AS failed, doc_id % 50 AS latency_ms
  FROM (SELECT doc_id, 'toxic' AS question, toxic = 1 AS want FROM labels
    UNION ALL SELECT doc_id, 'quality', quality = 1 FROM labels))"""


def metrics_sql(name="metrics", source="answers", keys="question"):
    return f"""{name}_c AS (SELECT {keys}, count(*) AS rows, count(*) FILTER (want AND got AND NOT failed) AS tp,
    count(*) FILTER (NOT want AND got AND NOT failed) AS fp, count(*) FILTER (want AND (NOT got OR failed)) AS fn,
    count(*) FILTER (NOT want AND (NOT got OR failed)) AS tn,
    coalesce(avg(latency_ms) FILTER (NOT failed), 0.0) AS avg_latency_ms FROM {source} GROUP BY {keys}),
{name}_r AS (SELECT *, coalesce((tp + tn) / nullif(rows, 0), 0.0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0.0) AS fpr,
    coalesce(fn / nullif(fn + tp, 0), 0.0) AS fnr FROM {name}_c),
{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM {name}_r)"""


RATES = ("accuracy", "precision", "recall", "fpr", "fnr", "f1", "avg_latency_ms")


@query(
    "semantic_eval",
    f"""WITH {answers_sql()}, {metrics_sql()} SELECT question, rows, tp, fp, fn, tn,
  {', '.join(f'round({m}, 6) AS {m}' for m in RATES)} FROM metrics""",
)
def semantic_eval(spark, folder):
    out = V.semantic_metrics(answers(spark, folder), "question")
    return out.select("question", "rows", "tp", "fp", "fn", "tn", *[F.round(m, 6).alias(m) for m in RATES])


FIT_SQL = """fit AS (SELECT {keys}, min(t) FILTER (fpr <= {target}) AS threshold FROM (
    SELECT {keys}, t.confidence AS t, CASE WHEN (SELECT count(*) FROM {src} n WHERE {same} AND NOT n.want) = 0 THEN 0
      ELSE (SELECT count(*) FROM {src} n WHERE {same} AND NOT n.want AND n.confidence >= t.confidence)
        / (SELECT count(*) FROM {src} n WHERE {same} AND NOT n.want) END AS fpr
    FROM (SELECT DISTINCT {keys}, confidence FROM {src}) t) GROUP BY {keys})"""


@query(
    "fit_threshold",
    f"""WITH {answers_sql()}, {FIT_SQL.format(keys='question', src='answers', same='n.question = t.question', target=0.2)}
SELECT f.question, coalesce(threshold, 0.0) AS threshold, threshold IS NOT NULL AS evaluated, count(*) AS samples,
  count(*) FILTER (want) AS positives, count(*) FILTER (NOT want) AS negatives
FROM fit f JOIN answers a ON a.question = f.question GROUP BY f.question, threshold""",
)
def fit_threshold(spark, folder):
    rows = answers(spark, folder).withColumnRenamed("want", "positive")
    return V.fit_threshold(rows, ["question"], 0.2)


SLICED_SQL = f"""sliced AS (SELECT a.*, d.lang AS language FROM answers a JOIN documents d ON d.doc_id = a.doc_id)"""


def sliced(spark, folder):
    langs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("language"))
    return answers(spark, folder).join(langs, "doc_id")


SAME = "n.question = t.question AND n.language = t.language"
CALIBRATED_SQL = f"""{answers_sql()}, {SLICED_SQL},
{FIT_SQL.format(keys='question, language', src='sliced', same=SAME, target=0.1)}"""


@query(
    "calibrate_slices",
    f"""WITH {CALIBRATED_SQL}
SELECT f.question, f.language, coalesce(threshold, 0.0) AS threshold, threshold IS NOT NULL AS evaluated,
  count(*) AS samples, count(*) FILTER (want) AS positives, count(*) FILTER (NOT want) AS negatives
FROM fit f JOIN sliced a ON a.question = f.question AND a.language = f.language GROUP BY f.question, f.language, threshold""",
)
def calibrate_slices(spark, folder):
    rows = sliced(spark, folder).withColumnRenamed("want", "positive")
    return V.fit_threshold(rows, ["question", "language"], 0.1)


LIMITS = {"max_fpr": 0.5, "max_fnr": 0.5, "min_precision": 0.2, "min_recall": 0.5, "min_samples": 50}


@query(
    "promotion_check",
    f"""WITH {CALIBRATED_SQL}, {metrics_sql('m', 'sliced', 'question, language')},
g AS (SELECT * FROM (SELECT unnest(['toxic', 'quality', 'risky']) AS question) CROSS JOIN (SELECT unnest(['en', 'fr', 'de', 'th']) AS language)),
j AS (SELECT g.question, g.language, m.rows, m.fpr, m.fnr, m.precision, m.recall, f.threshold,
  m.question IS NOT NULL AS present FROM g LEFT JOIN m ON m.question = g.question AND m.language = g.language
  LEFT JOIN fit f ON f.question = g.question AND f.language = g.language)
SELECT question, language, unnest(list_filter([CASE WHEN NOT present THEN 'missing_slice' END,
  CASE WHEN present AND threshold IS NULL THEN 'not_evaluated' END, CASE WHEN present AND fpr > 0.5 THEN 'max_fpr' END,
  CASE WHEN present AND fnr > 0.5 THEN 'max_fnr' END, CASE WHEN present AND precision < 0.2 THEN 'min_precision' END,
  CASE WHEN present AND recall < 0.5 THEN 'min_recall' END, CASE WHEN present AND rows < 50 THEN 'min_samples' END],
  lambda x: x IS NOT NULL)) AS violation FROM j""",
)
def promotion_check(spark, folder):
    rows = sliced(spark, folder)
    metrics = V.semantic_metrics(rows, "question", "language")
    fitted = V.fit_threshold(rows.withColumnRenamed("want", "positive"), ["question", "language"], 0.1)
    slices = metrics.join(fitted.select("question", "language", "evaluated", "samples"), ["question", "language"])
    return V.promotion_check(slices, ["toxic", "quality", "risky"], ["en", "fr", "de", "th"], LIMITS)


@query(
    "baseline_regressions",
    f"""WITH {answers_sql('before', 0.5)}, {answers_sql('after', 0.3)}, {metrics_sql('old', 'before')}, {metrics_sql('new', 'after')},
v AS (SELECT n.question, unnest([
  CASE WHEN n.rows < o.rows THEN {{'m': 'rows', 'a': CAST(o.rows AS DOUBLE), 'b': CAST(n.rows AS DOUBLE)}} END,
  CASE WHEN n.fp > o.fp + 0.02 * n.rows THEN {{'m': 'fp', 'a': CAST(o.fp AS DOUBLE), 'b': CAST(n.fp AS DOUBLE)}} END,
  CASE WHEN n.fn > o.fn + 0.02 * n.rows THEN {{'m': 'fn', 'a': CAST(o.fn AS DOUBLE), 'b': CAST(n.fn AS DOUBLE)}} END,
  CASE WHEN n.fpr > o.fpr + 0.02 THEN {{'m': 'fpr', 'a': o.fpr, 'b': n.fpr}} END,
  CASE WHEN n.fnr > o.fnr + 0.02 THEN {{'m': 'fnr', 'a': o.fnr, 'b': n.fnr}} END]) AS v
  FROM new n JOIN old o ON o.question = n.question)
SELECT question, v.m AS metric, round(v.a, 6) AS old_value, round(v.b, 6) AS new_value FROM v WHERE v IS NOT NULL""",
)
def baseline_regressions(spark, folder):
    old = V.semantic_metrics(answers(spark, folder, 0.5), "question")
    new = V.semantic_metrics(answers(spark, folder, 0.3), "question")
    out = V.baseline_regressions(old, new, 0.02)
    return out.select(
        "question", "metric", F.round("old_value", 6).alias("old_value"), F.round("new_value", 6).alias("new_value")
    )


# ---- spans ---------------------------------------------------------------------------------------------


def gold_spans(spark, folder):
    parts = planted_parts(spark, folder)
    tagged = parts.select("request_id", "text", D.language_of(F.col("text")).alias("language"))
    rows = D.with_findings(tagged, [D.ID_CARD, D.MAIL, D.IP4])
    return rows.select(
        "request_id",
        "language",
        F.col("f.subtype").alias("entity"),
        F.col("f.start").alias("start"),
        F.col("f.end").alias("end"),
    )


def perturbed(gold):
    """A recognizer that shifts every third span, drops every fifth and keeps the rest."""
    start = F.col("start")
    return gold.filter(start % 5 != 0).withColumn("start", F.when(start % 3 == 0, start + 2).otherwise(start))


GOLD_SQL = f"""gold AS (SELECT f.request_id, {LANG_SQL} AS language, subtype AS entity, "start", "end", t.text
  FROM findings f JOIN texts t USING (request_id) WHERE subtype IN ('TH_CITIZEN_ID', 'EMAIL') OR detector_order = 180),
pred AS (SELECT request_id, language, entity, CASE WHEN "start" % 3 = 0 THEN "start" + 2 ELSE "start" END AS "start", "end"
  FROM gold WHERE "start" % 5 <> 0),
g AS (SELECT language, entity, count(*) AS gold FROM gold GROUP BY 1, 2),
p AS (SELECT language, entity, count(*) AS predicted FROM pred GROUP BY 1, 2),
e AS (SELECT g.language, g.entity, count(*) FILTER (g."start" = p."start" AND g."end" = p."end") AS exact_tp, count(*) AS overlap_tp
  FROM gold g JOIN pred p ON g.request_id = p.request_id AND g.entity = p.entity
    AND p."start" < g."end" AND g."start" < p."end" GROUP BY 1, 2),
s AS (SELECT language, entity, gold, coalesce(predicted, 0) AS predicted, coalesce(exact_tp, 0) AS exact_tp,
  coalesce(overlap_tp, 0) AS overlap_tp FROM g LEFT JOIN p USING (language, entity) LEFT JOIN e USING (language, entity))"""


@query(
    "span_eval",
    f"""WITH {production_sql(PLANTED_SQL)}, {GOLD_SQL}
SELECT language, entity, gold, predicted, exact_tp, overlap_tp,
  round(coalesce(exact_tp / nullif(predicted, 0), 0), 6) AS exact_precision, round(coalesce(exact_tp / gold, 0), 6) AS exact_recall,
  round((gold - exact_tp) / gold, 6) AS exact_fnr, round(coalesce(overlap_tp / nullif(predicted, 0), 0), 6) AS overlap_precision,
  round(overlap_tp / gold, 6) AS overlap_recall, round((gold - overlap_tp) / gold, 6) AS overlap_fnr FROM s""",
)
def span_eval(spark, folder):
    gold = cut_lineage(gold_spans(spark, folder))
    out = V.span_eval(gold, perturbed(gold))
    rates = [c for c in out.columns if c.split("_")[-1] in ("precision", "recall", "fnr")]
    return out.select(
        "language", "entity", "gold", "predicted", "exact_tp", "overlap_tp", *[F.round(c, 6).alias(c) for c in rates]
    )


@query(
    "confidence_candidates",
    f"""WITH {production_sql(PLANTED_SQL)} SELECT DISTINCT CASE WHEN confidence < 0.5 THEN 0.25
  WHEN confidence < 0.75 THEN 0.5 WHEN confidence < 0.9 THEN 0.75 ELSE 0.9 END AS confidence FROM findings""",
)
def confidence_candidates(spark, folder):
    return V.confidence_candidates(findings(spark, folder))


DIGEST_COLUMNS = ("doc_id", "lang", "text")


def _spelled_sql(text: str = "text") -> str:
    return " || chr(0) || ".join(f"coalesce('=' || {c}, '-')" for c in ("doc_id", "lang", text))


TREE_SQL = f"""l AS (SELECT sha256({_spelled_sql()}) AS d, count(*) AS n FROM documents GROUP BY 1),
t2 AS (SELECT left(d, 2) AS name, sha256(string_agg(d || ':' || d || ':' || n, ',' ORDER BY d)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1),
t1 AS (SELECT left(name, 1) AS name, sha256(string_agg(name || ':' || digest || ':' || n, ',' ORDER BY name)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM t2 GROUP BY 1),
t0 AS (SELECT sha256(string_agg(name || ':' || digest || ':' || n, ',' ORDER BY name)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM t1)"""


@query("dataset_digest", f"WITH {TREE_SQL} SELECT rows, digest FROM t0")
def dataset_digest(spark, folder):
    return V.dataset_digest(table(spark, folder, "documents"), *DIGEST_COLUMNS, depth=2)


@query(
    "dataset_proofs",
    f"""WITH {TREE_SQL}, w AS (SELECT doc_id, {_spelled_sql()} AS whole, {_spelled_sql("(text || ' x')")} AS changed FROM documents)
SELECT doc_id, sha256(whole) AS row_digest, sha256(whole) IN (SELECT d FROM l) AS included, sha256(changed) IN (SELECT d FROM l) AS changed_included FROM w""",
)
def dataset_proofs(spark, folder):
    """Every document proved to be in the dataset, and not so with a word more. Ranges stay of one size, whatever the rows."""
    docs = table(spark, folder, "documents").select(*DIGEST_COLUMNS)
    tree = V.digest_tree(docs, DIGEST_COLUMNS, V.tree_depth(docs.count()))
    root = tree.where("level = 0").select("digest").first().digest
    changed = docs.withColumn("text", F.concat("text", F.lit(" x")))

    def proved(rows, name):
        shown = V.inclusion_proofs(rows, tree, DIGEST_COLUMNS, ["doc_id"])
        held = V.proof_holds(F.col("row_digest"), F.col("proof"), F.lit(root))
        return shown.select("doc_id", "row_digest", held.alias(name))

    other = proved(changed, "changed_included").drop("row_digest")
    return proved(docs, "included").join(other, "doc_id")


@query(
    "latency_sketch",
    """SELECT event_type, count(value) AS samples, min(value) AS min, max(value) AS max, q, true AS within FROM events, (VALUES (50), (95), (99)) v(q) GROUP BY 1, 5""",
)
def latency_sketch(spark, folder):
    """Sketched quantiles, each held against the ranks of its value in all events."""
    events = table(spark, folder, "events").select("event_type", "value")
    made = cut_lineage(V.sketch_quantiles(events, ["event_type"], "value", [0.5, 0.95, 0.99]))
    picks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"p{q}").alias("picked")) for q in (50, 95, 99)]))
    picked = made.select("event_type", "samples", "min", "max", picks.alias("p")).select("event_type", "samples", "min", "max", "p.*")
    ranks = events.join(picked, "event_type").groupBy("event_type", "samples", "min", "max", "q").agg(
        F.count_if(F.col("value") <= F.col("picked")).alias("upto"), F.count_if(F.col("value") < F.col("picked")).alias("below")
    )
    bound = F.col("samples") * V.sketch_error()
    wanted = F.col("samples") * F.col("q") / 100
    # The pick's own rank is any place of its equal values.
    near = (F.col("below") <= wanted + bound + 1) & (F.col("upto") >= wanted - bound - 1)
    return ranks.select("event_type", "samples", "min", "max", "q", near.alias("within"))


@query(
    "latency_quantiles",
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n AS samples, min(value) AS min, max(value) AS max, max(value) FILTER (i = floor((n - 1) * 0.5)) AS p50,
  max(value) FILTER (i = floor((n - 1) * 0.95)) AS p95, max(value) FILTER (i = floor((n - 1) * 0.99)) AS p99,
  round(count(*) FILTER (value > 100) / n, 6) AS error_rate,
  '200:' || count(*) FILTER (value <= 50) || ',429:' || count(*) FILTER (value > 50 AND value <= 100) || ',503:' || count(*) FILTER (value > 100) AS statuses
FROM o GROUP BY event_type, n""",
)
def latency_quantiles(spark, folder):
    events = table(spark, folder, "events").select("event_type", "value")
    quantiles = V.index_quantiles(events, ["event_type"], "value", [0.5, 0.95, 0.99])
    slow = events.groupBy("event_type").agg(
        F.round(F.count_if(F.col("value") > 100) / F.count(F.lit(1)), 6).alias("error_rate")
    )
    value = F.col("value")
    status = F.when(value > 100, 503).when(value > 50, 429).otherwise(200)
    # Every status is listed, also one that did not occur.
    none = events.select("event_type").distinct().select("event_type", F.explode(F.array(F.lit(200), F.lit(429), F.lit(503))).alias("status"))
    seen = V.status_counts(events, ["event_type"], status).select("event_type", F.explode("statuses").alias("s")).select("event_type", "s.*")
    listed = none.join(seen, ["event_type", "status"], "left").groupBy("event_type").agg(
        F.array_sort(F.collect_list(F.struct("status", F.coalesce("count", F.lit(0)).alias("count")))).alias("s")
    )
    shown = F.concat_ws(",", F.transform("s", lambda x: F.concat_ws(":", x["status"], x["count"]))).alias("statuses")
    return quantiles.join(slow, "event_type").join(listed.select("event_type", shown), "event_type")


# ---- drift ----------------------------------------------------------------------------------------------

SPLIT = "2024-01-16 00:00:00"


def drift_samples(spark, folder):
    """Two features per event: its type, and its property in steps of four."""
    k = F.get_json_object("props", "$.k").cast("int")
    items = F.array(
        F.struct(F.lit("event_type").alias("feature"), F.col("event_type").alias("label")),
        F.struct(F.lit("k").alias("feature"), F.concat(F.lit("k"), F.floor(k / 4).cast("string")).alias("label")),
    )
    rows = table(spark, folder, "events").select("event_id", "ts", "user_id", F.explode(items).alias("i"))
    return rows.select("event_id", "ts", "user_id", "i.*")


SAMPLES_SQL = """samples AS (SELECT event_id, ts, user_id, 'event_type' AS feature, event_type AS label FROM events
  UNION ALL SELECT event_id, ts, user_id, 'k', 'k' || (CAST(json_extract(props, '$.k') AS INTEGER) // 4) FROM events)"""


@query(
    "drift_buckets",
    """WITH s AS (SELECT date_trunc('day', ts) AS day, CASE WHEN user_id % 10 = 3 THEN 'other'
      WHEN user_id % 41 = 7 THEN 'not valid' ELSE 'u' || user_id END AS label, ts, event_id FROM events),
v AS (SELECT day, CASE WHEN regexp_full_match(label, '[A-Za-z0-9_.-]{1,32}') THEN label END AS label, count(*) AS n, min(ts) AS seen FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day, label IS NULL ORDER BY seen) AS rank FROM v)
SELECT day, 'user' AS feature, CASE WHEN label IS NULL THEN 'invalid' WHEN rank <= 32 THEN label ELSE 'other' END AS label,
  CAST(sum(n) AS BIGINT) AS count FROM r GROUP BY ALL""",
)
def drift_buckets(spark, folder):
    user = F.col("user_id")
    label = (
        F.when(user % 10 == 3, "other")
        .when(user % 41 == 7, "not valid")
        .otherwise(F.concat(F.lit("u"), user.cast("string")))
    )
    rows = table(spark, folder, "events").select(
        F.date_trunc("day", "ts").alias("day"), F.lit("user").alias("feature"), label.alias("label"), "ts", "event_id"
    )
    return R.drift_buckets(rows, ["day", "feature"], ["ts", "event_id"])


def metrics_cte(source: str, keys: str) -> str:
    names = keys.split(", ")
    on = " AND ".join(f"l.{k} = t.{k}" for k in names)
    return f"""l AS (SELECT {keys}, label, count(*) FILTER (cur) AS a, count(*) FILTER (base) AS b FROM {source} GROUP BY {keys}, label
  HAVING count(*) FILTER (cur) + count(*) FILTER (base) > 0),
t AS (SELECT {keys}, sum(a) AS ta, sum(b) AS tb FROM l GROUP BY {keys}),
x AS (SELECT l.*, CASE WHEN ta > 0 THEN a / ta ELSE 0 END AS x, CASE WHEN tb > 0 THEN b / tb ELSE 0 END AS y
  FROM l JOIN t ON {on}),
c AS (SELECT *, abs(sum(x) OVER (PARTITION BY {keys} ORDER BY label) - sum(y) OVER (PARTITION BY {keys} ORDER BY label)) AS gap FROM x),
drift AS (SELECT {keys}, CAST(sum(a) AS BIGINT) AS samples, CAST(sum(b) AS BIGINT) AS baseline_samples,
  sum((greatest(x, 1e-9) - greatest(y, 1e-9)) * ln(greatest(x, 1e-9) / greatest(y, 1e-9))) AS psi,
  sum(CASE WHEN x > 0 THEN x * ln(x / ((x + y) / 2)) / 2 ELSE 0 END + CASE WHEN y > 0 THEN y * ln(y / ((x + y) / 2)) / 2 ELSE 0 END) AS js,
  max(gap) AS ks FROM c GROUP BY {keys})"""


HALVES_SQL = f"""{SAMPLES_SQL}, h AS (SELECT *, ts >= TIMESTAMP '{SPLIT}' AS cur, ts < TIMESTAMP '{SPLIT}' AS base FROM samples),
{metrics_cte('h', 'feature')}"""


def _halves(spark, folder):
    now = F.col("ts") >= F.lit(SPLIT).cast("timestamp")
    return R.compare(drift_samples(spark, folder), ["feature"], now, ~now)


@query(
    "drift_psi",
    f"WITH {HALVES_SQL} SELECT feature, samples, baseline_samples, round(psi, 6) AS psi FROM drift",
)
def drift_psi(spark, folder):
    return _halves(spark, folder).select("feature", "samples", "baseline_samples", F.round("psi", 6).alias("psi"))


@query("drift_js_ks", f"WITH {HALVES_SQL} SELECT feature, round(js, 6) AS js, round(ks, 6) AS ks FROM drift")
def drift_js_ks(spark, folder):
    return _halves(spark, folder).select("feature", F.round("js", 6).alias("js"), F.round("ks", 6).alias("ks"))


OUTCOME_SQL = f"""h AS (SELECT 'outcome' AS feature, o_orderstatus AS label, o_orderdate >= TIMESTAMP '1997-01-01' AS cur,
  o_orderdate < TIMESTAMP '1997-01-01' AS base FROM orders), {metrics_cte('h', 'feature')}"""


@query(
    "drift_outcome",
    f"""WITH {OUTCOME_SQL} SELECT feature, samples, baseline_samples, round(psi, 6) AS psi, round(js, 6) AS js,
  round(ks, 6) AS ks FROM drift WHERE samples >= 100""",
)
def drift_outcome(spark, folder):
    """Order status as outcome label, once enough labelled samples exist."""
    rows = table(spark, folder, "orders").select(
        F.lit("outcome").alias("feature"), F.col("o_orderstatus").alias("label"), "o_orderdate"
    )
    now = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")
    out = R.compare(rows, ["feature"], now, ~now).filter("samples >= 100")
    return out.select(
        "feature", "samples", "baseline_samples", *[F.round(c, 6).alias(c) for c in ("psi", "js", "ks")]
    )


@query(
    "wilson_bounds",
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
p AS (SELECT user_id, n, 1 + 1.96 * 1.96 / n AS den, 0.5 + 1.96 * 1.96 / (2 * n) AS c,
  1.96 * sqrt(0.25 / n + 1.96 * 1.96 / (4.0 * n * n)) AS h FROM n)
SELECT user_id, n, round(greatest(0, c / den - h / den), 6) AS lower, round(least(1, c / den + h / den), 6) AS upper FROM p""",
)
def wilson_bounds(spark, folder):
    counts = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    low, high = R.wilson(F.col("n"))
    return counts.select("user_id", "n", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


DRIFT_POLICY = {
    "min_samples": 300,
    "psi_action": 0.012,
    "js_warning": 0.01,
    "ks_warning": 0.05,
    "sustained_windows": 2,
    "cooldown_seconds": 2 * 86400,
    "auto_rollback": False,
    "healthy_target": True,
}
STATUS_SQL = f"""base AS (SELECT event_type AS label, count(*) AS b FROM events WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1),
days AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events WHERE ts >= TIMESTAMP '{SPLIT}'),
cur AS (SELECT date_trunc('day', ts) AS day, event_type AS label, count(*) AS a FROM events WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY 1, 2),
h AS (SELECT d.day, b.label, coalesce(a, 0) AS a, b FROM days d CROSS JOIN base b LEFT JOIN cur c ON c.day = d.day AND c.label = b.label),
x AS (SELECT *, a / sum(a) OVER (PARTITION BY day) AS x, b / sum(b) OVER (PARTITION BY day) AS y FROM h),
k AS (SELECT *, abs(sum(x) OVER w - sum(y) OVER w) AS gap FROM x WINDOW w AS (PARTITION BY day ORDER BY label)),
m AS (SELECT day, CAST(sum(a) AS BIGINT) AS samples,
  sum((greatest(x, 1e-9) - greatest(y, 1e-9)) * ln(greatest(x, 1e-9) / greatest(y, 1e-9))) AS psi,
  sum(CASE WHEN x > 0 THEN x * ln(x / ((x + y) / 2)) / 2 ELSE 0 END + y * ln(y / ((x + y) / 2)) / 2) AS js, max(gap) AS ks FROM k GROUP BY 1),
w AS (SELECT day, samples, psi >= 0.012 OR js >= 0.01 OR ks >= 0.05 AS breach, row_number() OVER (ORDER BY day) AS n FROM m),
walk(n, day, sustained, acted, action) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), 0, CAST(NULL AS TIMESTAMP), '' UNION ALL
  SELECT w.n, w.day, s.v, CASE WHEN w.samples >= 300 AND s.v >= 2 AND (p.acted IS NULL OR w.day - p.acted >= INTERVAL 2 DAY) THEN w.day ELSE p.acted END,
    CASE WHEN w.samples < 300 THEN 'none' WHEN s.v < 2 THEN 'warning'
      WHEN p.acted IS NULL OR w.day - p.acted >= INTERVAL 2 DAY THEN 'pause_canary' ELSE 'freeze_promotion' END
  FROM walk p JOIN w ON w.n = p.n + 1,
  LATERAL (SELECT CASE WHEN w.samples < 300 THEN p.sustained WHEN w.breach THEN p.sustained + 1 ELSE greatest(p.sustained - 1, 0) END AS v) s)"""


@query(
    "drift_status",
    f"WITH RECURSIVE {STATUS_SQL} SELECT 'event_type' AS feature, day, sustained, action FROM walk WHERE n > 0",
)
def drift_status(spark, folder):
    windows = status_windows(spark, folder, F.col("user_id") % 3)
    return R.drift_status(windows, ["feature"], DRIFT_POLICY).withColumnRenamed("at", "day")


def status_windows(spark, folder, scope):
    """Each day after the split against the days before it, and how many scopes it was seen in."""
    events = table(spark, folder, "events").select("ts", scope.alias("scope"), F.col("event_type").alias("label"))
    split = F.lit(SPLIT).cast("timestamp")
    base = events.filter(F.col("ts") < split).groupBy("label").agg(F.count("*").alias("b"))
    day = F.date_trunc("day", "ts").alias("at")
    later = events.filter(F.col("ts") >= split)
    current = later.groupBy(day, "label").agg(F.count("*").alias("a"))
    days = later.select(day, "scope").groupBy("at").agg(
        F.count_distinct("scope").alias("scopes")
    )
    # Baseline labels are few; each carries over to every day up to the last one seen.
    last = later.agg(F.coalesce(F.max(F.date_trunc("day", "ts")), split)).scalar()
    span = F.sequence(split, last, F.expr("INTERVAL 1 DAY"))
    grid = base.select("label", "b", F.explode(span).alias("at"))
    counts = grid.join(current, ["at", "label"], "full").select(
        "at", "label", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")
    )
    metrics = R.divergence(counts, ["at"]).join(days, "at")
    return metrics.select(
        F.lit("event_type").alias("feature"), "at", "samples", R.breached(DRIFT_POLICY).alias("breach"), "scopes"
    )


ROLLBACK = DRIFT_POLICY | {"auto_rollback": True}
QUARANTINE = ROLLBACK | {"allow_quarantine": True}
ROLLBACK_SQL = STATUS_SQL.replace(
    "row_number() OVER (ORDER BY day) AS n FROM m)",
    "row_number() OVER (ORDER BY day) AS n, scopes FROM m JOIN sc USING (day))",
).replace("THEN 'pause_canary' ELSE", "THEN CASE WHEN w.scopes >= 2 THEN 'rollback_champion' ELSE 'pause_canary' END ELSE").replace(
    "days AS (", f"""sc AS (SELECT date_trunc('day', ts) AS day, count(DISTINCT CASE WHEN day(ts) % 2 = 0 THEN user_id % 3 ELSE 0 END) AS scopes
  FROM events WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY 1),
days AS (""", 1
)


@query(
    "drift_rollback",
    f"""WITH RECURSIVE {ROLLBACK_SQL}
SELECT kind, day, sustained, CASE WHEN kind = 'quarantine' AND action = 'rollback_champion' THEN 'incident_quarantine' ELSE action END AS action
FROM walk, (VALUES ('rollback'), ('quarantine')) v(kind) WHERE n > 0""",
)
def drift_rollback(spark, folder):
    """Policies that roll back or quarantine on their own once two scopes drift; every other day shows one scope."""
    scope = F.when(F.dayofmonth("ts") % 2 == 0, F.col("user_id") % 3).otherwise(F.lit(0))
    windows = cut_lineage(status_windows(spark, folder, scope))

    def acted(kind, policy):
        rows = R.drift_status(windows, ["feature"], policy)
        return rows.select(F.lit(kind).alias("kind"), F.col("at").alias("day"), "sustained", "action")

    return acted("rollback", ROLLBACK).unionByName(acted("quarantine", QUARANTINE))
