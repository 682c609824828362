"""Redaction and tokenization: span plans, ordinals and rewritten texts.

A part's findings live in one array beside its text, so planning and redaction are a
projection with no shuffle. Only request-wide ordinals shuffle, and only the findings do.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import value_hash
from ..functions.ranking import blocked_row_number
from ..functions.scan import Detector, computed_once, explode_rows, finding_array
from ..session import cut_lineage
from .detectors import PART_KEYS, TELEMETRY_KEY

SPAN = (
    "struct<start:int,neg_end:int,neg_priority:int,detector_order:int,end:int,priority:int,"
    "char_start:int,char_end:int,subtype:string,value_hash:string>"
)

# Priorities: secrets 3, validated personal data 2, entity spans 1, others 0.
SORTED = """
array_sort(transform(filter({f}, x -> x.`end` > x.start), x -> CAST(named_struct(
  'start', x.start, 'neg_end', -x.`end`,
  'neg_priority', -(CASE WHEN x.category = 'SECRET' THEN 3
                         WHEN x.category = 'PII' AND x.detector = 'pattern' THEN 2
                         WHEN x.category = 'PII' THEN 1 ELSE 0 END),
  'detector_order', x.detector_order, 'end', x.`end`,
  'priority', CASE WHEN x.category = 'SECRET' THEN 3
                   WHEN x.category = 'PII' AND x.detector = 'pattern' THEN 2
                   WHEN x.category = 'PII' THEN 1 ELSE 0 END,
  'char_start', x.char_start, 'char_end', x.char_end, 'subtype', x.subtype,
  'value_hash', x.value_hash) AS {span})))"""

# In start order an accepted span that ends before the candidate can never meet a later one,
# so only the newest accepted span stays open. A candidate replaces it when it outranks it.
GREEDY = """
aggregate({spans},
  named_struct('done', CAST(array() AS array<{span}>), 'open', CAST(NULL AS {span})),
  (acc, c) -> CASE
    WHEN acc.open IS NULL THEN named_struct('done', acc.done, 'open', c)
    WHEN acc.open.`end` <= c.start
      THEN named_struct('done', concat(acc.done, array(acc.open)), 'open', c)
    WHEN c.priority > acc.open.priority THEN named_struct('done', acc.done, 'open', c)
    ELSE acc END,
  acc -> CASE WHEN acc.open IS NULL THEN acc.done ELSE concat(acc.done, array(acc.open)) END)"""


def span_plan(findings: str) -> Column:
    """Non-overlapping spans of one part from its finding array, in text order."""
    spans = SORTED.format(f=findings, span=SPAN)
    return F.expr(GREEDY.format(spans=spans, span=SPAN))


def rewrite(text: str, plan: str, replacement: str) -> Column:
    """Text with every planned span `t` replaced by the SQL expression `replacement`."""
    return F.expr(
        f"""CASE WHEN size({plan}) = 0 THEN {text} ELSE
        aggregate({plan}, named_struct('pos', 0, 'out', CAST(array() AS array<string>)),
          (acc, t) -> named_struct('pos', t.char_end, 'out', concat(acc.out, array(
            substr({text}, acc.pos + 1, t.char_start - acc.pos), {replacement}))),
          acc -> concat(array_join(acc.out, ''), substr({text}, acc.pos + 1))) END"""
    )


REDACTED = "concat('[REDACTED:', t.subtype, ']')"
TOKEN = "concat('<', t.subtype, '_', lpad(CAST(t.ordinal AS string), greatest(3, length(CAST(t.ordinal AS string))), '0'), '>')"


def plan_parts(
    parts: DataFrame, detectors: Iterable[Detector], key: str = TELEMETRY_KEY
) -> DataFrame:
    """Parts with their `plan` array; one pass over the text, no shuffle."""
    found = finding_array(parts, detectors, "found")
    hashed = F.transform("found", lambda f: f.withField("value_hash", value_hash(key, f["value"])))
    rows = found.withColumn("hashed", hashed).withColumn("plan", span_plan("hashed"))
    return rows.drop("found", "hashed")


def plan_rows(
    planned: DataFrame, keys: Iterable[str] = PART_KEYS, with_value: bool = False
) -> DataFrame:
    """One row per planned span; the raw value only on request, for the vault."""
    value = "substr(text, t.char_start + 1, t.char_end - t.char_start)" if with_value else "''"
    items = F.expr(
        "transform(plan, t -> named_struct('start', t.start, 'end', t.`end`, 'char_start', "
        "t.char_start, 'char_end', t.char_end, 'subtype', t.subtype, 'priority', t.priority, "
        f"'value_hash', t.value_hash, 'value', {value}))"
    )
    rows = explode_rows(planned, keys, items, "p").select(*keys, "p.*")
    return rows if with_value else rows.drop("value")


def redact_parts(planned: DataFrame) -> DataFrame:
    return planned.withColumn("redacted", rewrite("text", "plan", REDACTED))


MESSAGES_PER_BLOCK = 64


def token_ordinals(rows: DataFrame, request: str = "request_id") -> DataFrame:
    """Ordinal per (request, subtype) by first appearance; equal hashes share one.

    Without a hash every occurrence counts. `rows` is read twice, so pass a written table.
    """
    at = F.concat_ws(":", "message_index", "part_index", "start")
    keyed = rows.withColumn(
        "identity", F.when(F.col("value_hash") != "", F.col("value_hash")).otherwise(at)
    )
    keys = [request, "subtype", "identity"]
    first = keyed.groupBy(*keys).agg(
        F.min(F.struct("message_index", "part_index", "start")).alias("first")
    )
    block = F.floor(F.col("first.message_index") / MESSAGES_PER_BLOCK)
    ranked = blocked_row_number(first, [request, "subtype"], block, ["first"], "ordinal")
    return keyed.join(ranked.drop("first"), keys).drop("identity")


def tokenize_parts(
    parts: DataFrame,
    detectors: Iterable[Detector],
    request: str = "request_id",
    with_value: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rewritten parts that hold findings, and the plan rows with ordinals and tokens.

    Parts without findings stay as they are and never shuffle.
    """
    planned = computed_once(plan_parts(parts, detectors), [*PART_KEYS, "text"], plan=F.col("plan"))
    hits = cut_lineage(planned.filter(F.size("plan") > 0))
    rows = token_ordinals(plan_rows(hits, with_value=with_value), request)
    tokens = rows.withColumn(
        "token",
        F.concat("subtype", F.lit("_"), F.format_string("%03d", "ordinal")),
    )
    per_part = tokens.groupBy(*PART_KEYS).agg(
        F.array_sort(
            F.collect_list(
                F.struct("char_start", "char_end", "subtype", F.col("ordinal").alias("ordinal"))
            )
        ).alias("numbered")
    )
    out = hits.drop("plan").join(per_part, list(PART_KEYS))
    return out.withColumn("tokenized", rewrite("text", "numbered", TOKEN)).drop("numbered"), tokens
