"""Audit events: building, sanitizing, hash chains, export batches.

A hash chain is one unbroken link from record to record. Building it is sequential by its
definition: the records of a chain stream through one task in order, which holds one hash.
Chains are independent of each other. Verifying is parallel: every record carries the hash before it, so
a record is checked against its predecessor, found through blocks of sequence numbers. A seal per
chain (records, last hash, MAC) shows a missing end, which the records alone cannot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256
from ..functions.ranking import blocked_last, blocked_row_number
from .vault import bounded_label, principal

#: Sequence numbers per block of the parallel check; results do not depend on it.
BLOCK = 4096
ZERO = "0" * 64


def audit_events(
    decisions: DataFrame, findings: DataFrame, requests: DataFrame, mode: str, request: str = "request_id"
) -> DataFrame:
    """One event per decision: distinct finding types in order, counts, evasion facts.

    Findings fold per (request, subtype) first, so a request contributes a handful of rows.
    """
    evasive = "evasion_type" in findings.columns
    kind = F.col("evasion_type") if evasive else F.lit("")
    chain = F.col("encoding_chain") if evasive else F.lit("")
    depth = F.when(chain != "", 1 + F.length(chain) - F.length(F.replace(chain, F.lit(">"), F.lit("")))).otherwise(0)
    per_type = findings.groupBy(request, "subtype").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("detector_order", "message_index", "part_index", "start")).alias("first"),
        F.collect_set(F.when(kind != "", kind)).alias("kinds"),
        F.max(depth).alias("depth"),
    )
    per_request = per_type.groupBy(request).agg(
        F.array_sort(F.collect_list(F.struct("first", "subtype"))).alias("types"),
        F.sum("n").alias("finding_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("evasion_types"),
        F.max("depth").alias("encoding_depth"),
    )
    rows = decisions.join(requests, request).join(per_request, request, "left")
    none = F.array().cast("array<string>")
    applied = F.when(F.lit(mode) == "enforce", F.col("action")).otherwise("ALLOW")
    return rows.select(
        request,
        *[c for c in requests.columns if c != request],
        "action",
        "matched_rule",
        "precedence_stage",
        "code",
        "policy_id",
        "policy_version",
        F.lit(mode).alias("mode"),
        F.col("action").alias("predicted_action"),
        applied.alias("applied_action"),
        F.coalesce(F.transform("types", lambda t: t["subtype"]), none).alias("finding_types"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        F.coalesce("evasion_types", none).alias("evasion_types"),
        F.coalesce("encoding_depth", F.lit(0)).alias("encoding_depth"),
        F.coalesce(F.array_contains("evasion_types", "budget_exceeded"), F.lit(False)).alias("budget_rejected"),
    )


# The allowlist of event fields and the caps of its lists.
LABELS = ("request_id", "provider", "policy_id", "matched_rule", "precedence_stage", "mode", "code", "reason_id")
PRINCIPALS = ("application", "tenant", "user")
ENUMS = ("action", "predicted_action", "applied_action")
NUMBERS = ("policy_version", "finding_count", "encoding_depth")
LATENCIES = ("deterministic_ms", "model_ms", "total_security_ms")
LIST_CAPS = {"roles": 16, "finding_types": 64, "evasion_types": 32}
MAX_CHUNKS = 10_000


def bounded_list(values: Column, cap: int) -> Column:
    kept = F.transform(F.slice(values, 1, cap), bounded_label)
    return F.filter(kept, lambda v: v != "")


def sanitize(events: DataFrame, principal_key: str = "", keep: Iterable[str] = ()) -> DataFrame:
    """Fixed projection: only allow-listed fields leave, labels and lists bounded.

    A list that loses items to its cap is named in `truncated`. `keep` are columns for the writer.
    """
    have = set(events.columns)
    columns = []
    code = F.coalesce("code", F.lit("")) if "code" in have else F.lit("")
    for name in LABELS:
        if name == "reason_id":
            own = bounded_label(F.coalesce("reason_id", F.lit(""))) if "reason_id" in have else F.lit("")
            columns.append(F.when(own != "", own).otherwise(bounded_label(code)).alias(name))
        elif name in have:
            columns.append(bounded_label(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias(name))
    for name in PRINCIPALS:
        if name in have:
            columns.append(principal(F.coalesce(name, F.lit("")), principal_key).alias(name))
    columns += [F.col(n) for n in ENUMS + NUMBERS if n in have]
    for name in LATENCIES:
        if name in have:
            columns.append(F.greatest(F.lit(0), F.col(name)).cast("long").alias(name))
    if "rag_chunks" in have:
        columns.append(F.least(F.lit(MAX_CHUNKS), F.greatest(F.lit(0), F.col("rag_chunks"))).alias("rag_chunks"))
    cut = []
    for name, cap in LIST_CAPS.items():
        if name in have:
            values = F.coalesce(name, F.array().cast("array<string>"))
            columns.append(bounded_list(values, cap).alias(name))
            cut.append(F.when(F.size(values) > cap, name))
    if "rag_chunks" in have:
        cut.append(F.when(F.col("rag_chunks") > MAX_CHUNKS, "rag_chunks"))
    marks = F.filter(F.array(*cut), lambda c: c.isNotNull()) if cut else F.array().cast("array<string>")
    return events.select(*columns, marks.alias("truncated"), *keep)


def write_events(events: DataFrame, path: str, day: Column) -> None:
    """Sanitized events as JSON, partitioned by day."""
    sanitize(events).withColumn("day", day).write.mode("append").partitionBy("day").json(path)


# ---- chains ---------------------------------------------------------------------------------------------


def big_endian(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def record_hash(sequence: Column, previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(big_endian(sequence), F.unhex(previous), F.encode(payload, "utf-8")), 256)


def chain_build(
    events: DataFrame, chain: str, block: Column, order: Iterable[str], payload: Column, mac_key: str
) -> DataFrame:
    """Sequence, previous hash, record hash and MAC per event of each chain.

    The first record follows 64 zeros, every other one the record before it.
    """
    numbered = blocked_row_number(events.withColumn("payload", payload), [chain], block, order, "sequence")
    kind = numbered.schema[chain].dataType.simpleString()

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, begun, previous = None, False, ZERO
        for rows in batches:
            before, hashes = [], []
            for own, sequence, text in zip(rows[chain].tolist(), rows["sequence"].tolist(), rows["payload"].tolist(), strict=True):
                if not begun or (own != current and not (pd.isna(own) and pd.isna(current))):
                    current, begun, previous = own, True, ZERO
                before.append(previous)
                previous = hashlib.sha256(sequence.to_bytes(8, "big") + bytes.fromhex(previous) + (text or "").encode()).hexdigest()
                hashes.append(previous)
            yield rows.assign(previous=before, record_hash=hashes)[[chain, "sequence", "previous", "record_hash", "payload"]]

    columns = f"{chain} {kind}, sequence long, previous string, record_hash string, payload string"
    rows = numbered.select(chain, "sequence", "payload").repartition(chain).sortWithinPartitions(chain, "sequence")
    out = rows.mapInPandas(link, columns)
    return out.withColumn("mac", hmac_sha256(mac_key, F.col("record_hash")))


def chain_seals(records: DataFrame, chain: str, mac_key: str) -> DataFrame:
    """One seal per chain: how many records, the hash of the last, and a MAC over both."""
    out = records.groupBy(chain).agg(
        F.count(F.lit(1)).alias("sealed"), F.max_by("record_hash", "sequence").alias("tail")
    )
    return out.withColumn("seal", hmac_sha256(mac_key, F.concat_ws(":", F.col("sealed").cast("string"), F.col("tail"))))


def chain_verify(records: DataFrame, chain: str, mac_key: str) -> DataFrame:
    """Every record with its first fault: gap, link, hash or mac.

    A gap is a sequence that does not follow the record before it, or a first one other than 1. Blocks of
    sequence numbers are checked in parallel, each with the last record of the blocks before.
    """
    block = F.floor((F.col("sequence") - 1) / BLOCK)
    rows = blocked_last(
        records, [chain], block, ["sequence"], {"_seq": F.col("sequence"), "_prev": F.col("record_hash")}
    )
    fault = (
        F.when(F.col("sequence") != F.coalesce("_seq", F.lit(0)) + 1, "gap")
        .when(F.col("previous") != F.coalesce("_prev", F.lit(ZERO)), "link")
        .when(F.col("record_hash") != record_hash(F.col("sequence"), F.col("previous"), F.coalesce("payload", F.lit(""))), "hash")
        .when(F.col("mac") != hmac_sha256(mac_key, F.col("record_hash")), "mac")
        .otherwise("")
    )
    return rows.withColumn("fault", fault).drop("_seq", "_prev")


def cut_ends(records: DataFrame, seals: DataFrame, chain: str, mac_key: str) -> DataFrame:
    """A fault `end` after the last record of every chain that ends before, or other than, its seal says.

    A seal whose MAC does not hold is a fault `seal` at sequence 0.
    """
    have = records.groupBy(chain).agg(
        F.max("sequence").alias("last"), F.max_by("record_hash", "sequence").alias("have")
    )
    rows = seals.join(have, chain, "left")
    good = F.col("seal") == hmac_sha256(mac_key, F.concat_ws(":", F.col("sealed").cast("string"), F.col("tail")))
    same = F.coalesce((F.col("last") == F.col("sealed")) & (F.col("have") == F.col("tail")), F.lit(False))
    fault = F.when(~good, "seal").when(~same, "end")
    at = F.when(good, F.coalesce("last", F.lit(0)) + 1).otherwise(0)
    return rows.select(chain, at.cast("long").alias("sequence"), fault.alias("fault")).filter("fault IS NOT NULL")


def chain_faults(verified: DataFrame, chain: str, ends: DataFrame | None = None) -> DataFrame:
    """First bad sequence per chain and its fault; `ends` are those of cut_ends()."""
    bad = verified.filter("fault <> ''").select(chain, "sequence", "fault")
    if ends is not None:
        bad = bad.unionByName(ends)
    return bad.groupBy(chain).agg(
        F.min("sequence").alias("first_bad"), F.min_by("fault", "sequence").alias("fault"), F.count(F.lit(1)).alias("faults")
    )


def chain_status(
    records: DataFrame, verified: DataFrame, chain: str, now: Column, at: str, ends: DataFrame | None = None
) -> DataFrame:
    counts = records.groupBy(chain).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.octet_length("payload")).alias("payload_bytes"),
        (F.max("sequence") + 1).alias("next_sequence"),
        F.min(at).alias("oldest"),
    )
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("oldest"))
    out = counts.join(chain_faults(verified, chain, ends).select(chain, "first_bad"), chain, "left")
    return out.select(
        chain, "records", "payload_bytes", "next_sequence", age.cast("long").alias("oldest_age_seconds"), F.col("first_bad").isNull().alias("ready")
    )


# ---- export ---------------------------------------------------------------------------------------------


def export_batches(events: DataFrame, block: Column, order: Iterable[str], event_id: str, size: int, after: int = 0, payload: Column | None = None) -> DataFrame:
    """Ordered batches of `size` events with a stable idempotency key, from a resume point.

    With `payload` each batch also carries its `items` (sequence, id, payload).
    """
    rows = blocked_row_number(events, [], block, order, "sequence").filter(F.col("sequence") > after)
    batch = F.floor((F.col("sequence") - 1 - after) / size).alias("batch")
    item = ["sequence", F.col(event_id).cast("string").alias("id")] + ([payload.alias("payload")] if payload is not None else [])
    grouped = rows.groupBy(batch).agg(
        F.array_sort(F.collect_list(F.struct(*item))).alias("items")
    )
    ids = F.array_join(F.transform("items", lambda x: x["id"]), "\0")
    return grouped.select(
        "batch",
        F.size("items").alias("events"),
        F.get("items", F.lit(0))["sequence"].alias("first_sequence"),
        F.get("items", F.size("items") - 1)["sequence"].alias("last_sequence"),
        F.left(F.sha2(ids, 256), F.lit(32)).alias("idempotency_key"),
        *(["items"] if payload is not None else []),
    )
