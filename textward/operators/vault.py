"""Token vault records, placeholders and re-identification.

Records are rows: scope digests and expiry are column expressions, quotas are running counts,
retrieval is one join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256
from ..functions.ranking import PLACE, blocked_row_number, blocked_sums_before, place_block, placed
from ..functions.scan import explode_rows, matches
from ..session import cut_lineage

SCOPE_VERSION = 1
# Forms of a placeholder label.
SIMPLE_LABEL = "[A-Z][A-Z0-9_]*_[0-9]{3}"
SIGNED_LABEL = r"v1(?:\.[A-Za-z0-9:_-]+){3,4}"
PLACEHOLDER = f"<(?:{SIMPLE_LABEL}|{SIGNED_LABEL})>"
SIGNED_SHAPE = (
    r"^v1\.(?:[A-Za-z0-9_:-]{1,64}\.)?[0-9a-f]{36}\.[0-9A-Fa-f]{8}\.[0-9A-Fa-f]{32}$"
)


@dataclass(frozen=True)
class VaultOptions:
    mac_key: str
    data_key: bytes
    ttl_seconds: int = 24 * 3600
    idle_seconds: int = 0
    max_value_bytes: int = 64 * 1024
    max_retrievals: int = 10
    single_use: bool = False
    per_scope: int = 0
    per_tenant: int = 0
    per_user: int = 0
    per_session: int = 0


def keyed_digest(key: str, label: str, value: Column) -> Column:
    return hmac_sha256(key, F.concat(F.lit(label + "\0"), value))


def scope_digest(o: VaultOptions, with_category: bool) -> Column:
    """Digest over the scope fields; the index digest leaves the data category out."""
    category = F.col("data_category") if with_category else F.lit("")
    fields = (
        F.lit(chr(SCOPE_VERSION)),
        F.col("tenant"),
        F.col("application"),
        keyed_digest(o.mac_key, "subject", F.col("subject")),
        keyed_digest(o.mac_key, "session", F.col("session")),
        F.col("policy_id"),
        F.col("policy_version").cast("string"),
        F.col("purpose"),
        category,
    )
    return hmac_sha256(o.mac_key, F.concat_ws("\0", *fields))


def session_index(o: VaultOptions) -> Column:
    fields = (
        F.lit("session-index"),
        F.col("tenant"),
        F.col("application"),
        keyed_digest(o.mac_key, "subject", F.col("subject")),
        keyed_digest(o.mac_key, "session", F.col("session")),
    )
    return hmac_sha256(o.mac_key, F.concat_ws("\0", *fields))


SCOPE_FIELDS = ("tenant", "application", "subject", "session", "policy_id", "purpose", "data_category")


# Codes of refused tokens.
SCOPE_REQUIRED, TOO_LARGE, QUOTA = "scope_required", "value_too_large", "quota_exceeded"


# ---- quotas ----------------------------------------------------------------------------------------------

#: Undecided rows that one task may settle in order.
FINISH = 50_000
#: Numbers of a block of the running counts.
PLACES = 4096
#: Decisions: no, yes, open.
NO, YES, OPEN = 0, 1, 2


@dataclass(frozen=True)
class Quota:
    """A limit per key; rows count once admitted (room in scope, tenant and user) or once stored (also in the session)."""

    keys: tuple[str, ...]
    limit: int
    counts: str
    gate: str


def _counted(rows: DataFrame, quotas: list[Quota]) -> DataFrame:
    """Undecided rows with `base_i`, decided rows before them that count, and `low_i`, `high_i`, what may come on top."""
    for i, q in enumerate(quotas):
        flag = F.col(q.counts)
        one = {
            "_done": F.when(F.col("done") & (flag == YES), 1).otherwise(0),
            "_low": F.when(~F.col("done") & (flag == YES), 1).otherwise(0),
            "_high": F.when(~F.col("done") & (flag != NO), 1).otherwise(0),
        }
        rows = blocked_sums_before(rows, [f"k{i}"], F.floor(F.col("place") / PLACES), ["place"], one)
        base = F.col(f"base{i}") + F.col("_done")
        rows = rows.withColumns({f"base{i}": base, f"low{i}": base + F.col("_low"), f"high{i}": base + F.col("_high")}).drop(*one)
    return rows.where(~F.col("done"))


def _judged(rows: DataFrame, quotas: list[Quota]) -> DataFrame:
    """Decisions that hold whatever the open ones become: refused if the least count fills a quota, let in if the greatest fills none."""

    def verdict(gate: str) -> tuple[Column, Column]:
        full, free = F.lit(False), F.lit(True)
        for i, q in enumerate(quotas):
            if q.gate == gate:
                full, free = full | (F.col(f"low{i}") >= q.limit), free & (F.col(f"high{i}") < q.limit)
        return full, free

    full, free = verdict("admitted")
    rows = rows.withColumn("admitted", F.when(full, NO).when(free, YES).otherwise(OPEN))
    full, free = verdict("stored")
    stored = F.when((F.col("admitted") == NO) | full, NO).when((F.col("admitted") == YES) & free, YES).otherwise(OPEN)
    drop = [f"{n}{i}" for n in ("low", "high") for i in range(len(quotas))]
    return rows.withColumn("stored", stored).drop(*drop)


def _settled(quotas: list[Quota]):
    """The rest in order, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for pdf in batches:
            keys = [[(i, k) for k in pdf[f"k{i}"]] for i in range(len(quotas))]
            bases = [pdf[f"base{i}"].tolist() for i in range(len(quotas))]
            out = []
            for n in range(len(pdf)):
                room = [bases[i][n] + counts.get(keys[i][n], 0) < q.limit for i, q in enumerate(quotas)]
                admitted = all(r for r, q in zip(room, quotas) if q.gate == "admitted")
                stored = admitted and all(r for r, q in zip(room, quotas) if q.gate == "stored")
                for i, q in enumerate(quotas):
                    if admitted if q.counts == "admitted" else stored:
                        counts[keys[i][n]] = counts.get(keys[i][n], 0) + 1
                out.append(YES if stored else NO)
            yield pd.DataFrame({"place": pdf["place"], "stored": out})

    return run


def _stored(rows: DataFrame, quotas: list[Quota], finish: int) -> DataFrame:
    """`place`, `stored` of rows (`place`, `k0`, ...) in the order of their places.

    Each round decides what the open rows cannot change. Decided rows travel once more, as counts, then only
    the open ones do; the first open row is decided in every round, and one full key decides all rows behind it. When `finish` rows or
    fewer are left, one task takes them in order.
    """
    start = {"admitted": F.lit(OPEN), "stored": F.lit(OPEN), "done": F.lit(False)}
    rows = rows.withColumns(start | {f"base{i}": F.lit(0).cast("long") for i in range(len(quotas))})
    answers: list[DataFrame] = []
    while True:
        counted = cut_lineage(_judged(_counted(rows, quotas), quotas))
        left = counted.count()
        if left <= finish:
            last = counted.repartition(1).sortWithinPartitions("place").mapInPandas(_settled(quotas), "place long, stored int")
            return reduce(DataFrame.unionByName, answers, last)
        marked = counted.withColumn("done", F.col("stored") != OPEN)
        answers.append(marked.where("done").select("place", "stored"))
        rows = marked


def issue_outcomes(tokens: DataFrame, o: VaultOptions, order: list[str], finish: int = FINISH) -> DataFrame:
    """Every token with `code`: empty if it is stored, else why it is refused.

    A token is stored if its scope, tenant, user and session all have room when its turn comes. It
    counts for tenant and user once these and the scope had room, for scope and session once it
    is stored. Tenants and users cross, so the counts depend on each other.
    """
    scoped = F.col("policy_version") > 0
    for name in SCOPE_FIELDS:
        scoped = scoped & (F.coalesce(F.col(name), F.lit("")) != "")
    small = F.octet_length("value") <= o.max_value_bytes
    code = (
        F.when(~F.coalesce(scoped, F.lit(False)), SCOPE_REQUIRED)
        .when(~F.coalesce(small, F.lit(False)), TOO_LARGE)
        .otherwise("")
    )
    rows = tokens.withColumn("code", code)
    scope = ("tenant", "application", "subject", "session", "policy_id", "policy_version", "purpose")
    quotas = [
        q
        for q in (
            Quota(scope, o.per_scope, "stored", "admitted"),
            Quota(("tenant",), o.per_tenant, "admitted", "admitted"),
            Quota(("subject",), o.per_user, "admitted", "admitted"),
            Quota(scope[:4], o.per_session, "stored", "stored"),
        )
        if q.limit > 0
    ]
    if not quotas:
        return rows
    rows = placed(rows, order)
    spelled = [F.to_json(F.struct(*q.keys)).alias(f"k{i}") for i, q in enumerate(quotas)]
    narrow = rows.where("code = ''").select(F.col("_place").alias("place"), *spelled)
    answers = _stored(narrow, quotas, finish).withColumnRenamed("place", "_place")
    out = rows.join(answers, "_place", "left")
    refused = F.when(F.col("stored") == NO, QUOTA).otherwise(F.col("code"))
    return out.withColumn("code", refused).drop("_place", "stored")


def issue(tokens: DataFrame, o: VaultOptions, order: list[str]) -> DataFrame:
    """Vault records of the tokens that issue_outcomes() stores."""
    rows = issue_outcomes(tokens, o, order).filter("code = ''").drop("code")
    expires = F.col("issued_at") + F.make_interval(secs=F.lit(o.ttl_seconds))
    idle = F.lit(None).cast("timestamp")
    if o.idle_seconds:
        idle = F.col("issued_at") + F.make_interval(secs=F.lit(o.idle_seconds))
    full = scope_digest(o, True)
    rows = rows.withColumn("namespace", scope_digest(o, False)).withColumn("scope_digest", full)
    sealed = F.aes_encrypt(
        F.col("value"),
        F.unhex(F.lit(o.data_key.hex())),
        F.lit("GCM"),
        F.lit("DEFAULT"),
        F.lit(""),
        seal_context(),
    )
    return rows.select(
        "namespace",
        "token",
        F.col("data_category"),
        "purpose",
        "scope_digest",
        session_index(o).alias("session_index"),
        F.col("issued_at").alias("created_at"),
        expires.alias("expires_at"),
        idle.alias("idle_expires_at"),
        F.lit(o.single_use).alias("single_use"),
        F.lit(o.max_retrievals).alias("max_retrievals"),
        sealed.alias("ciphertext"),
    )


def seal_context() -> Column:
    """Associated data: ties a ciphertext to its scope and token."""
    return F.concat_ws("|", "scope_digest", "namespace", "token")


def open_value(o: VaultOptions) -> Column:
    return F.try_aes_decrypt(
        F.col("ciphertext"),
        F.unhex(F.lit(o.data_key.hex())),
        F.lit("GCM"),
        F.lit("DEFAULT"),
        seal_context(),
    ).cast("string")


def placeholders(text: str) -> Column:
    """Placeholder matches of a text column; `value` keeps the angle brackets."""
    return matches(text, PLACEHOLDER, needles=("<",))


def label_of(value: Column) -> Column:
    return F.regexp_replace(value, "^<|>$", "")


def signed_ok(label: Column, keys: tuple[str, ...]) -> Column:
    """Shape, CRC-32 and MAC (under any retained key) of a signed label."""
    parts = F.split(label, r"\.")
    size = F.size(parts)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(size - 2, F.lit(1))), ".")
    crc = F.lpad(F.lower(F.hex(F.crc32(F.encode(base, "utf-8")))), 8, "0")
    mac_ok = F.lit(False)
    for key in keys:
        mac_ok = mac_ok | (F.lower(F.get(parts, size - 1)) == F.left(hmac_sha256(key, base), F.lit(32)))
    return label.rlike(SIGNED_SHAPE) & (F.lower(F.get(parts, size - 2)) == crc) & mac_ok


def sign_label(key: str, token_id: Column, category: Column) -> Column:
    """Label of 36 hex digits with its checksum and MAC."""
    base = F.concat_ws(".", F.lit("v1"), category, token_id)
    crc = F.lpad(F.lower(F.hex(F.crc32(F.encode(base, "utf-8")))), 8, "0")
    return F.concat_ws(".", base, crc, F.left(hmac_sha256(key, base), F.lit(32)))


def placeholder_rows(parts: DataFrame, keys: list[str], mac_keys: tuple[str, ...] = ()) -> DataFrame:
    """Placeholders per part; signed labels carry their validity, simple ones are valid."""
    rows = explode_rows(parts, keys, placeholders("text"), "m")
    label = label_of(F.col("m.value"))
    signed = F.startswith(label, F.lit("v1."))
    return rows.select(
        *keys,
        label.alias("label"),
        F.col("m.start").alias("start"),
        F.col("m.end").alias("end"),
        F.when(signed, signed_ok(label, mac_keys)).otherwise(True).alias("valid"),
    )


def reidentify(
    parts: DataFrame,
    vault: DataFrame,
    keys: list[str],
    at: Column,
    opened: Column,
    max_limit: int = 0,
) -> DataFrame:
    """Texts with placeholders resolved where scope, purpose, category and limits agree.

    `parts` carries namespace, scope_digest (per category: `scope_digests` map), purpose and
    has_tool_calls; unknown placeholders stay. Texts without placeholders do not shuffle.
    """
    marked = parts.withColumn("marks", placeholders("text"))
    open_rows = marked.filter((F.size("marks") > 0) & ~F.col("has_tool_calls"))
    wanted = explode_rows(open_rows, [*keys, "namespace", "scope_digests", "purpose"], "marks", "m").select(*keys, "namespace", "scope_digests", "purpose", label_of(F.col("m.value")).alias("token"), F.col("m.start").alias("at"))
    records = vault.select(
        "namespace",
        "token",
        F.col("purpose").alias("record_purpose"),
        F.col("scope_digest").alias("record_scope"),
        "data_category",
        "expires_at",
        "idle_expires_at",
        F.when(F.col("single_use"), 1).otherwise(F.col("max_retrievals")).alias("limit"),
        opened.alias("plain"),
    )
    alive = (at <= F.col("expires_at")) & (
        F.col("idle_expires_at").isNull() | (at <= F.col("idle_expires_at"))
    )
    agrees = (F.col("record_purpose") == F.col("purpose")) & (
        F.element_at("scope_digests", F.col("data_category")) == F.col("record_scope")
    )
    hit = wanted.join(records, ["namespace", "token"]).filter(alive)
    # Every look-up of a live record counts as a retrieval, also one that then disagrees.
    # A token that most texts hold is many blocks.
    hit = blocked_row_number(placed(hit, [*keys, "at"]), ["namespace", "token"], place_block(), [PLACE], "n").drop(PLACE)
    if max_limit:
        hit = hit.filter(F.col("n") <= max_limit)
    hit = hit.filter((F.col("limit") <= 0) | (F.col("n") <= F.col("limit")))
    values = hit.filter(agrees).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("at", "plain"))).alias("resolved")
    )
    out = marked.join(values, keys, "left")
    spans = F.expr(
        "transform(marks, m -> named_struct('char_start', m.char_start, 'char_end', m.char_end, "
        "'shown', coalesce(try_element_at(resolved, m.start), m.value)))"
    )
    from .transform import rewrite

    return out.withColumn("_spans", spans).withColumn(
        "text", rewrite("text", "_spans", "t.shown")
    ).drop("marks", "resolved", "_spans")


def revoke_session(vault: DataFrame, sessions: DataFrame) -> DataFrame:
    """Records left after dropping those of the given session indexes."""
    return vault.join(sessions.select("session_index").distinct(), "session_index", "left_anti")


def bounded_label(value: Column) -> Column:
    """At most 96 bytes of [A-Za-z0-9._:-/]; every other byte becomes '_'."""
    out = F.regexp_replace(value, r"^\s+|\s+$", "")
    # Replacing by byte count first keeps the 96-byte cut exact.
    out = F.regexp_replace(out, r"[\x{10000}-\x{10FFFF}]", "____")
    out = F.regexp_replace(out, r"[\x{800}-\x{FFFF}]", "___")
    out = F.regexp_replace(out, r"[\x{80}-\x{7FF}]", "__")
    return F.regexp_replace(F.left(out, F.lit(96)), r"[^A-Za-z0-9._:/-]", "_")


def principal(value: Column, key: str) -> Column:
    """Bounded principal label, replaced by a keyed digest where a key is set."""
    label = bounded_label(value)
    if not key:
        return label
    digest = F.sha2(F.concat(F.lit(key), F.lit("\0"), label), 256)
    return F.when(label == "", label).otherwise(F.concat(F.lit("sha256:"), F.left(digest, F.lit(32))))
