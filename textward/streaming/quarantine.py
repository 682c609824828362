"""Incident signals, containment state and checks against it."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import micros
from ..functions.folds import carry_fold

# Scopes with their rank, and level strengths.
SCOPE_RANK = {
    "tenant": 8,
    "application": 7,
    "user": 6,
    "session": 5,
    "tool": 4,
    "server": 4,
    "provider": 4,
    "route": 4,
}
STRENGTH = {"disable": 4, "require_human_review": 4, "isolate": 3, "throttle": 2, "observe": 1}
PROBATION_SCOPES = ("provider", "route", "tool", "server")
SEEN = 32
#: Cells that the requests of one key and hour are dealt to.
SALTS = 16
MICROS = 1_000_000


@dataclass(frozen=True)
class QuarantineRule:
    """Times in seconds."""

    level: str = "isolate"
    scope: str = "user"
    threshold: int = 3
    window: int = 300
    cooldown: int = 60
    ttl: int = 900
    max_ttl: int = 1800


def incident_signals(decisions: DataFrame, findings: DataFrame, request: str = "request_id") -> DataFrame:
    """Signals of verified requests: reason, evidence digest and idempotency key per finding.

    `decisions` carries action, policy_id, policy_version and verified; `findings` carries
    finding_id and, where known, evasion_type.
    """
    rows = findings.join(
        decisions.filter("verified").select(request, "action", "policy_id", "policy_version"), request
    )
    hidden = F.col("evasion_type") != "" if "evasion_type" in findings.columns else F.lit(False)
    category = F.col("category")
    reason = (
        F.when(
            (category == "SECRET") | ((category == "PII") & F.col("action").isin("BLOCK", "REVIEW")),
            "secret_exfiltration",
        )
        .when(hidden, "detector_evasion")
        .when(category == "TOOL_SECURITY", "tool_policy_violation")
    )
    rows = rows.withColumn("reason", reason).filter("reason IS NOT NULL")
    place = F.concat(F.char(F.col("message_index")), F.lit(":"), F.char(F.col("part_index")))
    return rows.select(
        request,
        "reason",
        "policy_id",
        "policy_version",
        F.sha2(F.concat_ws("\0", "category", "subtype", "detector", place), 256).alias("evidence"),
        F.concat_ws(":", F.col(request).cast("string"), "reason", "finding_id").alias("idempotency_key"),
    )


def scope_key(tenant: Column, scope: str, *target: Column) -> Column:
    """Key digest of a scope: tenant digest, scope and target digest joined by NUL."""
    tenant_digest = F.sha2(tenant.cast("string"), 256)
    own = F.sha2(F.concat_ws("\0", *[t.cast("string") for t in target]), 256) if target else tenant_digest
    return F.sha2(F.concat_ws("\0", tenant_digest, F.lit(scope), own), 256)


# ---- state ----------------------------------------------------------------------------------------------


class Containment:
    """State of one scope key, fed with signals in time order."""

    def __init__(self, rule: QuarantineRule):
        self.rule = rule
        self.count = 0
        self.window_start: int | None = None
        self.last = 0
        self.expires = 0
        self.seen: deque = deque(maxlen=SEEN)

    def observe(self, at: int, signal: str) -> tuple[int, bool, int]:
        """Signals counted in the window, whether containment starts now, and its expiry."""
        rule = self.rule
        known = self.window_start is not None
        if known and signal in self.seen:
            return self.count, False, self.expires
        if not known or at - self.window_start > rule.window * MICROS:
            self.count, self.window_start = 0, at
        cooling = (
            rule.cooldown > 0
            and known
            and self.count >= rule.threshold
            and at - self.last < rule.cooldown * MICROS
        )
        self.seen.append(signal)
        self.last = at
        if cooling:
            return self.count, False, self.expires
        self.count += 1
        if self.count < rule.threshold or self.expires > at:
            return self.count, False, self.expires
        ttl = min(rule.ttl, rule.max_ttl)
        self.expires = at + (ttl if ttl > 0 else 60) * MICROS
        return self.count, True, self.expires


def _fold(rule: QuarantineRule):
    def fold(state, pdf: pd.DataFrame):
        state = state or Containment(rule)
        out = [state.observe(int(at), s) for at, s in zip(pdf["at_us"], pdf["signal"], strict=True)]
        return state, pd.DataFrame(
            {
                "key": pdf["key"],
                "signal": pdf["signal"],
                "at_us": pdf["at_us"],
                "signal_count": [o[0] for o in out],
                "activated": [o[1] for o in out],
                "expires_us": [o[2] for o in out],
            }
        )

    return fold


def quarantine_states(signals: DataFrame, rule: QuarantineRule) -> DataFrame:
    """Containment after each signal (`key`, `signal`, `at`).

    The first signal opens a window measured from itself; the threshold-th one in it starts
    containment until its expiry. The state of a key is sequential, so its narrow rows
    stream through in order with one small state.
    """
    kind = dict(signals.dtypes)["key"]
    rows = signals.select("key", F.col("signal").cast("string").alias("signal"), micros("at").alias("at_us"))
    out = carry_fold(
        rows,
        "key",
        ["at_us", "signal"],
        _fold(rule),
        f"key {kind}, signal string, at_us bigint, signal_count int, activated boolean, expires_us bigint",
    )
    return out.select(
        "key",
        "signal",
        F.timestamp_micros("at_us").alias("at"),
        "signal_count",
        "activated",
        F.when(F.col("expires_us") > 0, F.timestamp_micros("expires_us")).alias("expires_at"),
    )


def containments(states: DataFrame, rule: QuarantineRule) -> DataFrame:
    """Activations as intervals per scope key."""
    return states.filter("activated").select(
        "key",
        F.lit(rule.scope).alias("scope"),
        F.lit(rule.level).alias("level"),
        F.col("at").alias("started_at"),
        "expires_at",
        "signal_count",
    )


# ---- checks ---------------------------------------------------------------------------------------------


def quarantine_check(
    requests: DataFrame,
    intervals: DataFrame,
    scopes: Mapping[str, Column],
    request: str,
    at: str,
    probation_seconds: int = 600,
) -> DataFrame:
    """Strongest containment in force per request over its scopes.

    `intervals` carries key, scope, level, started_at and expires_at; `scopes` maps a scope to
    the key of the request (NULL where the request has none). The interval in force is found
    by an equality join on (key, hour) cells, so a key with many intervals stays cheap.
    """
    offered = F.filter(
        F.array(*[F.struct(F.lit(s).alias("scope"), k.alias("key")) for s, k in scopes.items()]),
        lambda x: x["key"].isNotNull(),
    )
    asked = requests.select(request, F.col(at).alias("at"), F.explode(offered).alias("s")).select(request, "at", "s.*")
    # A provider's busy hour is a few cells: intervals are few, and each stands in all of them.
    asked = asked.withColumn("cell", F.floor(F.unix_timestamp("at") / 3600)).withColumn("salt", F.pmod(F.xxhash64(request), F.lit(SALTS)))
    tail = F.when(F.col("scope").isin(*PROBATION_SCOPES), probation_seconds).otherwise(0)
    until = F.unix_timestamp("expires_at") + tail
    cells = F.sequence(F.floor(F.unix_timestamp("started_at") / 3600), F.floor(until / 3600))
    spread = intervals.withColumn("tail", tail).withColumn("cell", F.explode(cells))
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = asked.join(spread, ["key", "scope", "cell", "salt"]).filter(
        (F.col("at") >= F.col("started_at"))
        & (micros("at") < micros("expires_at") + F.col("tail") * MICROS)
    )
    active = F.col("at") < F.col("expires_at")
    level = F.col("level")
    code = (
        F.when(~active, "QUARANTINE_PROBATION")
        .when(level == "throttle", "QUARANTINE_THROTTLED")
        .otherwise("QUARANTINED")
    )
    strength = F.lit(0)
    for name, value in STRENGTH.items():
        strength = F.when(level == name, value).otherwise(strength)
    rank = F.lit(0)
    for name, value in SCOPE_RANK.items():
        rank = F.when(F.col("scope") == name, value).otherwise(rank)
    # Observing never stops a request.
    hit = hit.filter(level != "observe")
    order = F.struct(strength.alias("strength"), rank.alias("rank"), F.col("started_at"))
    best = hit.withColumn("code", code).groupBy(request).agg(
        F.max_by(F.struct("code", "scope", "level"), order).alias("b")
    )
    out = requests.select(request).join(best, request, "left")
    return out.select(
        request,
        F.col("b").isNull().alias("allowed"),
        F.coalesce("b.code", F.lit("")).alias("code"),
        F.coalesce("b.scope", F.lit("")).alias("scope"),
        F.coalesce("b.level", F.lit("")).alias("level"),
    )


def latest_states(intervals: DataFrame) -> DataFrame:
    """Newest containment per key; combines map-side."""
    fields = [c for c in intervals.columns if c not in ("key",)]
    newest = intervals.groupBy("key").agg(F.max_by(F.struct(*fields), F.col("started_at")).alias("s"))
    return newest.select("key", "s.*")


def quarantine_summary(states: DataFrame) -> DataFrame:
    """Counts by status; reasons and scopes of the states not released.

    `states` carries status, reason and scope; the three are counted together once.
    """
    combos = states.groupBy("status", "reason", "scope").agg(F.count(F.lit(1)).alias("n"))
    held = F.col("status") != "released"
    items = F.filter(
        F.array(
            F.struct(F.lit("status").alias("kind"), F.col("status").alias("label")),
            F.when(held, F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("label"))),
            F.when(held, F.struct(F.lit("scope").alias("kind"), F.col("scope").alias("label"))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = combos.select(F.explode(items).alias("i"), "n").select("i.*", "n")
    return rows.groupBy("kind", "label").agg(F.sum("n").alias("count"))
