"""Operational aggregates: series, breakdowns, counters, freshness and fleet state."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import blocked_row_number
from ..session import cut_lineage

# Actions and the groups the dashboard counts.
ACTIONS = ("ALLOW", "BLOCK", "TOKENIZE", "REDACT", "REVIEW", "RESTRICT_TOOLS", "FORCE_LOCAL_MODEL")
KPI_ACTIONS = {
    "protected_events": ("BLOCK", "TOKENIZE", "REDACT", "REVIEW", "RESTRICT_TOOLS"),
    "blocked_high_risk": ("BLOCK",),
    "tokenized_redacted": ("TOKENIZE", "REDACT"),
    "requests_prevented": ("BLOCK", "REVIEW", "RESTRICT_TOOLS"),
}
MAX_POINTS, MIN_BUCKET, MAX_WINDOW = 120, 60, 24 * 3600
MAX_DIMENSION = 32
LATENCY_BOUNDS = {
    "scanner": (0.5, 1, 2, 5, 10, 25, 50, 100),
    "security": (1, 5, 10, 25, 50, 100, 250),
    "model": (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000),
}


def bucket_seconds(window: int, bucket: int | None = None) -> int:
    """Bucket width of a series: at least a minute and at most 120 points."""
    if not 0 < window <= MAX_WINDOW:
        raise ValueError("window must be positive and no longer than a day")
    if bucket is None:
        bucket = max(window // MAX_POINTS, MIN_BUCKET)
        if window % bucket:
            bucket += MIN_BUCKET
    elif not MIN_BUCKET <= bucket <= window:
        raise ValueError("bucket must lie between a minute and the window")
    if window // bucket > MAX_POINTS:
        raise ValueError("window and bucket exceed 120 points")
    return bucket


def floor_time(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def timeseries(events: DataFrame, window: int = MAX_WINDOW, bucket: int | None = None) -> DataFrame:
    """Points of consecutive windows: actions, findings, protected and forwarded counts.

    Empty buckets are present. `events` carries ts, action and category.
    """
    width = bucket_seconds(window, bucket)
    counted = events.groupBy(floor_time(F.col("ts"), width).alias("point")).agg(
        *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ACTIONS],
        F.count("category").alias("findings"),
        F.count_if(~F.col("action").isin("ALLOW", "OTHER")).alias("protected"),
        F.count_if(F.col("action") == "ALLOW").alias("forwarded"),
    )
    ends = events.select(floor_time(F.col("ts"), window).alias("window_start")).distinct()
    steps = F.sequence(F.lit(0), F.lit(window // width - 1))
    grid = ends.select("window_start", F.explode(steps).alias("i")).withColumn(
        "point", F.timestamp_seconds(F.unix_timestamp("window_start") + F.col("i") * width)
    )
    out = grid.drop("i").join(counted, "point", "left")
    names = [a.lower() for a in ACTIONS] + ["findings", "protected", "forwarded"]
    return out.select("window_start", "point", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def breakdown(events: DataFrame, dimensions: Iterable[str], filters: dict[str, str] | None = None) -> DataFrame:
    """Counts per value of each dimension, ranked by count, then key.

    The dimensions are counted together once; the unpivot runs on those few combinations.
    """
    dimensions = list(dimensions)
    filters = filters or {}
    combos = events.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))
    items = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key"))
            for d in dimensions
        ]
    )
    rows = combos.select(F.explode(items).alias("i"), "n").select("i.*", "n")
    for dimension, wanted in filters.items():
        rows = rows.filter((F.col("dimension") != dimension) | (F.col("key") == wanted))
    out = rows.groupBy("dimension", "key").agg(F.sum("n").alias("count"))
    # Most values are rare: blocks by the size of the count, the largest first.
    block = -F.floor(F.log2("count") * 8)
    return blocked_row_number(out, ["dimension"], block, [F.desc("count"), "key"], "rank")


def kpis(events: DataFrame, window: int = MAX_WINDOW) -> DataFrame:
    """Each KPI per window against the window before: delta percent and trend."""
    counted = events.groupBy(floor_time(F.col("ts"), window).alias("window_start")).agg(
        *[F.count_if(F.col("action").isin(*acts)).alias(k) for k, acts in KPI_ACTIONS.items()]
    )
    items = F.array(
        *[F.struct(F.lit(k).alias("kpi"), F.col(k).alias("value")) for k in KPI_ACTIONS]
    )
    rows = counted.select("window_start", F.explode(items).alias("i")).select("window_start", "i.*")
    before = rows.select(
        F.timestamp_seconds(F.unix_timestamp("window_start") + window).alias("window_start"),
        "kpi",
        F.col("value").alias("previous"),
    )
    out = rows.join(before, ["window_start", "kpi"], "left")
    out = out.withColumn("previous", F.coalesce("previous", F.lit(0)))
    value, previous = F.col("value"), F.col("previous")
    # The cast to bigint truncates toward zero.
    delta = F.when(previous == 0, F.when(value > 0, 100).otherwise(0)).otherwise(
        (value * F.lit(100.0) / previous - 100).cast("bigint")
    )
    trend = F.when(value > previous, "up").when(value < previous, "down").otherwise("flat")
    return out.select("window_start", "kpi", "value", "previous", delta.cast("bigint").alias("delta_percent"), trend.alias("trend"))


def funnel(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("action").alias("inspected"),
        F.count("category").alias("findings"),
        F.count_if(~F.col("action").isin("ALLOW", "OTHER")).alias("transformed_or_blocked"),
        F.count_if(F.col("action") == "ALLOW").alias("forwarded"),
    )


# Actions that keep something from being forwarded as it is.
PREVENTING = ("BLOCK", "TOKENIZE", "REDACT", "REVIEW")


def leaderboard(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Finding types ranked by count, category, subtype, beside the total and the prevented requests."""
    prevented = decisions.agg(F.count_if(F.col("action").isin(*PREVENTING))).scalar()
    counted = findings.groupBy("category", "subtype").agg(F.count(F.lit(1)).alias("count"))
    # One row per finding type, a closed set: the unpartitioned windows stay tiny.
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.desc("count"), "category", "subtype")
    return counted.select(
        "category", "subtype", "count", F.row_number().over(order).alias("rank"), F.sum("count").over(every).alias("total"), prevented.alias("prevented")
    )


def bounded_label(value: Column, fallback: str) -> Column:
    label = F.upper(F.trim(value))
    return (
        F.when(label == "", fallback)
        .when(F.octet_length(label) > 48, "OTHER")
        .when(label.rlike("^[A-Z0-9_.-]+$"), label)
        .otherwise(fallback)
    )


def capped_dimension(rows: DataFrame, bucket: str, label: str, order: Iterable[str]) -> DataFrame:
    """Counts per bucket: the first 31 distinct labels by first sight, the rest as `other`.

    Labels are counted first; Spark prunes the rank to 31 per bucket before the shuffle.
    """
    counted = cut_lineage(
        rows.groupBy(bucket, label).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("seen")
        )
    )
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("seen", label))
    kept = counted.withColumn("rank", rank).filter(F.col("rank") <= MAX_DIMENSION - 1)
    totals = counted.groupBy(bucket).agg(F.sum("n").alias("total"))
    held = kept.groupBy(bucket).agg(F.sum("n").alias("held"))
    rest = totals.join(held, bucket).filter("total > held")
    return kept.select(bucket, label, F.col("n").alias("count")).unionByName(
        rest.select(bucket, F.lit("other").alias(label), (F.col("total") - F.col("held")).alias("count"))
    )


def counters(decisions: DataFrame, findings: DataFrame, mode: str, request: str = "request_id") -> DataFrame:
    """Labelled counters: requests by action and mode, findings once per request and type,
    evasion findings by type, depth and action."""
    requests = decisions.groupBy(F.col("action").alias("label_a")).agg(F.count(F.lit(1)).alias("value"))
    requests = requests.select(F.lit("requests").alias("counter"), "label_a", F.lit(mode).alias("label_b"), F.lit("").alias("label_c"), "value")
    types = findings.select(request, "category", "subtype").distinct()
    types = types.groupBy(F.col("category").alias("label_a"), F.col("subtype").alias("label_b")).agg(
        F.count(F.lit(1)).alias("value")
    )
    types = types.select(F.lit("findings").alias("counter"), "label_a", "label_b", F.lit("").alias("label_c"), "value")
    out = requests.unionByName(types)
    if "evasion_type" in findings.columns:
        depth = F.when(
            F.col("encoding_chain") != "",
            1 + F.length("encoding_chain") - F.length(F.replace("encoding_chain", F.lit(">"), F.lit(""))),
        ).otherwise(0)
        hidden = findings.filter("evasion_type <> ''").join(decisions.select(request, "action"), request)
        hidden = hidden.groupBy(
            F.col("evasion_type").alias("label_a"), depth.cast("string").alias("label_b"), F.col("action").alias("label_c")
        ).agg(F.count(F.lit(1)).alias("value"))
        out = out.unionByName(
            hidden.select(F.lit("evasion").alias("counter"), "label_a", "label_b", "label_c", "value")
        )
    return out


def stream_counters(released: DataFrame, stream: str = "stream_id") -> DataFrame:
    """Counters of released streams (`released`, `terminated`): streams by what became of them, transformations by subtype."""
    ends = released.groupBy(stream).agg(F.bool_or("terminated").alias("over"))
    actions = ends.groupBy(F.when(F.col("over"), "terminate").otherwise("release").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    marks = F.regexp_extract_all("released", F.lit(r"\[REDACTED:([A-Z0-9_]+)\]"), F.lit(1))
    changed = released.select(F.explode(marks).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("value"))
    return actions.select(F.lit("stream_actions").alias("counter"), "label", "value").unionByName(
        changed.select(F.lit("transformations").alias("counter"), "label", "value")
    )


def latency_histogram(rows: DataFrame, value: str, bounds: Iterable[float], *keys: str) -> DataFrame:
    """Cumulative counts per upper bound, `+Inf` included, in one aggregation."""
    bounds = list(bounds)
    names = [f"{float(b):g}" for b in bounds] + ["+Inf"]
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    counted = rows.groupBy(*keys).agg(*counts, F.count(value).alias(f"_b{len(bounds)}"))
    items = F.array(
        *[F.struct(F.lit(n).alias("le"), F.col(f"_b{i}").alias("count")) for i, n in enumerate(names)]
    )
    return counted.select(*keys, F.explode(items).alias("i")).select(*keys, "i.*")


def shadow_rates(decisions: DataFrame, findings: DataFrame, request: str = "request_id") -> DataFrame:
    """Shadow mode: disagreements, and blocks or reviews with no secret or personal data."""
    plain = findings.filter(F.col("category").isin("SECRET", "PII")).select(request).distinct()
    rows = decisions.join(plain.withColumn("hit", F.lit(True)), request, "left")
    stopped = F.col("action").isin("BLOCK", "REVIEW")
    return rows.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("action") != "ALLOW").alias("disagreements"),
        F.count_if(stopped & F.col("hit").isNull()).alias("false_positive_samples"),
    )


def freshness(events: DataFrame, now: Column, *keys: str, limit: int = 60) -> DataFrame:
    out = events.groupBy(*keys).agg(F.max("ts").alias("last_event"))
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("last_event"))
    return out.select(
        *keys,
        "last_event",
        age.cast("long").alias("age_seconds"),
        F.when(age > limit, "stale").otherwise("fresh").alias("status"),
    )


def latest_heartbeats(heartbeats: DataFrame, node: str = "node") -> DataFrame:
    """Newest heartbeat per node; combines map-side, so a chatty node does not collect."""
    fields = [c for c in heartbeats.columns if c != node]
    newest = heartbeats.groupBy(node).agg(
        F.max_by(F.struct(*fields), F.struct("sent_at", "heartbeat_id")).alias("h")
    )
    return newest.select(node, "h.*")


def fleet_compliance(nodes: DataFrame, heartbeats: DataFrame, now: Column, stale_after: int = 300) -> DataFrame:
    """Per node: claim class, degraded, compliant and stale against its desired digests.

    `nodes` carries node, desired_policy, desired_config, build_digest and sbom_digest.
    """
    last = latest_heartbeats(heartbeats)
    seen = last.withColumnsRenamed({"build_digest": "h_build", "sbom_digest": "h_sbom"}).withColumn("seen", F.lit(True))
    rows = nodes.join(seen, "node", "left")
    known = F.coalesce("seen", F.lit(False))
    compliant = (
        known
        & (F.col("policy_digest") == F.col("desired_policy"))
        & (F.col("config_digest") == F.col("desired_config"))
        & (F.col("h_build") == F.col("build_digest"))
        & (F.col("h_sbom") == F.col("sbom_digest"))
        & (F.col("drift") == "compliant")
    )
    late = ~known | (F.unix_timestamp(now) - F.unix_timestamp("sent_at") > stale_after)
    return rows.select(
        *nodes.columns,
        known.alias("enrolled"),
        F.coalesce(known & (F.col("claim_class") == "external_attested"), F.lit(False)).alias("external_proof"),
        F.coalesce(
            known & ((F.col("readiness") == "degraded") | (F.col("health") != "healthy")), F.lit(False)
        ).alias("degraded"),
        F.coalesce(compliant, F.lit(False)).alias("compliant"),
        F.coalesce(late, F.lit(True)).alias("stale"),
    )


def compliance_summary(states: DataFrame, *keys: str) -> DataFrame:
    known = F.col("enrolled")
    return states.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(known).alias("enrolled"),
        F.count_if(known & F.col("external_proof")).alias("external_proof"),
        F.count_if(known & ~F.col("external_proof")).alias("claims_only"),
        F.count_if(F.col("degraded")).alias("degraded"),
        F.count_if(known & F.col("compliant")).alias("compliant"),
        F.count_if(known & ~F.col("compliant")).alias("noncompliant"),
        F.count_if(F.col("stale")).alias("stale"),
    )


def tool_activity(events: DataFrame) -> DataFrame:
    both = events.groupBy("action", "result_status").agg(F.count(F.lit(1)).alias("n"))
    items = F.array(
        F.struct(F.lit("action").alias("kind"), F.col("action").alias("label")),
        F.struct(F.lit("result_status").alias("kind"), F.col("result_status").alias("label")),
    )
    rows = both.select(F.explode(items).alias("i"), "n").select("i.*", "n")
    return rows.groupBy("kind", "label").agg(F.sum("n").alias("count"))


def prompt_budget(parts: DataFrame, limit: int, request: str = "request_id") -> DataFrame:
    out = parts.groupBy(request).agg(
        F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes")
    )
    return out.withColumn("over_budget", F.col("chars") > limit)


def alerts(components: DataFrame, now: Column, limit: int = 60) -> DataFrame:
    """Alert rows per component: not ready, stale data, or a state that needs attention.

    `components` carries component, state, required and last_event.
    """
    fine = F.col("state").isin("healthy", "ready")
    age = F.unix_timestamp(now) - F.unix_timestamp("last_event")
    rows = F.array(
        F.when(F.col("required") & ~fine, F.struct(F.lit("readiness").alias("alert"), F.lit("high").alias("severity"), F.col("state").alias("status"))),
        F.when(age > limit, F.struct(F.lit("freshness").alias("alert"), F.lit("medium").alias("severity"), F.lit("stale").alias("status"))),
        F.when(
            ~F.col("required") & ~fine & (F.col("state") != "disabled"),
            F.struct(F.lit("component").alias("alert"), F.lit("medium").alias("severity"), F.col("state").alias("status")),
        ),
    )
    kept = F.filter(rows, lambda r: r.isNotNull())
    return components.select("component", F.explode(kept).alias("a")).select("component", "a.*")
