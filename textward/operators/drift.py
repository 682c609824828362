"""Distribution drift: bucketed counts, divergence metrics and the window status fold."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 32
FLOOR = 1e-9
VALID_LABEL = "^[A-Za-z0-9_.-]{1,32}$"


def drift_buckets(samples: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Counts per label: the first 32 seen per key by name, all later ones together as `other`.

    Labels that are no valid names count as `invalid`. Every sample is in one bucket. Labels are
    counted before they are ranked; a key with very many labels is combined map-side.
    """
    keys = list(keys)
    label = F.when(F.col("label").rlike(VALID_LABEL), F.col("label")).otherwise(F.lit(None).cast("string"))
    counted = samples.withColumn("label", label).groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first_seen")
    )
    seen = Window.partitionBy(*keys, F.col("label").isNull()).orderBy("first_seen", "label")
    bucket = (
        F.when(F.col("label").isNull(), "invalid")
        .when(F.row_number().over(seen) <= MAX_BUCKETS, F.col("label"))
        .otherwise("other")
    )
    ranked = counted.withColumn("bucket", bucket)
    return ranked.groupBy(*keys, F.col("bucket").alias("label")).agg(F.sum("n").alias("count"))


def compare(rows: DataFrame, keys: Iterable[str], current: Column, baseline: Column) -> DataFrame:
    """PSI, Jensen-Shannon and Kolmogorov-Smirnov per key between two halves of one table.

    One pass counts both sides per label, which is the full outer join on labels. A key holds
    at most 32 labels, so the windows over labels are small.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys, "label").agg(
        F.count_if(current).alias("a"), F.count_if(baseline).alias("b")
    )
    return divergence(counts, keys)


def divergence(counts: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Metrics from counts `a` (current) and `b` (baseline) per label."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    rows = counts.filter((F.col("a") > 0) | (F.col("b") > 0))
    rows = rows.withColumn("ta", F.sum("a").over(whole)).withColumn("tb", F.sum("b").over(whole))
    share = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(F.lit(0.0))
    rows = rows.withColumn("x", share("a", "ta")).withColumn("y", share("b", "tb"))
    upto = whole.orderBy("label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("gap", F.abs(F.sum("x").over(upto) - F.sum("y").over(upto)))
    x, y = F.col("x"), F.col("y")
    fx, fy = F.greatest(x, F.lit(FLOOR)), F.greatest(y, F.lit(FLOOR))
    mid = (x + y) / 2
    half = lambda v: F.when(v > 0, v * F.ln(v / mid) / 2).otherwise(F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.sum("a").alias("samples"),
        F.sum("b").alias("baseline_samples"),
        F.sum((fx - fy) * F.ln(fx / fy)).alias("psi"),
        F.sum(half(x) + half(y)).alias("js"),
        F.max("gap").alias("ks"),
    )


def wilson(n: Column) -> tuple[Column, Column]:
    """95 % interval at p = 0.5."""
    z, p = 1.96, 0.5
    size = n.cast("double")
    den = 1 + z * z / size
    center = (p + z * z / (2 * size)) / den
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / den
    low = F.when(n > 0, F.greatest(F.lit(0.0), center - half)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), center + half)).otherwise(F.lit(0.0))
    return low, high


def breached(policy: Mapping[str, float]) -> Column:
    return (
        (F.col("psi") >= policy["psi_action"])
        | (F.col("js") >= policy["js_warning"])
        | (F.col("ks") >= policy["ks_warning"])
    )


# None, warning, freeze_promotion, pause_canary, rollback_champion, incident_quarantine.
FOLD = """
aggregate(windows,
  named_struct('sustained', 0, 'acted', CAST(NULL AS timestamp),
    'out', CAST(array() AS array<struct<at:timestamp,sustained:int,action:string>>)),
  (acc, w) -> CASE WHEN w.samples < {min_samples} THEN named_struct(
      'sustained', acc.sustained, 'acted', acc.acted, 'out', concat(acc.out, array(named_struct(
        'at', w.at, 'sustained', acc.sustained, 'action', 'none'))))
    ELSE transform(array(CASE WHEN w.breach THEN acc.sustained + 1 ELSE greatest(acc.sustained - 1, 0) END), s ->
      transform(array(CASE
          WHEN s < {sustained} THEN 'warning'
          WHEN NOT ({cooldown} = 0 OR acc.acted IS NULL
            OR unix_timestamp(w.at) - unix_timestamp(acc.acted) >= {cooldown}) THEN 'freeze_promotion'
          WHEN {rollback} AND w.scopes >= 2 THEN '{rollback_action}'
          ELSE 'pause_canary' END), a -> named_struct(
        'sustained', s, 'acted', CASE WHEN a IN ('pause_canary', '{rollback_action}') THEN w.at ELSE acc.acted END,
        'out', concat(acc.out, array(named_struct('at', w.at, 'sustained', s, 'action', a)))))[0])[0] END,
  acc -> acc.out)"""


def drift_status(windows: DataFrame, keys: Iterable[str], policy: Mapping) -> DataFrame:
    """Sustained breaches and the action per window, in window order.

    Each baseline's evaluated windows (one row per day or hour, not per event) fold in one
    expression: +1 on a breach, -1 otherwise, then warning, freeze, pause or rollback.
    """
    keys = list(keys)
    rows = windows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("at", "samples", "breach", "scopes"))).alias("windows")
    )
    fold = FOLD.format(
        min_samples=int(policy["min_samples"]),
        sustained=int(policy["sustained_windows"]),
        cooldown=int(policy["cooldown_seconds"]),
        rollback=str(bool(policy["auto_rollback"] and policy["healthy_target"])).lower(),
        rollback_action="incident_quarantine" if policy.get("allow_quarantine") else "rollback_champion",
    )
    return rows.select(*keys, F.explode(F.expr(fold)).alias("s")).select(*keys, "s.*")
