"""Evaluation and calibration: counts first, metrics from the counts.

Scores are pre-aggregated per distinct value before anything is ordered, and running sums
are blocked by score, so a slice that holds most rows stays spread.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import blocked_running_sum, null_safe_join
from ..functions.rules import rule_frame
from ..session import cut_lineage


def ratio(part: Column, whole: Column) -> Column:
    """0/0 counts as 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def detector_eval(rows: DataFrame, got: DataFrame, want: DataFrame, request: str = "request_id") -> DataFrame:
    """TP, FP, FN over distinct (row, subtype) sets; TN counts rows with both sets empty."""
    mark = lambda df, g, w, subtype: df.select(
        request, subtype.alias("subtype"), F.lit(g).alias("g"), F.lit(w).alias("w")
    )
    name, none = F.col("subtype"), F.lit("")
    # Every row carries one empty mark, so rows with both sets empty are counted too.
    marks = mark(got, 1, 0, name).unionByName(mark(want, 0, 1, name)).unionByName(mark(rows, 0, 0, none))
    pairs = marks.groupBy(request, "subtype").agg(F.max("g").alias("g"), F.max("w").alias("w"))
    per_row = pairs.groupBy(request).agg(
        F.sum(F.col("g") * F.col("w")).alias("tp"),
        F.sum(F.col("g") * (1 - F.col("w"))).alias("fp"),
        F.sum((1 - F.col("g")) * F.col("w")).alias("fn"),
    )
    empty = F.col("tp") + F.col("fp") + F.col("fn") == 0
    return per_row.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("tp"), F.lit(0)).alias("true_positives"),
        F.coalesce(F.sum("fp"), F.lit(0)).alias("false_positives"),
        F.coalesce(F.sum("fn"), F.lit(0)).alias("false_negatives"),
        F.count_if(empty).alias("true_negatives"),
    )


def confusion(answers: DataFrame, *keys: str) -> DataFrame:
    """Per key: tp, fp, fn, tn. `answers` carries want, got and failed.

    A failed call is a miss for wanted answers and counts as a rejection otherwise.
    """
    got = F.col("got") & ~F.col("failed")
    want = F.col("want")
    return answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(want & got).alias("tp"),
        F.count_if(~want & got).alias("fp"),
        F.count_if(want & ~got).alias("fn"),
        F.count_if(~want & ~got).alias("tn"),
        F.coalesce(F.avg(F.when(~F.col("failed"), F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"),
    )


def semantic_metrics(answers: DataFrame, *keys: str) -> DataFrame:
    c = confusion(answers, *keys)
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    out = c.select(
        *keys,
        "rows",
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(tp + tn, F.col("rows")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(fn, fn + tp).alias("fnr"),
        "avg_latency_ms",
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def fit_threshold(scores: DataFrame, keys: Iterable[str], target_fpr: float) -> DataFrame:
    """Lowest observed score whose false positive rate on negatives meets the target.

    `scores` carries confidence and positive. Slices that hold no passing score, or a score
    outside [0, 1], are not evaluated.
    """
    keys = list(keys)
    valid = F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence")
    distinct = scores.groupBy(*keys, "confidence").agg(
        F.count_if(~F.col("positive")).alias("neg"),
        F.count_if("positive").alias("pos"),
        F.bool_and(F.coalesce(valid, F.lit(False))).alias("valid"),
    )
    totals = distinct.groupBy(*keys).agg(
        F.sum("neg").alias("negatives"),
        F.sum("pos").alias("positives"),
        F.bool_and("valid").alias("all_valid"),
    )
    falling = (-F.col("confidence")).alias("falling")
    ranked = blocked_running_sum(
        distinct.withColumn("falling", falling),
        keys,
        F.floor(F.col("falling") * 1000),
        ["falling"],
        F.col("neg"),
        "false_positives",
    )
    judged = ranked.join(totals, keys)
    passing = F.col("all_valid") & (
        (F.col("negatives") == 0) | (F.col("false_positives") / F.col("negatives") <= target_fpr)
    )
    best = judged.groupBy(*keys).agg(
        F.min(F.when(passing, F.col("confidence"))).alias("threshold"),
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
    )
    return best.select(
        *keys,
        F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
        F.col("threshold").isNotNull().alias("evaluated"),
        (F.col("positives") + F.col("negatives")).alias("samples"),
        "positives",
        "negatives",
    )


def promotion_check(
    slices: DataFrame, questions: Iterable[str], languages: Iterable[str], limits: Mapping[str, float]
) -> DataFrame:
    """Violations per required (question, language): missing, unevaluated or out of bounds.

    `slices` carries samples, evaluated, fpr, fnr, precision and recall.
    """
    languages = list(languages)
    grid = rule_frame(
        slices.sparkSession,
        [(q, lang) for q in questions for lang in languages],
        "question string, language string",
    )
    rows = grid.join(slices.withColumn("present", F.lit(True)), ["question", "language"], "left")
    present = F.coalesce("present", F.lit(False))
    checks = (
        ("missing_slice", ~present),
        ("not_evaluated", present & ~F.col("evaluated")),
        ("max_fpr", present & (F.col("fpr") > limits["max_fpr"])),
        ("max_fnr", present & (F.col("fnr") > limits["max_fnr"])),
        ("min_precision", present & (F.col("precision") < limits["min_precision"])),
        ("min_recall", present & (F.col("recall") < limits["min_recall"])),
        ("min_samples", present & (F.col("samples") < limits["min_samples"])),
    )
    failed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda v: v.isNotNull())
    return rows.select("question", "language", F.explode(failed).alias("violation"))


def baseline_regressions(old: DataFrame, new: DataFrame, tolerance: float, key: str = "question") -> DataFrame:
    """Metrics that got worse beyond tolerance; questions only the new run has are ignored."""
    names = ("rows", "fp", "fn", "fpr", "fnr")
    left = old.select(key, *[F.col(n).alias(f"old_{n}") for n in names])
    both = left.join(new.select(key, *names), key)
    slack = tolerance * F.col("rows")

    def row(name: str, cond: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(name).alias("metric"),
                F.col(f"old_{name}").cast("double").alias("old_value"),
                F.col(name).cast("double").alias("new_value"),
            ),
        )

    found = F.array(
        row("rows", F.col("rows") < F.col("old_rows")),
        row("fp", F.col("fp") > F.col("old_fp") + slack),
        row("fn", F.col("fn") > F.col("old_fn") + slack),
        row("fpr", F.col("fpr") > F.col("old_fpr") + tolerance),
        row("fnr", F.col("fnr") > F.col("old_fnr") + tolerance),
    )
    return both.select(key, F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select(key, "v.*")


#: Positions per bin when examples are cut into independent stretches.
BIN = 4096
GOLD, PREDICTED = 0, 1


def _stretches(spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Spans with `stretch`: spans of different stretches never meet.

    A bin begins a stretch if no span of an earlier bin reaches into it. Bins, not spans, are put in order.
    """
    binned = spans.withColumn("bin", F.floor(F.col("start") / width))
    bins = binned.groupBy(*keys, "bin").agg(F.max("end").alias("reach"))
    before = Window.partitionBy(*keys).orderBy("bin")
    reach = F.max("reach").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (reach <= F.col("bin") * width), 1).otherwise(0)
    cut = bins.select(*keys, "bin", new.alias("new"))
    cut = cut.select(*keys, "bin", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    return null_safe_join(binned, cut, [*keys, "bin"]).drop("bin")


class _Sweep:
    """Greedy overlap matching of one stretch: gold spans in order take the first free predicted span they meet.

    Free predicted spans wait in a heap by (start, end). One that ends before a gold span begins meets no later gold
    span either and goes. A gold span is decided once all spans that start before its end are seen, so
    only what overlaps the place of the sweep is held.
    """

    def __init__(self):
        self.waiting: deque = deque()
        self.free: list[tuple[int, int]] = []
        self.matched = 0

    def add(self, side: int, start: int, end: int) -> None:
        while self.waiting and self.waiting[0][1] <= start:
            self._decide()
        if side == GOLD:
            self.waiting.append((start, end))
        else:
            heapq.heappush(self.free, (start, end))

    def _decide(self) -> None:
        start, end = self.waiting.popleft()
        while self.free and self.free[0][1] <= start:
            heapq.heappop(self.free)
        if self.free and self.free[0][0] < end:
            heapq.heappop(self.free)
            self.matched += 1

    def close(self) -> int:
        while self.waiting:
            self._decide()
        return self.matched


def _overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches per (language, entity) of this task; rows come sorted by stretch and start."""
    found: dict = {}
    place = sweep = None
    for pdf in batches:
        columns = ("example", "language", "entity", "stretch", "side", "start", "end")
        for example, language, entity, stretch, side, start, end in zip(*[pdf[c].tolist() for c in columns], strict=True):
            if (example, language, entity, stretch) != place:
                if sweep is not None:
                    found[place[1:3]] = found.get(place[1:3], 0) + sweep.close()
                place, sweep = (example, language, entity, stretch), _Sweep()
            sweep.add(side, start, end)
    if sweep is not None:
        found[place[1:3]] = found.get(place[1:3], 0) + sweep.close()
    yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["language", "entity", "overlap_tp"])


def span_eval(gold: DataFrame, predicted: DataFrame, example: str = "request_id", width: int = BIN) -> DataFrame:
    """Exact and overlap matches per (language, entity); each predicted span is used once.

    Equal spans pair off by counts. For overlaps, gold spans in order of (start, end) take the first free
    predicted span they meet: spans are dealt by stretches that do not touch, sorted, and swept once.
    """
    keys = ["example", "language", "entity"]

    def side(rows: DataFrame, number: int) -> DataFrame:
        return rows.select(F.col(example).alias("example"), "language", "entity", "start", "end", F.lit(number).alias("side"))

    spans = side(gold, GOLD).unionByName(side(predicted, PREDICTED))
    is_gold = F.col("side") == GOLD
    equal = spans.groupBy(*keys, "start", "end").agg(F.count_if(is_gold).alias("gold"), F.count_if(~is_gold).alias("predicted"))
    sums = equal.groupBy("language", "entity").agg(
        F.sum("gold").alias("gold"),
        F.sum("predicted").alias("predicted"),
        F.sum(F.least("gold", "predicted")).alias("exact_tp"),
    )
    # A span without length meets nothing and must not hold a place.
    real = _stretches(spans.where("start < `end`"), keys, width)
    dealt = real.repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "start", "end", "side")
    kinds = dict(spans.dtypes)
    met = dealt.select(*keys, "stretch", "side", "start", "end").mapInPandas(
        _overlaps, f"language {kinds['language']}, entity {kinds['entity']}, overlap_tp long"
    )
    met = met.groupBy("language", "entity").agg(F.sum("overlap_tp").alias("overlap_tp"))
    sums = sums.join(met, ["language", "entity"], "left").withColumn("overlap_tp", F.coalesce("overlap_tp", F.lit(0)).cast("long"))
    return sums.select(
        "language",
        "entity",
        "gold",
        "predicted",
        "exact_tp",
        "overlap_tp",
        *[
            m
            for kind in ("exact", "overlap")
            for m in (
                ratio(F.col(f"{kind}_tp"), F.col("predicted")).alias(f"{kind}_precision"),
                ratio(F.col(f"{kind}_tp"), F.col("gold")).alias(f"{kind}_recall"),
                ratio(F.col("gold") - F.col(f"{kind}_tp"), F.col("gold")).alias(f"{kind}_fnr"),
            )
        ],
    )


def rounded_confidence(v: Column) -> Column:
    return F.when(v < 0.5, 0.25).when(v < 0.75, 0.5).when(v < 0.9, 0.75).otherwise(0.9)


def confidence_candidates(findings: DataFrame) -> DataFrame:
    return findings.select(rounded_confidence(F.col("confidence")).alias("confidence")).distinct()


# ---- provenance ------------------------------------------------------------------------------------------

#: Digests per leaf range that `tree_depth` aims at.
RANGE = 64
CHILD = "array<struct<name:string,digest:string,rows:bigint>>"


def tree_depth(rows: int) -> int:
    """Hex digits of a leaf range, so that one holds about RANGE digests."""
    depth = 0
    while rows > RANGE * 16**depth:
        depth += 1
    return depth


def row_digest(columns: Iterable[str]) -> Column:
    """Digest of a row's values; NULL differs from an empty text."""
    values = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\0", *values), 256)


def node_digest(children: Column) -> Column:
    """Digest of a node from its children in order of their names."""
    spelled = F.transform(children, lambda c: F.concat_ws(":", c["name"], c["digest"], c["rows"]))
    return F.sha2(F.array_join(spelled, ","), 256)


def digest_tree(rows: DataFrame, columns: Iterable[str], depth: int) -> DataFrame:
    """Nodes (`level`, `name`, `digest`, `rows`, `children`) of a hash tree over the rows, whatever their order.

    Leaves are the distinct row digests with their counts. They are spread evenly, so the first `depth` hex
    digits cut them into ranges of like size; a node of level k stands for a prefix of k digits and covers at most 16 nodes. No
    task holds more than one range, equal rows meet as a count.
    """
    leaves = rows.select(row_digest(columns).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    below = leaves.select(F.col("digest").alias("name"), "digest", "rows")
    out = None
    for level in range(depth, -1, -1):
        child = F.struct("name", "digest", "rows")
        grouped = below.groupBy(F.left("name", F.lit(level)).alias("prefix")).agg(
            F.array_sort(F.collect_list(child)).cast(CHILD).alias("children"), F.sum("rows").alias("rows")
        )
        nodes = cut_lineage(
            grouped.select(F.lit(level).alias("level"), F.col("prefix").alias("name"), node_digest(F.col("children")).alias("digest"), "rows", "children")
        )
        out = nodes if out is None else out.unionByName(nodes)
        below = nodes.select("name", "digest", "rows")
    return out


def dataset_digest(rows: DataFrame, *columns: str, depth: int | None = None) -> DataFrame:
    """Provenance digest of a dataset: the rows and the root of their hash tree."""
    depth = tree_depth(rows.count()) if depth is None else depth
    root = digest_tree(rows, columns, depth).where("level = 0").select("rows", "digest")
    # A dataset without rows has the digest of no children.
    empty = F.sha2(F.lit(""), 256)
    return root.groupBy().agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("digest"), empty).alias("digest"))


def inclusion_proofs(rows: DataFrame, tree: DataFrame, columns: Iterable[str], keep: Iterable[str]) -> DataFrame:
    """`keep` columns with `proof`: the children lists from the row's range up to the root; NULL if the tree lacks the range."""
    keep = list(keep)
    levels = [r[0] for r in tree.select("level").distinct().orderBy("level").collect()]
    # The way up is made once per range, so rows travel once and without the lists.
    ways, above = None, 0
    for level in levels:
        nodes = tree.where(F.col("level") == level).select(F.col("name").alias("_name"), F.array("children").alias("_way"))
        if ways is not None:
            upper = ways.select(F.col("_name").alias("_upper"), F.col("_way").alias("_rest"))
            nodes = nodes.join(upper, F.left("_name", F.lit(above)) == F.col("_upper"), "left")
            nodes = nodes.select("_name", F.concat("_way", "_rest").alias("_way"))
        ways, above = nodes, level
    out = rows.select(*keep, row_digest(columns).alias("_digest"))
    if ways is None:
        whole = F.lit(None).cast(f"array<{CHILD}>")
    else:
        out, whole = out.join(ways, F.left("_digest", F.lit(above)) == F.col("_name"), "left"), F.col("_way")
    return out.select(*keep, F.col("_digest").alias("row_digest"), whole.alias("proof"))


def proof_holds(digest: Column, proof: Column, root: Column) -> Column:
    """Whether a row of this digest is under the root: each step holds the digest of the one before it."""
    start = F.struct(digest.alias("digest"), F.lit(True).alias("good"))

    def step(acc: Column, children: Column) -> Column:
        known = F.exists(children, lambda c: c["digest"] == acc["digest"])
        return F.struct(node_digest(children).alias("digest"), (acc["good"] & known).alias("good"))

    end = F.aggregate(proof, start, step)
    return F.coalesce(end["good"] & (end["digest"] == root), F.lit(False))


def status_counts(rows: DataFrame, keys: Iterable[str], status: Column) -> DataFrame:
    """`statuses` per key: (status, count) ascending by status; statuses are a closed set."""
    keys = list(keys)
    counted = rows.groupBy(*keys, status.alias("status")).agg(F.count(F.lit(1)).alias("count"))
    return counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("status", "count"))).alias("statuses"))


def index_quantiles(
    rows: DataFrame, keys: Iterable[str], value: str, quantiles: Iterable[float], block: float = 0.1
) -> DataFrame:
    """Quantiles picked at index int((n - 1) * q), never interpolated.

    Works on distinct values with counts; running counts are blocked by value range.
    """
    keys = list(keys)
    quantiles = list(quantiles)
    distinct = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = distinct.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    running = blocked_running_sum(
        distinct, keys, F.floor(F.col(value) / block), [value], F.col("n"), "upto"
    )
    joined = running.join(totals, keys)

    def pick(q: float) -> Column:
        at = F.floor((F.col("total") - 1) * F.lit(q))
        inside = (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
        return F.max(F.when(inside, F.col(value))).alias(f"p{round(q * 100)}")

    picked = joined.groupBy(*keys).agg(*[pick(q) for q in quantiles])
    return totals.join(picked, keys).withColumnRenamed("total", "samples")


def sketch_quantiles(rows: DataFrame, keys: Iterable[str], value: str, quantiles: Iterable[float], k: int = 400) -> DataFrame:
    """Quantiles from one mergeable KLL sketch per key, in a single small shuffle.

    The rank of an answer is off by at most `sketch_error(k)` of the samples with 99 % confidence, on any distribution;
    `index_quantiles` is exact and costs a shuffle of the distinct values.
    """
    keys, quantiles = list(keys), list(quantiles)
    sketch = F.call_function("kll_sketch_agg_double", F.col(value).cast("double"), F.lit(k)).alias("sketch")
    rows = rows.groupBy(*keys).agg(F.count(value).alias("samples"), F.min(value).alias("min"), F.max(value).alias("max"), sketch)
    picked = [F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(float(q))).alias(f"p{round(q * 100)}") for q in quantiles]
    return rows.select(*keys, "samples", "min", "max", *picked)


def sketch_error(k: int = 400) -> float:
    """Bound on the normalised rank error of a sketch, as published for KLL (single-sided, 99 %)."""
    return 2.296 / k**0.9021
