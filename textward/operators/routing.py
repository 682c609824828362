"""Route choice, response shapes, report comparison, lifecycle checks, rollout selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import carry_fold
from ..functions.ranking import blocked_last, blocked_row_number
from ..functions.rules import rule_list
from .policy import glob_regex, in_cohort

ROUTE_DDL = (
    "id string, class string, provider string, family string, enabled boolean, priority int, "
    "allow string, deny string, aliases map<string,string>, streaming boolean, tools boolean, "
    "chat boolean, responses boolean, messages boolean, embeddings boolean"
)


def route_rows(routes: Iterable[Mapping], order: Iterable[str] | None = None) -> list[dict]:
    """Routes in candidate order: the given chain, else priority, then id; globs compiled."""
    rows = []
    for r in routes:
        caps = r.get("capabilities", ())
        rows.append(
            {
                "id": r["id"],
                "class": r["class"],
                "provider": r["provider"],
                "family": r.get("family", "*"),
                "enabled": r.get("enabled", True),
                "priority": r.get("priority", 0),
                "allow": glob_regex(r["allow"]) if r.get("allow") else None,
                "deny": glob_regex(r["deny"]) if r.get("deny") else None,
                "aliases": dict(r.get("aliases", {})),
                **{c: c in caps for c in ("streaming", "tools", "chat", "responses", "messages", "embeddings")},
            }
        )
    if order is None:
        return sorted(rows, key=lambda r: (r["priority"], r["id"]))
    by_id = {r["id"]: r for r in rows}
    return [by_id[i] for i in order if i in by_id]


def _supports(r: Column, family: Column, capability: Column, stream: Column, tools: Column) -> Column:
    by_family = (
        F.when(family == "anthropic", r["messages"])
        .when(family == "openai", r["chat"] | r["responses"] | r["embeddings"])
        .otherwise(r["chat"] | r["responses"] | r["messages"])
    )
    named = (
        F.when(capability == "chat", r["chat"])
        .when(capability == "responses", r["responses"])
        .when(capability == "messages", r["messages"])
        .when(capability == "embeddings", r["embeddings"])
        .otherwise(by_family)
    )
    return (~stream | r["streaming"]) & (~tools | r["tools"]) & named


def select_route(
    requests: DataFrame, routes: Iterable[Mapping], order: Iterable[str] | None = None
) -> DataFrame:
    """Chosen route and routed model, or the reject reason of highest precedence.

    Requests carry action, family, capability, streaming, tools, requested_provider,
    verified_provider and model. The routes are a constant array: no join, no shuffle.
    """
    c = {n: F.col(n) for n in ("action", "family", "capability", "streaming", "tools", "requested_provider", "verified_provider", "model")}
    local = c["action"] == "FORCE_LOCAL_MODEL"

    def judge(r: Column) -> Column:
        verified, requested = c["verified_provider"], c["requested_provider"]
        provider_bad = (
            (local & (r["class"] != "local"))
            | ((verified != "") & (verified != r["provider"]) & (verified != r["class"]))
            | (~local & (verified == "") & (requested != "") & (requested != r["provider"]) & (requested != r["class"]))
        )
        family_bad = (c["family"] != "") & (r["family"] != "*") & (r["family"] != c["family"])
        fit = _supports(r, c["family"], c["capability"], c["streaming"], c["tools"])
        model = c["model"]
        routed = F.coalesce(F.try_element_at(r["aliases"], model), model)
        denied = F.coalesce(F.rlike(model, r["deny"]) | F.rlike(routed, r["deny"]), F.lit(False))
        open_model = r["allow"].isNull() | F.rlike(model, r["allow"]) | F.rlike(routed, r["allow"])
        model_bad = (model != "") & (denied | ~open_model)
        state = (
            F.when(~r["enabled"], "off")
            .when(provider_bad, "provider")
            .when(family_bad | ~fit, "capability")
            .when(model_bad, "model")
            .otherwise("")
        )
        return F.struct(state.alias("state"), r["id"].alias("id"), routed.alias("routed"))

    # Forcing a local model keeps only local candidates, so others never count as rejected.
    candidates = F.filter(
        rule_list(route_rows(routes, order), ROUTE_DDL), lambda r: ~local | (r["class"] == "local")
    )
    rows = requests.withColumn("_j", F.transform(candidates, judge))
    best = F.get(F.filter("_j", lambda j: j["state"] == ""), F.lit(0))
    saw = lambda state: F.exists("_j", lambda j: j["state"] == state)
    reason = (
        F.when(best.isNotNull(), "")
        .when(saw("model"), "ROUTE_MODEL_REJECTED")
        .when(saw("capability"), "ROUTE_CAPABILITY_REJECTED")
        .when(local, "ROUTE_LOCAL_UNAVAILABLE")
        .when(saw("provider"), "ROUTE_PROVIDER_REJECTED")
        .otherwise("ROUTE_UNAVAILABLE")
    )
    return rows.select(
        *requests.columns,
        F.coalesce(best["id"], F.lit("")).alias("route"),
        F.coalesce(best["routed"], F.lit("")).alias("routed_model"),
        reason.alias("reject"),
    )


# ---- response shapes ------------------------------------------------------------------------------------

SHAPE = (
    "struct<object:string,model:string,usage:variant,stop_reason:string,"
    "choices:array<struct<finish_reason:string,message:struct<content:variant,tool_calls:array<variant>>>>,"
    "content:array<struct<text:string,type:string>>>"
)


def _text_bytes(r: Column) -> Column:
    shown = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    choices = F.transform(
        r["choices"], lambda c: F.coalesce(F.octet_length(shown(c["message"]["content"])), F.lit(0))
    )
    blocks = F.transform(r["content"], lambda b: F.coalesce(F.octet_length(b["text"]), F.lit(0)))
    empty = F.array().cast("array<int>")
    total = F.concat(F.coalesce(choices, empty), F.coalesce(blocks, empty))
    return F.aggregate(total, F.lit(0), lambda acc, n: acc + n)


def _tool_calls(r: Column) -> Column:
    calls = F.transform(
        r["choices"], lambda c: F.greatest(F.size(c["message"]["tool_calls"]), F.lit(0))
    )
    listed = F.aggregate(F.coalesce(calls, F.array().cast("array<int>")), F.lit(0), lambda acc, n: acc + n)
    return listed + F.coalesce(F.size(F.filter(r["content"], lambda b: b["type"] == "tool_use")), F.lit(0)) * F.when(
        r["content"].isNull(), 0
    ).otherwise(1)


def _count(values: Column) -> Column:
    return F.when(values.isNull(), 0).otherwise(F.size(values))


def _shape(r: Column) -> Column:
    last_finish = F.element_at(
        F.concat(
            F.array(F.lit("")),
            F.coalesce(
                F.transform(r["choices"], lambda c: F.coalesce(c["finish_reason"], F.lit(""))),
                F.array().cast("array<string>"),
            ),
        ),
        -1,
    )
    return F.struct(
        F.coalesce(r["model"], F.lit("")).alias("model"),
        _count(r["choices"]).alias("choices"),
        _text_bytes(r).alias("text_bytes"),
        _tool_calls(r).alias("tool_calls"),
        last_finish.alias("finish"),
        F.coalesce(r["stop_reason"], F.lit("")).alias("stop"),
        r["usage"].isNotNull().alias("usage"),
    )


def sse_events(body: Column) -> Column:
    """Data payloads of a server-sent event body, one per event."""
    blocks = F.split(body, "\n\n+")
    data = F.transform(
        blocks,
        lambda b: F.array_join(
            F.transform(
                F.filter(F.split(b, "\n"), lambda line: F.startswith(line, F.lit("data:"))),
                lambda line: F.trim(F.substr(line, F.lit(6))),
            ),
            "\n",
        ),
    )
    return F.filter(data, lambda d: d != "")


def response_shape(bodies: DataFrame, keys: Iterable[str] = ("request_id",)) -> DataFrame:
    """Shape of JSON or event-stream responses (`body`, `kind`); merged over a stream's events."""
    stream = F.col("kind") == "sse"
    payloads = F.when(stream, F.filter(sse_events(F.col("body")), lambda d: d != "[DONE]")).otherwise(
        F.array("body")
    )
    rows = bodies.withColumn("_p", payloads)
    rows = rows.withColumn("_r", F.transform("_p", lambda p: F.try_variant_get(F.try_parse_json(p), "$", SHAPE)))
    rows = rows.withColumn("_s", F.transform("_r", _shape))
    total = lambda n: F.aggregate("_s", F.lit(0), lambda acc, s: acc + s[n])
    last = lambda n: F.element_at(
        F.concat(F.array(F.lit("")), F.filter(F.transform("_s", lambda s: s[n]), lambda v: v != "")), -1
    )
    return rows.select(
        *keys,
        "kind",
        F.size("_s").alias("events"),
        total("choices").alias("choices"),
        total("text_bytes").alias("text_bytes"),
        total("tool_calls").alias("tool_calls"),
        last("model").alias("model"),
        last("finish").alias("finish"),
        last("stop").alias("stop"),
        F.exists("_s", lambda s: s["usage"]).alias("usage"),
        (stream & (F.contains("body", F.lit("[DONE]")) | (last("stop") != ""))).alias("done"),
    )


# ---- reports --------------------------------------------------------------------------------------------


def report_compare(base: DataFrame, candidate: DataFrame, case: str = "case_id") -> DataFrame:
    """Differences per case: presence, status and shape (`status`, `shape` columns)."""
    b = base.select(case, F.col("status").alias("b_status"), F.col("shape").alias("b_shape"), F.lit(True).alias("b"))
    c = candidate.select(case, F.col("status").alias("c_status"), F.col("shape").alias("c_shape"), F.lit(True).alias("c"))
    rows = b.join(c, case, "full")
    both = F.col("b").isNotNull() & F.col("c").isNotNull()

    def diff(kind: str, cond: Column, old: Column, new: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), old.alias("baseline"), new.alias("candidate")))

    none = F.lit("")
    found = F.array(
        diff("case_presence", ~both, none, none),
        diff("status", both & (F.col("b_status") != F.col("c_status")), F.col("b_status"), F.col("c_status")),
        diff("semantic_shape", both & ~F.col("b_shape").eqNullSafe(F.col("c_shape")), none, none),
    )
    return rows.select(case, F.explode(F.filter(found, lambda d: d.isNotNull())).alias("d")).select(case, "d.*")


def latency_delta(base: DataFrame, candidate: DataFrame, duration: str) -> DataFrame:
    """One row: total duration of the candidate's cases less that of the baseline's."""
    both = base.select((-F.col(duration)).alias("d")).unionByName(candidate.select(F.col(duration).alias("d")))
    return both.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("latency_delta_ms"))


def report_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("required").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
    )


# ---- lifecycle ------------------------------------------------------------------------------------------

# Allowed model state transitions; '' is an unregistered model.
TRANSITIONS = {
    "": ("registered",),
    "registered": ("validated", "revoked"),
    "validated": ("shadow", "canary", "promoted", "revoked"),
    "shadow": ("canary", "paused", "revoked"),
    "canary": ("promoted", "paused", "rolled_back", "revoked"),
    "promoted": ("paused", "rolled_back", "retired", "revoked"),
    "paused": ("shadow", "canary", "promoted", "rolled_back", "retired", "revoked"),
    "rolled_back": ("retired", "revoked"),
    "retired": ("revoked",),
    "revoked": (),
}
STATES = tuple(TRANSITIONS)
RECORDS_PER_BLOCK = 512


def _allowed_sql(state: str, to: str) -> str:
    """Next state: `to` where the edge exists, else unchanged. States are numbers."""
    edges = [
        f"({state} = {i} AND {to} IN ({','.join(str(STATES.index(t)) for t in targets)}))"
        for i, targets in enumerate(TRANSITIONS.values())
        if targets
    ]
    return f"CASE WHEN {' OR '.join(edges)} THEN {to} ELSE {state} END"


def _walk_maps(model: str):
    def fold(state, pdf: pd.DataFrame):
        state = 0 if state is None else state
        starts = []
        for ends in pdf["ends"]:
            starts.append(state)
            state = int(ends[state])
        return state, pd.DataFrame({model: pdf[model], "part": pdf["part"], "start": starts})

    return fold


def lifecycle_check(requests: DataFrame, model: str, block: Column, order: Iterable[str], key: str) -> DataFrame:
    """Each request with the state before it, and whether its transition is allowed.

    A rejected request leaves the state unchanged, so the state is a fold. Every block of
    512 requests is first reduced to the map from any start state to its end state; the
    maps compose over a model's blocks, and each block then replays from its known start.
    Duplicate idempotency keys keep the first request.
    """
    order = list(order)
    firsts = requests.groupBy(key).agg(F.min_by(F.struct(*requests.columns), F.struct(*order)).alias("r")).select("r.*")
    number = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("to_state")).cast("int") - 1
    seq = blocked_row_number(firsts.withColumn("to", number), [model], block, order, "seq")
    seq = seq.withColumn("part", F.floor((F.col("seq") - 1) / RECORDS_PER_BLOCK))
    groups = seq.groupBy(model, "part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "to"))).alias("items")
    )
    step = _allowed_sql("s", "x.to")
    ends = F.expr(
        f"transform(sequence(0, {len(STATES) - 1}), i -> aggregate(items, i, (s, x) -> {step}))"
    )
    mapped = groups.withColumn("ends", ends)
    # One row per block of 512 requests: the maps are walked in order with one state number.
    kind = dict(mapped.dtypes)[model]
    starts = carry_fold(
        mapped.select(F.col(model), "part", "ends"),
        model,
        ["part"],
        _walk_maps(model),
        f"`{model}` {kind}, part bigint, start int",
    )
    mapped = mapped.join(starts, [model, "part"])
    replay = F.expr(
        f"""aggregate(items, named_struct('s', start, 'out',
            CAST(array() AS array<struct<seq:bigint,before:int,after:int>>)),
          (acc, x) -> transform(array(transform(array(acc.s), s -> {step})[0]), n -> named_struct('s', n, 'out',
            concat(acc.out, array(named_struct('seq', x.seq, 'before', acc.s, 'after', n)))))[0],
          acc -> acc.out)"""
    )
    states = mapped.select(model, F.explode(replay).alias("x")).select(model, "x.*")
    names = F.array(*[F.lit(s) for s in STATES])
    out = seq.join(states, [model, "seq"])
    return out.select(
        *requests.columns,
        "seq",
        F.get(names, F.col("before")).alias("from_state"),
        (F.col("before") != F.col("after")).alias("allowed"),
        F.get(names, F.col("after")).alias("state"),
    )


ACTIVATING = ("promoted", "rolled_back")


def champions(checked: DataFrame, registry: str, model: str, block: Column, order: Iterable[str]) -> DataFrame:
    """Checked requests with `active`, the champion of their registry after each, and `rollback_target`.

    An allowed promotion or rollback makes its model the champion. A promotion that replaces another model remembers
    that one as its rollback parent; `rollback_target` is the parent of the present champion, the only
    model that an automatic rollback may go to. Both are last values before a row, looked up in blocks: a registry with most of the
    requests is many of them.
    """
    order = list(order)
    activates = F.col("allowed") & F.col("to_state").isin(*ACTIVATING)
    rows = blocked_last(checked, [registry], block, order, {"active_before": F.when(activates, F.col(model))})
    rows = rows.withColumn("active", F.when(activates, F.col(model)).otherwise(F.col("active_before")))
    replaced = F.col("allowed") & (F.col("to_state") == "promoted") & (F.col("active_before") != F.col(model))
    rows = rows.withColumn("parent", F.when(replaced, F.col("active_before")))
    # Parents are facts about the promoted model, and every request asks about the champion; a fact comes before its own request.
    place = [F.col(registry).alias("_registry"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], block.alias("_at")]
    facts = rows.where("parent IS NOT NULL").select(*place, F.col(model).alias("_model"), F.lit(0).alias("_ask"), F.col("parent").alias("_parent"))
    asks = rows.select(*place, F.col("active").alias("_model"), F.lit(1).alias("_ask"), F.lit(None).cast(dict(rows.dtypes)["parent"]).alias("_parent"))
    marks = [f"_o{i}" for i in range(len(order))]
    told = blocked_last(facts.unionByName(asks), ["_registry", "_model"], F.col("_at"), [*marks, "_ask"], {"rollback_target": F.col("_parent")})
    told = told.where("_ask = 1").select("_registry", *marks, "rollback_target")
    on = [rows[registry].eqNullSafe(told["_registry"]), *[rows[c].eqNullSafe(told[m]) for c, m in zip(order, marks)]]
    return rows.join(told, reduce(lambda a, b: a & b, on)).drop("_registry", *marks, "active_before")


# ---- rollout --------------------------------------------------------------------------------------------


def version_key(version: Column) -> Column:
    """Up to three numeric parts as an array that compares like a version."""
    parts = F.split(F.regexp_replace(version, "^v", ""), r"\.")
    return F.transform(
        F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0))
    )


def selected(value: Column, selectors: Iterable[str]) -> Column:
    """'*' accepts everything; an empty list accepts nothing."""
    selectors = list(selectors)
    if "*" in selectors:
        return F.lit(True)
    return value.isin(*selectors) if selectors else F.lit(False)


def rollout_eligible(nodes: DataFrame, wanted: Mapping, percent: int) -> DataFrame:
    """Nodes with `eligible` (selectors, capabilities, version) and `assigned` (cohort)."""
    needed = F.array(*[F.lit(c) for c in wanted["capabilities"]]).cast("array<string>")
    floor = F.array(*[F.lit(int(p)) for p in (wanted["minimum_version"].lstrip("v").split(".") + ["0", "0"])[:3]])
    ok = (
        selected(F.col("tenant"), wanted["tenants"])
        & selected(F.col("environment"), wanted["environments"])
        & selected(F.col("region"), wanted["regions"])
        & (F.size(F.array_except(needed, "capabilities")) == 0)
        & (version_key(F.col("version")) >= floor)
    )
    cohort = in_cohort(F.col("node"), F.col("tenant"), F.col("environment"), F.lit(True), percent)
    return nodes.withColumn("eligible", ok).withColumn("assigned", ok & cohort)
