"""Policy decisions: candidates from broadcast rules, then the best per request.

A decision is one ordered minimum. Every stage contributes candidate rows carrying
(stage order, falling severity, falling priority, rule); `min` over that struct picks the
winner with a map-side combine, so a request costs one shuffle of a few small rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import cohort_slot
from ..functions.rules import (
    attach,
    case_map,
    first_rule,
    most_specific_first,
    open_or_equal,
    rule_frame,
    rule_list,
    wildcard,
)

# Action severities.
SEVERITY = {
    "BLOCK": 7,
    "RESTRICT_TOOLS": 6,
    "FORCE_LOCAL_MODEL": 5,
    "REVIEW": 4,
    "TOKENIZE": 3,
    "REDACT": 2,
    "ALLOW": 1,
}
# Precedence of the decision stages.
STAGES = (
    "explicit_deny",
    "canonicalization",
    "secret",
    "tenant",
    "application",
    "role",
    "pii",
    "semantic",
    "default",
)
# Result codes per stage.
CODES = {
    "explicit_deny": "POLICY_DENIED",
    "canonicalization": "EVASION_REJECTED",
    "secret": "SECRET_DETECTED",
    "tenant": "TENANT_RESTRICTED",
    "application": "APPLICATION_RESTRICTED",
    "role": "ROLE_RESTRICTED",
    "pii": "PII_DETECTED",
    "default": "",
}
# Default actions of the evasion stage where no rule is set.
EVASION_DEFAULT = {"SECRET": "BLOCK", "PII": "REVIEW"}

CANDIDATE = (
    "struct<stage_order:int,neg_severity:int,neg_priority:int,tie:string,rule:string,"
    "action:string,stage:string,code:string>"
)


@dataclass(frozen=True)
class Policy:
    """Validated policy document, already parsed."""

    id: str
    version: int
    default: str = "ALLOW"
    safe_default: str = ""
    deny: tuple[Mapping, ...] = ()
    secrets: Mapping[str, str] = field(default_factory=dict)
    pii: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    targets: Mapping[str, str] = field(default_factory=dict)
    provider_subtypes: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    provider_categories: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    subtype_actions: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    category_actions: Mapping[str, str] = field(default_factory=dict)
    confidence: tuple[Mapping, ...] = ()
    counts: tuple[Mapping, ...] = ()
    evasion: Mapping[str, str] = field(default_factory=dict)
    budget_action: str = "BLOCK"
    tenants: Mapping[str, str] = field(default_factory=dict)
    applications: Mapping[str, str] = field(default_factory=dict)
    roles: Mapping[str, str] = field(default_factory=dict)
    semantic: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    fallback: tuple[Mapping, ...] = ()


def expand_legacy(p: Policy) -> Policy:
    """Older document forms expressed as category, subtype, provider and count rules."""
    categories = dict(p.category_actions)
    subtypes = {c: dict(s) for c, s in p.subtype_actions.items()}
    by_provider = {k: dict(v) for k, v in p.provider_subtypes.items()}
    by_category = {k: dict(v) for k, v in p.provider_categories.items()}
    confidence, counts = list(p.confidence), list(p.counts)
    bare = not (categories or subtypes or by_provider or by_category or confidence or counts)
    if bare and not p.safe_default:
        categories["SECRET"] = "REDACT"
        if p.pii:
            categories["PII"] = "ALLOW"
        confidence.append(
            {
                "id": "compat-high-confidence-finding",
                "category": "SECRET",
                "min_confidence": 0.9,
                "action": "BLOCK",
            }
        )
    if p.secrets:
        categories.setdefault("SECRET", "REDACT")
    if p.pii:
        categories.setdefault("PII", "ALLOW")
    for subtype, action in p.secrets.items():
        subtypes.setdefault("SECRET", {}).setdefault(subtype, action)
    for subtype, providers in p.pii.items():
        for provider, action in providers.items():
            by_provider.setdefault(provider, {}).setdefault(subtype, action)
    for provider, action in p.targets.items():
        slot = by_category.setdefault(provider, {})
        if action:
            slot.setdefault("PII", action)
    for provider, action in p.pii.get("MULTIPLE_PII", {}).items():
        counts.append(
            {
                "id": f"compat-multiple-pii-{provider}",
                "category": "PII",
                "provider": provider,
                "min_count": 3,
                "action": action,
                "shown": f"pii.MULTIPLE_PII.{provider}",
            }
        )
    return Policy(
        **{
            **p.__dict__,
            "safe_default": p.safe_default or "BLOCK",
            "category_actions": categories,
            "subtype_actions": subtypes,
            "provider_subtypes": by_provider,
            "provider_categories": by_category,
            "confidence": tuple(confidence),
            "counts": tuple(counts),
        }
    )


RULE_DDL = (
    "rule string, stage string, category string, subtype string, provider string, "
    "action string, threshold double, min_count int"
)

RULE_DDL_COLUMNS = tuple(c.split()[0] for c in RULE_DDL.split(","))


def _count_rule(rule: Mapping) -> str:
    return rule.get("shown") or "count." + rule["id"]


def rule_rows(p: Policy) -> list[tuple]:
    """The document as one flat rule table sorted by rule id."""
    rows: list[tuple] = []

    def add(rule, stage, action, category=None, subtype=None, provider=None, thr=None, n=None):
        rows.append((rule, stage, category, subtype, provider, action, thr, n))

    for cat, action in p.category_actions.items():
        add(f"category_actions.{cat}", "category", action, cat)
    for cat, subs in p.subtype_actions.items():
        for sub, action in subs.items():
            add(f"subtype_actions.{cat}.{sub}", "subtype", action, cat, sub)
    for prov, cats in p.provider_categories.items():
        for cat, action in cats.items():
            add(f"providers.{prov}.categories.{cat}", "provider_boundary", action, cat, None, prov)
    for prov, subs in p.provider_subtypes.items():
        for sub, action in subs.items():
            add(f"providers.{prov}.subtypes.{sub}", "provider_subtype", action, None, sub, prov)
    for r in p.confidence:
        add(
            f"confidence.{r['id']}", "confidence_escalation", r["action"], r["category"],
            r.get("subtype"), r.get("provider"), float(r["min_confidence"]),
        )
    for r in p.counts:
        add(
            _count_rule(r), "finding_count_escalation", r["action"], r["category"],
            r.get("subtype"), r.get("provider"), None, int(r["min_count"]),
        )
    for kind, action in p.evasion.items():
        add(f"evasion.{kind}", "canonicalization", action, "EVASION", kind)
    if p.budget_action:
        add("evasion.budget", "canonicalization", p.budget_action, "EVASION", "budget_exceeded")
    add("safe_default", "safe_default", p.safe_default)
    add("default", "default", p.default)
    return sorted(rows, key=lambda r: r[0])


def policy_rules(spark: SparkSession, p: Policy) -> DataFrame:
    return rule_frame(spark, rule_rows(expand_legacy(p)), RULE_DDL)


def severity(action: Column) -> Column:
    return case_map(action, SEVERITY, 0)


def stage_of(category: Column) -> Column:
    return F.when(category == "SECRET", "secret").otherwise("pii")


def code_of(stage: Column) -> Column:
    return case_map(stage, CODES)


# ---- candidates from findings -------------------------------------------------------------


def finding_groups(findings: DataFrame, request: str = "request_id") -> DataFrame:
    """Findings per (request, provider, category, subtype): count and highest confidence.

    All finding rules depend on these two numbers only, so the decision runs on this small
    frame. Aggregates map-side before its one shuffle.
    """
    return findings.groupBy(request, "provider", "category", "subtype").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("max_confidence")
    )


def _lookup_rows(p: Policy) -> list[tuple]:
    """(key, action, priority, specific): key equals the rule name shown in decisions."""
    rows = [(f"secrets.{s}", a, 10) for s, a in p.secrets.items()]
    rows += [(f"pii.{s}.{v}", a, 10) for s, m in p.pii.items() for v, a in m.items()]
    rows += [(f"targets.{v}", a, 5) for v, a in p.targets.items() if a]
    rows += [
        (f"providers.{v}.subtypes.{s}", a, 9)
        for v, m in p.provider_subtypes.items()
        for s, a in m.items()
    ]
    rows += [
        (f"providers.{v}.categories.{c}", a, 5)
        for v, m in p.provider_categories.items()
        for c, a in m.items()
    ]
    rows += [
        (f"subtype_actions.{c}.{s}", a, 8)
        for c, m in p.subtype_actions.items()
        for s, a in m.items()
    ]
    rows += [(f"category_actions.{c}", a, 4) for c, a in p.category_actions.items()]
    return rows


def _join_name(*parts) -> Column:
    return F.concat_ws(".", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def finding_actions(groups: DataFrame, policy: Policy) -> DataFrame:
    """Most specific action per finding group: action, rule and priority columns added."""
    p = expand_legacy(policy)
    cat, sub, prov = F.col("category"), F.col("subtype"), F.col("provider")
    keys = (
        F.when(cat == "SECRET", _join_name("secrets", sub)),
        F.when(cat == "PII", _join_name("pii", sub, prov)),
        F.when(cat == "PII", _join_name("targets", prov)),
        _join_name("providers", prov, "subtypes", sub),
        _join_name("providers", prov, "categories", cat),
        _join_name("subtype_actions", cat, sub),
        _join_name("category_actions", cat),
    )
    table = {
        key: {"action": action, "rule": key, "priority": priority}
        for key, action, priority in _lookup_rows(p)
    }
    out = groups
    for i, key in enumerate(keys):
        out = attach(out, f"_rule{i}", key, table, "action string, rule string, priority int")
    fallback = F.struct(
        F.lit(p.safe_default).alias("action"),
        F.lit("safe_default").alias("rule"),
        F.lit(0).alias("priority"),
    )
    base = F.coalesce(*[F.col(f"_rule{i}") for i in range(len(keys))], fallback)
    return out.select(*groups.columns, base.alias("base")).select(*groups.columns, "base.*")


def _escalations(rows: Iterable[Mapping], value: str) -> list[dict]:
    return [
        {
            "rule": r["rule"],
            "category": r["category"],
            "subtype": r.get("subtype"),
            "provider": r.get("provider"),
            "bound": float(r[value]),
            "action": r["action"],
        }
        for r in rows
    ]


ESCALATION_DDL = (
    "rule string, category string, subtype string, provider string, bound double, action string"
)


def _applying(rules: Column, measure) -> Column:
    """Escalations of the row's category, provider and subtype whose bound is reached."""
    hits = F.filter(
        rules,
        lambda r: (r["category"] == F.col("category"))
        & open_or_equal(r["subtype"], F.col("subtype"))
        & open_or_equal(r["provider"], F.col("provider"))
        & (measure(r) >= r["bound"]),
    )
    return F.transform(
        hits,
        lambda r: F.struct(
            r["action"].alias("action"), r["rule"].alias("rule"), F.lit(1).alias("priority")
        ),
    )


def confidence_escalations(groups: DataFrame, policy: Policy) -> Column:
    p = expand_legacy(policy)
    rows = [{**r, "rule": "confidence." + r["id"]} for r in p.confidence]
    rules = rule_list(_escalations(rows, "min_confidence"), ESCALATION_DDL)
    return _applying(rules, lambda r: F.col("max_confidence"))


def count_escalations(groups: DataFrame, policy: Policy) -> Column:
    """Needs `category_total` beside `n`; a rule without subtype counts the category."""
    p = expand_legacy(policy)
    rows = [{**r, "rule": _count_rule(r)} for r in p.counts]
    rules = rule_list(_escalations(rows, "min_count"), ESCALATION_DDL)
    return _applying(
        rules, lambda r: F.when(r["subtype"].isNull(), F.col("category_total")).otherwise(F.col("n"))
    )


def with_category_total(groups: DataFrame, request: str = "request_id") -> DataFrame:
    """Findings per request and category; a group holds one row per subtype."""
    total = F.sum("n").over(Window.partitionBy(request, "category"))
    return groups.withColumn("category_total", total)


def finding_candidates(groups: DataFrame, policy: Policy, request: str = "request_id") -> DataFrame:
    """Base, confidence and count candidates of every finding group."""
    scored = finding_actions(with_category_total(groups, request), policy)
    base = F.array(F.struct("action", "rule", "priority"))
    options = F.concat(
        base, confidence_escalations(scored, policy), count_escalations(scored, policy)
    )
    rows = scored.select(request, "category", F.explode(options).alias("c"))
    return rows.select(request, "category", "c.action", "c.rule", "c.priority")


def candidate(stage: Column, action: Column, rule: Column, priority: Column, tie=None) -> Column:
    order = case_map(stage, {s: i for i, s in enumerate(STAGES)})
    return F.struct(
        order.cast("int").alias("stage_order"),
        (-severity(action)).cast("int").alias("neg_severity"),
        (-priority).cast("int").alias("neg_priority"),
        (rule if tie is None else tie).alias("tie"),
        rule.alias("rule"),
        action.alias("action"),
        stage.alias("stage"),
        code_of(stage).alias("code"),
    )


def best_candidates(candidates: DataFrame, *keys: str) -> DataFrame:
    """Severest action, then highest priority, then first rule name, per key."""
    order = F.struct(
        (-severity(F.col("action"))).alias("s"),
        (-F.col("priority")).alias("p"),
        F.col("rule").alias("rule"),
        F.col("action").alias("action"),
        F.col("priority").alias("priority"),
    )
    best = candidates.groupBy(*keys).agg(F.min(order).alias("b"))
    return best.select(*keys, "b.action", "b.rule", "b.priority")


# ---- identity stages ------------------------------------------------------------------------

DENY_DDL = "position int, application string, tenant string, subject string, role string, action string"


def deny_rule(policy: Policy, application: Column, tenant: Column, subject: Column, roles: Column) -> Column:
    """First deny rule whose set matchers all hold; rules without matchers never apply."""
    rows = [
        {"position": i, **r}
        for i, r in enumerate(policy.deny)
        if any(r.get(k) for k in ("application", "tenant", "subject", "role"))
    ]
    return first_rule(
        rule_list(rows, DENY_DDL),
        lambda r: open_or_equal(r["application"], application)
        & open_or_equal(r["tenant"], tenant)
        & open_or_equal(r["subject"], subject)
        & (r["role"].isNull() | F.coalesce(F.array_contains(roles, r["role"]), F.lit(False))),
    )


def with_named_rule(df: DataFrame, table: Mapping[str, str], name: str) -> DataFrame:
    """`df` with `{name}_action` from a table keyed by the column `name`."""
    rules = {k: {"action": v} for k, v in table.items()}
    out = attach(df, f"_{name}", F.col(name), rules, "action string")
    return out.withColumn(f"{name}_action", F.col(f"_{name}.action")).drop(f"_{name}")


def role_candidates(requests: DataFrame, policy: Policy, request: str = "request_id") -> DataFrame:
    rows = requests.select(request, F.explode("roles").alias("role"))
    hit = with_named_rule(rows, policy.roles, "role").filter("role_action IS NOT NULL")
    return hit.select(
        request,
        F.col("role_action").alias("action"),
        F.concat(F.lit("roles."), F.col("role")).alias("rule"),
        F.lit(1).alias("priority"),
    )


def semantic_candidates(signals: DataFrame, policy: Policy, request: str = "request_id") -> DataFrame:
    """Triggered signals whose (question, risk) has an action."""
    table = {f"{q}.{risk}": {"action": a} for q, m in policy.semantic.items() for risk, a in m.items()}
    key = F.concat_ws(".", "question", "risk")
    hit = attach(signals.filter("triggered"), "_rule", key, table, "action string")
    hit = hit.filter("_rule IS NOT NULL").withColumn("action", F.col("_rule.action"))
    return hit.select(
        request,
        "action",
        F.concat_ws(".", F.lit("semantic"), "question", "risk").alias("rule"),
        F.lit(0).alias("priority"),
        "question",
        "risk",
    )


def semantic_actions(signals: DataFrame, policy: Policy, request: str = "request_id") -> DataFrame:
    """Severest action per request, then first question."""
    rows = semantic_candidates(signals, policy, request)
    order = F.struct(
        (-severity(F.col("action"))).alias("s"), "question", "rule", "action", "risk"
    )
    best = rows.groupBy(request).agg(F.min(order).alias("b"))
    return best.select(
        request,
        "b.action",
        "b.rule",
        F.concat(F.upper("b.question"), F.lit("_RISK")).alias("code"),
    )


def evasion_candidates(findings: DataFrame, policy: Policy, request: str = "request_id") -> DataFrame:
    """Action per evasion finding: type/category rule, type rule, then the defaults."""
    table = {k: {"action": v} for k, v in policy.evasion.items()}
    unsafe = F.coalesce(F.col("unsafe_span"), F.lit(False))
    kind = F.coalesce(
        F.when(F.col("evasion_type") != "", F.col("evasion_type")), F.when(unsafe, "unsafe_span")
    )
    rows = findings.withColumn("kind", kind).filter("kind IS NOT NULL")
    rows = attach(rows, "_exact", F.concat_ws("/", "kind", "category"), table, "action string")
    rows = attach(rows, "_plain", F.col("kind"), table, "action string")
    fallback = F.coalesce(
        case_map(F.col("category"), EVASION_DEFAULT),
        F.when(F.col("kind") == "budget_exceeded", policy.budget_action),
    )
    action = F.coalesce("_exact.action", "_plain.action", fallback)
    return (
        rows.withColumn("action", action)
        .filter("action IS NOT NULL")
        .select(
            request,
            "action",
            F.concat(F.lit("evasion."), F.col("kind")).alias("rule"),
            F.lit(20).alias("priority"),
        )
    )


# ---- the precedence chain ----------------------------------------------------------------------


def decide(
    requests: DataFrame,
    findings: DataFrame,
    policy: Policy,
    signals: DataFrame | None = None,
    request: str = "request_id",
) -> DataFrame:
    """One decision per request: deny, canonicalization, secret, tenant, application, role,
    personal data, semantic risk, default.

    `requests` carries tenant, application, provider and, where known, subject and roles.
    `findings` carries provider and, where known, the evasion columns.
    """
    p = expand_legacy(policy)
    groups = finding_groups(findings, request)
    found = finding_candidates(groups, p, request).filter(F.col("category").isin("SECRET", "PII"))
    rows = [
        found.select(
            request,
            candidate(
                stage_of(F.col("category")), F.col("action"), F.col("rule"), F.col("priority")
            ).alias("c"),
        )
    ]
    if "evasion_type" in findings.columns:
        hidden = evasion_candidates(findings, p, request)
        rows.append(
            hidden.select(
                request,
                candidate(
                    F.lit("canonicalization"), F.col("action"), F.col("rule"), F.col("priority")
                ).alias("c"),
            )
        )
    if signals is not None:
        risky = semantic_candidates(signals, p, request)
        item = candidate(
            F.lit("semantic"), F.col("action"), F.col("rule"), F.col("priority"), F.col("question")
        )
        named = item.withField("code", F.concat(F.upper("question"), F.lit("_RISK")))
        rows.append(risky.select(request, named.alias("c")))
    rows.append(identity_candidates(requests, p, request))
    every = rows[0]
    for other in rows[1:]:
        every = every.unionByName(other)
    best = every.groupBy(request).agg(F.min("c").alias("c"))
    return best.select(
        request,
        F.col("c.action").alias("action"),
        F.col("c.rule").alias("matched_rule"),
        F.col("c.stage").alias("precedence_stage"),
        F.coalesce("c.code", F.lit("")).alias("code"),
        F.lit(p.id).alias("policy_id"),
        F.lit(p.version).alias("policy_version"),
    )


def identity_candidates(requests: DataFrame, policy: Policy, request: str = "request_id") -> DataFrame:
    """Deny, tenant, application, role and default candidates in one pass over requests."""
    rows = requests
    if "subject" not in rows.columns:
        rows = rows.withColumn("subject", F.lit(None).cast("string"))
    if "roles" not in rows.columns:
        rows = rows.withColumn("roles", F.array().cast("array<string>"))
    rows = with_named_rule(rows, policy.tenants, "tenant")
    rows = with_named_rule(rows, policy.applications, "application")
    denied = deny_rule(
        policy, F.col("application"), F.col("tenant"), F.col("subject"), F.col("roles")
    )
    rows = rows.withColumn("denied", denied)
    role_rules = rule_list(
        [{"role": k, "action": v} for k, v in policy.roles.items()], "role string, action string"
    )
    held = F.filter(role_rules, lambda r: F.array_contains(F.col("roles"), r["role"]))
    role_options = F.transform(
        held,
        lambda r: candidate(
            F.lit("role"), r["action"], F.concat(F.lit("roles."), r["role"]), F.lit(1)
        ),
    )

    def named(kind: str) -> Column:
        return F.when(
            F.col(f"{kind}_action").isNotNull(),
            candidate(
                F.lit(kind),
                F.col(f"{kind}_action"),
                F.concat(F.lit(f"{kind}s."), F.col(kind)),
                F.lit(0),
            ),
        )

    deny = F.when(
        F.col("denied").isNotNull(),
        candidate(
            F.lit("explicit_deny"),
            F.col("denied.action"),
            F.concat(F.lit("deny["), F.col("denied.position").cast("string"), F.lit("]")),
            F.lit(0),
        ),
    )
    fallback = candidate(F.lit("default"), F.lit(policy.default), F.lit("default"), F.lit(0))
    options = F.concat(
        F.array(deny, named("tenant"), named("application"), fallback), role_options
    )
    # Only the best identity candidate can win, so one row per request reaches the shuffle.
    return rows.select(request, F.array_min(F.filter(options, lambda c: c.isNotNull())).alias("c"))


def confidence_rank(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, 4).when(confidence >= 0.8, 3).when(confidence >= 0.5, 2).otherwise(1)
    )


# Names of the confidence buckets.
BUCKETS = {4: "very_high", 3: "high", 2: "medium", 1: "low"}


def finding_summary(findings: DataFrame, *keys: str) -> DataFrame:
    out = findings.groupBy(*keys, "category", "subtype").agg(
        F.count(F.lit(1)).alias("count"), F.max(confidence_rank(F.col("confidence"))).alias("rank")
    )
    return out.withColumn("confidence_bucket", case_map(F.col("rank"), BUCKETS)).drop("rank")


# ---- semantic stage -----------------------------------------------------------------------------


def semantic_fallback(rows: DataFrame, policy: Policy) -> DataFrame:
    """Most specific fallback rule for (risk, direction, provider); earliest wins ties."""
    rules = most_specific_first(policy.fallback, ("direction", "provider"))
    ddl = "position int, risk string, direction string, provider string, action string"
    hit = first_rule(
        rule_list(rules, ddl),
        lambda r: (r["risk"] == F.col("risk"))
        & wildcard(r["direction"], F.col("direction"))
        & wildcard(r["provider"], F.col("provider")),
    )
    return rows.withColumn("hit", hit).select(
        *rows.columns,
        F.col("hit.action").alias("action"),
        F.when(F.col("hit").isNotNull(), F.concat(F.lit("fallback.semantic."), F.col("risk"))).alias(
            "rule"
        ),
    )


# Risk ranks.
RISK_RANK = {"high": 3, "medium": 2, "low": 1}


def semantic_plan(
    requests: DataFrame, findings: DataFrame, questions: Iterable[Mapping], request: str = "request_id"
) -> DataFrame:
    """Questions to ask per request; none where a secret was found or none are configured."""
    by_direction: dict[str, list[Mapping]] = {}
    for q in questions:
        for direction in q["directions"]:
            by_direction.setdefault(direction, []).append(q)
    rows = [
        (d, ",".join(q["id"] for q in qs), max((q["risk"] for q in qs), key=RISK_RANK.get))
        for d, qs in by_direction.items()
    ]
    table = {d: {"question_ids": ids, "max_risk": risk} for d, ids, risk in rows}
    secret = findings.filter(F.col("category") == "SECRET").select(request).distinct()
    marked = requests.select(request, "direction").join(
        secret.withColumn("has_secret", F.lit(True)), request, "left"
    )
    out = attach(marked, "plan", F.col("direction"), table, "question_ids string, max_risk string")
    out = out.select("*", "plan.*")
    blocked = F.coalesce("has_secret", F.lit(False))
    ask = ~blocked & F.col("question_ids").isNotNull()
    reason = (
        F.when(blocked, "secret")
        .when(F.col("question_ids").isNull(), "no_questions")
        .otherwise("required")
    )
    return out.select(
        request,
        ask.alias("ask"),
        reason.alias("reason"),
        F.when(ask, F.col("question_ids")).otherwise("").alias("question_ids"),
        F.when(ask, F.col("max_risk")).otherwise("").alias("max_risk"),
    )


def gate_signals(signals: DataFrame, thresholds: Iterable[Mapping]) -> DataFrame:
    """Triggered signals whose best-matching calibrated slice is evaluated and cleared."""
    rules = most_specific_first(thresholds, ("language", "application", "provider"))
    ddl = (
        "position int, question string, language string, application string, provider string, "
        "min_confidence double, evaluated boolean"
    )
    hit = first_rule(
        rule_list(rules, ddl),
        lambda r: (r["question"] == F.col("question"))
        & wildcard(r["language"], F.col("language"))
        & wildcard(r["application"], F.col("application"))
        & wildcard(r["provider"], F.col("provider")),
    )
    rows = signals.filter("triggered").withColumn("slice", hit)
    return rows.filter(
        F.col("slice.evaluated") & (F.col("confidence") >= F.col("slice.min_confidence"))
    ).drop("slice")


def evidence_reason(
    provider: Column,
    schema: Column,
    checkpoint: Column,
    model: Column,
    answers: Column,
    want: Mapping,
    required: tuple[str, ...],
) -> Column:
    """First failing check of model evidence, or NULL when it is valid.

    `answers` maps question to confidence.
    """
    wanted = F.array(*[F.lit(q) for q in required])

    def fault(question: Column) -> Column:
        score = F.element_at(answers, question)
        return (
            F.when(~F.map_contains_key(answers, question), "missing_decision")
            .when(F.isnan(score) | score.isNull() | (score < 0) | (score > 1), "confidence")
            .otherwise("")
        )

    faults = F.filter(F.transform(wanted, fault), lambda f: f != "")
    return (
        F.when((F.trim(provider) == "") | (F.lower(provider) == "noop"), "provider")
        .when(schema != want["schema"], "schema")
        .when(checkpoint != want["checkpoint"], "checkpoint")
        .when(F.lower(provider) != want["provider"].lower(), "provider_mismatch")
        .when(model != want["model"], "model_binding")
        .when(F.size(F.array_except(F.map_keys(answers), wanted)) > 0, "unknown_question")
        .otherwise(F.get(faults, F.lit(0)))
    )


def semantic_subject(parts: DataFrame, requests: DataFrame, request: str = "request_id") -> DataFrame:
    """Text to judge. Requests: first text part of the last user message; other directions:
    the last message with text. Aggregates map-side, so long conversations do not collect."""
    texts = parts.filter((F.col("part_type") == "text") & (F.length("text") > 0))
    rank = F.struct(F.col("message_index"), (-F.col("part_index")).alias("p"))
    item = F.struct("text", "role")
    picked = texts.groupBy(request).agg(
        F.max_by(item, F.when(F.col("role") == "user", rank)).alias("user_item"),
        F.max_by(item, rank).alias("any_item"),
    )
    chosen = F.when(F.col("direction") == "request", F.col("user_item")).otherwise(F.col("any_item"))
    out = requests.select(request, "direction").join(picked, request, "left")
    out = out.withColumn("chosen", chosen)
    fallback_role = F.when(F.col("direction") == "request", "user").otherwise("")
    return out.select(
        request,
        "direction",
        F.coalesce("chosen.text", F.lit("")).alias("text"),
        F.coalesce("chosen.role", fallback_role).alias("role"),
    )


# ---- comparison, cohorts, tools, overrides --------------------------------------------------------


def in_cohort(seed: Column, tenant: Column, application: Column, verified: Column, percent: int) -> Column:
    if percent <= 0:
        return F.lit(False)
    return verified & (cohort_slot(seed, tenant, application) < min(percent, 100))


def policy_diff(
    requests: DataFrame,
    findings: DataFrame,
    active: Policy,
    other: Policy,
    canary: Column,
    request: str = "request_id",
) -> DataFrame:
    """Requests of the canary cohort on which two policies disagree."""
    cohort = requests.filter(canary)
    found = findings.join(cohort.select(request), request, "left_semi")
    left = decide(cohort, found, active, request=request)
    right = decide(cohort, found, other, request=request)
    both = left.select(request, F.col("action").alias("active_action")).join(
        right.select(request, F.col("action").alias("candidate_action")), request
    )
    return both.filter("active_action <> candidate_action")


def glob_regex(patterns: Iterable[str]) -> str:
    """Anchored pattern for shell globs where * and ? do not cross '/'."""
    import re

    out = []
    for glob in patterns:
        text = re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append(text.replace(r"\[", "[").replace(r"\]", "]"))
    return "^(?:" + "|".join(out) + ")$"


def tool_allowed(name: Column, allow: Iterable[str], deny: Iterable[str]) -> Column:
    allow, deny = tuple(allow), tuple(deny)
    ok = name.rlike(glob_regex(allow)) if allow else F.lit(True)
    return ok & ~name.rlike(glob_regex(deny)) if deny else ok


def strip_tools(tools: Column, restricted: Iterable[str]) -> Column:
    """Tool structs whose name is not restricted."""
    blocked = F.array(*[F.lit(r) for r in restricted])
    return F.filter(tools, lambda t: ~F.array_contains(blocked, t["name"]))


# JSON type names and the variant types that satisfy them.
VARIANT_TYPES = {
    "object": "^OBJECT",
    "array": "^ARRAY",
    "string": "^STRING",
    "number": r"^(?:BIGINT|DOUBLE|DECIMAL)",
    "integer": r"^(?:BIGINT|DECIMAL\([0-9]+,0\))",
    "boolean": "^BOOLEAN",
    "null": "^VOID",
}


def schema_valid(value: Column, schema: Mapping, depth: int = 0, max_depth: int = 16) -> Column:
    """A JSON Schema subset compiled to one predicate over a VARIANT column."""
    if depth > max_depth:
        return F.lit(False)
    kind = F.schema_of_variant(value)
    checks = [F.lit(True)]
    if "enum" in schema:
        shown = F.try_variant_get(value, "$", "string")
        checks.append(shown.isin([str(v) for v in schema["enum"]]))
    if schema.get("type") in VARIANT_TYPES:
        checks.append(kind.rlike(VARIANT_TYPES[schema["type"]]))
    is_object = kind.rlike("^OBJECT")
    keys = F.when(is_object, F.json_object_keys(F.to_json(value)))
    for name in schema.get("required", ()):
        checks.append(~is_object | F.array_contains(keys, name))
    properties = schema.get("properties")
    if properties is not None:
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(n) for n in properties]).cast("array<string>")
            checks.append(~is_object | (F.size(F.array_except(keys, known)) == 0))
        for name, child in properties.items():
            inner = F.try_variant_get(value, f"$.{name}", "variant")
            present = is_object & F.array_contains(keys, name)
            checks.append(~present | schema_valid(inner, child, depth + 1, max_depth))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        checks.append(
            ~kind.rlike("^ARRAY")
            | F.forall(items, lambda x: schema_valid(x, schema["items"], depth + 1, max_depth))
        )
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return F.coalesce(out, F.lit(False))


def tool_args_valid(args: Column, schema: Mapping, max_bytes: int = 256 * 1024) -> Column:
    parsed = F.try_parse_json(args)
    return F.coalesce(
        (F.octet_length(args) <= max_bytes) & parsed.isNotNull() & schema_valid(parsed, schema),
        F.lit(False),
    )


def decision_overrides(decisions: DataFrame, findings: DataFrame, request: str = "request_id") -> DataFrame:
    """Overrides after the chain. `decisions` carries recognizer_down, passthrough and mode;
    `findings` carries part_type."""
    attached = (
        findings.filter(F.col("part_type") == "attachment")
        .select(request)
        .distinct()
        .withColumn("attached", F.lit(True))
    )
    rows = decisions.join(attached, request, "left")
    masked = F.col("action").isin("REDACT", "TOKENIZE") & F.coalesce("attached", F.lit(False))
    base = F.when(F.col("passthrough"), "ALLOW").when(F.col("recognizer_down"), "BLOCK")
    rule = F.when(F.col("passthrough"), "passthrough").when(
        F.col("recognizer_down"), "pii_ner_required"
    )
    final = base.when(masked, "BLOCK").otherwise(F.col("action"))
    return rows.select(
        request,
        final.alias("action"),
        rule.when(masked, "attachment_span").otherwise(F.col("matched_rule")).alias("matched_rule"),
        F.when(F.col("mode") == "enforce", final).otherwise("ALLOW").alias("applied_action"),
    )
