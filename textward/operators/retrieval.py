"""Retrieval access: extraction from bodies, per-result checks, whole-batch decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_walk import first_object

# Names the retrieval object, its result lists and fields may carry.
HOLDERS = ("retrieval", "rag", "retrieved_context", "retrieval_context")
LISTS = (
    "documents",
    "chunks",
    "results",
    "contexts",
    "context",
    "retrieval_results",
    "retrieved_documents",
    "tool_results",
    "tool_result",
    "items",
)
CONTENT = ("content", "text", "page_content", "snippet")
REQUEST_FIELDS = {
    "operation": ("operation", "requested_operation"),
    "collection": ("collection", "collection_id"),
    "index": ("index", "index_id"),
    "purpose": ("purpose", "use_purpose"),
    "query": ("query", "search_query", "query_text"),
    "query_digest": ("query_digest",),
}
RESULT_FIELDS = {
    "document_id": ("document_id", "resource_id", "document", "id"),
    "chunk_id": ("chunk_id", "segment_id", "chunk"),
    "collection": ("collection", "collection_id"),
    "index": ("index", "index_id"),
    "purpose": ("purpose", "use_purpose"),
    "tenant": ("tenant", "tenant_id"),
    "application": ("application", "application_id"),
    "subject": ("subject", "user", "user_id"),
    "content": CONTENT,
    "content_digest": ("content_digest",),
}
RESULT_LISTS = {
    "classification": ("classification", "classifications"),
    "roles": ("roles", "role"),
    "groups": ("groups", "group"),
}


@dataclass(frozen=True)
class RetrievalLimits:
    max_depth: int = 8
    max_nodes: int = 512
    max_results: int = 256
    max_result_bytes: int = 1 << 20
    allowed_operations: tuple[str, ...] = ()
    require_classification: bool = False


def _struct_of(names, kind: str = "variant") -> str:
    return "struct<" + ",".join(f"`{n}`:{kind}" for n in dict.fromkeys(names)) + ">"


def _string(v: Column) -> Column:
    """A trimmed, non-empty string member."""
    shown = F.trim(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.when(shown != "", shown)


def _first(names, *sources: Column) -> Column:
    return F.coalesce(*[_string(s[n]) for n in names for s in sources], F.lit(""))


def _strings(names, *sources: Column) -> Column:
    """A string or a list of strings under the first present name."""
    options = []
    for n in names:
        for s in sources:
            v = s[n]
            items = F.transform(F.try_variant_get(v, "$", "array<variant>"), _string)
            one = F.when(_string(v).isNotNull(), F.array(_string(v)))
            options += [F.filter(items, lambda x: x.isNotNull()), one]
    return F.coalesce(*options, F.array().cast("array<string>"))


def extract(bodies: DataFrame, limits: RetrievalLimits = RetrievalLimits(), keys=("request_id",)) -> DataFrame:
    """One row per retrieval result found in a JSON body, with request fields and digests.

    The body is searched level by level; the first object that holds a retrieval block or a result list is
    taken. A body that is no JSON, is nested below `max_depth`, has over `max_nodes` nodes, or names a
    retrieval without results is refused: it gives one empty row marked `malformed`.
    """
    keys = list(keys)
    rows = bodies.withColumn("_root", F.try_parse_json("body"))
    conditions = [
        f"coalesce(startswith(schema_of_variant(try_variant_get(h.value, '$.{h}', 'variant')), "
        "'OBJECT'), false)"
        for h in HOLDERS
    ]
    conditions += [f"try_variant_get(h.value, '$.{k}', 'variant') IS NOT NULL" for k in LISTS if k != "items"]
    found = first_object("_root", " OR ".join(conditions), limits.max_depth)
    rows = rows.withColumn("_found", found).withColumn("_hit", F.col("_found.hit"))
    refused = F.col("body").isNotNull() & (
        F.col("_root").isNull() | F.col("_found.too_deep") | (F.col("_found.nodes") > limits.max_nodes)
    )
    for holder in ("retrieval", "rag"):
        inner = F.try_variant_get("_hit", f"$.{holder}", "variant")
        rows = rows.withColumn(
            "_hit", F.when(F.startswith(F.schema_of_variant(inner), F.lit("OBJECT")), inner).otherwise(F.col("_hit"))
        )
    nested = [F.try_variant_get("_hit", f"$.{h}", "variant") for h in ("retrieved_context", "retrieval_context", "context")]
    objects = [F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v) for v in nested]
    rows = rows.withColumn("_hit", F.coalesce(*objects, F.col("_hit")))
    fields = [n for names in REQUEST_FIELDS.values() for n in names]
    rows = rows.withColumn("_r", F.try_variant_get("_hit", "$", _struct_of([*fields, *LISTS])))
    r = F.col("_r")
    request = {name: _first(names, r) for name, names in REQUEST_FIELDS.items()}
    listed = F.coalesce(*[F.try_variant_get(r[k], "$", "array<variant>") for k in LISTS])
    malformed = F.coalesce(refused | (F.col("_hit").isNotNull() & (F.coalesce(F.size(listed), F.lit(0)) <= 0)), F.lit(False))
    nothing = F.array(F.parse_json(F.lit("{}")))
    rows = rows.select(
        *keys,
        *[F.when(malformed, "").otherwise(c).alias(f"r_{n}") for n, c in request.items()],
        malformed.alias("malformed"),
        F.posexplode_outer(F.when(malformed, nothing).otherwise(listed)).alias("position", "_v"),
    ).filter("_v IS NOT NULL")
    names = [n for v in (*RESULT_FIELDS.values(), *RESULT_LISTS.values()) for n in v]
    shape = _struct_of(names)
    rows = rows.withColumn("_m", F.try_variant_get("_v", "$", shape))
    rows = rows.withColumn("_d", F.try_variant_get("_v", "$.metadata", shape))
    m, d = F.col("_m"), F.col("_d")
    got = {name: _first(names, m, d) for name, names in RESULT_FIELDS.items()}
    has_content = F.coalesce(*[s[n] for n in (*CONTENT, "content_digest") for s in (m, d)]).isNotNull()
    digest = lambda v: F.concat(F.lit("sha256:"), F.sha2(v, 256))
    query = F.col("r_query")
    return rows.select(
        *keys,
        "position",
        "malformed",
        F.when(F.col("r_operation") == "", "retrieve").otherwise(F.col("r_operation")).alias("operation"),
        F.when(query != "", digest(query)).otherwise(F.col("r_query_digest")).alias("query_digest"),
        F.col("r_collection").alias("request_collection"),
        F.col("r_index").alias("request_index"),
        F.col("r_purpose").alias("request_purpose"),
        got["document_id"].alias("document_id"),
        got["chunk_id"].alias("chunk_id"),
        *[
            F.when(got[n] != "", got[n]).otherwise(F.col(f"r_{n}")).alias(n)
            for n in ("collection", "index", "purpose")
        ],
        got["tenant"].alias("tenant"),
        got["application"].alias("application"),
        got["subject"].alias("subject"),
        *[_strings(names, m, d).alias(n) for n, names in RESULT_LISTS.items()],
        F.when(got["content_digest"] != "", got["content_digest"]).otherwise(digest(got["content"])).alias("content_digest"),
        (has_content & (F.octet_length(got["content"]) <= limits.max_result_bytes)).alias("has_content"),
    )


def acl_fault(caller: str = "caller") -> Column:
    """First failing access check of a result against its caller struct; '' when allowed."""
    c = F.col(caller)
    missing = (
        (F.col("document_id") == "")
        | (F.col("collection") == "")
        | (F.col("purpose") == "")
        | (F.col("tenant") == "")
        | (F.col("application") == "")
        | ~F.col("has_content")
    )
    return (
        F.when(missing, "metadata")
        .when((F.col("tenant") != c["tenant"]) | (F.col("application") != c["application"]), "identity")
        .when(
            (F.col("collection") != F.col("request_collection"))
            | ((F.col("request_index") != "") & (F.col("index") != F.col("request_index")))
            | (F.col("purpose") != F.col("request_purpose")),
            "scope",
        )
        .when((F.col("subject") != "") & (F.col("subject") != c["subject"]), "subject")
        .when(F.size(F.array_except("roles", c["roles"])) > 0, "role")
        .when(F.size(F.array_except("groups", c["groups"])) > 0, "group")
        .otherwise("")
    )


def retrieval_acl(results: DataFrame, callers: DataFrame, request: str = "request_id") -> DataFrame:
    """Results with `fault`; callers join by request, so each result meets one caller row."""
    fields = [c for c in callers.columns if c != request]
    who = callers.select(request, F.struct(*fields).alias("caller"))
    return results.join(who, request).withColumn("fault", acl_fault()).drop("caller")


# Batch result codes in order of precedence.
BATCH_CODES = (
    "RAG_MALFORMED",
    "RAG_METADATA_REJECTED",
    "RAG_CLASSIFICATION_REQUIRED",
    "RAG_OPERATION_DENIED",
    "RAG_DECISION_MALFORMED",
    "RAG_DECISION_STALE",
    "RAG_DECISION_MISMATCH",
    "RAG_AUTH_ALLOWED",
)


def retrieval_batch(
    judged: DataFrame, limits: RetrievalLimits = RetrievalLimits(), request: str = "request_id"
) -> DataFrame:
    """Whole-batch outcome: one bad, stale or denied result denies the batch.

    `judged` carries the result columns with `fault` and, where authorized, `decision`
    ('' valid, else malformed, stale or mismatch). The aggregate combines map-side.
    """
    rank = lambda code: F.lit(BATCH_CODES.index(code))
    per_result = (
        F.when(F.col("fault") == "metadata", rank("RAG_MALFORMED"))
        .when(F.col("query_digest") == "", rank("RAG_MALFORMED"))
        .when(F.col("fault") != "", rank("RAG_METADATA_REJECTED"))
    )
    if limits.require_classification:
        per_result = per_result.when(F.size("classification") == 0, rank("RAG_CLASSIFICATION_REQUIRED"))
    if limits.allowed_operations:
        per_result = per_result.when(~F.col("operation").isin(*limits.allowed_operations), rank("RAG_OPERATION_DENIED"))
    per_result = (
        per_result.when(F.col("decision") == "malformed", rank("RAG_DECISION_MALFORMED"))
        .when(F.col("decision") == "stale", rank("RAG_DECISION_STALE"))
        .when(F.col("decision") != "", rank("RAG_DECISION_MISMATCH"))
        .otherwise(rank("RAG_AUTH_ALLOWED"))
    )
    grouped = judged.withColumn("_rank", per_result).groupBy(request).agg(
        F.count(F.lit(1)).alias("chunks"), F.min("_rank").alias("_rank")
    )
    worst = F.when(F.col("chunks") > limits.max_results, 0).otherwise(F.col("_rank"))
    code = F.get(F.array(*[F.lit(c) for c in BATCH_CODES]), worst)
    return grouped.select(request, "chunks", (code == "RAG_AUTH_ALLOWED").alias("allowed"), code.alias("code"))


def binding(c: dict[str, Column]) -> Column:
    """Digest that ties a decision to its request, resource and expiry (microseconds)."""
    resource = F.concat_ws("|", c["document_id"], c["chunk_id"], c["content_digest"])
    parts = (
        F.lit("v1"), c["request_id"], c["tenant"], c["application"], c["subject"], c["policy_id"],
        c["policy_version"], c["operation"], c["collection"], c["index"], c["purpose"],
        c["query_digest"], resource, F.unix_micros(c["expires_at"]), c["decision_id"], c["action"],
    )
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


ACTIONS = ("ALLOW", "DENY", "REDACT", "RESTRICT")


def decision_fault(c: dict[str, Column], given: Column, now: Column, max_age_seconds: int) -> Column:
    """'' for a valid decision, else malformed, stale, mismatch or denied."""
    expires = c["expires_at"]
    latest = now + F.make_interval(secs=F.lit(max_age_seconds))
    malformed = (
        (c["decision_id"] == "") | ~c["action"].isin(*ACTIONS) | expires.isNull() | (given == "")
    )
    return (
        F.when(malformed, "malformed")
        .when((expires < now) | (expires > latest), "stale")
        .when(F.lower(given) != binding(c), "mismatch")
        .when(c["action"] != "ALLOW", "denied")
        .otherwise("")
    )
