"""The policies, thresholds and question sets the registered queries run under."""

from __future__ import annotations

from ..operators.policy import Policy

ACTIVE = Policy(
    id="standard",
    version=3,
    default="ALLOW",
    safe_default="BLOCK",
    deny=(
        {"tenant": "src3", "application": "de", "action": "BLOCK"},
        {"application": "xx", "action": "BLOCK"},
        {"tenant": "src11", "action": "REVIEW"},
    ),
    secrets={"GITLAB_PAT": "BLOCK", "PEM_PRIVATE_KEY": "BLOCK"},
    pii={"EMAIL": {"cloud": "TOKENIZE"}, "MULTIPLE_PII": {"local": "REVIEW"}},
    targets={"local": "REDACT"},
    provider_subtypes={"cloud": {"CREDIT_CARD": "BLOCK", "JWT": "REVIEW"}},
    provider_categories={"cloud": {"PII": "TOKENIZE"}},
    subtype_actions={
        "SECRET": {"JWT": "REDACT", "OPENAI_API_KEY": "BLOCK", "GITHUB_TOKEN": "REDACT"},
        "PII": {"IP_ADDRESS": "ALLOW"},
    },
    category_actions={"SECRET": "REDACT", "PII": "REDACT"},
    confidence=(
        {"id": "sure-secret", "category": "SECRET", "min_confidence": 0.95, "action": "BLOCK"},
        {
            "id": "sure-card",
            "category": "PII",
            "subtype": "CREDIT_CARD",
            "provider": "local",
            "min_confidence": 0.9,
            "action": "REVIEW",
        },
    ),
    counts=({"id": "dense-pii", "category": "PII", "min_count": 3, "action": "REVIEW"},),
    evasion={"zero_width_control": "REVIEW", "encoded": "BLOCK", "encoded/PII": "REDACT"},
    tenants={"src5": "FORCE_LOCAL_MODEL"},
    applications={"es": "REVIEW"},
    roles={"guest": "RESTRICT_TOOLS", "admin": "ALLOW", "intern": "REVIEW"},
    semantic={"toxic": {"high": "REVIEW"}, "quality": {"low": "REDACT"}},
    fallback=(
        {"risk": "high", "direction": "*", "provider": "", "action": "BLOCK"},
        {"risk": "high", "direction": "response", "provider": "*", "action": "REVIEW"},
        {"risk": "high", "direction": "response", "provider": "cloud", "action": "REDACT"},
        {"risk": "medium", "direction": "request", "provider": "", "action": "REVIEW"},
        {"risk": "medium", "direction": "", "provider": "LOCAL", "action": "ALLOW"},
    ),
)

CANDIDATE = Policy(
    id="standard",
    version=4,
    default="ALLOW",
    safe_default="BLOCK",
    category_actions={"SECRET": "BLOCK", "PII": "TOKENIZE"},
    subtype_actions={"PII": {"IP_ADDRESS": "ALLOW"}},
)

LEGACY = Policy(
    id="legacy",
    version=1,
    default="ALLOW",
    secrets={"JWT": "BLOCK"},
    pii={"EMAIL": {"cloud": "REDACT"}, "MULTIPLE_PII": {"cloud": "REVIEW"}},
    targets={"local": "ALLOW"},
)

QUESTIONS = (
    {"id": "toxic", "risk": "high", "directions": ("request", "response")},
    {"id": "quality", "risk": "low", "directions": ("request", "tool_result")},
)

THRESHOLDS = (
    {"question": "toxic", "min_confidence": 0.8, "evaluated": True},
    {"question": "toxic", "language": "en", "application": "de", "min_confidence": 0.6, "evaluated": True},
    {"question": "toxic", "language": "en", "provider": "CLOUD", "min_confidence": 0.7, "evaluated": True},
    {"question": "quality", "language": "*", "min_confidence": 0.55, "evaluated": True},
    {"question": "quality", "language": "en", "application": "fr", "min_confidence": 0.5, "evaluated": False},
)

TOOL_SCHEMA = {
    "type": "object",
    "required": ["k"],
    "additionalProperties": False,
    "properties": {
        "k": {"type": "integer"},
        "mode": {"type": "string", "enum": ["fast", "slow"]},
        "tags": {"type": "array", "items": {"type": "string"}},
    },
}
