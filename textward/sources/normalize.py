"""Request and response bodies as rows: one row per message part, malformed rows flagged.

Bodies are parsed once into VARIANT. Everything below is column expressions on that value,
so a body never leaves the executor that read it and nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import computed_once

PART = "struct<part_type:string,tool_name:string,text:string,ref:string>"
MESSAGE = f"struct<role:string,parts:array<{PART}>,bad:boolean>"

# Endpoint paths per family.
EXACT_PATHS = {
    "/v1/chat/completions": "chat",
    "/v1/responses": "responses",
    "/v1/completions": "completions",
    "/v1/embeddings": "embeddings",
    "/v1/messages": "messages",
    "/anthropic/v1/messages": "messages",
    "/v1/complete": "complete",
}
GENERIC_PATHS = (
    "/message",
    "/messages",
    "/chatcompletion",
    "/chat/completions",
    "/response",
    "/responses",
    "/v1/message",
    "/v1/response",
)
GENERIC_SUFFIXES = (
    "/chat/completions",
    "/chatcompletion",
    "/messages",
    "/message",
    "/responses",
    "/response",
)
# Content part types and the keys that mark an untyped attachment.
TEXT_TYPES = ("text", "input_text", "output_text")
IMAGE_TYPES = ("image_url", "input_image", "image")
FILE_TYPES = ("file", "input_file", "document", "attachment")
ATTACHMENT_KEYS = (
    "attachment",
    "file_data",
    "file_base64",
    "base64",
    "data",
    "url",
    "file_url",
    "document_url",
    "image_url",
    "source",
)


def _trimmed(path: Column) -> Column:
    return F.regexp_replace(path, "/$", "")


def endpoint_family(path: Column) -> Column:
    """Request family by exact path, then by suffix; NULL when unsupported."""
    p = _trimmed(path)
    out = None
    for exact, family in EXACT_PATHS.items():
        out = F.when(p == exact, family) if out is None else out.when(p == exact, family)
    out = out.when(p.isin(*GENERIC_PATHS), "generic")
    for suffix in GENERIC_SUFFIXES:
        out = out.when(F.endswith(p, F.lit(suffix)), "generic")
    return out


def stream_family(path: Column) -> Column:
    p = _trimmed(path)
    return (
        F.when(F.endswith(p, F.lit("/responses")), "responses")
        .when(F.endswith(p, F.lit("/messages")), "messages")
        .when(F.endswith(p, F.lit("/chat/completions")), "chat")
        .otherwise("generic")
    )


ITEM = (
    "struct<type:string,text:string,input_text:string,output_text:string,name:string,input:variant,"
    "content:variant," + ",".join(f"{k}:variant" for k in ATTACHMENT_KEYS) + ">"
)
CALLS = "array<struct<function:struct<name:string,arguments:string>>>"
REQUEST = (
    "model string, messages array<struct<role:string,content:variant,tool_call_id:string,"
    f"tool_calls:{CALLS}>>, system variant, max_tokens variant, instructions string, "
    "prompt variant, input variant, input_text variant, text variant, content variant, "
    "attachments variant"
)
RESPONSE = (
    "model string, completion string, content variant, choices array<struct<text:string,"
    f"message:struct<role:string,content:variant,tool_calls:{CALLS}>>>, "
    "output array<struct<text:string,content:variant>>, data array<struct<text:string,content:variant>>"
)
NO_PARTS = f"CAST(array() AS array<{PART}>)"
NO_MESSAGES = f"CAST(array() AS array<{MESSAGE}>)"


def kind_of(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, VOID, ... of a VARIANT; NULL where absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def items_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _parts(*parts: Column) -> Column:
    return F.array(*parts).cast(f"array<{PART}>")


def _part(kind: str, text: Column, tool: Column | None = None, ref: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("part_type"),
        (none if tool is None else tool).alias("tool_name"),
        text.alias("text"),
        (none if ref is None else ref).alias("ref"),
    )


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _item_parts(p: Column, depth: int) -> Column:
    """Parts of one typed content item."""
    marked = F.coalesce(*[p[k] for k in ATTACHMENT_KEYS]).isNotNull()
    typed = F.coalesce(_filled(p["type"]), F.when(marked, "attachment"), F.lit(""))
    shown = F.coalesce(*[_filled(p[k]) for k in TEXT_TYPES], F.lit(""))
    blank = F.lit("")
    out = (
        F.when(typed.isin(*TEXT_TYPES), _parts(_part("text", shown)))
        .when(typed == "tool_use", _parts(_part("tool_call", F.to_json(p["input"]), p["name"])))
        .when(typed.isin(*IMAGE_TYPES), _parts(_part("image_ref", blank, ref=F.to_json(p))))
        .when(typed.isin(*FILE_TYPES), _parts(_part("attachment", blank, ref=F.to_json(p))))
    )
    if depth > 0:
        inner = F.transform(
            content_parts(p["content"], depth - 1),
            lambda x: x.withField("part_type", F.lit("tool_result")),
        )
        # An empty result still is one part.
        out = out.when((typed == "tool_result") & ~F.coalesce(kind_of(p["content"]).isin("STRING", "ARRAY"), F.lit(False)), _parts(_part("tool_result", blank)))
        out = out.when(typed == "tool_result", inner)
    # A result nested in results is kept as its JSON, so its text still is scanned.
    below = F.coalesce(F.to_json(p["content"]), blank)
    return out.when(typed == "tool_result", _parts(_part("tool_result", below))).otherwise(
        _parts(_part("json", blank))
    )


def content_parts(content: Column, depth: int = 1) -> Column:
    """Parts of a content value: null, string, or an array of typed items."""
    items = F.try_variant_get(content, "$", f"array<{ITEM}>")
    return (
        F.when(kind_of(content) == "STRING", F.filter(_parts(_part("text", as_string(content))), lambda p: p["text"] != ""))
        .when(items.isNotNull(), F.flatten(F.transform(items, lambda p: _item_parts(p, depth))))
        .otherwise(F.expr(NO_PARTS))
    )


def content_bad(content: Column) -> Column:
    """Unsupported content: neither null, string nor an array of objects."""
    kind = kind_of(content)
    items = F.try_variant_get(content, "$", f"array<{ITEM}>")
    odd = items.isNull() | F.exists(items, lambda p: p.isNull())
    return F.coalesce(~kind.isin("STRING", "VOID") & odd, F.lit(False))


def _tool_calls(calls: Column) -> Column:
    parts = F.transform(
        calls,
        lambda c: _part(
            "tool_call",
            F.coalesce(c["function"]["arguments"], F.lit("")),
            F.coalesce(c["function"]["name"], F.lit("")),
        ),
    ).cast(f"array<{PART}>")
    return F.coalesce(parts, F.expr(NO_PARTS))


def _message(role: Column, parts: Column, bad: Column) -> Column:
    return F.struct(role.alias("role"), parts.alias("parts"), bad.alias("bad")).cast(MESSAGE)


def _messages(*messages: Column) -> Column:
    return F.array(*messages).cast(f"array<{MESSAGE}>")


def _text_message(role: str, text: Column) -> Column:
    return _message(F.lit(role), _parts(_part("text", text)), text == "")


def _listed(values: Column, build) -> Column:
    return F.coalesce(F.transform(values, build), F.expr(NO_MESSAGES))


def _no_empty(messages: Column) -> Column:
    """Messages without content count as malformed."""
    return F.transform(messages, lambda m: m.withField("bad", m["bad"] | (F.size(m["parts"]) == 0)))


def chat_messages(root: Column) -> Column:
    def build(m: Column) -> Column:
        parts = F.transform(
            F.concat(content_parts(m["content"]), _tool_calls(m["tool_calls"])),
            lambda p: p.withField(
                "part_type",
                F.when(
                    (p["part_type"] == "text") & (F.coalesce(m["tool_call_id"], F.lit("")) != ""),
                    "tool_result",
                ).otherwise(p["part_type"]),
            ),
        )
        role = F.coalesce(m["role"], F.lit(""))
        return _message(role, parts, (role == "") | content_bad(m["content"]))

    return _listed(root["messages"], build)


def block_messages(root: Column) -> Column:
    """System first, then messages."""
    system = _messages(
        _message(F.lit("system"), content_parts(root["system"]), content_bad(root["system"]))
    )
    lead = F.filter(system, lambda m: (F.size(m["parts"]) > 0) | m["bad"])
    listed = _listed(
        root["messages"],
        lambda m: _message(
            F.coalesce(m["role"], F.lit("")),
            content_parts(m["content"]),
            (F.coalesce(m["role"], F.lit("")) == "") | content_bad(m["content"]),
        ),
    )
    # Without messages the system text alone is not a request.
    return F.when(F.size(root["messages"]) > 0, F.concat(lead, _no_empty(listed))).otherwise(
        F.expr(NO_MESSAGES)
    )


INPUT = "struct<role:string,content:variant,input_text:string>"


def input_messages(root: Column) -> Column:
    """Instructions, then `input`: a string, a list of messages, or one object."""
    told = _messages(_text_message("system", F.coalesce(root["instructions"], F.lit(""))))
    lead = F.filter(told, lambda m: ~m["bad"])
    value = F.coalesce(root["input"], root["input_text"])

    def build(m: Column) -> Column:
        short = _parts(_part("text", F.coalesce(m["input_text"], F.lit(""))))
        parts = F.when(m["content"].isNull(), F.filter(short, lambda p: p["text"] != "")).otherwise(
            content_parts(m["content"])
        )
        return _message(F.coalesce(_filled(m["role"]), F.lit("user")), parts, content_bad(m["content"]))

    many = F.coalesce(
        F.try_variant_get(value, "$", f"array<{INPUT}>"), F.array(F.try_variant_get(value, "$", INPUT))
    )
    body = F.when(kind_of(value) == "STRING", _messages(_text_message("user", as_string(value)))).otherwise(
        _no_empty(_listed(F.filter(many, lambda m: m.isNotNull()), build))
    )
    return F.when(value.isNotNull(), F.concat(lead, body)).otherwise(F.expr(NO_MESSAGES))


def listed_texts(value: Column) -> Column:
    """A string or a list of strings as user messages; empty strings are malformed."""
    texts = F.when(kind_of(value) == "STRING", F.array(as_string(value))).otherwise(
        F.transform(items_of(value), lambda p: F.when(kind_of(p) == "STRING", as_string(p)).otherwise(""))
    )
    return _listed(texts, lambda t: _text_message("user", t))


def single_field(root: Column) -> Column:
    """The first of the known single fields that holds content."""
    fields = ("prompt", "input", "text", "content", "attachments")
    options = F.array(*[_message(F.lit("user"), content_parts(root[k]), F.lit(False)) for k in fields])
    return F.slice(F.filter(options, lambda m: F.size(m["parts"]) > 0), 1, 1)


def _fine(messages: Column) -> Column:
    return (F.size(messages) > 0) & ~F.exists(messages, lambda m: m["bad"])


REQUEST_SHAPES = {
    "chat": (("chat", "generic"), chat_messages),
    "block": (("messages", "generic"), block_messages),
    "input": (("responses",), input_messages),
    "prompts": (("completions",), lambda r: listed_texts(r["prompt"])),
    "inputs": (("embeddings",), lambda r: listed_texts(r["input"])),
    "prompt": (("complete",), lambda r: F.slice(listed_texts(r["prompt"]), 1, 1)),
    "single": (("generic",), single_field),
}


def _shaped(rows: DataFrame, shapes: dict, families: tuple[str, ...] | None) -> tuple[DataFrame, dict]:
    """One column per shape in use, filled only for the families that read it."""
    names = {}
    for name, (wanted, build) in shapes.items():
        used = [f for f in wanted if families is None or f in families]
        if used:
            rows = rows.withColumn(f"_{name}", F.when(F.col("family").isin(*used), build(F.col("root"))))
            names[name] = used
    return rows, names


def normalize_requests(
    bodies: DataFrame, keys: tuple[str, ...] = ("request_id",), families: tuple[str, ...] | None = None
) -> DataFrame:
    """Bodies (`body`, `family`) with their messages and a `malformed` flag.

    `families` names the shapes present, which keeps the plan to those. A generic body is
    read as chat first (as blocks when `system` or `max_tokens` is present), then by its
    single fields.
    """
    rows = bodies.withColumn("root", F.from_json("body", REQUEST))
    rows, shapes = _shaped(rows, REQUEST_SHAPES, families)
    root = F.col("root")
    model = F.coalesce(root["model"], F.lit(""))
    picked = [F.when(F.col("family") != "generic", F.col(f"_{n}")) for n in shapes]
    if families is None or "generic" in families:
        blocky = root["system"].isNotNull() | root["max_tokens"].isNotNull()
        chat, block = F.col("_chat"), F.col("_block")
        picked += [
            F.when((model != "") & _fine(chat) & blocky & _fine(block), block),
            F.when((model != "") & _fine(chat), chat),
            F.when((model != "") & _fine(block), block),
            F.col("_single"),
        ]
    rows = rows.withColumn("messages", F.coalesce(*picked, F.expr(NO_MESSAGES)))
    malformed = ((model == "") & (F.col("family") != "generic")) | ~_fine(F.col("messages"))
    bad = F.coalesce(malformed, F.lit(True))
    return computed_once(rows, [*keys, "family"], model=model, messages=F.col("messages"), malformed=bad)


def request_parts(normalized: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """One row per part of the well-formed bodies."""
    rows = normalized.filter(~F.col("malformed")).select(
        *keys, F.posexplode_outer("messages").alias("message_index", "m")
    )
    parts = rows.filter("m IS NOT NULL").select(
        *keys, "message_index", "m.role", F.posexplode_outer("m.parts").alias("part_index", "p")
    )
    return parts.filter("p IS NOT NULL").select(
        *keys, "message_index", "part_index", "role", "p.part_type", "p.tool_name", "p.text", "p.ref"
    )


# ---- responses ------------------------------------------------------------------------------------------


def _assistant(parts: Column, bad: Column) -> Column:
    return _message(F.lit("assistant"), parts, bad)


def _plain(text: Column) -> Column:
    return _parts(_part("text", F.coalesce(text, F.lit(""))))


def _done(root: Column) -> Column:
    """The `completion` field as one assistant message, where present."""
    return F.when(
        root["completion"].isNotNull(), _messages(_assistant(_plain(root["completion"]), F.lit(False)))
    ).otherwise(F.expr(NO_MESSAGES))


def choice_messages(root: Column) -> Column:
    return _listed(
        root["choices"],
        lambda c: _message(
            F.coalesce(c["message"]["role"], F.lit("")),
            F.concat(content_parts(c["message"]["content"]), _tool_calls(c["message"]["tool_calls"])),
            content_bad(c["message"]["content"]),
        ),
    )


def completion_messages(root: Column) -> Column:
    listed = _listed(root["choices"], lambda c: _assistant(_plain(c["text"]), F.lit(False)))
    return F.when(F.size(root["choices"]) > 0, listed).otherwise(_done(root))


def output_messages(root: Column) -> Column:
    def build(item: Column) -> Column:
        more = F.filter(_plain(item["text"]), lambda p: p["text"] != "")
        return _assistant(F.concat(content_parts(item["content"]), more), content_bad(item["content"]))

    listed = F.filter(
        _listed(F.coalesce(root["output"], root["data"]), build), lambda m: (F.size(m["parts"]) > 0) | m["bad"]
    )
    return F.coalesce(listed, F.expr(NO_MESSAGES))


def content_message(root: Column) -> Column:
    """Fallback of an output without messages: a plain `content` string."""
    return F.when(
        kind_of(root["content"]) == "STRING",
        _messages(_assistant(_plain(as_string(root["content"])), F.lit(False))),
    ).otherwise(F.expr(NO_MESSAGES))


def block_response(root: Column) -> Column:
    more = F.when(root["completion"].isNotNull(), _plain(root["completion"])).otherwise(F.expr(NO_PARTS))
    one = _messages(
        _assistant(F.concat(content_parts(root["content"]), more), content_bad(root["content"]))
    )
    return F.filter(one, lambda m: (F.size(m["parts"]) > 0) | m["bad"])


RESPONSE_SHAPES = {
    "choices": (("chat",), choice_messages),
    "completions": (("completions", "complete"), completion_messages),
    "outputs": (("responses", "generic"), output_messages),
    "contents": (("responses", "generic"), content_message),
    "blocks": (("messages",), block_response),
}


def normalize_responses(
    bodies: DataFrame, keys: tuple[str, ...] = ("request_id",), families: tuple[str, ...] | None = None
) -> DataFrame:
    rows = bodies.withColumn("root", F.from_json("body", RESPONSE))
    rows = rows.withColumn("parsed", F.try_parse_json("body").isNotNull())
    rows, shapes = _shaped(rows, RESPONSE_SHAPES, families)
    order = [n for n in shapes if n != "contents"]
    picked = [F.when(F.size(f"_{n}") > 0, F.col(f"_{n}")) for n in order]
    if "contents" in shapes:
        picked.append(F.col("_contents"))
    rows = rows.withColumn("messages", F.coalesce(*picked, F.expr(NO_MESSAGES)))
    malformed = ~F.col("parsed") | F.exists("messages", lambda m: m["bad"])
    bad, model = F.coalesce(malformed, F.lit(True)), F.coalesce("root.model", F.lit(""))
    return computed_once(rows, [*keys, "family"], model=model, messages=F.col("messages"), malformed=bad)


# ---- rewriting ------------------------------------------------------------------------------------------


def rebuild_bodies(parts: DataFrame, keys: tuple[str, ...] = ("request_id",), text: str = "text") -> DataFrame:
    """Chat bodies rebuilt from their parts, texts at the same coordinates.

    One body's parts meet in one group; a body is at most one request.
    """
    item = F.struct("part_index", "part_type", "tool_name", F.col(text).alias("text"))
    per_message = parts.groupBy(*keys, "message_index", "role").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    content = F.transform(
        "items", lambda p: F.struct(p["part_type"].alias("type"), p["text"].alias("text"))
    )
    message = F.struct("message_index", F.struct("role", content.alias("content")).alias("m"))
    bodies = per_message.groupBy(*keys).agg(F.array_sort(F.collect_list(message)).alias("ms"))
    messages = F.transform("ms", lambda x: x["m"])
    return bodies.select(*keys, F.to_json(F.struct(messages.alias("messages"))).alias("body"))


def unmatched_targets(plan: DataFrame, parts: DataFrame) -> DataFrame:
    """Planned spans whose part does not exist: an error for the caller to report."""
    return plan.join(parts, ["request_id", "message_index", "part_index"], "left_anti")


# ---- evaluation sets ------------------------------------------------------------------------------------

# Languages, risks and directions of evaluation rows.
LANGUAGES = ("th", "en", "mixed")
RISKS = (
    "clean",
    "pii",
    "secret",
    "prompt_injection",
    "system_prompt_extraction",
    "credential_exfiltration",
    "policy_bypass",
    "unsafe_tool_intent",
)
DIRECTIONS = ("request", "tool_call", "response", "tool_result")
EVAL_SCHEMA = (
    "id string, language string, direction string, risk string, state string, expected map<string,variant>"
)


def eval_rows(lines: DataFrame, column: str = "line") -> DataFrame:
    """JSONL evaluation rows with the first failing check, expected findings and answers."""
    parsed = lines.withColumn("r", F.from_json(column, EVAL_SCHEMA)).withColumn(
        "ok", F.try_parse_json(column).isNotNull()
    )
    r = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(""))
    fault = (
        F.when(~F.col("ok"), "json")
        .when(r("id") == "", "id")
        .when(~r("language").isin(*LANGUAGES), "language")
        .when(~r("risk").isin(*RISKS), "risk")
        .when(~r("direction").isin(*DIRECTIONS), "direction")
        .when(r("state") == "", "state")
        .when(F.col("r.expected").isNull(), "expected")
        .otherwise("")
    )
    found = F.transform(
        items_of(F.try_element_at("r.expected", F.lit("findings"))),
        lambda v: F.when(kind_of(v) == "STRING", as_string(v)),
    )
    answers = F.filter(
        F.map_entries("r.expected"),
        lambda e: (e["key"] != "findings") & (kind_of(e["value"]) == "BOOLEAN"),
    )
    return parsed.select(
        *[c for c in lines.columns if c != column],
        "r.id",
        "r.language",
        "r.direction",
        "r.risk",
        "r.state",
        fault.alias("fault"),
        F.coalesce(F.filter(found, lambda v: v.isNotNull()), F.array().cast("array<string>")).alias(
            "findings_expected"
        ),
        F.transform(
            answers,
            lambda e: F.struct(
                e["key"].alias("question"), F.try_variant_get(e["value"], "$", "boolean").alias("answer")
            ),
        ).alias("answers_expected"),
    )


GOLD_SCHEMA = (
    "id string, language string, text string, spans array<struct<entity:string,start:int,end:int>>"
)


def gold_spans(lines: DataFrame, column: str = "line") -> DataFrame:
    """Gold spans of JSONL examples, one row each; spans outside their text are flagged."""
    rows = lines.select(F.from_json(column, GOLD_SCHEMA).alias("r")).select("r.*")
    out = rows.select("id", "language", F.octet_length("text").alias("n_bytes"), F.explode("spans").alias("s"))
    valid = (F.col("s.start") >= 0) & (F.col("s.end") > F.col("s.start")) & (F.col("s.end") <= F.col("n_bytes"))
    return out.select("id", "language", "s.entity", "s.start", "s.end", valid.alias("valid"))
