"""Provider event streams: text fragments, and release of inspected text.

Text is released in parts that no match crosses: the open start of a match waits until it closes,
and a stream that would hold more than its limit ends (see `holdback`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_walk import string_leaves
from ..functions.ranking import blocked_running_sum, null_safe_join
from ..functions.scan import Detector, finding_array
from ..operators.transform import span_plan
from ..session import cut_lineage
from .holdback import Held, OpenMatches

FRAGMENT = "struct<path:string,text:string,kind:string>"
NO_FRAGMENTS = f"CAST(array() AS array<{FRAGMENT}>)"
CHAT = (
    "struct<choices:array<struct<delta:struct<content:variant,"
    "tool_calls:array<struct<function:struct<arguments:variant>>>>>>>"
)
# Keys that mark an attachment, and content keys of generic events.
ATTACHMENT_KEYS = "image_url|input_image|input_file|file_data|document|attachment|attachments"
GENERIC_KEYS = ("text", "content", "delta", "output_text", "partial_json", "arguments")


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _at(root: Column, path: str) -> Column:
    return _text(F.try_variant_get(root, path, "variant"))


def _fragment(path, text: Column, kind) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(path).alias("path"), text.alias("text"), as_col(kind).alias("kind")).cast(FRAGMENT)


def _present(*fragments: Column) -> Column:
    return F.filter(F.array(*fragments), lambda f: f["text"].isNotNull())


def chat_fragments(root: Column) -> Column:
    choices = F.try_variant_get(root, "$", CHAT)["choices"]

    def build(c: Column, i: Column) -> Column:
        own = _present(
            _fragment(F.concat(F.lit("choices."), i.cast("string"), F.lit(".content")), _text(c["delta"]["content"]), "text")
        )
        calls = F.transform(
            c["delta"]["tool_calls"],
            lambda t, j: _fragment(
                F.concat(F.lit("choices."), i.cast("string"), F.lit(".tool_calls."), j.cast("string")),
                _text(t["function"]["arguments"]),
                "tool_arguments",
            ),
        )
        calls = F.filter(calls, lambda f: f["text"].isNotNull())
        return F.concat(own, F.coalesce(calls, F.expr(NO_FRAGMENTS)))

    return F.coalesce(F.flatten(F.transform(choices, build)), F.expr(NO_FRAGMENTS))


def response_fragments(root: Column) -> Column:
    typ = F.coalesce(_at(root, "$.type"), F.lit(""))
    tool = F.contains(typ, F.lit("function_call_arguments")) | F.contains(typ, F.lit("tool"))
    open_delta = F.startswith(typ, F.lit("response.output_text.")) | tool
    tool_kind = F.contains(typ, F.lit("function_call")) | F.contains(typ, F.lit("tool"))
    rows = []
    for key in ("delta", "text", "output_text", "arguments"):
        text = _at(root, f"$.{key}")
        if key == "delta":
            text = F.when(open_delta, text)
        kind = F.lit("tool_arguments") if key == "arguments" else F.when(tool_kind, "tool_arguments").otherwise("text")
        rows.append(_fragment(key, text, kind))
    rows.append(_fragment("item.arguments", _at(root, "$.item.arguments"), "tool_arguments"))
    return _present(*rows)


def block_fragments(root: Column) -> Column:
    rows = _present(
        _fragment("delta.text", _at(root, "$.delta.text"), "text"),
        _fragment("delta.partial_json", _at(root, "$.delta.partial_json"), "tool_arguments"),
        _fragment(
            "delta.input_json_delta", _at(root, "$.delta.input_json_delta.partial_json"), "tool_arguments"
        ),
    )
    return F.when(_at(root, "$.type") == "content_block_delta", rows).otherwise(F.expr(NO_FRAGMENTS))


def with_generic_fragments(df: DataFrame, root: str, text: str, name: str) -> DataFrame:
    """Known content keys at any depth, in key order; a bare string is one fragment."""
    known = F.filter(string_leaves(root, text), lambda n: F.lower(n["key"]).isin(*GENERIC_KEYS))
    tool = lambda n: F.contains(F.lower(n["key"]), F.lit("arg")) | (n["key"] == "partial_json")
    shown = F.transform(
        known, lambda n: _fragment(n["path"], n["text"], F.when(tool(n), "tool_arguments").otherwise("text"))
    )
    bare = _present(_fragment("", _text(F.col(root)), "text"))
    out = F.when(F.size(bare) > 0, bare).otherwise(F.array_sort(shown))
    return df.withColumn(name, out)


def sse_fragments(events: DataFrame, keys: Iterable[str] = ("stream_id", "seq")) -> DataFrame:
    """Fragments per event (`family`, `data`); known families fail closed on bad JSON.

    One row per fragment; events without fragments keep one row with NULL text.
    """
    keys = list(keys)
    silent = F.trim("data").isin("", "[DONE]")
    rows = events.withColumn("_root", F.when(~silent, F.try_parse_json("data")))
    rows = with_generic_fragments(rows, "_root", "data", "_generic")
    family, root = F.col("family"), F.col("_root")
    plain = F.array(_fragment("", F.col("data"), "text"))
    fragments = (
        F.when(silent, F.expr(NO_FRAGMENTS))
        .when(root.isNull() & (family == "generic"), plain)
        .when(root.isNull(), F.expr(NO_FRAGMENTS))
        .when(family == "chat", chat_fragments(root))
        .when(family == "responses", response_fragments(root))
        .when(family == "messages", block_fragments(root))
        .otherwise(F.col("_generic"))
    )
    flagged = rows.select(
        *keys,
        "family",
        (~silent & root.isNull() & (family != "generic")).alias("malformed"),
        F.col("data").rlike(rf'(?<!\\)"(?i:{ATTACHMENT_KEYS})"\s*:').alias("attachment"),
        fragments.alias("_f"),
    )
    out = flagged.select(*keys, "family", "malformed", "attachment", F.posexplode_outer("_f").alias("fragment", "f"))
    return out.select(*keys, "family", "malformed", "attachment", "fragment", "f.text", "f.kind")


# ---- release --------------------------------------------------------------------------------------------

#: Characters a stream may hold back, and fewest characters of a block of a long stream.
LIMIT = 1 << 20
BLOCK_CHARS = 4 << 20


def release(parts: DataFrame, detectors: Iterable[Detector], window: int = 0, blocked: Iterable[str] = (), limit: int = LIMIT) -> DataFrame:
    """`released`: the redacted text of each part (`own`), and `stopped`: whether its stream ends in it.

    No match leaves its part. A stream ends `window` characters before the first finding of a
    blocked subtype, at a finding longer than `limit`, or after a part marked `over`.
    """
    rows = finding_array(parts, detectors, "_found", "own")
    hashed = F.transform("_found", lambda f: f.withField("value_hash", F.lit("")))
    rows = rows.withColumn("_hashed", hashed).withColumn("_plan", span_plan("_hashed"))
    names = list(blocked)

    def first(test, before: int = 0) -> Column:
        start = F.get(F.filter("_plan", test), F.lit(0))["char_start"]
        return F.when(start.isNotNull(), F.greatest(start - before, F.lit(0)))

    long = first(lambda t: t["char_end"] - t["char_start"] > limit)
    stop = F.least(long, first(lambda t: t["subtype"].isin(*names), window)) if names else long
    # A stop inside an earlier match moves to its start.
    inside = F.filter("_plan", lambda t: (t["char_start"] < F.col("_stop")) & (t["char_end"] > F.col("_stop")))
    rows = rows.withColumn("_stop", stop)
    rows = rows.withColumn("_upto", F.coalesce(F.get(inside, F.lit(0))["char_start"], "_stop", F.length("own")))
    text = F.expr(
        """aggregate(filter(_plan, t -> t.char_end <= _upto), named_struct('pos', 0, 'out', CAST(array() AS array<string>)),
          (acc, t) -> named_struct('pos', t.char_end, 'out', concat(acc.out, array(
            substr(own, acc.pos + 1, t.char_start - acc.pos), concat('[REDACTED:', t.subtype, ']')))),
          acc -> concat(array_join(acc.out, ''), substr(own, acc.pos + 1, _upto - acc.pos)))"""
    )
    kept = [c for c in parts.columns if c not in ("own", "over")]
    return rows.select(*kept, text.alias("released"), (F.col("over") | F.col("_stop").isNotNull()).alias("stopped"))


FIRST, DELTA, LAST = 0, 1, 2


def _blocks(deltas: DataFrame, stream: str, size: int) -> DataFrame:
    """Deltas with the block of their stream's running length; a stream of any length is many blocks."""
    sized = deltas.select(stream, "seq", "data").withColumn("n", F.length("data"))
    placed = blocked_running_sum(sized, [stream], F.floor(F.col("seq") / 1024), ["seq"], F.col("n"), "upto")
    block = F.floor((F.col("upto") - F.col("n")) / size)
    return placed.select(stream, block.alias("block"), F.col("seq").cast("long").alias("seq"), "data")


def _in_order(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch[c].tolist() for c in columns], strict=True)


def _ends(rules: OpenMatches, limit: int, stream: str):
    """What is still held at the end of each block, seen from its own text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = held = None
        for key, block, data in _in_order(batches, stream, "block", "data"):
            if (key, block) != place:
                if held is not None:
                    yield _row(place, held)
                place, held = (key, block), Held(rules, limit)
            held.add(data or "")
        if held is not None:
            yield _row(place, held)

    def _row(place, held):
        held.settle()
        return pd.DataFrame([(*place, held.pending)], columns=[stream, "block", "tail"])

    return run


def _parts(rules: OpenMatches, limit: int, chunk: int, stream: str):
    """Parts of each block, which begins with the tail of the one before and leaves its own to the next."""
    names = [stream, "block", "part", "own", "over"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        place, held, ready, size, number = None, None, [], 0, 0
        for key, block, mark, data in _in_order(batches, stream, "block", "mark", "data"):
            if (key, block) != place:
                place, held, ready, size, number = (key, block), Held(rules, limit), [], 0, 0
            if held.over:
                continue
            if mark == FIRST:
                held.pending = data
                continue
            # At the end of a block all goes but the tail that its successor begins with.
            text = held.add(data or "") if mark == DELTA else held.take(max(0, len(held.pending) - int(data)))
            ready.append(text)
            size += len(text)
            if size >= chunk or held.over or (size and mark == LAST):
                out.append((*place, number, "".join(ready), held.over))
                ready, size, number = [], 0, number + 1
            if len(out) >= 256:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return run


def stream_parts(
    deltas: DataFrame, rules: OpenMatches, chunk: int, limit: int, stream: str = "stream_id", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Parts (`block`, `part`, `own`, `over`) of ordered deltas (`seq`, `data`) that no match crosses.

    A stream is cut into blocks of its running length, at least four times the limit. What a block
    holds at its end follows from its own text, as a match from before it would be over the
    limit by then. So all blocks of a stream are read at once: a first pass finds what each leaves
    over, a second one gives that to its successor and cuts the block into parts.
    """
    kind = dict(deltas.dtypes)[stream]
    rows = cut_lineage(_blocks(deltas, stream, max(block_chars, 4 * limit)))
    place = [stream, "block"]
    places = rows.select(*place).distinct()
    last = places.groupBy(stream).agg(F.max("block").alias("last"))
    # Only what a block gives to a successor is looked for; most streams are one block.
    long = last.where("last > 0")
    dealt = null_safe_join(rows, long, [stream]).where("block < last").drop("last").repartition(*place).sortWithinPartitions(*place, "seq")
    tails = cut_lineage(dealt.mapInPandas(_ends(rules, limit, stream), f"{stream} {kind}, block long, tail string"))
    no_seq = F.lit(None).cast("long").alias("seq")
    first = tails.select(stream, (F.col("block") + 1).alias("block"), no_seq, F.col("tail").alias("data"), F.lit(FIRST).alias("mark"))
    left = F.coalesce(F.length("tail"), F.lit(0)).cast("string")
    of = tails.select(F.col(stream).alias("_of"), F.col("block").alias("_block"), "tail")
    close = places.join(of, F.col(stream).eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_block")), "left")
    close = close.select(stream, "block", no_seq, left.alias("data"), F.lit(LAST).alias("mark"))
    marked = rows.withColumn("mark", F.lit(DELTA)).unionByName(first).unionByName(close)
    dealt = marked.repartition(*place).sortWithinPartitions(*place, "mark", "seq")
    return dealt.mapInPandas(_parts(rules, limit, chunk, stream), f"{stream} {kind}, block long, part long, own string, over boolean")


def stream_release(
    deltas: DataFrame,
    detectors: Iterable[Detector],
    window: int = 4096,
    chunk: int = 65536,
    blocked: Iterable[str] = (),
    stream: str = "stream_id",
    limit: int = LIMIT,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Released text of each stream in parts (`block`, `part`) of about `chunk` characters.

    Text waits until no match can cross the place where it is cut, whatever `chunk` and `window` are. A stream
    that holds more than `limit` characters, or meets a finding of a blocked subtype, is
    `terminated`: nothing from there on is released, and of a blocked finding nothing from `window`
    characters before it.
    """
    detectors = tuple(detectors)
    parts = stream_parts(deltas, OpenMatches(detectors, window), chunk, limit, stream, block_chars)
    out = cut_lineage(release(parts, detectors, window, blocked, limit))
    place = F.struct("block", "part")
    stops = out.where("stopped").groupBy(stream).agg(F.min(place).alias("_stop"))
    rows = out.join(stops, stream, "left").where(F.col("_stop").isNull() | (place <= F.col("_stop")))
    return rows.select(stream, "block", "part", "released", F.col("_stop").isNotNull().alias("terminated"))
