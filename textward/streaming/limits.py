"""Rate limits, concurrency and circuit breakers over ordered events."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import carry_fold
from ..functions.timing import micros
from ..functions.ranking import PLACE, blocked_last, blocked_row_number, blocked_running_sum, place_block, placed

MICROS = 1_000_000
EVENTS_PER_BLOCK = 4096


# ---- token bucket ---------------------------------------------------------------------------------------
#
# Tokens are whole numbers of 1/MICROS token, and a microsecond refills `rate` of them, so the
# arithmetic is exact. An event is a map of the token count: refill, cap at the burst, take
# one token when there is one. Maps of blocks compose, so a key of any size is reduced block
# by block, and only the composed maps (a few pieces each) are walked in order.


def _apply(pieces: list[tuple[int, int, int, bool]], refill: int, burst: int):
    """One event on a piecewise map: pieces (low, high, offset, constant) over start tokens."""
    out: list[tuple[int, int, int, bool]] = []

    def put(low, high, value, constant):
        if low > high:
            return
        if out:
            a, b, v, c = out[-1]
            if c == constant and v == value and b + 1 == low:
                out[-1] = (a, high, v, c)
                return
        out.append((low, high, value, constant))

    def take(low, high, value, constant):
        if constant:
            put(low, high, value - MICROS if value >= MICROS else value, True)
            return
        cut = MICROS - value
        put(low, min(high, cut - 1), value, False)
        put(max(low, cut), high, value - MICROS, False)

    for low, high, value, constant in pieces:
        if constant:
            take(low, high, min(burst, value + refill), True)
            continue
        shifted = value + refill
        full = burst - shifted
        take(low, min(high, full - 1), shifted, False)
        if high >= full:
            take(max(low, full), high, burst, True)
    return out


def _block_maps(rate: int, burst: int):
    """Rows sorted by (key, block, seq) to one map per block; blocks may span batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, pieces, last = None, [], 0
        for pdf in batches:
            done = []
            columns = (pdf["key"], pdf["block"], pdf["us"], pdf["prev_us"])
            for key, block, us, prev in zip(*[c.tolist() for c in columns], strict=True):
                if (key, block) != place:
                    if place is not None:
                        done.append((*place, pieces))
                    place, pieces, last = (key, block), [(0, burst, 0, False)], prev
                pieces = _apply(pieces, max(us - last, 0) * rate, burst)
                last = us
            yield _map_rows(done)
        if place is not None:
            yield _map_rows([(*place, pieces)])

    return run


def _map_rows(done: list) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "key": [d[0] for d in done],
            "block": [d[1] for d in done],
            "low": [[p[0] for p in d[2]] for d in done],
            "offset": [[p[2] for p in d[2]] for d in done],
            "constant": [[p[3] for p in d[2]] for d in done],
        }
    )


def _walk(burst: int):
    def fold(tokens, pdf: pd.DataFrame):
        tokens = burst if tokens is None else tokens
        starts = []
        for low, offset, constant in zip(pdf["low"], pdf["offset"], pdf["constant"], strict=True):
            starts.append(tokens)
            piece = bisect.bisect_right(list(low), tokens) - 1
            tokens = int(offset[piece]) + (0 if constant[piece] else tokens)
        return tokens, pd.DataFrame({"key": pdf["key"], "block": pdf["block"], "start_tokens": starts})

    return fold


def bucket_step(tokens: int, gap_us: int, rate: int, burst: int) -> tuple[int, bool, int]:
    """One event: tokens after it, whether it passes, and the wait in microseconds if not."""
    tokens = min(burst, tokens + max(gap_us, 0) * rate)
    if tokens >= MICROS:
        return tokens - MICROS, True, 0
    return tokens, False, -(-(MICROS - tokens) // rate)


def _replay(rate: int, burst: int):
    """Each block replayed from its known start; rows sorted by (key, block, seq)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, tokens, last = None, 0, 0
        for pdf in batches:
            left, passed, wait = [], [], []
            columns = (pdf["key"], pdf["block"], pdf["us"], pdf["prev_us"], pdf["start_tokens"])
            for key, block, us, prev, start in zip(*[c.tolist() for c in columns], strict=True):
                if (key, block) != place:
                    place, tokens, last = (key, block), start, prev
                tokens, ok, retry = bucket_step(tokens, us - last, rate, burst)
                last = us
                left.append(tokens)
                passed.append(ok)
                wait.append(retry)
            out = pdf[["key", "id", "seq"]].copy()
            yield out.assign(allowed=passed, tokens=left, retry_after_us=wait)

    return run


def token_bucket(
    events: DataFrame, key: str, event_id: str, ts: str, rate: int, burst: int, size: int = EVENTS_PER_BLOCK
) -> DataFrame:
    """Allow or deny per event of a key: `rate` tokens per second, `burst` tokens at most."""
    full = burst * MICROS
    rows = events.select(
        F.col(key).alias("key"), F.col(event_id).alias("id"), micros(ts).alias("us")
    )
    rows = placed(rows, ["key", "us", "id"])
    rows = blocked_row_number(rows, ["key"], place_block(), [PLACE], "seq").drop(PLACE)
    rows = rows.withColumn("block", F.floor((F.col("seq") - 1) / size))
    ends = rows.groupBy("key", "block").agg(F.max("us").alias("end_us"))
    per_key = Window.partitionBy("key").orderBy("block")
    ends = ends.select("key", "block", F.lag("end_us").over(per_key).alias("before_us"))
    within = Window.partitionBy("key", "block").orderBy("seq")
    rows = rows.join(ends, ["key", "block"])
    first = F.coalesce("before_us", F.min("us").over(within))
    rows = rows.select("key", "id", "us", "seq", "block", first.alias("prev_us"))
    kind = dict(rows.dtypes)
    place = ["key", "block"]
    maps = rows.repartition(*place).sortWithinPartitions(*place, "seq").mapInPandas(
        _block_maps(rate, full),
        f"key {kind['key']}, block bigint, low array<bigint>, offset array<bigint>, constant array<boolean>",
    )
    # One row per block of 4096 events: the maps are walked in order with one number of state.
    starts = carry_fold(
        maps, "key", ["block"], _walk(full), f"key {kind['key']}, block bigint, start_tokens bigint"
    )
    started = rows.join(starts, place).repartition(*place).sortWithinPartitions(*place, "seq")
    out = started.mapInPandas(
        _replay(rate, full),
        f"key {kind['key']}, id {kind['id']}, seq bigint, allowed boolean, tokens bigint, retry_after_us bigint",
    )
    return out.withColumnsRenamed({"key": key, "id": event_id})


# ---- concurrency ----------------------------------------------------------------------------------------


def concurrency_sweep(
    calls: DataFrame, key: str, event_id: str, start: Column, end: Column, limit: int
) -> DataFrame:
    """Calls in flight at each start, the new one included; ends before starts at one instant."""
    rows = calls.select(F.col(key), F.col(event_id), micros(start).alias("s"), micros(end).alias("e"))
    marks = rows.select(
        key, event_id, F.explode(F.array(F.struct(F.col("e").alias("us"), F.lit(-1).alias("step")), F.struct(F.col("s").alias("us"), F.lit(1).alias("step")))).alias("m")
    ).select(key, event_id, "m.*")
    marks = placed(marks, [key, "us", "step", event_id])
    out = blocked_running_sum(marks, [key], place_block(), [PLACE], F.col("step"), "in_flight")
    return out.filter("step = 1").select(key, event_id, "in_flight", (F.col("in_flight") > limit).alias("over_limit"))


# ---- circuit breaker ------------------------------------------------------------------------------------


def breaker_timeline(
    outcomes: DataFrame, key: str, event_id: str, ts: str, threshold: int, cooldown_seconds: int
) -> DataFrame:
    """State of a breaker at each outcome: failures before it, open, half open or closed.

    `outcomes` carries `success`. The failures before an event follow from its number and
    the number of the last success, so nothing is folded in sequence.
    """
    rows = placed(outcomes, [key, ts, event_id])
    rows = blocked_row_number(rows, [key], place_block(), [PLACE], "seq").drop(PLACE)
    block = F.floor(F.col("seq") / EVENTS_PER_BLOCK)
    looked = blocked_last(
        rows,
        [key],
        block,
        ["seq"],
        {
            "last_success": F.when(F.col("success"), F.col("seq")),
            "last_failure_at": F.when(~F.col("success"), F.col(ts)),
        },
    )
    failures = (F.col("seq") - 1 - F.coalesce("last_success", F.lit(0))).cast("long")
    cooled = micros(ts) >= micros("last_failure_at") + cooldown_seconds * MICROS
    state = (
        F.when(failures < threshold, "closed").when(cooled, "half_open").otherwise("open")
    )
    opens = ~F.col("success") & (failures + 1 >= threshold)
    return looked.select(
        key,
        event_id,
        "seq",
        failures.alias("failures_before"),
        state.alias("state_before"),
        opens.alias("opens"),
    )
