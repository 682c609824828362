"""Structured Streaming forms of the operators.

Each takes a streaming frame and returns one; the caller starts the sink, with a checkpoint in the
cluster's shared folder. State lives in keyed stores that survive a lost executor, so sessions that run these jobs need
`spark.sql.streaming.stateStore.providerClass` set to the RocksDB provider (`session.STATE_STORE`). Rows
of a key pass one by one; what they change is the batch arithmetic. State that can no longer change an answer
goes by event-time timers, never by the clock, so a replay decides as the live stream did.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scan import Detector
from ..functions.timing import micros
from ..operators import detectors as D
from .deltas import LIMIT, release
from .holdback import Held, OpenMatches
from .limits import MICROS, bucket_step
from .quarantine import SEEN, Containment, QuarantineRule

DAY = "24 hours"


def minute_counts(events: DataFrame) -> DataFrame:
    """One-minute tumbling counts; events more than a day behind their arrival go.

    `events` carries at, arrived_at and event_type.
    """
    fresh = events.filter(F.col("at") >= F.col("arrived_at") - F.expr(f"INTERVAL {DAY}"))
    return fresh.withWatermark("at", DAY).groupBy(F.window("at", "1 minute"), "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )


def stream_findings(parts: DataFrame, detectors: Iterable[Detector] = D.PRODUCTION) -> DataFrame:
    """Findings of a stream of parts, one per type and place.

    With an event time column `at` the duplicates are held within its watermark only.
    """
    timed = "at" in parts.columns
    keys = [*D.PART_KEYS, "at"] if timed else list(D.PART_KEYS)
    found = D.scan(parts, detectors, keys=keys)
    place = [*D.PART_KEYS, "category", "subtype", "start", "end"]
    if timed and parts.isStreaming:
        return found.withWatermark("at", DAY).dropDuplicatesWithinWatermark(place)
    return found.dropDuplicates(place)


# ---- state -----------------------------------------------------------------------------------------------

#: Rows of one key in one micro-batch that are put in order; later ones come as they arrive.
REORDER = 4096


def in_order(rows: Iterator[Row], *order: str) -> Iterator[Row]:
    """Rows by `order` as far as a heap of REORDER rows reaches; the group is never held."""
    heap: list[tuple] = []
    for n, row in enumerate(rows):
        heapq.heappush(heap, (*[row[c] for c in order], n, row))
        if len(heap) > REORDER:
            yield heapq.heappop(heap)[-1]
    while heap:
        yield heapq.heappop(heap)[-1]


class _Keyed(StatefulProcessor):
    """One value per key, forgotten by a timer on event time."""

    state = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def forget_at(self, us: int) -> None:
        """One timer per key, at the end of the second; an earlier one goes."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((us // MICROS + 1) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """Rows (`key`, `at`, ...) through a processor with timers on `at`."""
    timed = rows.withWatermark("at", late)
    return timed.groupBy(key).transformWithState(processor, schema, "append", "EventTime")


# ---- rate limit ------------------------------------------------------------------------------------------


class _Bucket(_Keyed):
    state = "tokens long, last long"

    def __init__(self, rate: int, burst: int):
        self.rate, self.full = rate, burst * MICROS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.value.get() if self.value.exists() else None
        tokens, last = held or (self.full, None)
        for row in in_order(rows, "us", "id"):
            us = row["us"]
            tokens, ok, wait = bucket_step(tokens, us - (us if last is None else last), self.rate, self.full)
            last = us if last is None else max(last, us)
            yield Row(key=key[0], id=row["id"], allowed=ok, retry_after_us=wait)
        self.value.update((tokens, last))
        # From then on the bucket is full, as an unknown one.
        self.forget_at(last - -(self.full - tokens) // self.rate)


def token_bucket_stream(events: DataFrame, rate: int, burst: int, late: str = "10 minutes") -> DataFrame:
    """Allow or deny per event of `key` (`id`, `at`), as it arrives.

    A key is forgotten when the watermark passes the time its bucket is full again, so forgetting it
    changes no answer however fast events are replayed. Events later than `late` are dropped.
    """
    rows = events.select("key", "id", "at", micros("at").alias("us"))
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, id {kinds['id']}, allowed boolean, retry_after_us long"
    return _stateful(rows, "key", _Bucket(rate, burst), schema, late)


# ---- breaker ---------------------------------------------------------------------------------------------


class _Breaker(_Keyed):
    state = "failures long, open_until long"

    def __init__(self, threshold: int, cooldown: int):
        self.threshold, self.cooldown = threshold, cooldown

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        failures, open_until = self.value.get() if self.value.exists() else (0, 0)
        for row in in_order(rows, "us", "id"):
            name = "closed" if failures < self.threshold else "open" if row["us"] < open_until else "half_open"
            yield Row(key=key[0], id=row["id"], failures_before=failures, state_before=name)
            failures = 0 if row["success"] else failures + 1
            open_until = row["us"] + self.cooldown if failures >= self.threshold else 0
        # A breaker without failures is as good as an unknown one.
        if failures:
            self.value.update((failures, open_until))
        else:
            self.value.clear()


def breaker_stream(outcomes: DataFrame, threshold: int, cooldown_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Breaker state before each outcome (`key`, `id`, `at`, `success`)."""
    rows = outcomes.select("key", "id", "at", micros("at").alias("us"), "success")
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, id {kinds['id']}, failures_before long, state_before string"
    return _stateful(rows, "key", _Breaker(threshold, cooldown_seconds * MICROS), schema, late)


# ---- quarantine ------------------------------------------------------------------------------------------


class _Quarantine(_Keyed):
    state = "count long, window_start long, last long, expires long"

    def __init__(self, rule: QuarantineRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.signals = handle.getListState("signals", "signal string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = Containment(self.rule)
        if self.value.exists():
            held.count, held.window_start, held.last, held.expires = self.value.get()
            held.seen.extend(s[0] for s in self.signals.get())
        for row in in_order(rows, "us", "signal"):
            count, started, expires = held.observe(row["us"], row["signal"])
            if started:
                yield Row(key=key[0], started_us=row["us"], expires_us=expires, signal_count=count)
        self.value.update((held.count, held.window_start, held.last, held.expires))
        self.signals.put([(s,) for s in list(held.seen)[-SEEN:]])


def quarantine_stream(signals: DataFrame, rule: QuarantineRule, late: str = "10 minutes") -> DataFrame:
    """Containments as they start (`key`, `signal`, `at`).

    The last signals of a key are remembered for good, as a repeated delivery counts once however late.
    """
    rows = signals.select("key", F.col("signal").cast("string").alias("signal"), "at", micros("at").alias("us"))
    schema = f"key {dict(rows.dtypes)['key']}, started_us long, expires_us long, signal_count long"
    out = _stateful(rows, "key", _Quarantine(rule), schema, late)
    return out.select(
        "key",
        F.timestamp_micros("started_us").alias("started_at"),
        F.timestamp_micros("expires_us").alias("expires_at"),
        "signal_count",
    )


# ---- holdback --------------------------------------------------------------------------------------------


class _Holdback(StatefulProcessor):
    """Deltas of one stream in the order of their numbers; what no match can cross goes on.

    `value` keeps the number awaited, the number of the next part, the held text, how much of it was looked at,
    and whether the stream is over; `early` keeps deltas that came before their turn.
    """

    def __init__(self, rules: OpenMatches, limit: int, idle: int | None):
        self.rules, self.limit, self.idle = rules, limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "awaited long, part long, pending string, looked long, over boolean")
        self.early = handle.getListState("early", "seq long, data string, done boolean")

    def _load(self) -> tuple[int, int, Held, bool]:
        if not self.value.exists():
            return 0, 0, Held(self.rules, self.limit), False
        awaited, part, pending, looked, over = self.value.get()
        return awaited, part, Held(self.rules, self.limit, pending, looked), over

    def _flushed(self, key, part: int, own: str, over: bool) -> Iterator[Row]:
        if own or over:
            yield Row(stream_id=key[0], part=part, own=own, over=over)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        awaited, part, held, over = self._load()
        early = {seq: (data, done) for seq, data, done in self.early.get()} if self.early.exists() else {}
        latest, out = None, []
        for row in in_order(rows, "seq"):
            latest = row["us"] if latest is None else max(latest, row["us"] or 0)
            # A delta seen before, or after the end, is a repeated delivery.
            if over or row["seq"] < awaited:
                continue
            early[row["seq"]] = (row["data"], row["done"])
            while not over and awaited in early:
                data, done = early.pop(awaited)
                awaited += 1
                out.append(held.add(data or ""))
                if done and not held.over:
                    out.append(held.take(len(held.pending)))
                over = held.over or bool(done)
            # Deltas that wait for a missing one are held text too.
            if not over and len(held.pending) + sum(len(d or "") for d, _ in early.values()) > self.limit:
                held.over = over = True
        own = "".join(out)
        yield from self._flushed(key, part, own, held.over)
        self.value.update((awaited, part + 1 if own else part, "" if over else held.pending, held.looked, over))
        if over or not early:
            self.early.clear()
        else:
            self.early.put([(seq, *rest) for seq, rest in sorted(early.items())])
        if self.idle is not None and latest is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((latest // MICROS + 1 + self.idle) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A silent stream ends: without gaps its held text goes out, behind a gap nothing does."""
        awaited, part, held, over = self._load()
        gap = self.early.exists()
        self.early.clear()
        if not over:
            own = "" if gap else held.take(len(held.pending))
            yield from self._flushed(key, part, own, gap)
            # What comes later is ignored: the number it would need has passed.
            self.value.update((awaited, part + 1, "", 0, True))

    def close(self) -> None:
        pass


class _Ended(_Keyed):
    """Parts of one stream up to the one it ends in."""

    state = "stopped boolean"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stopped = self.value.exists()
        for row in in_order(rows, "part"):
            if stopped:
                return
            stopped = bool(row["stopped"])
            yield Row(stream_id=key[0], part=row["part"], released=row["released"], terminated=stopped)
        if stopped:
            self.value.update((True,))


def holdback_stream(
    deltas: DataFrame,
    detectors: Iterable[Detector],
    window: int = 4096,
    limit: int = LIMIT,
    blocked: Iterable[str] = (),
    idle_seconds: int | None = None,
    late: str = "10 minutes",
) -> DataFrame:
    """Released text of streams of deltas (`stream_id`, `seq` from 0 on, `data`, `done`) in parts.

    Deltas may come in any order and more than once. The open start of a match waits in the state until it
    closes; `done` flushes a stream. A stream that holds more than `limit` characters ends, and
    so does one with a finding of a blocked subtype: its last part is `terminated`, held text never leaves. With an event
    time column `at` and `idle_seconds`, a stream that is silent for so long is flushed.
    """
    detectors = tuple(detectors)
    timed = "at" in deltas.columns
    us = micros("at") if timed else F.lit(0).cast("long")
    rows = deltas.select("stream_id", F.col("seq").cast("long").alias("seq"), "data", "done", us.alias("us"), *(["at"] if timed else []))
    if timed:
        rows = rows.withWatermark("at", late)
    kind = dict(deltas.dtypes)["stream_id"]
    idle = idle_seconds if timed else None
    parts = rows.groupBy("stream_id").transformWithState(
        _Holdback(OpenMatches(detectors, window), limit, idle),
        f"stream_id {kind}, part long, own string, over boolean",
        "append",
        "EventTime" if timed else "None",
    )
    out = release(parts, detectors, window, blocked, limit)
    return out.groupBy("stream_id").transformWithState(
        _Ended(), f"stream_id {kind}, part long, released string, terminated boolean", "append", "None"
    )
