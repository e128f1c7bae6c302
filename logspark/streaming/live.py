"""Operators with timers: alerts, silences and rate decisions while rows arrive.

All of them work in event time.  What they emit depends on the watermark alone and not on how the
input was cut into micro-batches, because a row or a timer only ever moves a series up to
the watermark, in order of time.  Each state is bounded by what is still open at the
watermark, is removed when nothing is open, and lies in the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logspark import fixed
from logspark.operators import telemetry
from logspark.operators.ratelimit import SlidingLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY_BUCKETS = 1024  # states that the keys of a stream share; it must not change while a checkpoint is in use
ERROR_RATIO, MEAN_LATENCY = "error_ratio", "mean_latency"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _micros(seconds: Column) -> Column:
    return (seconds * 1_000_000).cast("long")


# --- alerts --------------------------------------------------------------------------


class Rule(NamedTuple):
    """When a series is in alert: its value over ``window_s`` is above ``limit`` at every step for ``hold_s``."""

    value: str
    window_s: int
    step_s: int
    hold_s: int
    limit: float

    def of(self, requests: int, errors: int, micros: int) -> float:
        return errors / requests if self.value == ERROR_RATIO else micros / 1_000_000 / requests


class _Alert(NamedTuple):
    """An alert that is not over: its first and last step in alert, greatest value, and whether it fires."""

    pending: int
    until: int
    peak: float
    firing: bool


class AlertProcessor(StatefulProcessor):
    """pending, firing and resolved (or cancelled, if it never fired) of one series.

    The state holds the sums of the steps that a window not yet evaluated may cover and
    at most one open alert.  A timer at the next step's end evaluates a series without new input.
    """

    def __init__(self, keys: list[str], rule: Rule):
        if rule.window_s % rule.step_s:
            raise ValueError("the window must be a multiple of the step")
        self.keys, self.rule = keys, rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step long", "requests long, errors long, micros long")
        self.open = handle.getValueState("open", "pending long, until long, peak double, firing boolean")
        self.done = handle.getValueState("done", "step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            self.steps.updateValue((row["step"],), (row["requests"], row["errors"], row["micros"]))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, timerValues) -> Iterator[Row]:
        """Evaluate every window that ends between the last one evaluated and the watermark."""
        rule, width = self.rule, self.rule.window_s // self.rule.step_s
        now = timerValues.getCurrentWatermarkInMs() // (rule.step_s * 1000)
        done = self.done.get()[0] if self.done.exists() else -1
        sums = {k[0]: v for k, v in self.steps.iterator()}
        alert = _Alert(*self.open.get()) if self.open.exists() else None
        for end in sorted({s + i for s in sums for i in range(1, width + 1) if done < s + i <= now}):
            parts = [sums[s] for s in range(end - width, end) if s in sums]
            value = rule.of(*(sum(p) for p in zip(*parts, strict=True)))
            if alert and (end > alert.until + 1 or not value > rule.limit):
                yield self._over(key, alert)
                alert = None
            if value > rule.limit:
                if alert is None:
                    alert = _Alert(end, end, value, False)
                    yield self._row(key, "pending", end, alert)
                alert = alert._replace(until=end, peak=max(alert.peak, value))
                if not alert.firing and (end - alert.pending) * rule.step_s >= rule.hold_s:
                    alert = alert._replace(firing=True)
                    yield self._row(key, "firing", end, alert)
        if alert and alert.until < now:
            yield self._over(key, alert)
            alert = None
        for step in [s for s in sums if s + width <= now]:
            self.steps.removeKey((step,))
            del sums[step]
        if alert:
            self.open.update(tuple(alert))
        else:
            self.open.clear()
        if sums or alert:
            self.done.update((now,))
            self.handle.registerTimer((now + 1) * rule.step_s * 1000)
        else:
            self.done.clear()

    def _over(self, key, alert: _Alert) -> Row:
        return self._row(key, "resolved" if alert.firing else "cancelled", alert.until + 1, alert)

    def _row(self, key, transition: str, at: int, alert: _Alert) -> Row:
        step_s = self.rule.step_s
        named = dict(zip(self.keys, key, strict=True))
        return Row(**named, transition=transition, at_s=at * step_s, pending_s=alert.pending * step_s, peak=alert.peak)


def alert_transitions(
    requests: DataFrame, keys: list[str], rule: Rule, watermark: str = fixed.WATERMARK
) -> DataFrame:
    """(keys, transition, at_s, pending_s, peak) of every series, as the watermark passes them.

    Requests are summed per series and step first, spread over all tasks, and only the
    closed steps of a series meet.  ``peak`` is the greatest value so far.
    """
    rows = telemetry.measured(requests).withWatermark("ts", watermark)
    steps = rows.groupBy(F.window("ts", f"{rule.step_s} seconds"), *keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        _micros(F.sum(F.col("duration_s").cast("decimal(18,6)"))).alias("micros"),
    )
    step = F.floor(F.unix_seconds("window.start") / rule.step_s).cast("long")
    closed = steps.select(*keys, step.alias("step"), "requests", "errors", "micros", F.window_time("window").alias("ts"))
    types = dict(requests.dtypes) | {"route": "string"}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", transition string, at_s long, pending_s long, peak double"
    return closed.groupBy(*keys).transformWithState(AlertProcessor(keys, rule), schema, "append", "eventTime")


# --- silences ------------------------------------------------------------------------


class SilenceProcessor(StatefulProcessor):
    """down and back of one source, whose signs of life arrive in any order within the watermark.

    The state holds the last sign the watermark has passed, and the first and last one of each
    ``hold_s`` after it: within such a bucket no silence can be long enough.  A timer at the end of the
    tolerated silence finds a source down without any new row.
    """

    def __init__(self, source: str, hold_s: int):
        self.source, self.hold = source, hold_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "first long, last long")
        self.last = handle.getValueState("last", "us long, down boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen: dict[int, tuple[int, int]] = {}
        for row in rows:
            bucket, us = row["us"] // self.hold, row["us"]
            first, last = seen.get(bucket, (us, us))
            seen[bucket] = min(first, us), max(last, us)
        for bucket, (first, last) in seen.items():
            if self.waiting.containsKey((bucket,)):
                old = self.waiting.getValue((bucket,))
                first, last = min(first, old[0]), max(last, old[1])
            self.waiting.updateValue((bucket,), (first, last))
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, timerValues) -> Iterator[Row]:
        """Look at all signs of life before the watermark, then at the silence since the last one."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, down = self.last.get() if self.last.exists() else (None, False)
        buckets = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator())
        for bucket, first, latest in buckets:
            if first >= now:
                break
            if last is not None and first - last > self.hold:
                if not down:
                    yield self._row(key, "down", last, None)
                yield self._row(key, "back", last, first)
            last, down = max(latest, first if last is None else last), False
            # A bucket that the watermark has not passed may still get later signs.
            if now >= (bucket + 1) * self.hold:
                self.waiting.removeKey((bucket,))
        if last is None:
            next_us = buckets[0][1]
        else:
            if not down and now > last + self.hold:
                yield self._row(key, "down", last, None)
                down = True
            self.last.update((last, down))
            open_ends = [first for _, first, _ in buckets if first >= now] or [(b + 1) * self.hold for b, _, _ in buckets if now < (b + 1) * self.hold]
            next_us = min([*open_ends, *([] if down else [last + self.hold])], default=None)
        if next_us is not None:
            self.handle.registerTimer(next_us // 1000 + 1)

    def _row(self, key, transition: str, last: int, back: int | None) -> Row:
        silence = (back - last if back is not None else self.hold) / 1_000_000
        return Row(**{self.source: key[0]}, transition=transition, last_seen_us=last, back_us=back, silent_s=silence)


def silence_transitions(
    requests: DataFrame, source: str, hold_s: int = 60, watermark: str = fixed.WATERMARK
) -> DataFrame:
    """(source, transition, last_seen_us, back_us, silent_s) as the watermark passes them.

    ``down`` comes once a source has been silent for longer than ``hold_s``, whether or not rows
    of it arrive; ``silent_s`` is ``hold_s`` there and the whole silence in ``back``.
    A source's state stays as long as the source may come back: two numbers and a flag.
    """
    kind = dict(requests.dtypes)[source]
    signs = requests.withWatermark("ts", watermark).select(source, F.unix_micros("ts").alias("us"), "ts")
    schema = f"{source} {kind}, transition string, last_seen_us long, back_us long, silent_s double"
    return signs.groupBy(source).transformWithState(SilenceProcessor(source, hold_s), schema, "append", "eventTime")


# --- rate decisions ------------------------------------------------------------------

RATE_KEY = ["path", "client_ip"]


class RateProcessor(StatefulProcessor):
    """Admits the hits of the keys of one bucket in order of time, instant by instant.

    Rows are closed instants: all before the watermark, each once.  The state holds, for each key, the
    times of admitted hits that may still matter, at most ``times`` of them; keys without any are dropped, with
    the next rows or by a timer.  Most keys are hit once or twice, and a state of its own for each would be some calls to the
    state store a key; a bucket takes its keys in one.
    """

    def __init__(self, times: int, seconds: int):
        self.times, self.seconds = times, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "keys array<struct<path: string, client_ip: string, us: array<long>>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        logs = {(k[0], k[1]): SlidingLog(self.times, self.seconds, list(k[2])) for k in self._held()}
        for us, path, client, hits in sorted(((r["us"], r["path"], r["client_ip"], r["hits"]) for r in rows), key=lambda r: r[0]):
            log = logs.get((path, client))
            if log is None:
                log = logs[path, client] = SlidingLog(self.times, self.seconds)
            admitted = log.admit(us, hits)
            yield Row(path=path, client_ip=client, us=us, hits=hits, admitted=admitted, rejected=hits - admitted)
        self._keep([(*k, list(log.recent)) for k, log in logs.items()], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep(self._held(), timerValues)
        yield from ()

    def close(self) -> None:
        pass

    def _held(self) -> list:
        return self.recent.get()[0] if self.recent.exists() else []

    def _keep(self, keys: list, timerValues) -> None:
        """Store the keys that a later hit may still meet, and come back when none is left."""
        now = timerValues.getCurrentWatermarkInMs()
        open_keys = [tuple(k) for k in keys if k[2] and self._end_ms(k[2][-1]) > now]
        if open_keys:
            self.recent.update((open_keys,))
            self.handle.registerTimer(max(self._end_ms(k[2][-1]) for k in open_keys))
        else:
            self.recent.clear()

    def _end_ms(self, us: int) -> int:
        return us // 1000 + self.seconds * 1000 + 1


def rate_decisions(
    requests: DataFrame, times: int, seconds: int, watermark: str = fixed.WATERMARK, buckets: int = KEY_BUCKETS
) -> DataFrame:
    """(path, client_ip, us, hits, admitted, rejected) once the watermark has passed an instant.

    Hits that wait for the watermark are counts per (path, client, instant) in the state of an
    aggregation, spread over all tasks whatever their key.  A key's own state is at most
    ``times`` numbers, held with those of the other keys of its bucket; its task sees a count per instant of the micro-batch,
    not its hits.
    """
    counted = requests.withWatermark("ts", watermark).groupBy(*RATE_KEY, "ts").agg(F.count(F.lit(1)).alias("hits"))
    closed = counted.select(*RATE_KEY, F.unix_micros("ts").alias("us"), "hits", "ts")
    schema = "path string, client_ip string, us long, hits long, admitted long, rejected long"
    closed = closed.withColumn("bucket", F.pmod(F.xxhash64(*RATE_KEY), F.lit(buckets)).cast("int"))
    return closed.groupBy("bucket").transformWithState(RateProcessor(times, seconds), schema, "append", "eventTime")
