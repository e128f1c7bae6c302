"""Sliding-window rate check over a request log.

A hit is admitted when fewer than ``times`` admitted hits lie within the last
``seconds``; rejected hits are not remembered.  That makes the check a
recurrence along time, which a window frame cannot express.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.scale import cut

KEY = ["path", "client_ip"]
ADMITTED = "path string, client_ip string, us long, hits long, admitted long, rejected long"


class SlidingLog:
    """Times of admitted hits of one key, at most ``times`` of them."""

    def __init__(self, times: int, seconds: int, recent: list[int] | None = None):
        self.times, self.span = times, seconds * 1_000_000
        self.recent = deque(recent or [])

    def admit(self, us: int, hits: int) -> int:
        """How many of ``hits`` at one instant are admitted; instants must not go back."""
        while self.recent and us - self.recent[0] > self.span:
            self.recent.popleft()
        taken = min(hits, self.times - len(self.recent))
        self.recent.extend([us] * taken)
        return taken


PART = [*KEY, "_part", "_chunk"]
_PART_SCHEMA = "path string, client_ip string, _part long, _chunk long"
_LISTS = "carry array<long>, old array<long>, end array<long>"


def _independent_parts(instants: DataFrame, seconds: int, chunk_instants: int) -> DataFrame:
    """Add ``_part``: runs of a key's instants between silences longer than the window, and ``_chunk`` in it.

    No admitted hit reaches over such a silence, so parts are independent.  Silences
    are looked for between time buckets as long as the window, so the ordered pass
    sees one row per key and busy bucket, not per hit.  A chunk is a run of buckets with
    about ``chunk_instants`` instants, one bucket at least.
    """
    span = seconds * 1_000_000
    bucketed = instants.withColumn("_bucket", F.floor(F.col("us") / span).cast("long"))
    buckets = bucketed.groupBy(*KEY, "_bucket").agg(
        F.min("us").alias("_first"), F.max("us").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    in_time = Window.partitionBy(*KEY).orderBy("_bucket")
    apart = F.coalesce(F.col("_first") - F.lag("_last").over(in_time) > span, F.lit(True))
    starts = buckets.withColumn("_start", F.when(apart, F.col("_bucket")))
    part = F.last("_start", ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    parts = starts.select(*KEY, "_bucket", part.alias("_part"), "_n")
    before = Window.partitionBy(*KEY, "_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / chunk_instants).cast("long")
    chunks = parts.withColumn("_chunk", chunk).drop("_n")
    return bucketed.join(chunks, [*KEY, "_bucket"]).drop("_bucket")


def _by_chunk(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """(whether a chunk begins, rows of one chunk) of rows that come ordered by chunk and time."""
    current = None
    for frame in frames:
        keys = list(zip(*(frame[c] for c in PART), strict=True))
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            yield keys[a] != current, frame.iloc[a:b]
            current = keys[a]


def _fold(batches: Iterator[pa.RecordBatch], times: int, seconds: int) -> Iterator[pa.RecordBatch]:
    """Admit the instants of each chunk, whose first row holds the times carried into it.

    Most chunks are a hit or two, so a batch is one pass over plain numbers, whatever the number of its chunks.
    """
    log = SlidingLog(times, seconds)
    for batch in batches:
        admitted: list[int] = []
        for us, hits, carry in zip(*(batch.column(c).to_pylist() for c in ("us", "hits", "carry")), strict=True):
            if carry is not None:
                log = SlidingLog(times, seconds, carry)
            else:
                admitted.append(log.admit(us, hits))
        rows = batch.filter(pc.is_null(batch.column("carry")))
        taken = pa.array(admitted, pa.int64())
        columns = [*(rows.column(c) for c in (*KEY, "us", "hits")), taken, pc.subtract(rows.column("hits"), taken)]
        yield pa.RecordBatch.from_arrays(columns, [*KEY, "us", "hits", "admitted", "rejected"])


def _end_states(frames: Iterator[pd.DataFrame], times: int, seconds: int) -> Iterator[pd.DataFrame]:
    """The times that each chunk carries out, given those carried in.

    If the chunk was folded before from other times (``old``), both are folded side by side until they hold the same;
    from there on the chunk ends as it did (``end``), and its other rows are passed over.
    """
    log = other = key = end = None
    carry: list[int] = []
    done = False

    def row() -> pd.DataFrame:
        return pd.DataFrame([[*key, carry, end if done else list(log.recent)]], columns=[*PART, "carry", "end"])

    for begins, rows in _by_chunk(frames):
        if begins:
            if key is not None:
                yield row()
            first = rows.iloc[0]
            key, carry, end, done = [first[c] for c in PART], list(first["carry"]), first["end"], False
            log = SlidingLog(times, seconds, carry)
            other = SlidingLog(times, seconds, list(first["old"])) if first["old"] is not None else None
            rows = rows.iloc[1:]
        if done:
            continue
        for us, hits in zip(rows["us"].tolist(), rows["hits"].tolist(), strict=True):
            log.admit(us, hits)
            if other is not None:
                other.admit(us, hits)
                if log.recent == other.recent:
                    done, end = True, list(end)
                    break
    if key is not None:
        yield row()


def _dealt(instants: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of each chunk in time order behind its mark, chunks spread over all tasks."""
    none = F.lit(None).cast("array<long>")
    rows = instants.select(*PART, "us", "hits", *[none.alias(c) for c in ("carry", "old", "end")])
    first = marks.select(*PART, F.lit(-(1 << 62)).cast("long").alias("us"), F.lit(0).cast("long").alias("hits"), "carry", "old", "end")
    return rows.unionByName(first).repartition(*PART).sortWithinPartitions(*PART, "us")


def _carried(instants: DataFrame, times: int, seconds: int) -> DataFrame:
    """``carry`` of every chunk: the admitted times that reach into it.

    All chunks of long parts are folded from nothing, side by side.  Then those whose predecessor
    carries something else than was assumed are folded again, until no assumption fails.  A chunk
    soon holds the same whatever it began with if a window ever has room left, so two rounds mostly do; in
    the worst case each round settles one more chunk of a part.
    """
    nothing = F.array().cast("array<long>")
    chunks = cut(instants.select(*PART).distinct(), "rate_chunks")
    long_parts = chunks.where("_chunk > 0").select(*PART[:-1]).distinct()
    if long_parts.isEmpty():
        return chunks.withColumn("carry", nothing)
    in_long = cut(instants.join(long_parts, PART[:-1], "left_semi"), "rate_long")
    marks = chunks.join(long_parts, PART[:-1], "left_semi").select(
        "*", nothing.alias("carry"), F.lit(None).cast("array<long>").alias("old"), F.lit(None).cast("array<long>").alias("end")
    )
    schema = f"{_PART_SCHEMA}, carry array<long>, end array<long>"
    fold = lambda rows: rows.mapInPandas(lambda frames: _end_states(frames, times, seconds), schema)
    states = cut(fold(_dealt(in_long, marks)), "rate_states")
    order = Window.partitionBy(*PART[:-1]).orderBy("_chunk")
    while True:
        due = states.withColumn("due", F.coalesce(F.lag("end").over(order), nothing))
        changed = cut(due.where("due != carry").select(*PART, F.col("due").alias("carry"), F.col("carry").alias("old"), "end"), "rate_changed")
        if changed.isEmpty():
            break
        again = in_long.join(changed.select(*PART), PART, "left_semi")
        new = cut(fold(_dealt(again, changed)), "rate_again")
        states = cut(states.join(new, PART, "left_anti").unionByName(new), "rate_states")
    return chunks.join(states.select(*PART, "carry"), PART, "left").withColumn("carry", F.coalesce("carry", nothing))


def admitted_hits(requests: DataFrame, times: int, seconds: int, chunk_instants: int = 200_000) -> DataFrame:
    """Per key and instant: ``hits, admitted, rejected``.

    Each chunk is read in time order with a state of at most ``times`` values.  A key that is
    never silent for longer than the window is cut into chunks as well, see ``_carried``, so
    one key with all hits keeps all tasks busy.
    """
    instants = requests.groupBy(*KEY, F.unix_micros("ts").alias("us")).agg(F.count(F.lit(1)).alias("hits"))
    parts = cut(_independent_parts(instants, seconds, chunk_instants), "rate_parts")
    empty = F.lit(None).cast("array<long>")
    marks = _carried(parts, times, seconds).select(*PART, "carry", empty.alias("old"), empty.alias("end"))
    rows = _dealt(parts, marks).select(*KEY, "us", "hits", "carry")
    return rows.mapInArrow(lambda batches: _fold(batches, times, seconds), ADMITTED)
