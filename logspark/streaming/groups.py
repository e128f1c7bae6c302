"""Error groups of a stream of lines: counts, time range and the first sample lines, in any order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logspark import fixed
from logspark.functions.text import fingerprint, severity_of_level
from logspark.operators import grouping

KEY_BUCKETS = 4096  # states that the groups of a stream share; it must not change while a checkpoint is in use
GROUP = "count long, first_us long, last_us long, lines array<struct<line_no:bigint,text:string>>"
_HELD = "file_id: {}, level: string, template: string, generation: long, touched: long, count: long, first_us: long, last_us: long, lines: array<struct<line_no: bigint, text: string>>"
_LINE = pa.struct([("line_no", pa.int64()), ("text", pa.string())])


def _partial(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row per group of each Arrow batch, with its first ``k`` lines."""
    keys = grouping.IDENTITY
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by("line_no")
        grouped = table.group_by(keys, use_threads=False).aggregate(
            [("line_no", "count"), ("us", "min"), ("us", "max"), ("line_no", "list"), ("text", "list")]
        )
        first = [pc.list_slice(grouped.column(c).combine_chunks(), 0, k) for c in ("line_no_list", "text_list")]
        lines = pa.StructArray.from_arrays([f.flatten() for f in first], fields=list(_LINE))
        held = pa.ListArray.from_arrays(pa.array([0, *pc.cumulative_sum(pc.list_value_length(first[0])).to_pylist()], pa.int32()), lines)
        columns = [grouped.column(c) for c in (*keys, "line_no_count", "us_min", "us_max")]
        out = pa.table([*columns, held], names=[*keys, "count", "first_us", "last_us", "lines"])
        yield from out.combine_chunks().to_batches()


def partial_groups(errors: DataFrame, k: int = fixed.SAMPLES_PER_GROUP) -> DataFrame:
    """Lines reduced to groups inside each task, before any shuffle: a hot group sends a row per batch of lines."""
    rows = errors.select(*grouping.IDENTITY, F.col("line_no").cast("long"), F.unix_micros("ts").alias("us"), "text")
    kind = dict(errors.dtypes)["file_id"]
    schema = f"file_id {kind}, level string, template string, {GROUP}"
    return rows.mapInArrow(lambda batches: _partial(batches, k), schema)


class GroupProcessor(StatefulProcessor):
    """Running totals of the groups of one bucket and their first ``k`` lines by line number.

    Event time is the time of arrival, so no line is late, and the watermark follows it at a distance.  When it
    has passed a group's last line, the group is dropped from the state.  If lines of it
    come later, they start another generation, known by the time of its first row; generations of a
    group add up to what one would have held.  The groups of a bucket are read and stored at once, as a
    state of its own for each would be some calls to the state store a group.
    """

    def __init__(self, k: int, file_kind: str = "bigint"):
        self.k, self.file_kind = k, file_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", f"groups array<struct<{_HELD.format(self.file_kind)}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        width = len(grouping.IDENTITY)
        held = {g[:width]: list(g[width:]) for g in self._held()}
        touched = {}
        for row in rows:
            name = tuple(row[c] for c in grouping.IDENTITY)
            generation, now, count, first, last, lines = held.get(name) or (row["arrived_ms"], 0, 0, None, None, [])
            first = min((t for t in (first, row["first_us"]) if t is not None), default=None)
            last = max((t for t in (last, row["last_us"]) if t is not None), default=None)
            lines = nsmallest(self.k, lines + [(line["line_no"], line["text"]) for line in row["lines"]])
            held[name] = touched[name] = [generation, max(now, row["arrived_ms"]), count + row["count"], first, last, lines]
        for name, (generation, _, count, first, last, lines) in touched.items():
            named = dict(zip(grouping.IDENTITY, name, strict=True))
            shown = [Row(line_no=n, text=text) for n, text in lines]
            yield Row(**named, generation=generation, count=count, first_us=first, last_us=last, lines=shown)
        self._keep([(*name, *total) for name, total in held.items()], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep(self._held(), timerValues)
        yield from ()

    def close(self) -> None:
        pass

    def _held(self) -> list[tuple]:
        """The stored groups as plain tuples: rows out of the state cannot be stored again."""
        groups = self.total.get()[0] if self.total.exists() else []
        return [(*g[:-1], [(line[0], line[1]) for line in g[-1]]) for g in groups]

    def _keep(self, groups: list[tuple], timerValues) -> None:
        """Store the groups that the watermark has not passed, and come back when it has passed all of them."""
        touched = len(grouping.IDENTITY) + 1
        kept = [g for g in groups if g[touched] >= timerValues.getCurrentWatermarkInMs()]
        if kept:
            self.total.update((kept,))
            self.handle.registerTimer(max(g[touched] for g in kept) + 1)
        else:
            self.total.clear()


def streaming_sampled_groups(
    errors: DataFrame, k: int = fixed.SAMPLES_PER_GROUP, idle_s: int = 86_400, buckets: int = KEY_BUCKETS
) -> DataFrame:
    """Totals and samples of every group that a micro-batch touches, from a stream of error lines.

    The state of a group is five numbers and ``k`` lines, and is dropped after about ``idle_s`` seconds
    without a line, so it follows the groups in use, not those ever seen.
    """
    kind = dict(errors.dtypes)["file_id"]
    schema = f"file_id {kind}, level string, template string, generation long, {GROUP}"
    arrived = partial_groups(errors, k).withColumn("arrived", F.current_timestamp())
    arrived = arrived.withColumn("arrived_ms", F.unix_millis("arrived")).withWatermark("arrived", f"{idle_s} seconds")
    arrived = arrived.withColumn("bucket", F.pmod(F.xxhash64(*grouping.IDENTITY), F.lit(buckets)).cast("int"))
    return arrived.groupBy("bucket").transformWithState(GroupProcessor(k, kind), schema, "update", "eventTime")


def finish_sampled_groups(spark: SparkSession, path: str, k: int = fixed.SAMPLES_PER_GROUP) -> DataFrame:
    """Groups as ``grouping.error_groups`` returns them, from all rows the stream has stored in ``path``."""
    key = [*grouping.IDENTITY, "generation"]
    newest = Window.partitionBy(*key).orderBy(F.desc("batch_id"))
    latest = spark.read.parquet(path).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1)
    merged = latest.groupBy(*grouping.IDENTITY).agg(
        F.sum("count").alias("count"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.slice(F.array_sort(F.flatten(F.collect_list("lines"))), 1, k).alias("lines"),
    )
    return merged.select(
        "file_id",
        fingerprint(F.col("level"), F.col("template")).alias("fingerprint"),
        "level",
        "template",
        severity_of_level(F.col("level")).alias("severity"),
        "count",
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
        F.transform("lines", lambda line: line["text"]).alias("sample_lines"),
    )
