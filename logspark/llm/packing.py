"""Operator 7: best-fit packing planned on the histogram of lengths.

Documents are tokenised and only those longer than a sequence are cut.  The plan
needs nothing but the number of pieces of each length, at most ``capacity`` numbers:
lengths are taken from the longest, and each goes into the open sequences with the
least room that still holds it, whole groups of equal sequences at a time.  The plan
is a list of runs of slots; each piece takes the slot whose number equals the rank of
the piece within its length.  Ranks and slots are joined on (length, rank), so no key
is hot even if a third of all pieces have one length.

Null and empty texts are one piece that holds the end id only.  Rows with equal ids
are separate documents.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm import common, tokens

PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length int, ids binary"
RUN_SCHEMA = "length int, first_rank long, slots long, per_sequence long, first_sequence long, offset long"
BLOCK = 4096


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, ids, bounds in tokens.encode_column(tokenizer, batch.column("text")):
            n = len(bounds) - 1
            sizes = np.diff(bounds) + 1
            closed = np.full(len(ids) + n, end_id, "<u4")
            ends = np.cumsum(sizes)
            inside = np.ones(len(closed), bool)
            inside[ends - 1] = False
            closed[inside] = ids
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(n), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            at = np.append(0, np.cumsum(length)) * 4
            raw = pa.py_buffer(closed.tobytes())
            yield pa.record_batch(
                {
                    "row": batch.column("row").slice(row, n).take(pa.array(doc)),
                    "doc_id": batch.column("doc_id").slice(row, n).take(pa.array(doc)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start.astype(np.int64)),
                    "length": pa.array(length.astype(np.int32)),
                    "ids": pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at.astype(np.int32).tobytes()), raw]),
                }
            )


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents with their token ids (unsigned 32-bit little-endian).

    Only documents of more than ``capacity`` ids, the end id included, are cut.
    """
    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    return named.mapInArrow(lambda batches: _cut(batches, tokenizer, end_id, capacity), PIECE_SCHEMA)


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over a histogram: runs (length, first_rank, slots, per_sequence, first_sequence, offset).

    Slot ``s`` of a run lies in sequence ``first_sequence + s // per_sequence`` at
    ``offset + (s % per_sequence) * length``.  Sequences with equal room wait as
    intervals of numbers; work follows the number of distinct lengths, not of pieces.
    """
    rooms: list[int] = []
    waiting: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0

    def wait(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in waiting:
                waiting[room] = []
                insort(rooms, room)
            waiting[room].append((first, n))

    def fill(length: int, room: int, first: int, n: int, rank: int, left: int) -> int:
        """Put up to ``left`` pieces into the interval; the rest of it waits again."""
        each = room // length
        full, over = min(left // each, n), 0
        if full:
            runs.append((length, rank, full * each, each, first, capacity - room))
            wait(room - each * length, first, full)
        taken = full * each
        if full < n and left > taken:
            over = left - taken
            runs.append((length, rank + taken, over, over, first + full, capacity - room))
            wait(room - over * length, first + full, 1)
            wait(room, first + full + 1, n - full - 1)
        else:
            wait(room, first + full, n - full)
        return taken + over

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                n = -(-left // (capacity // length))
                room, first, opened = capacity, opened, opened + n
            else:
                room = rooms[i]
                first, n = waiting[room].pop()
                if not waiting[room]:
                    del waiting[room], rooms[i]
            put = fill(length, room, first, n, rank, left)
            rank, left = rank + put, left - put
    return runs


def slots(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """One row per planned slot: (length, rank, sequence_id, offset), unrolled in blocks of ``BLOCK``."""
    table = spark.createDataFrame(runs, RUN_SCHEMA)
    blocks = table.withColumn("block", F.explode(F.expr(f"sequence(0L, (slots - 1) div {BLOCK})")))
    blocks = blocks.repartition("length", "first_rank", "block")
    slot = blocks.withColumn("slot", F.explode(F.expr(f"sequence(block * {BLOCK}, least(slots, (block + 1) * {BLOCK}) - 1)")))
    return slot.select(
        "length",
        (F.col("first_rank") + F.col("slot")).alias("rank"),
        F.expr("first_sequence + slot div per_sequence").alias("sequence_id"),
        F.expr("offset + (slot % per_sequence) * length").alias("offset"),
    )


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each piece (row, piece, length) its sequence and its place there.

    ``pieces`` must be a stored table; extra columns stay.  All lengths must lie
    between 1 and ``capacity``.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    ranked = _ranked(pieces)
    return ranked.join(slots(pieces.sparkSession, plan_runs(counts, capacity)), ["length", "rank"])


def _ranked(pieces: DataFrame) -> DataFrame:
    """Rank of each piece within its length, from 0: place in the order of length less the pieces of shorter ones."""
    placed = common.in_order(pieces, ["length", "row", "piece"], "packing-order")
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_less", F.coalesce(F.sum("_n").over(shorter), F.lit(0))).drop("_n")
    # At most one row per length, so at most ``capacity`` rows.
    return placed.join(F.broadcast(sizes), "length").withColumn("rank", F.col("position") - F.col("_less")).drop("position", "_less")


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The token ids of each sequence in order: (sequence_id, length, ids binary).

    A sequence holds at most ``capacity`` ids, so its pieces fit one row.
    """
    parts = pieces.select("row", "piece", "ids").join(packed.select("row", "piece", "sequence_id", "offset", "length"), ["row", "piece"])
    sorted_parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(sorted_parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return parts.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
