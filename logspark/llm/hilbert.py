"""Operator 6: documents in the order of a Hilbert curve over their metadata, cut into shards.

Each dimension is quantised to ``2**bits`` steps: numbers between approximate quantiles of
the whole column, strings by the rank of the whole string among the distinct ones.  The number of
bits follows the number of rows, so that there are many cells to a file at any size.  The cells' place on the curve is worked out with integer expressions only.  Rows
are range-partitioned by it, so files and shards are runs of the curve: each covers a
compact box of every dimension at once, and the minima and maxima in the files let a
filter on any of them skip most.

The law is ``rows``: shards are equal runs, their counts at most one apart.  Ties on the
curve go by id, then by the text's checksum; equal rows may take each other's places.
Null dimensions lie in the lowest step.  A null text has no bytes and the checksum of an
empty one.  An empty table gives an empty result.  ``shard_number`` and ``shard_slot`` are added
and replace input columns of these names; others stay.

The main path uses DataFrame and SQL functions only.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm import common

LEAST_BITS = 4
FILE_ROWS = 1 << 20
CELLS_A_FILE = 64


def bits_for(rows: int, dimensions: int) -> int:
    """Bits a dimension, so that a file of ``FILE_ROWS`` rows spans ``CELLS_A_FILE`` cells on average, within a 63-bit index."""
    wanted = ceil(log2(max(rows * CELLS_A_FILE / FILE_ROWS, 1)) / dimensions)
    return min(max(LEAST_BITS, wanted), 62 // dimensions)


def _string_steps(df: DataFrame, name: str, bits: int) -> DataFrame:
    """(value, step) of each distinct string: its rank, cut into ``2**bits`` runs of nearly equal length."""
    values = df.select(F.col(name).alias("value")).where("value is not null").distinct()
    ranked = common.in_order(values, ["value"], "hilbert-values")
    total = max(ranked.count(), 1)
    return ranked.select("value", F.expr(f"CAST(position * {1 << bits}L div {total} AS INT)").alias("step"))


def step(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value; 0 for null."""
    known = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    return F.coalesce(F.size(F.filter(known, lambda e: e < value)), F.lit(0)).cast("int")


def curve_index(cells: str, dimensions: int, bits: int) -> list[tuple[str, str]]:
    """Steps (column, SQL) from an array of cell numbers to its place on the Hilbert curve.

    First the cell's coordinates are unrotated from the coarsest bit to the finest, then
    Gray-coded, and at last their bits are interleaved.
    """
    masks = [1 << b for b in range(bits - 1, 0, -1)]
    moves = ", ".join(f"struct({q} AS q, {i} AS i)" for q in masks for i in range(dimensions))
    turned = cells
    if masks:
        turned = f"""aggregate(array({moves}), {cells}, (x, s) -> transform(x, (v, j) ->
            CASE WHEN (x[s.i] & s.q) <> 0 THEN IF(j = 0, v ^ (s.q - 1), v)
                 WHEN j = 0 OR j = s.i THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1))
                 ELSE v END))"""
    gray = "transform(_turned, (v, j) -> aggregate(slice(_turned, 1, j + 1), 0, (a, b) -> a ^ b))"
    flip = "0"
    if masks:
        flip = f"aggregate(array({', '.join(map(str, masks))}), 0, (t, q) -> IF((_gray[{dimensions - 1}] & q) <> 0, t ^ (q - 1), t))"
    places = ", ".join(f"struct({b} AS b, {i} AS i)" for b in range(bits - 1, -1, -1) for i in range(dimensions))
    woven = f"aggregate(array({places}), 0L, (n, s) -> n * 2 + (shiftright(_gray[s.i] ^ _flip, s.b) & 1))"
    return [("_turned", turned), ("_gray", gray), ("_flip", flip), ("_curve", woven)]


def with_curve(df: DataFrame, dimensions: list[str], bits: int) -> DataFrame:
    """Add ``_curve``, the row's place on the Hilbert curve over the quantised dimensions."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    kinds, steps, out = dict(df.dtypes), {}, df
    numbers = [name for name in dimensions if kinds[name] != "string"]
    if numbers:
        found = df.agg(*[F.percentile_approx(F.col(name).cast("double"), shares, 10_000).alias(name) for name in numbers]).first()
        steps = {name: step(F.col(name).cast("double"), found[name] or []) for name in numbers}
    for name in dimensions:
        if name not in steps:
            # A value may be that of a third of all rows; Spark broadcasts the table or splits such a value's rows.
            table = _string_steps(df, name, bits).toDF(f"_{name}_value", f"_{name}_step")
            out = out.join(table, F.col(name) == F.col(f"_{name}_value"), "left").drop(f"_{name}_value")
            steps[name] = F.coalesce(F.col(f"_{name}_step"), F.lit(0))
    out = out.withColumn("_cells", F.array(*[steps[name] for name in dimensions]))
    for name, sql in curve_index("_cells", len(dimensions), bits):
        out = out.withColumn(name, F.expr(sql))
    return out.select(*df.columns, "_curve")


def shard_rows(docs: DataFrame, dimensions: list[str], shards: int, bits: int | None = None) -> DataFrame:
    """Store ``docs`` in curve order and add ``shard_number`` and the gapless ``shard_slot``."""
    added = ["shard_number", "shard_slot"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    row, back = common.packed_row(docs)
    held = [F.col(f"`{name}`").alias(f"d{i}") for i, name in enumerate(dimensions)]
    check = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("check")
    frame = docs.select(*held, F.col("doc_id").alias("id"), check, row)
    if bits is None:
        bits = bits_for(docs.count(), len(dimensions))
    curved = with_curve(frame, [f"d{i}" for i in range(len(dimensions))], bits).select("row", "_curve", "id", "check")
    placed = common.in_order(curved, ["_curve", "id", "check"], "hilbert")
    total = placed.count()
    placed = placed.select("row", "position", F.expr(f"CAST(position * {shards} div {max(total, 1)} AS INT)").alias("number"))
    first = F.expr(f"(number * {total}L + {shards - 1}) div {shards}")
    return placed.select("row", "number", (F.col("position") - first).alias("slot")).select(
        *back, F.col("number").alias("shard_number"), F.col("slot").alias("shard_slot")
    )


def write_shards(placed: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Write each shard as a folder of Parquet files, each a run of at most ``file_rows`` slots."""
    run = F.floor(F.col("shard_slot") / file_rows)
    dealt = placed.repartitionByRange("shard_number", run).sortWithinPartitions("shard_number", "shard_slot")
    dealt.write.option("maxRecordsPerFile", file_rows).partitionBy("shard_number").parquet(folder)
