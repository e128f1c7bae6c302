"""Operator 3: near-duplicate vectors by random-hyperplane signs, exact cosine and components.

Each table hashes a vector to the signs of ``bits`` random projections.  The number of bits
follows the logarithm of the number of vectors, so that buckets keep their size, and
the number of tables follows from the bits, so that a pair at the threshold
is missed with at most ``MISS``.  Equal vectors are one class that counts as
many.  A bucket is dealt into blocks of ``BLOCK`` classes and each pair of blocks is one
matrix product; pairs never leave the task, only counts and a spanning forest of their
links do.  A pair that meets in several tables counts in the first one.  Vectors of each width have
hyperplanes and buckets of their own.  What goes through the shuffle for each table is a vector's components and
its signs as packed bytes.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
do rows without id.  They are returned as their own component.  Rows with equal ids are separate vectors of one node.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import common, vectors

MISS = 1e-5
BLOCK = 256
LEAST_BITS = 6
SIGNED_SCHEMA = "rep long, copies long, width int, packed binary, signs array<long>, marks binary"
LINK_SCHEMA = "rep long, links long, root long"


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for ``n`` classes."""
    agree = 1 - acos(threshold) / pi
    bits = max(LEAST_BITS, ceil(log2(max(n, 1) / BLOCK)))
    return bits, ceil(log(MISS) / log(1 - agree**bits))


def hyperplanes(width: int, bits: int, tables: int, seed: int = 23) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, tables * bits))


def signatures(rows: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each row in each table."""
    signs = (vectors.directions(rows) @ planes > 0).reshape(len(rows), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _sign(batches, bits: int, tables: int):
    planes: dict[int, np.ndarray] = {}
    for whole in batches:
        for width, batch in vectors.by_width(whole):
            if width not in planes:
                planes = {width: hyperplanes(width, bits, tables)}  # one width's at a time
            rows = vectors.matrix(batch.column("embedding"))
            found = signatures(rows, planes[width], bits)
            with np.errstate(over="ignore"):
                single = rows.astype(np.float32)
            exact = single if (single == rows).all() else rows
            at = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables)
            yield pa.record_batch(
                {
                    "rep": batch.column("rep"),
                    "copies": batch.column("copies"),
                    "width": pa.array(np.full(len(batch), width, np.int32)),
                    "packed": pa.array([r.tobytes() for r in exact], pa.binary()),
                    "signs": pa.ListArray.from_arrays(at, pa.array(found.ravel())),
                    "marks": pa.array([r.tobytes() for r in found.astype(np.int32)], pa.binary()),
                }
            )


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the length of each row."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of packed components; single precision where that holds a row exactly."""
    data, sizes = _bytes(column)
    if (sizes == 4 * width).all():
        return data.view(np.float32).reshape(-1, width).astype(np.float64)
    rows = np.split(data, np.cumsum(sizes)[:-1])
    return np.stack([r.view(np.float32 if len(r) == 4 * width else np.float64).astype(np.float64) for r in rows])


def _links(group: pa.Table, threshold: float) -> pa.Table:
    """Counts and forest links inside one pair of blocks of one bucket."""
    order = np.argsort(group.column("rep").to_numpy(), kind="stable")
    group = group.take(pa.array(order))
    table = int(group.column("table")[0].as_py())
    low, high, block = (group.column(c).to_numpy() for c in ("low", "high", "block"))
    rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
    unit = vectors.directions(_unpacked(group.column("packed"), int(group.column("width")[0].as_py())))
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if low[0] != high[0]:
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(linked)
    signs = _bytes(group.column("marks"))[0].view(np.int32).reshape(len(rep), -1)
    for earlier in range(table):
        fresh = signs[a, earlier] != signs[b, earlier]
        a, b = a[fresh], b[fresh]
    links = np.bincount(a, weights=copies[b], minlength=len(rep)).astype(np.int64)
    linked[:] = False
    linked[a, b] = True
    some = links > 0
    root = rep[common.smallest_reachable(linked)]
    return pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some]), "root": pa.array(root[some])})


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct vector: its smallest id and how many rows have it."""
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; links have a cosine of at least ``threshold``."""
    named = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    classes = common.stored(_classes(named.where(vectors.usable())), "vector-classes")
    n = classes.count()
    bits, tables = shape(n, threshold)
    signed = classes.mapInArrow(lambda batches: _sign(batches, bits, tables), SIGNED_SCHEMA)
    signed = common.stored(signed, "vector-signs")
    bucket = ["width", "table", "sign"]
    buckets = signed.select("width", F.posexplode("signs").alias("table", "sign"))
    sizes = buckets.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select(*bucket, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = signed.select("rep", "copies", "width", "packed", "marks", F.posexplode("signs").alias("table", "sign")).join(sizes, bucket)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", "packed"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    grouped = dealt.groupBy(*bucket, "low", "high")
    found = common.stored(grouped.applyInArrow(lambda group: _links(group, threshold), LINK_SCHEMA), "vector-links")
    labels = common.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-rounds")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # A node id may stand for several classes only if rows share an id; their links then add up.
    known = classes.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("known_links"),
        F.coalesce("component", "rep").alias("known_component"),
        F.lit(True).alias("used"),
    )
    every = named.withColumn("used", vectors.usable()).join(known, ["embedding", "used"], "left")
    component = F.coalesce("known_component", "vec_id")
    return every.select(
        "vec_id",
        F.coalesce("known_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
