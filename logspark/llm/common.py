"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from logspark.operators.scale import new_path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it back, so that later jobs start from files."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have: the wanted ones, lengthened where taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def packed_row(docs: DataFrame, but: tuple[str, ...] = ()) -> tuple[Column, list[Column]]:
    """(a struct ``row`` of all columns except ``but``, the columns that give the input back, in order).

    A table of ``row`` and the columns ``but`` may get others of any name without meeting one of the input.
    """
    others = [c for c in docs.columns if c not in but]
    kinds = [("held", BooleanType()), *[(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(others)]]
    row = F.struct(F.lit(True), *[F.col(f"`{c}`") for c in others]).cast(StructType([StructField(*kind) for kind in kinds]))
    back = [F.col(f"`{c}`") if c in but else F.col(f"row.c{others.index(c)}").alias(c) for c in docs.columns]
    return row.alias("row"), back


def packed(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """(the columns ``own`` and all others in a struct ``row``, the columns that give the input back, in order)."""
    row, back = packed_row(docs, own)
    return docs.select(*own, row), back


def in_order(df: DataFrame, order: list, name: str, position: str = "position") -> DataFrame:
    """Store rows in a global order with gapless positions from 0; no task sees more than its range.

    Rows are range-partitioned and sorted; counts per range give the offsets.  The
    window runs over one row per range, whose number is the shuffle's partition count.
    """
    at, part, rows, first, before = free_names(df, "_at", "_range", "_rows", "_first", "_before")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = stored(ranged.withColumn(at, F.monotonically_increasing_id()), name)
    table = table.withColumn(part, F.shiftright(at, 33))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = table.groupBy(part).agg(F.count(F.lit(1)).alias(rows), F.min(at).alias(first))
    ranges = ranges.withColumn(before, F.coalesce(F.sum(rows).over(earlier), F.lit(0)))
    number = F.col(before) + F.col(at) - F.col(first)
    placed = table.join(F.broadcast(ranges.drop(rows)), part)
    return placed.withColumn(position, number).drop(at, part, first, before)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every end of an edge (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours are
    linked to its smallest one, then its smaller neighbours are.  Edges never grow
    in number, chains shorten by a power each round, and each round is stored.  So are the
    smallest neighbours: joins of two stored tables let Spark split the rows of a node
    that very many others are linked to.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _digest(edges)
    while seen[0]:
        both = _both_ways(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        least = stored(least, f"{name}-least")
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, f"{name}-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = large.join(least, "a").where("b != m").select("b", "m").union(least)
        edges = stored(small.toDF("a", "b").distinct(), name)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def smallest_reachable(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable by links, for each row of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        lower = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, lower)
        new = new[new]
        if (new == label).all():
            return label
        label = new
