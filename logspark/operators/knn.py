"""Exact nearest neighbours of dense unit vectors within a tenant.

Vectors are assigned to the nearest of some pivots, whose number follows the square root of the
number of points up to ``MOST_PIVOTS``.  Every query
first searches its own cell, which gives a lower bound for its k-th best score.
It then visits only the cells that can beat this bound by the triangle
inequality on angles.

What travels are blocks of neighbouring cells.  A tenant has about ``SIDE`` of them at most, so a vector is copied a
bounded number of times however many cells it visits; the cells are told apart inside a task, which scores a block
of queries with a block of points in matrix products, some rows at a time.  Where no cell can be left
out the number of products grows with the square of the points, spread over the pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from logspark.operators.scale import cut, join_to_many, unsized

CELL = ["tenant", "cell"]
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
SIDE, LEAST_ROWS, BLOCK_BYTES = 16, 2048, 16 << 20
MATRIX = 4 << 20  # numbers of the largest matrix that a task holds
MOST_TASKS = 1000
_SLACK = 1e-6  # covers rounding of angles; a wider bound only visits more cells


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors, spread by hash: the only data that reaches the driver."""
    rows = points.select("vector").orderBy(F.xxhash64("id")).limit(n).collect()
    return np.array([row["vector"] for row in rows], dtype=np.float64)


def _ids(rows: DataFrame, name: str = "id") -> str:
    """Schema of id and tenant, which may be numbers or strings."""
    kinds = dict(rows.dtypes)
    return f"{name} {kinds['id']}, tenant {kinds['tenant']}"


def _sortable(ids: np.ndarray) -> np.ndarray:
    ids = np.asarray(ids)
    return ids.astype(str) if ids.dtype == object else ids


def _place(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the angle to it, some rows at a time."""
    cell, angle = np.empty(len(vectors), np.int32), np.empty(len(vectors))
    step = max(1, MATRIX // len(pivots))
    for at in range(0, len(vectors), step):
        cosines = np.clip(vectors[at : at + step] @ pivots.T, -1.0, 1.0)
        nearest = cosines.argmax(axis=1)
        cell[at : at + step] = nearest
        angle[at : at + step] = np.arccos(cosines[np.arange(len(nearest)), nearest])
    return cell, angle


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of vectors of one width, which hold no null."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def with_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell``, the nearest pivot, and ``angle`` to it; other columns stay."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell, angle = _place(matrix_of(batch.column("vector")), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    return rows.mapInArrow(placed, schema)


# --- blocks ------------------------------------------------------------------------


def _block_rows(n: int, width: int) -> int:
    """Rows of a block: a ``SIDE``-th of all, within what a task holds easily."""
    return min(max(1, BLOCK_BYTES // (8 * width)), max(LEAST_ROWS, -(-n // SIDE)))


def _spans(sizes: DataFrame, block_rows: int) -> DataFrame:
    """Add to (tenant, cell, n) where a cell begins among the tenant's rows, and its first and last block.

    A tenant has at most as many cells as there are pivots.
    """
    earlier = Window.partitionBy("tenant").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    began = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    block = lambda at: F.floor(at / block_rows).cast("int")
    return began.withColumn("first", block(F.col("before"))).withColumn("last", block(F.col("before") + F.col("n") - 1))


def _in_blocks(rows: DataFrame, spans: DataFrame, block_rows: int, name: str) -> DataFrame:
    """Add the block of each row: cells that follow each other share one, and a large cell has several."""
    placed = join_to_many(rows, spans.select(*CELL, "before", "n"), CELL, "id", "cell_spans")
    at = F.col("before") + F.pmod(F.xxhash64("id"), F.col("n"))
    return placed.withColumn(name, F.floor(at / block_rows).cast("int")).drop("before", "n")


def _able(angles: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which cells (columns) may hold a point that reaches the bound of a query (row); without a bound all may."""
    least = np.maximum(0.0, np.maximum(angles - farthest, nearest - angles))
    return np.isnan(bound)[:, None] | (np.cos(least) >= bound[:, None] - _SLACK)


def _visits(asked: DataFrame, spans: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, tenant, vector, bound, q_block, targets, cells) of queries: the blocks of points that may hold one of the best.

    ``cells`` is set in one row of each block of queries: all cells that one of them visits.
    """

    def targets(queries: pa.Table, cells: pa.Table) -> pa.Table:
        number, nearest, farthest, first, last = (cells.column(c).to_numpy() for c in ("cell", "nearest", "farthest", "first", "last"))
        vectors, bound = matrix_of(queries.column("vector")), queries.column("bound").to_numpy().astype(float)
        blocks = np.arange(first.min(), last.max() + 1) if len(first) else np.empty(0, np.int32)
        lies = (first[:, None] <= blocks) & (blocks <= last[:, None])
        found, visited = [], np.zeros(len(number), bool)
        step = max(1, MATRIX // max(1, len(number)))
        for at in range(0, len(vectors), step):
            angles = np.arccos(np.clip(vectors[at : at + step] @ pivots[number].T, -1.0, 1.0))
            able = _able(angles, nearest, farthest, bound[at : at + step])
            visited |= able.any(axis=0)
            found += [blocks[row] for row in (able.astype(np.float32) @ lies.astype(np.float32)) > 0]
        seen = [number[visited].tolist(), *[None] * (len(vectors) - 1)]
        added = [pa.array(found, pa.list_(pa.int32())), pa.array(seen, pa.list_(pa.int32()))]
        names = ["id", "tenant", "vector", "bound", "q_block"]
        return pa.table([*(queries.column(c) for c in names), *added], names=[*names, "targets", "cells"])

    some = asked.select("tenant", "q_block").distinct()
    beside = cut(spans.select("tenant", "cell", "nearest", "farthest", "first", "last").join(unsized(some), "tenant"), "knn_beside")
    key = ["tenant", "q_block"]
    schema = f"{_ids(asked)}, vector array<double>, bound double, q_block int, targets array<int>, cells array<int>"
    return asked.groupBy(*key).cogroup(beside.groupBy(*key)).applyInArrow(targets, schema)


def _best(queries: pa.Table, points: pa.Table, k: int, skip_same_id: bool, own_cell: bool, pivots: np.ndarray) -> dict[str, np.ndarray]:
    """The best ``k`` points of one block for each query of another: those of its cell only, or of all cells that may hold them."""
    points = points.sort_by("cell")
    q_vectors, p_vectors = matrix_of(queries.column("vector")), matrix_of(points.column("vector"))
    q_ids, p_ids = (_sortable(t.column("id").to_numpy()) for t in (queries, points))
    values, code = np.unique(p_ids, return_inverse=True)
    cells, starts = np.unique(points.column("cell").to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(code))
    angles = np.arccos(np.clip(np.einsum("ij,ij->i", p_vectors, pivots[points.column("cell").to_numpy()]), -1.0, 1.0))
    nearest, farthest = np.minimum.reduceat(angles, starts), np.maximum.reduceat(angles, starts)
    own = queries.column("cell").to_numpy() if own_cell else None
    order = np.argsort(own, kind="stable") if own_cell else np.arange(len(q_ids))
    same = np.searchsorted(values, q_ids)
    same = np.where(values[np.minimum(same, len(values) - 1)] == q_ids, same, -1)
    step = max(1, min(1024, MATRIX // len(code)))
    rows, columns, scores = [], [], []
    for at in range(0, len(order), step):
        now = order[at : at + step]
        if own_cell:
            able = own[now][:, None] == cells
        else:
            to_pivot = np.arccos(np.clip(q_vectors[now] @ pivots[cells].T, -1.0, 1.0))
            able = _able(to_pivot, nearest, farthest, queries.column("bound").to_numpy().astype(float)[now])
        wanted = np.flatnonzero(able.any(axis=0))
        if not len(wanted):
            continue
        whole = len(wanted) == len(cells)
        at_points = np.concatenate([np.arange(starts[c], ends[c]) for c in wanted])
        score = q_vectors[now] @ (p_vectors if whole else p_vectors[at_points]).T
        if own_cell:
            score[~np.repeat(able[:, wanted], ends[wanted] - starts[wanted], axis=1)] = -np.inf
        if skip_same_id:
            score[same[now][:, None] == code[at_points]] = -np.inf
        if score.shape[1] > k:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]]
        else:
            least = np.full((len(now), 1), -np.inf)
        row, column = np.nonzero((score >= least - 1e-12) & np.isfinite(score))
        # Scored once more, pair by pair, so that equal vectors have equal scores wherever they lie.
        exact = np.empty(len(row))
        for a in range(0, len(row), 1 << 16):
            piece = slice(a, a + (1 << 16))
            exact[piece] = (q_vectors[now[row[piece]]] * p_vectors[at_points[column[piece]]]).sum(axis=1)
        best = np.lexsort((code[at_points[column]], -exact, row))
        turn = np.arange(len(best)) - np.searchsorted(row[best], row[best])
        best = best[turn < k]
        rows.append(now[row[best]])
        columns.append(at_points[column[best]])
        scores.append(exact[best])
    taken = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((rows, np.int64), (columns, np.int64), (scores, float))]
    return {"query_id": queries.column("id").take(pa.array(taken[0])), "match_id": points.column("id").take(pa.array(taken[1])), "score": pa.array(taken[2])}


def _met(visits: DataFrame, points: DataFrame, k: int, skip_same_id: bool, own_cell: bool, pivots: np.ndarray) -> DataFrame:
    """Blocks of queries (``q_block``, one row for each ``p_block`` visited) against blocks of points."""
    key = ["tenant", "q_block", "p_block"]
    pairs = cut(visits.select(*key).distinct(), "knn_pairs")
    spark = visits.sparkSession
    # As many tasks as pairs of blocks: Spark would join small ones, whose work is not in their bytes.
    tasks = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, 2 * pairs.count()))
    copies = points.join(unsized(pairs), ["tenant", "p_block"])

    def best(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        kinds = [queries.schema.field("tenant").type, queries.schema.field("id").type, candidates.schema.field("id").type, pa.float64()]
        if not len(queries) or not len(candidates):
            return pa.table({c: pa.array([], t) for c, t in zip(("tenant", "query_id", "match_id", "score"), kinds, strict=True)})
        found = _best(queries, candidates, k, skip_same_id, own_cell, pivots)
        return pa.table({"tenant": pa.array([queries.column("tenant")[0].as_py()] * len(found["score"]), kinds[0]), **found})

    asked, known = dict(visits.dtypes), dict(points.dtypes)
    schema = f"tenant {asked['tenant']}, query_id {asked['id']}, match_id {known['id']}, score double"
    sides = [side.repartition(tasks, *key).groupBy(*key) for side in (visits, copies)]
    return sides[0].cogroup(sides[1]).applyInArrow(best, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("tenant", "query_id").orderBy(F.desc("score"), F.asc("match_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_cells(
    asked: DataFrame,
    read: Callable[[list[int]], DataFrame],
    cells: DataFrame,
    pivots: np.ndarray,
    k: int,
    skip_same_id: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """The exact best ``k`` for ``asked`` (id, tenant, vector, cell) among points in ``cells`` (tenant, cell, nearest, farthest, n).

    ``read`` gives the points (id, tenant, vector, cell) of some cells.
    """
    if block_rows is None:
        block_rows = _block_rows(cells.agg(F.sum("n")).first()[0] or 0, pivots.shape[1])
    spans = cut(_spans(cells, block_rows), "knn_cells")
    sizes = asked.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut(_in_blocks(asked.select("id", "tenant", "vector", "cell"), _spans(sizes, block_rows), block_rows, "q_block"), "knn_asked")

    def met(visits: DataFrame, wanted: list[int], own_cell: bool, name: str) -> DataFrame:
        points = _in_blocks(read(wanted).select("id", "tenant", "vector", "cell"), spans, block_rows, "p_block")
        return cut(_met(visits, points, k, skip_same_id, own_cell, pivots), name)

    at_home = join_to_many(dealt, spans.select(*CELL, "first", "last"), CELL, "id", "knn_home")
    at_home = at_home.select("id", "tenant", "vector", "cell", "q_block", F.explode(F.sequence("first", "last")).alias("p_block"))
    first = cut(_ranked(met(at_home, distinct_values(dealt, "cell"), True, "knn_own_cell"), k), "knn_first")
    bounds = first.where(F.col("rank") == k).select("tenant", F.col("query_id").alias("id"), F.col("score").alias("bound"))
    visits = cut(_visits(dealt.join(unsized(bounds), ["tenant", "id"], "left"), spans, pivots), "knn_visits")
    wanted = distinct_values(visits.select(F.explode("cells").alias("cell")), "cell")
    visits = visits.select("id", "tenant", "vector", "bound", "q_block", F.explode("targets").alias("p_block"))
    return _ranked(met(visits, wanted, False, "knn_found"), k)


def distinct_values(rows: DataFrame, name: str) -> list[int]:
    """Distinct cells or buckets: a bounded number of them, whatever the number of rows."""
    return sorted(r[name] for r in rows.select(name).distinct().collect())


def nearest_neighbours(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    skip_same_id: bool = False,
    n_pivots: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``tenant, query_id, match_id, score, rank``: exact top ``k`` by cosine.

    Both sides have ``id, tenant, vector`` with unit vectors; ids and tenants are numbers
    or strings, and ties go to the smaller id.  Rows without a tenant take no part.
    """
    if n_pivots is None:
        n_pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, round(points.count() ** 0.5)))
    pivots = _pivots(points, n_pivots)
    placed = lambda rows: with_cells(rows.select("id", "tenant", "vector").where("tenant is not null"), pivots)
    assigned, asked = cut(placed(points), "knn_points"), cut(placed(queries), "knn_queries")
    cells = assigned.groupBy(*CELL).agg(F.min("angle").alias("nearest"), F.max("angle").alias("farthest"), F.count(F.lit(1)).alias("n"))
    return search_cells(asked, lambda _: assigned, cells, pivots, k, skip_same_id, block_rows)
