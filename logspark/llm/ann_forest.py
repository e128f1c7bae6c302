"""Operator 2: approximate nearest neighbours by a forest of random-projection trees.

A tree splits at each level by the projection on one random direction; the threshold of
a node is the median of the sample rows that reach it, or of the level's whole sample
where a node has too few.  The forest is fitted on at most about ``SAMPLE`` rows and
then places every row in a leaf of each tree; the depth follows the logarithm of the
number of rows, so leaves keep their size.  A query walks all trees with one queue ordered
by the sum of the squared margins crossed so far, which is about the squared distance from
the query to a node's cell, and visits the best leaves of the whole forest.  Candidates in
those leaves are ranked by exact cosine on the original vectors; each leaf is dealt into
blocks of rows and blocks of queries, and every block returns only each query's best, so no
list of all candidates exists.

How many leaves a query visits is measured in the run: ``MEASURED`` queries are compared
with all rows, in blocks, and walk their queues until their true nearest are found.  All
queries then visit as many leaves as find the share ``RECALL`` of those, and ``PROBES`` at
least, so recall does not fall as the table grows; the work of a query grows instead.

Vectors of each width have a forest of their own and find one another only.  A forest's sample is drawn
by a hash of id and vector and holds ``SAMPLE`` rows at most.

Vectors that are null, empty, zero, without id, or with null or
non-finite components neither query nor are found.  Ties go to the smaller id.  Rows with
equal ids count once, with their best score, and never answer their own id.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from math import ceil, isnan, log2, nan
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm import common, vectors

SAMPLE = 16_384
TREES = 8
LEAF = 128
PROBES = 384
RECALL = 0.95
MEASURED = 200
VISIT_ROWS = 16_384
NODE_SAMPLE = 4
ROW_BLOCK = 1024
QUERY_BLOCK = 256
FOUND_SCHEMA = "query_id long, vec_id long, score double"
MET_SCHEMA = "query_id long, vec_id long, score double, leaves array<long>"
LEAF_KEY = ["width", "tree", "leaf"]


class Forest(NamedTuple):
    """Directions (tree, level, width); per tree and level the thresholds of its nodes and a spare one."""

    directions: np.ndarray
    thresholds: list[list[np.ndarray]]
    spare: np.ndarray

    def cut(self, tree: int, level: int, node: int) -> float:
        known = self.thresholds[tree][level]
        value = float(known[node]) if node < len(known) else nan
        return float(self.spare[tree, level]) if isnan(value) else value

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row (row, tree)."""
        out = np.zeros((len(unit), len(self.directions)), np.int64)
        for tree, levels in enumerate(self.directions):
            at = unit @ levels.T
            node = out[:, tree]
            for level in range(at.shape[1]):
                known = self.thresholds[tree][level]
                value = known[np.minimum(node, len(known) - 1)] if len(known) else np.full(len(node), np.nan)
                value = np.where((node >= len(known)) | np.isnan(value), self.spare[tree, level], value)
                node = node * 2 + (at[:, level] > value)
            out[:, tree] = node
        return out

    def walk(self, unit: np.ndarray) -> Iterator[tuple[int, int]]:
        """The (tree, leaf) pairs that one vector should look into, nearest first."""
        depth = self.directions.shape[1]
        at = (self.directions @ unit).tolist()
        queue = [(0.0, tree, 0, 0) for tree in range(len(self.directions))]
        while queue:
            margin, tree, level, node = heappop(queue)
            while level < depth:
                side = at[tree][level] - self.cut(tree, level, node)
                right = side > 0
                heappush(queue, (margin + side * side, tree, level + 1, node * 2 + (not right)))
                node, level = node * 2 + right, level + 1
            yield tree, node

    def best_leaves(self, unit: np.ndarray, probes: int) -> list[tuple[int, int]]:
        return list(islice(self.walk(unit), probes))

    def needed(self, unit: np.ndarray, targets: np.ndarray) -> list[int]:
        """After how many leaves one vector meets each of the rows that lie in ``targets`` (row, tree)."""
        rows_of: dict[tuple[int, int], list[int]] = {}
        for row, leaves in enumerate(targets.tolist()):
            for place in enumerate(leaves):
                rows_of.setdefault(place, []).append(row)
        met: dict[int, int] = {}
        for visited, place in enumerate(self.walk(unit), 1):
            for row in rows_of.get(place, ()):
                met.setdefault(row, visited)
            if len(met) == len(targets):
                break
        return list(met.values())


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 31) -> Forest:
    depth = max(0, ceil(log2(max(rows, 1) / leaf)))
    source = np.random.default_rng(seed)
    directions = vectors.directions(source.normal(size=(trees * max(depth, 1), sample.shape[1])))
    directions = directions.reshape(trees, -1, sample.shape[1])[:, :depth]
    spare = np.zeros((trees, depth))
    thresholds: list[list[np.ndarray]] = []
    for tree in range(trees):
        node = np.zeros(len(sample), np.int64)
        levels = []
        for level in range(depth):
            at = sample @ directions[tree, level]
            spare[tree, level] = np.median(at)
            known = np.full(int(node.max()) + 1, np.nan)
            order = np.lexsort((at, node))
            starts = np.flatnonzero(np.append(True, np.diff(node[order]) != 0))
            for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
                if b - a >= NODE_SAMPLE:
                    known[node[order[a]]] = np.median(at[order[a:b]])
            enough = np.flatnonzero(~np.isnan(known))
            levels.append(known[: enough[-1] + 1] if len(enough) else known[:0])
            value = np.where(np.isnan(known[node]), spare[tree, level], known[node])
            node = node * 2 + (at > value)
        thresholds.append(levels)
    return Forest(directions, thresholds, spare)


def _place(batches, forests: dict[int, Forest]):
    for whole in batches:
        for width, batch in vectors.by_width(whole):
            found = forests[width].leaves(vectors.directions(vectors.matrix(batch.column("embedding"))))
            n, trees = found.shape
            rows = pa.array(np.repeat(np.arange(n), trees))
            yield pa.record_batch(
                {
                    "width": pa.array(np.full(n * trees, width, np.int32)),
                    "tree": pa.array(np.tile(np.arange(trees, dtype=np.int32), n)),
                    "leaf": pa.array(found.ravel()),
                    "vec_id": batch.column("vec_id").take(rows),
                    "embedding": batch.column("embedding").take(rows),
                }
            )


def _probe(batches, forests: dict[int, Forest], probes: dict[int, int]):
    for every in batches:
        for width, whole in vectors.by_width(every):
            step = max(1, VISIT_ROWS // probes[width])
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                unit = vectors.directions(vectors.matrix(batch.column("embedding")))
                visits = [forests[width].best_leaves(v, probes[width]) for v in unit]
                rows = pa.array(np.repeat(np.arange(len(batch)), [len(v) for v in visits]))
                yield pa.record_batch(
                    {
                        "width": pa.array(np.full(len(rows), width, np.int32)),
                        "tree": pa.array([t for v in visits for t, _ in v], pa.int32()),
                        "leaf": pa.array([x for v in visits for _, x in v], pa.int64()),
                        "query_id": batch.column("vec_id").take(rows),
                        "query": batch.column("embedding").take(rows),
                    }
                )


def _nearest(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Each query's ``k`` nearest of one block of candidates, by cosine, ties by id."""
    ids = rows.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    unit = vectors.directions(vectors.matrix(rows.column("embedding")))[order]
    asked = vectors.directions(vectors.matrix(queries.column("query")))
    query_ids = queries.column("query_id").to_numpy()
    # Each product is summed in the same order, so equal vectors have equal scores.
    score = np.einsum("ij,kj->ik", asked, unit)
    score[query_ids[:, None] == ids[None, :]] = -np.inf
    again = np.append(False, ids[1:] == ids[:-1])
    if again.any():  # rows with one id count once, with their best score
        starts = np.flatnonzero(~again)
        ids, score = ids[starts], np.maximum.reduceat(score, starts, axis=1)
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(score, best, axis=1)
    some = found > -np.inf
    whose = np.broadcast_to(query_ids[:, None], best.shape)
    return pa.table({"query_id": pa.array(whose[some]), "vec_id": pa.array(ids[best][some]), "score": pa.array(found[some])})


def _needed(batches, forest: Forest):
    for batch in batches:
        for unit, leaves in zip(batch.column("unit").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
            targets = np.array(leaves).reshape(-1, len(forest.directions))
            yield pa.record_batch({"needed": pa.array(forest.needed(np.array(unit), targets), pa.int64())})


def _compared(batches, asked: pa.Table, forest: Forest, k: int):
    """Each query's ``k`` nearest of a batch of rows, with the leaves that the row of that score lies in."""
    queries = vectors.directions(vectors.matrix(asked.column("query")))
    place = {q: i for i, q in enumerate(asked.column("query_id").to_pylist())}
    for batch in batches:
        if len(batch):
            found = _nearest(pa.Table.from_batches([batch]), asked, k)
            unit = vectors.directions(vectors.matrix(batch.column("embedding")))
            ids = batch.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            rows = []
            for query, i in zip(found.column("query_id").to_pylist(), found.column("vec_id").to_pylist(), strict=True):
                own = order[np.searchsorted(ids[order], i) : np.searchsorted(ids[order], i, "right")]
                rows.append(own[np.argmax(unit[own] @ queries[place[query]])])
            leaves = forest.leaves(unit[rows]) if rows else np.zeros((0, len(forest.directions)), np.int64)
            yield from found.append_column("leaves", pa.array(list(leaves), pa.list_(pa.int64()))).combine_chunks().to_batches()


def measured_probes(rows: DataFrame, is_query: Column, k: int, forest: Forest, recall: float = RECALL) -> int:
    """Leaves to visit so that ``MEASURED`` of the queries find the share ``recall`` of their ``k`` nearest of all rows.

    ``rows`` are of one width.
    """
    spark = rows.sparkSession
    picked = rows.where(is_query).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(1)), "embedding").limit(MEASURED)
    asked = picked.dropDuplicates(["vec_id"]).toArrow().rename_columns(["query_id", "query"])
    if not asked.num_rows:
        return PROBES
    found = rows.select("vec_id", "embedding").mapInArrow(lambda batches: _compared(batches, asked, forest, k), MET_SCHEMA)
    once = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "leaves")).alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("best.score"), "vec_id")
    best = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    targets = best.groupBy("query_id").agg(F.flatten(F.collect_list("best.leaves")).alias("leaves")).toArrow().to_pylist()
    if not targets:
        return PROBES
    queries = dict(zip(asked.column("query_id").to_pylist(), vectors.directions(vectors.matrix(asked.column("query"))), strict=True))
    walks = [(queries[r["query_id"]].tolist(), r["leaves"]) for r in targets]
    walks = spark.createDataFrame(walks, "unit array<double>, leaves array<long>")
    needed = walks.mapInArrow(lambda batches: _needed(batches, forest), "needed long").toArrow()
    ranks = np.sort(needed.column("needed").to_numpy())
    return max(PROBES, int(ranks[ceil(recall * len(ranks)) - 1]))


def _fitted(rows: DataFrame, n: int, trees: int, leaf: int) -> Forest:
    """A forest for ``n`` rows of one width, from a sample that does not grow with them."""
    draw = F.xxhash64("vec_id", "embedding")
    share = int(min(1.0, 1.2 * SAMPLE / max(n, 1)) * (1 << 30))
    picked = rows.where(F.pmod(draw, F.lit(1 << 30)) < share).orderBy(draw, "vec_id").limit(SAMPLE)
    return fit(vectors.directions(vectors.matrix(picked.select("embedding").toArrow().column(0))), n, trees, leaf)


def search(
    embeddings: DataFrame, is_query: Column, k: int, probes: int | None = None, trees: int = TREES, leaf: int = LEAF
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``is_query`` marks.

    ``probes`` fixes the leaves that a query visits instead of measuring them.
    """
    kind = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    named = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind))
    rows = common.stored(named.where(vectors.usable()), "ann-vectors")
    forests, visited = {}, {}
    for width, n in sorted(vectors.widths(rows).items()):
        own = rows.where(F.size("embedding") == width)
        forests[width] = _fitted(own, n, trees, leaf)
        deep = forests[width].directions.shape[1] > 0  # else one leaf a tree holds all rows
        visited[width] = probes or (measured_probes(own, is_query, k, forests[width]) if deep else PROBES)

    placed = f"width int, tree int, leaf long, vec_id long, embedding {kind}"
    index = common.stored(rows.mapInArrow(lambda batches: _place(batches, forests), placed), "ann-index")
    probed = f"width int, tree int, leaf long, query_id long, query {kind}"
    visits = rows.where(is_query).mapInArrow(lambda batches: _probe(batches, forests, visited), probed)
    visits = common.stored(visits, "ann-visits")
    sizes = index.groupBy(*LEAF_KEY).agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).alias("row_blocks"))
    asked = visits.groupBy(*LEAF_KEY).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("query_blocks"))
    shape = common.stored(sizes.join(asked, LEAF_KEY), "ann-leaves")
    left = index.join(shape, LEAF_KEY).withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")))
    left = left.withColumn("query_block", F.explode(F.expr("sequence(0L, query_blocks - 1)"))).drop("row_blocks", "query_blocks")
    right = visits.join(shape, LEAF_KEY).withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")))
    right = right.withColumn("row_block", F.explode(F.expr("sequence(0L, row_blocks - 1)"))).drop("row_blocks", "query_blocks")
    keys = [*LEAF_KEY, "row_block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _nearest(a, b, k), FOUND_SCHEMA)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
