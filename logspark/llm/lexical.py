"""Operator 11: the highest-scoring documents of every item, by a dual-tree search.

A document has a coordinate per term: what one occurrence of the term in an item adds to
the score.  An item counts its terms.  The score is their product, all in whole numbers.
Both sides are trees: a node holds the largest value of each coordinate below it, so the
product of an item node and a document node bounds every score between them.  A pair
of nodes whose bound is below the weakest k-th score of the node's items is left out,
with all documents and items below, which is exact; what remains is split, down to single scores.

Items are cut into blocks of at most ``BLOCK_TERMS`` terms, and a block is what a task holds next to
its documents: one pass over the stored coordinates per block.  Documents stream through the
tasks; each batch of at most ``BATCH_TERMS`` coordinates becomes one tree, sorted by its heaviest
terms so that neighbours are alike.  A k-th score to begin with comes from a first search over
about ``SAMPLE`` documents; any k documents' scores bound the final k-th one from below, so
they only spare work.  Tasks return at most k documents an item, and the rank is taken of those.

A term is compared by a 64-bit hash.  Null and empty texts have no terms: such documents are never found
and such items return nothing.  Ties go to the smaller id, null ids last; rows with equal ids
are separate documents, and repeated item rows separate items.  An empty table on either side
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm import common, words

BLOCK_TERMS = 500_000
BATCH_TERMS = 1_000_000
SAMPLE = 2_000
FAN = 16
ITEM_FAN = 8
NONE = np.iinfo(np.int64).max
TERM_SCHEMA = "id long, n long, terms binary, times binary"
COUNT_SCHEMA = "term long, df long"
FOUND_SCHEMA = "item_row long, doc_id long, score long"


class Sparse(NamedTuple):
    """Rows of (coordinate, value); row i is ``first[i]:first[i+1]``, coordinates ascending."""

    first: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def rows(self, which: np.ndarray) -> Sparse:
        sizes = (self.first[1:] - self.first[:-1])[which]
        first = np.append(0, np.cumsum(sizes))
        take = np.repeat(self.first[which] - first[:-1], sizes) + np.arange(first[-1])
        return Sparse(first, self.at[take], self.value[take])

    def grouped(self, group: np.ndarray) -> Sparse:
        """Coordinate maxima of groups of consecutive rows; ``group`` numbers the rows from 0."""
        owner = np.repeat(group, np.diff(self.first))
        order = np.lexsort((self.at, owner))
        owner, at, value = owner[order], self.at[order], self.value[order]
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])
        starts = np.flatnonzero(new)
        largest = np.maximum.reduceat(value, starts) if len(starts) else value
        first = np.searchsorted(owner[starts], np.arange(int(group[-1]) + 2 if len(group) else 1))
        return Sparse(first, at[starts], largest)

    def times(self, dense: np.ndarray) -> np.ndarray:
        """The product of every row with one dense vector."""
        sums = np.append(0, np.cumsum(self.value * dense[self.at]))
        return sums[self.first[1:]] - sums[self.first[:-1]]


# --- terms of texts ------------------------------------------------------------------


def _terms(batches: Iterator[pa.RecordBatch], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Distinct term hashes and counts of each text; only of ``known`` ones (sorted) if given."""
    for batch in batches:
        ids = batch.column("id")
        for row, data, offsets in words.text_groups(batch.column("text")):
            found = words.words_of(data, offsets, words.ALNUM)
            size = np.diff(found.first)
            whose, hashes = np.repeat(np.arange(len(size)), size), found.hash.view(np.int64)
            if known is not None:
                kept = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)
                whose, hashes = whose[kept], hashes[kept]
            order = np.lexsort((hashes, whose))
            whose, hashes = whose[order], hashes[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (whose[1:] != whose[:-1]) | (hashes[1:] != hashes[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(starts, append=len(hashes)).astype(np.int32)
            first = np.searchsorted(whose[starts], np.arange(len(size) + 1))
            terms = hashes[starts]
            cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            yield pa.record_batch(
                {
                    "id": ids.slice(row, len(size)),
                    "n": pa.array(size.astype(np.int64)),
                    "terms": pa.array([terms[a:b].tobytes() for a, b in cuts], pa.binary()),
                    "times": pa.array([times[a:b].tobytes() for a, b in cuts], pa.binary()),
                }
            )


def text_terms(rows: DataFrame, name: str, known: np.ndarray | None = None) -> DataFrame:
    """Stored (id, n, terms, times) of every row (id, text); ``n`` counts all terms with repeats."""
    named = rows.select(F.col("id").cast("long"), F.col("text").cast("string"))
    return common.stored(named.mapInArrow(lambda batches: _terms(batches, known), TERM_SCHEMA), name)


def _joined(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and where each row's begin."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data.view(dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows each term is; counts are merged whenever a million terms have gathered."""
    gathered, pending = [], 0
    seen, df = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        terms, where = np.unique(np.concatenate([seen, *gathered]), return_inverse=True)
        weight = np.concatenate([df, np.ones(pending, np.int64)])
        return terms, np.bincount(where, weight, minlength=len(terms)).astype(np.int64)

    for batch in batches:
        terms, _ = _joined(batch.column("terms"), np.int64)
        gathered.append(terms)
        pending += len(terms)
        if pending >= 1_000_000:
            seen, df = merged()
            gathered, pending = [], 0
            if len(seen) >= 1_000_000:
                yield pa.record_batch({"term": seen, "df": df})
                seen, df = np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen, df = merged()
    if len(seen):
        yield pa.record_batch({"term": seen, "df": df})


def document_counts(table: DataFrame) -> DataFrame:
    """(term, df) of stored terms, added up in tasks first."""
    partial = table.select("terms").mapInArrow(_document_counts, COUNT_SCHEMA)
    return partial.groupBy("term").agg(F.sum("df").alias("df"))


# --- one block of items --------------------------------------------------------------


class Items(NamedTuple):
    """Item rows of a block: their numbers, terms as coordinates of ``vocabulary``, and that term's weight."""

    row: np.ndarray
    terms: Sparse
    vocabulary: np.ndarray
    weight: np.ndarray


class ItemNode(NamedTuple):
    """Items below (places in the block), their terms with the largest count among them, children."""

    items: np.ndarray
    at: np.ndarray
    largest: np.ndarray
    children: list

    def times(self, rows: Sparse, scratch: np.ndarray) -> np.ndarray:
        """The product with every row; ``scratch`` has a zero per coordinate before and after."""
        scratch[self.at] = self.largest
        out = rows.times(scratch)
        scratch[self.at] = 0
        return out


def _parent(group: list[ItemNode]) -> ItemNode:
    at, where = np.unique(np.concatenate([node.at for node in group]), return_inverse=True)
    largest = np.zeros(len(at), np.int64)
    np.maximum.at(largest, where, np.concatenate([node.largest for node in group]))
    return ItemNode(np.concatenate([node.items for node in group]), at, largest, group)


def item_tree(items: Items) -> ItemNode:
    """Items that share their heaviest terms side by side, ``ITEM_FAN`` children to a node."""
    size = len(items.row)
    head = np.zeros((size, 2), np.int64)
    for i in range(size):
        at = items.terms.at[items.terms.first[i] : items.terms.first[i + 1]]
        heavy = at[np.argsort(-items.weight[at], kind="stable")][:2]
        head[i, : len(heavy)] = heavy
    level = []
    for i in np.lexsort((head[:, 1], head[:, 0])).tolist():
        a, b = items.terms.first[i], items.terms.first[i + 1]
        level.append(ItemNode(np.array([i]), items.terms.at[a:b], items.terms.value[a:b], []))
    while len(level) > 1:
        level = [_parent(level[i : i + ITEM_FAN]) for i in range(0, len(level), ITEM_FAN)]
    return level[0]


class Best:
    """The k best documents found of each item of a block, and its weakest score that still counts."""

    def __init__(self, size: int, k: int, floor: np.ndarray, coordinates: int):
        self.k, self.floor = k, floor.copy()
        self.scratch = np.zeros(coordinates, np.int64)
        none = np.zeros(0, np.int64)
        self.found = [(none, none) for _ in range(size)]

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer documents; equal scores at the k-th place stay for the smaller id."""
        score = np.concatenate([self.found[item][0], scores])
        doc = np.concatenate([self.found[item][1], ids])
        order = np.lexsort((doc, -score))[: self.k]
        self.found[item] = score[order], doc[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], score[order[-1]])


class DocumentTree:
    """Documents of one batch under nodes of coordinate maxima, ``FAN`` children to a node; level 0 are documents."""

    def __init__(self, ids: np.ndarray, coordinates: Sparse):
        head = np.full((len(ids), 2), -1, np.int64)
        owner = np.repeat(np.arange(len(ids)), np.diff(coordinates.first))
        order = np.lexsort((-coordinates.value, owner))
        for place in (0, 1):
            has = np.flatnonzero(np.diff(coordinates.first) > place)
            head[has, place] = coordinates.at[order[coordinates.first[has] + place]]
        alike = np.lexsort((head[:, 1], head[:, 0]))
        self.ids = ids[alike]
        self.levels = [coordinates.rows(alike)]
        while len(self.levels[-1].first) > FAN + 1:
            size = len(self.levels[-1].first) - 1
            self.levels.append(self.levels[-1].grouped(np.arange(size) // FAN))

    def top(self) -> tuple[int, np.ndarray]:
        return len(self.levels) - 1, np.arange(len(self.levels[-1].first) - 1)

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        size = len(self.levels[level - 1].first) - 1
        children = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return children[children < size]


def search(node: ItemNode, tree: DocumentTree, level: int, nodes: np.ndarray, best: Best) -> None:
    """Offer every document below ``nodes`` that may be among the best of an item below ``node``."""
    bound = node.times(tree.levels[level].rows(nodes), best.scratch)
    kept = (bound > 0) & (bound >= best.floor[node.items].min())
    nodes, bound = nodes[kept], bound[kept]
    if not len(nodes):
        return
    if node.children:
        under = (level - 1, tree.below(level, nodes)) if level else (0, nodes)
        for child in node.children:
            search(child, tree, *under, best)
    elif level:
        # The most promising half first: its scores raise the k-th one before the rest is looked at.
        order = np.argsort(-bound, kind="stable")
        half = max(1, len(order) // 2)
        for part in (order[:half], order[half:]):
            if len(part):
                search(node, tree, level - 1, tree.below(level, np.sort(nodes[part])), best)
    else:
        best.add(int(node.items[0]), tree.ids[nodes], bound)


def _coordinates(batch: pa.RecordBatch, items: Items, documents: int, size: int) -> tuple[np.ndarray, Sparse]:
    """(ids, coordinates) of a batch's documents that hold a term of the block."""
    terms, first = _joined(batch.column("terms"), np.int64)
    times, _ = _joined(batch.column("times"), np.int32)
    n = batch.column("n").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(n)), np.diff(first))
    at = np.minimum(np.searchsorted(items.vocabulary, terms), len(items.vocabulary) - 1)
    known = items.vocabulary[at] == terms
    owner, at, tf = owner[known], at[known], times[known].astype(np.int64)
    length = 25 + (75 * n * documents) // size
    value = items.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[owner]))
    holding, owner = np.unique(owner, return_inverse=True)
    ids = batch.column("id").fill_null(NONE).to_numpy(zero_copy_only=False)[holding]
    return ids, Sparse(np.searchsorted(owner, np.arange(len(holding) + 1)), at, value)


def _batches_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``BATCH_TERMS`` terms each, whole documents at least."""
    for batch in batches:
        _, first = _joined(batch.column("terms"), np.int64)
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(first, first[row] + BATCH_TERMS, "right")) - 1)
            end = min(end, len(batch))
            yield batch.slice(row, end - row)
            row = end


def _searched(batches: Iterator[pa.RecordBatch], items: Items, floor: np.ndarray, k: int, documents: int, size: int) -> Iterator[pa.RecordBatch]:
    root = item_tree(items)
    best = Best(len(items.row), k, floor, len(items.vocabulary))
    for batch in _batches_of_terms(batches):
        ids, coordinates = _coordinates(batch, items, documents, size)
        if not len(ids):
            continue
        whole = coordinates.grouped(np.zeros(len(ids), np.int64))
        bound = int(root.times(whole, best.scratch)[0])
        if bound > 0 and bound >= best.floor.min():
            tree = DocumentTree(ids, coordinates)
            search(root, tree, *tree.top(), best)
    for item, (score, doc) in enumerate(best.found):
        if len(score):
            doc = pa.array(doc, mask=doc == NONE)
            yield pa.record_batch({"item_row": pa.array(np.full(len(score), items.row[item])), "doc_id": doc, "score": pa.array(score)})


def search_block(table: DataFrame, items: Items, floor: np.ndarray, k: int, documents: int, size: int) -> DataFrame:
    """(item_row, doc_id, score): each task's k best documents of every item, of scores no lower than ``floor``."""
    found = lambda batches: _searched(batches, items, floor, k, documents, size)
    return table.mapInArrow(found, FOUND_SCHEMA)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item; tasks cut their own rows to k before anything is shuffled."""
    best = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# --- all items -----------------------------------------------------------------------


def _blocks(items: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first, terms, times) of runs of items of about ``BLOCK_TERMS`` terms; the driver holds one run."""
    ids, terms, times, held = [], [], [], 0
    for row in items.select("id", "terms", "times").toLocalIterator():
        found = np.frombuffer(row["terms"], np.int64)
        if not len(found):
            continue
        if held and held + len(found) > BLOCK_TERMS:
            yield _run(ids, terms, times)
            ids, terms, times, held = [], [], [], 0
        ids.append(row["id"])
        terms.append(found)
        times.append(np.frombuffer(row["times"], np.int32))
        held += len(found)
    if ids:
        yield _run(ids, terms, times)


def _run(ids: list[int], terms: list[np.ndarray], times: list[np.ndarray]) -> tuple:
    first = np.append(0, np.cumsum([len(t) for t in terms]))
    return np.array(ids, np.int64), first, np.concatenate(terms), np.concatenate(times).astype(np.int64)


def weight_of(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


def _known_terms(items: DataFrame) -> np.ndarray | None:
    """Sorted terms of all items if they are no more than a block's; None if tasks had better keep every term."""
    known = document_counts(items).select("term").limit(BLOCK_TERMS + 1).toArrow().column("term").to_numpy()
    return np.sort(known) if len(known) <= BLOCK_TERMS else None


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, seed: int = 5) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of every item with a score above 0.

    ``docs`` has (doc_id, text), ``items`` has (item_id, text).
    """
    spark = docs.sparkSession
    numbered = common.stored(items.select(F.monotonically_increasing_id().alias("id"), F.col("item_id").cast("long"), "text"), "lexical-items")
    item_terms = text_terms(numbered, "lexical-item-terms")
    table = text_terms(docs.select(F.col("doc_id").alias("id"), "text"), "lexical-terms", _known_terms(item_terms))
    documents, size = table.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = common.stored(document_counts(table), "lexical-counts")
    found = spark.createDataFrame([], FOUND_SCHEMA + ", rank int")
    for rows, first, terms, times in _blocks(item_terms) if documents else ():
        vocabulary, at = np.unique(terms, return_inverse=True)
        asked = spark.createDataFrame(pa.table({"term": vocabulary}))
        known = counts.join(F.broadcast(asked), "term", "left_semi").toArrow()
        order = np.searchsorted(vocabulary, known.column("term").to_numpy())
        df = np.zeros(len(vocabulary), np.int64)
        df[order] = known.column("df").to_numpy()
        block = Items(rows, Sparse(first, at, times), vocabulary, weight_of(df, documents))
        floor = _first_floor(table, block, k, documents, size, seed)
        one = ranked(search_block(table, block, floor, k, documents, size), k)
        found = found.unionByName(common.stored(one, "lexical-found"))
    named = numbered.select(F.col("id").alias("item_row"), "item_id")
    return found.join(named, "item_row").select("item_id", "rank", "doc_id", "score")


def _first_floor(table: DataFrame, block: Items, k: int, documents: int, size: int, seed: int) -> np.ndarray:
    """Each item's k-th score among about ``SAMPLE`` documents: no final one is lower.  0 where fewer were found."""
    share = min(1.0, SAMPLE / documents)
    some = table.where(F.pmod(F.xxhash64(F.lit(seed), "id", "terms"), F.lit(1 << 30)) < int(share * (1 << 30)))
    floor = np.zeros(len(block.row), np.int64)
    first = ranked(search_block(some, block, floor, k, documents, size), k).where(F.col("rank") == k)
    at = {row: i for i, row in enumerate(block.row.tolist())}
    for row in first.collect():
        floor[at[row["item_row"]]] = row["score"]
    return floor
