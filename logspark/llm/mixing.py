"""Operator 10: a mix of sources with target weights, dealt to output shards by a hypergeometric splitting tree.

Every source is one stream of words: its documents in an order drawn by a hash, as
often as needed.  The stream is cut into blocks of ``block_words`` words, and a document belongs
to the block in which it begins.  A source's target is a number of words, so of blocks to draw.
These block counts are split down a binary tree of shards: each node draws,
without replacement, how many blocks of each source go left.  A shard takes the next
undrawn blocks of each source's stream, which is permuted already, so blocks are disjoint
and counts exact; what no shard has drawn is not taken.  In a shard, rows are shuffled by sorting on another hash.

Targets are found with sums over the table of sources.  The tree runs over groups of
``GROUP`` sources first, whose totals are all that the driver holds; each group then splits its
share among its sources in a task, with the same draws.  Blocks grow with the corpus where it
would have more than ``MOST_BLOCKS`` of them.  Sizes before a document come from buckets of about ``BUCKET_ROWS``
rows of the permuted source, so a source with a third of all rows is spread evenly.

Null sources are one source, the last.  Documents without words take none and are in no
shard.  Rows with equal ids are separate documents.  An empty table gives an empty result.
Other columns stay; added ones start with ``mix_`` and replace input columns of their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm import common

BUCKET_ROWS = 256
GROUP = 4096
MOST_BLOCKS = 400_000_000
WORD = r"[^\x20\x09-\x0D]+"
PLAN_SCHEMA = "key string, source_size long, target double, quota long, buckets long, bounds array<long>"
ADDED = ["mix_source_size", "mix_target", "mix_taken"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """Add ``target`` to each source (size, weight): all words shared by weight, at most ``most`` times its own.

    What a source cannot take is shared again by weight among the others, until no
    target is above its limit.  Every round is one sum over the stored table, and closes
    at least one source for good.
    """
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = F.col("size") * most
    left, weight, closed = total, 0.0, 0
    while True:
        share = F.lit(float(left)) * F.col("weight") / F.lit(weight) if weight else F.lit(0.0)
        full = (F.col("size") == 0) | (share > limit)
        found = sources.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if weight and found["n"] == closed or not found["weight"]:
            target = F.when(full, limit).otherwise(share) if found["weight"] else limit
            return sources.withColumn("target", target.cast("double"))
        left, weight, closed = total - found["words"], found["weight"], found["n"]


def equal_shards(total: int, shards: int) -> np.ndarray:
    """Blocks of each shard: as near to equal as whole numbers are."""
    return np.diff(total * np.arange(shards + 1) // shards)


def split_blocks(counts: np.ndarray, shard_totals: np.ndarray, seed: list[int]) -> np.ndarray:
    """Blocks of each source (column) for each shard (row), drawn down a binary tree of shards.

    Rows add up to ``shard_totals`` and columns to ``counts`` exactly.
    """
    out = np.zeros((len(shard_totals), len(counts)), np.int64)

    def descend(have: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        draw = np.random.default_rng([*seed, low, high])
        left = draw.multivariate_hypergeometric(have, int(shard_totals[low:middle].sum()), method="marginals")
        descend(left, low, middle)
        descend(have - left, middle, high)

    if len(counts):
        descend(np.asarray(counts, np.int64), 0, len(shard_totals))
    return out


def _split_group(table: pa.Table, of_group: dict[int, np.ndarray], seed: int) -> pa.Table:
    """The first block of each shard, and the end of the last one, for each source of a group."""
    table = table.sort_by("position")
    group = table.column("part")[0].as_py()
    drawn = split_blocks(table.column("blocks").to_numpy(), of_group[group], [seed, group + 1])
    bounds = np.vstack([np.zeros((1, drawn.shape[1]), np.int64), np.cumsum(drawn, axis=0)]).T
    kept = table.select(["key", "source_size", "target", "quota", "buckets"])
    return kept.append_column("bounds", pa.array(list(bounds), pa.list_(pa.int64())))


def plan(sources: DataFrame, pattern: tuple[float, ...], most: int, shards: int, block_words: int, seed: int) -> tuple[DataFrame, int]:
    """(a row per source (key, size, rows) with its target and what each shard draws, words per block)."""
    order = [F.col("key") == "-", "key"]
    placed = common.stored(common.in_order(sources, order, "mix-order"), "mix-sources")
    weights = F.array(*[F.lit(float(w)) for w in pattern])
    weight = F.get(weights, (F.col("position") % len(pattern)).cast("int"))
    goals = with_targets(placed.withColumn("weight", weight), most)
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    width = max(block_words, -(-total // MOST_BLOCKS))
    quota = F.least(F.round("target").cast("long"), F.col("size") * most)
    goals = goals.select(
        "key",
        F.col("size").alias("source_size"),
        "target",
        quota.alias("quota"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long").alias("buckets"),
        F.ceil(quota / width).cast("long").alias("blocks"),
        "position",
        F.expr(f"position div {GROUP}").alias("part"),
    )
    goals = common.stored(goals, "mix-goals")
    parts = {r["part"]: r["blocks"] for r in goals.groupBy("part").agg(F.sum("blocks").alias("blocks")).collect()}
    counts = np.array([parts[k] for k in sorted(parts)], np.int64)
    drawn = split_blocks(counts, equal_shards(int(counts.sum()), shards), [seed, 0])
    of_group = {k: drawn[:, i] for i, k in enumerate(sorted(parts))}
    split = goals.groupBy("part").applyInArrow(lambda table: _split_group(table, of_group, seed), PLAN_SCHEMA)
    return common.stored(split, "mix-plan"), width


def mix(
    docs: DataFrame,
    pattern: tuple[float, ...],
    most: int = 3,
    shards: int = 8,
    block_words: int = 2048,
    whole: bool = False,
    seed: int = 17,
) -> DataFrame:
    """Add to each row (doc_id, source, size and any others) what the mix takes of it.

    ``pattern`` repeats over the sources in code-point order, nulls last.  Added are
    ``mix_source_size``, ``mix_target`` and ``mix_taken``: an array of (pass, words,
    shard, block, place) with one entry per time a shard has drawn the block in which the document
    begins.  ``words`` are its first ones, less than all only where the source's quota ends.
    With ``whole`` a document there is taken whole if half of it or more lies before that end.
    """
    key = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
    keyed = docs.select(F.col("doc_id").alias("id"), F.col("size").cast("long").alias("size"), key.alias("key"), row.alias("row"))
    sources = keyed.groupBy("key").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("rows"))
    table, width = plan(common.stored(sources, "mix-totals"), pattern, most, shards, block_words, seed)
    named = keyed.withColumn("draw", F.xxhash64(F.lit(seed), "id", "key", "size")).join(table, "key")
    share = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    named = named.withColumn("bucket", F.floor(share * F.col("buckets")))
    taken = _taken(most, shards, width, whole, seed)
    added = zip(("source_size", "target", "taken"), ADDED, strict=True)
    # The row's own columns come back in a step of their own, so that no name above can mean one of them.
    rows = _with_start(named).select("row", "source_size", "target", taken.alias("taken"))
    return rows.select("row.*", *[F.col(c).alias(name) for c, name in added])


def _with_start(named: DataFrame) -> DataFrame:
    """``start``: words of the source before each document."""
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = named.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "bucket").orderBy(F.shiftrightunsigned("draw", 11), "id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return named.join(sums, ["key", "bucket"]).withColumn("start", F.col("before") + before)


def _taken(most: int, shards: int, width: int, whole: bool, seed: int) -> Column:
    """The takings of a document by the shards that have drawn its blocks."""

    def once(n: Column) -> Column:
        start = F.col("start") + n * F.col("source_size")
        words = F.greatest(F.lit(0), F.least("size", F.col("quota") - start)).cast("long")
        if whole:
            words = F.when(words * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("long")
        block = F.floor(start / width).cast("long")
        shard = F.size(F.filter("bounds", lambda first: first <= block)) - 1
        place = F.xxhash64(F.lit(seed + 1), "id", "draw", n)
        return F.struct(n.cast("int").alias("pass"), words.alias("words"), shard.alias("shard"), block.alias("block"), place.alias("place"))

    every = F.transform(F.sequence(F.lit(0), F.lit(most)), once)
    return F.filter(every, lambda one: (one["words"] > 0) & (one["shard"] < shards))


def taken_rows(mixed: DataFrame) -> DataFrame:
    """One row per time a document is taken, in shards, shuffled inside each by ``mix_place``."""
    names = ["pass", "words", "shard", "block", "place"]
    added = [F.col(f"one.{c}").alias(f"mix_{c}") for c in names]
    row = F.struct(*[F.col(f"`{c}`") for c in mixed.columns if c not in ADDED and c[4:] not in names])
    rows = mixed.select(row.alias("row"), F.explode("mix_taken").alias("one")).select("row.*", *added)
    return rows.repartitionByRange("mix_shard", "mix_place").sortWithinPartitions("mix_shard", "mix_place")
