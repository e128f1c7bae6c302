"""Operator 9: near-duplicate texts by circulant MinHash, exact Jaccard verification and components.

A text's set is its distinct runs of five words, each as a 64-bit hash of lower-cased
words.  Two permutations make the whole signature: the first scatters hashes over
``POSITIONS`` places, the second is one table of places that is shifted by one for
each further coordinate.  Coordinates are cut into bands; the number of bands follows
from the threshold, so that a pair at the threshold is missed with at most ``MISS``.

Texts with equal sets form one class, which its smallest document id stands for.  The classes of a
band's bucket are compared by ``MARKS`` coordinates, of which a byte each is kept; those whose estimate lies
so far below the threshold that chance explains it for ``FAR`` deviations at most are not tied, so texts that only share
boilerplate do not meet.  Buckets of more than ``MEMBERS`` classes tie all to the smallest.  What the ties connect is
a cluster.  A cluster is dealt into blocks of about ``BLOCK`` classes or ``BLOCK_SHINGLES``
hashes; a task compares the full sets of one pair of blocks by counting what they share, and
returns a spanning forest of the links.  So the candidate pairs of a large group of near copies
are never rows, no task holds the group, and no link is lost.

Rows without words have an empty set and link with nothing; null and empty texts are
such rows.  Rows with a null id are returned and link with nothing.  Rows that share an
id are one node.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import common, words

SHINGLE_WORDS = 5
ROWS = 6
MARKS = 96
FAR = 5.5
MEMBERS = 256
MISS = 1e-5
POSITIONS = 1 << 20
_CHUNK = 1 << 12
SIGNATURE_SCHEMA = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, marks binary"
SET_SCHEMA = "doc_id long, cluster long, blocks long, shingles binary"
LINK_SCHEMA = "a long, b long"
BLOCK = 128
BLOCK_SHINGLES = 1 << 18
_COLUMNS = 4096


def bands_for(threshold: float) -> int:
    return ceil(log(MISS) / log(1 - threshold**ROWS))


def least_agreement(threshold: float) -> int:
    """Equal marks out of ``MARKS`` that a pair at the threshold has for all but a chance of about a ten-millionth."""
    return max(1, int(MARKS * threshold - FAR * sqrt(MARKS * threshold * (1 - threshold))))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) for runs of texts."""
    for row, data, offsets in words.text_groups(column):
        found = words.words_of(data, offsets, words.SPACED)
        runs = words.ngrams(found.hash, SHINGLE_WORDS)
        sets = []
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            own = runs[a : b - SHINGLE_WORDS + 1] if b - a >= SHINGLE_WORDS else words.ngrams(found.hash[a:b], b - a) if b > a else runs[:0]
            own = np.sort(own)
            sets.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
        yield row, sets


class Circulant:
    """Signatures of shingle sets from two permutations."""

    def __init__(self, bands: int, seed: int = 7):
        self.bands, coordinates = bands, bands * ROWS
        second = np.random.default_rng(seed).permutation(POSITIONS).astype(np.uint32)
        round_trip = np.concatenate([second, second[: coordinates - 1]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(round_trip, coordinates)

    def bands_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """Band keys of each set; the number of the band is part of its key."""
        return self.signed(sets)[0]

    def signed(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, a byte of each of the first ``MARKS`` coordinates) of each set."""
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        place = (words.mix(every) >> np.uint64(64 - 20)).astype(np.int64)
        least = np.full((len(sets), self.shifted.shape[1]), POSITIONS, np.uint32)
        for a in range(0, len(every), _CHUNK):
            whose = owner[a : a + _CHUNK]
            starts = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
            part = np.minimum.reduceat(self.shifted[place[a : a + _CHUNK]], starts, axis=0)
            least[whose[starts]] = np.minimum(least[whose[starts]], part)
        rows = least.reshape(len(sets), self.bands, ROWS)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), (len(sets), self.bands)).copy()
        for i in range(ROWS):
            key = words.mix(key + rows[:, :, i].astype(np.uint64))
        return key.view(np.int64), (words.mix(least[:, :MARKS].astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _signatures(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    circulant = Circulant(bands)
    other = np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        for row, sets in shingle_sets(batch.column("text")):
            keys, marks = circulant.signed(sets)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").slice(row, len(sets)),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "key1": pa.array(np.array([words.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    "key2": pa.array(np.array([words.mix(s ^ other).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                    "marks": pa.array([m.tobytes() for m in marks], pa.binary()),
                }
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in shingle_sets(batch.column("text")):
            kept = {c: batch.column(c).slice(row, len(sets)) for c in ("doc_id", "cluster", "blocks")}
            yield pa.record_batch({**kept, "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; members of one set only are left out before they are counted."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common_column = np.cumsum(holders > 1) - 1
    several = holders[column] > 1
    owner, column = owner[several], common_column[column[several]]
    shared = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


def _links(group: pa.Table, percent: int) -> pa.Table:
    """Forest links inside one pair of blocks of one cluster."""
    group = group.take(pa.array(np.argsort(group.column("doc_id").to_numpy(), kind="stable")))
    ids = group.column("doc_id").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    shared = shared_counts(sets)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    root = ids[common.smallest_reachable(linked)]
    return pa.table({"a": pa.array(ids[ids != root]), "b": pa.array(root[ids != root])})


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Forest ties inside each bucket, of classes with ``least`` equal marks; rows come ordered by bucket and id."""
    held = None
    for batch in _and_last(batches):
        table = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if table is None or not len(table):
            continue
        band = table.column("band").to_numpy()
        starts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        done = len(table) if batch is None else int(starts[-1])
        held = None if batch is None else table.slice(done)
        starts = starts[starts < done]
        if not len(starts):
            continue
        ids = table.column("doc_id").to_numpy()[:done]
        marks = np.frombuffer(b"".join(table.column("marks").slice(0, done).to_pylist()), np.uint8).reshape(done, -1)
        sizes = np.diff(starts, append=done)
        two = starts[sizes == 2]
        two = two[(marks[two] == marks[two + 1]).sum(1) >= least]
        a, b = [ids[two + 1]], [ids[two]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own, members = marks[start : start + size], ids[start : start + size]
            linked = np.stack([(own == one).sum(1) >= least for one in own])
            root = members[common.smallest_reachable(linked)]
            a.append(members[members != root])
            b.append(root[members != root])
        yield pa.record_batch({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _ties(classes: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) of classes that share a bucket, such that every pair at the threshold that does is connected."""
    banded = classes.select("doc_id", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = common.stored(sizes, "minhash-buckets")  # as a table of its own it lets Spark split a frequent band's rows
    # Ids and bands meet first, by one plan at every size; marks join the few rows that share a bucket.
    members = common.stored(banded.join(sizes.hint("merge"), "band"), "minhash-members")
    small = members.where(F.col("n") <= MEMBERS).join(classes.select("doc_id", "marks").hint("merge"), "doc_id")
    dealt = small.select("band", "doc_id", "marks").repartition("band").sortWithinPartitions("band", "doc_id")
    alike = dealt.mapInArrow(lambda batches: _alike(batches, least_agreement(percent / 100)), LINK_SCHEMA)
    large = members.where(F.col("n") > MEMBERS)
    leaders = common.stored(large.groupBy("band").agg(F.min("doc_id").alias("leader")), "minhash-leaders")
    led = large.join(leaders, "band").where("doc_id > leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    return common.stored(alike.union(led).distinct(), "minhash-ties")


def _verified(ties: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold on full sets and connect all that is linked inside the clusters of ``ties``."""
    clusters = common.components(ties, "minhash-ties").toDF("doc_id", "cluster")
    clusters = clusters.join(classes.select("doc_id", "n_shingles"), "doc_id")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("hashes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("hashes") / BLOCK_SHINGLES))
    members = clusters.select("doc_id", "cluster").join(sizes.select("cluster", blocks.alias("blocks")), "cluster")
    texts = docs.join(members.distinct().hint("merge"), "doc_id").select("doc_id", "cluster", "blocks", "text")
    sets = common.stored(texts.mapInArrow(_sets, SET_SCHEMA), "minhash-sets")
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    grouped = dealt.select("cluster", "low", "high", "doc_id", "shingles").groupBy("cluster", "low", "high")
    return common.stored(grouped.applyInArrow(lambda group: _links(group, percent), LINK_SCHEMA), "minhash-links")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Texts are linked if at least ``percent`` in a hundred of all shingles of the two
    are shared.  ``component_id`` is the smallest id reachable by links.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bands = bands_for(percent / 100)
    signed = docs.mapInArrow(lambda batches: _signatures(batches, bands), SIGNATURE_SCHEMA)
    signed = common.stored(signed, "minhash")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "marks")).alias("one"))
    classes = common.stored(classes.select("key1", "key2", "one.*"), "minhash-classes")

    links = _verified(_ties(classes, percent), classes, docs, percent)
    labels = common.components(links, "minhash-rounds").toDF("doc_id", "component")
    everyone = classes.select("key1", "key2", "doc_id").join(labels, "doc_id", "left")
    everyone = everyone.select("key1", "key2", F.coalesce("component", "doc_id").alias("found"), F.lit(True).alias("known"))
    result = signed.drop("bands", "marks").withColumn("known", F.expr("n_shingles > 0 and doc_id is not null"))
    result = result.join(everyone, ["key1", "key2", "known"], "left")
    result = result.withColumn("component_id", F.coalesce("found", "doc_id"))
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
