"""Operator 12: draw documents by importance, so that their word runs are spread as a target's are.

A 256-byte table lower-cases A-Z and blanks separators in a text's UTF-8, ``bytes.split`` yields
its words, and a chained CRC-32 (the checksum of a run is the seed that the next word extends) gives the
hash of every run of 1 to ``longest`` words.  Counters reduce the runs of each text to
buckets, and tasks reduce those to counts per bucket of the whole corpus.  A bucket's gain is the
logarithm of how much more frequent it is in the target, a document's weight the sum of
its runs' gains.  Adding Gumbel noise from a hash of the id and keeping the highest sums draws
without replacement in proportion to the exponential of the weights.

Texts are read once; the driver and each task hold one number per bucket.  Ranks come from a range
partitioning, so no task sees more than its range of scores, however many documents are drawn.

Null and empty texts have no words, weight 0 and no rank.  A null id is hashed like an empty one and
ranked after other ids of the same score; rows with equal ids are separate documents.  Repeated
target rows each count.  An empty table gives an empty result; without a target all its counts are 0.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm import common

BUCKETS = 10_000
COUNTED_SCHEMA = "doc_id long, n_words long, n_features long, buckets array<int>, times array<long>"
SUM_SCHEMA = "bucket int, n long"
# A-Z become a-z; a-z, digits and the bytes of other characters stay; every other ASCII byte is a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def run_checksums(found: list[bytes], longest: int) -> Counter:
    """How often each checksum occurs among the runs of 1 to ``longest`` words joined by a blank."""
    # Without longer runs, equal words are counted before their checksum is taken.
    if longest == 1:
        total: Counter = Counter()
        for word, n in Counter(found).items():
            total[zlib.crc32(word)] += n
        return total
    last = [zlib.crc32(word) for word in found]
    total = Counter(last)
    spaced = [b" " + word for word in found]
    for n in range(1, longest):
        last = list(map(zlib.crc32, spaced[n:], last[: len(spaced) - n]))
        total.update(last)
    return total


def bucket_counts(text: bytes, longest: int, buckets: int) -> tuple[int, Counter]:
    """(number of words, occurrences per bucket) of one text."""
    found = text.translate(TABLE).split()
    total: Counter = Counter()
    for checksum, n in run_checksums(found, longest).items():
        total[checksum % buckets] += n
    return len(found), total


def _counted(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        words, features, at, times, ends = [], [], [], [], [0]
        for text in texts:
            n, total = bucket_counts(text.as_py() or b"", longest, buckets)
            words.append(n)
            features.append(total.total())
            at.append(np.fromiter(total.keys(), np.int32, len(total)))
            times.append(np.fromiter(total.values(), np.int64, len(total)))
            ends.append(ends[-1] + len(total))
        if not ends[1:]:
            continue
        ends = pa.array(ends, pa.int32())
        held = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists))) for lists in (at, times)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), *held], ["doc_id", "n_words", "n_features", "buckets", "times"])


def counted(rows: DataFrame, longest: int, buckets: int, name: str) -> DataFrame:
    """Stored counts per bucket of every row's (doc_id, text)."""
    texts = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return common.stored(texts.mapInArrow(lambda batches: _counted(batches, longest, buckets), COUNTED_SCHEMA), name)


def _summed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("times").flatten().to_numpy())
    at = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})


def bucket_totals(table: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences per bucket in the whole table; tasks add up their rows, so at most ``buckets`` rows leave each."""
    sums = table.select("buckets", "times").mapInArrow(lambda batches: _summed(batches, buckets), SUM_SCHEMA)
    total = np.zeros(buckets, np.int64)
    for row in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in the target and in the corpus."""
    size, wanted, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (size + buckets) / ((s + 1.0) * (wanted + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def _weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, times = batch.column("buckets"), batch.column("times").flatten().to_numpy()
        if not len(at):
            continue
        sums = np.append(0, np.cumsum(gain[at.flatten().to_numpy()] * times))
        ends = np.append(0, np.cumsum(at.value_lengths().to_numpy()))
        own = batch.select(["doc_id", "n_words", "n_features"])
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sums[ends[1:]] - sums[ends[:-1]])], [*own.schema.names, "weight"])


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths from the first 32 bits of a hash of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; rank is null where not drawn.

    ``docs`` has (doc_id, text), ``target`` has (text).  Of the documents with ``least_words`` words or
    more, ``percent`` percent are drawn.
    """
    table = counted(docs, longest, buckets, "importance-counts")
    wanted = counted(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets, "importance-target")
    gain = gains(bucket_totals(table, buckets), bucket_totals(wanted, buckets))
    schema = "doc_id long, n_words long, n_features long, weight long"
    weighed = table.mapInArrow(lambda batches: _weighed(batches, gain), schema)
    scored = common.stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance-scores")
    able = scored.where(F.col("n_words") >= least_words)
    wanted_rows = percent * able.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = common.in_order(able, order, "importance-order").withColumn("rank", F.col("position") + 1)
    rank = F.when(F.col("rank") <= wanted_rows, F.col("rank")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    few = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank).unionByName(few)
