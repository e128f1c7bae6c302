"""Operator 13: a toxicity score for every text from FTRL-proximal logistic regression on hashed word runs.

A text's features are its words, its pairs of neighbouring words and its pairs of words with
one word left out between them, hashed into ``BUCKETS`` coordinates and counted; a count is
divided by the square root of the text's number of features, so that short and long
texts weigh alike.  FTRL-proximal keeps for every coordinate the sum of its gradients and of
their squares: the second gives each coordinate its own learning rate, and an L1 limit on the
first keeps coordinates at exactly 0 until enough has been seen of them.  The weights
that are left are few, at most ``BUCKETS``, and go out to all tasks.

Learning is spread over shards of about ``SHARD_ROWS`` rows.  In each of ``ROUNDS`` rounds a
shard reads its rows one after another ``PASSES`` times, from the state all shards start with; then a
coordinate's changes are averaged over the shards that saw it.  Shards and orders come from
hashes of the rows, so a model does not depend on how the tables are split.

About ``max_rows`` distinct labelled rows are learnt from, drawn by a hash first of the id, then of id
and text; rows that repeat id, text and label count once.  All texts are scored, read whole.  Null and
empty texts have no features and get the score of the bias alone.  Rows with a null id count as held
out.  An id with several labels counts with each.  Without any labelled row every
score is 0.5.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm import common, words
from logspark.operators.scale import new_path

BUCKETS = 1 << 18
MAX_ROWS = 32_000
SHARD_ROWS = 2_500
SHARD_BYTES = 10 << 20
ROUNDS, PASSES = 10, 1
_SHARES = 1 << 30
ROW_SCHEMA = "shard int, draw long, label int, buckets binary, times binary"
SHARD_SCHEMA = "shard int, labels binary, sizes binary, buckets binary, times binary"
CHANGE_SCHEMA = "z binary, n binary, seen binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, score double"


class Rates(NamedTuple):
    """Learning rate scale and offset, the L1 and L2 weights of FTRL-proximal, and the weight of a toxic row's loss."""

    alpha: float = 30.0
    beta: float = 0.1
    l1: float = 0.6
    l2: float = 0.0
    positive: float = 1.5


RATES = Rates()


class State(NamedTuple):
    """Sum of gradients (less what the weights moved) and of their squares; the last coordinate is the bias."""

    z: np.ndarray
    n: np.ndarray


def empty_state() -> State:
    return State(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))


def weights(z: np.ndarray, n: np.ndarray, rates: Rates, free: np.ndarray | bool) -> np.ndarray:
    """The weights that minimise the regularised sum of past losses; ``free`` coordinates know no L1 limit."""
    beyond = np.sign(z) * np.maximum(np.abs(z) - np.where(free, 0.0, rates.l1), 0)
    return -beyond / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2)


def learn(state: State, rows: Iterator[tuple[int, np.ndarray, np.ndarray]], rates: Rates) -> tuple[State, np.ndarray]:
    """The state after reading (label, buckets, values) in order, and which coordinates were seen."""
    z, n = state.z.copy(), state.n.copy()
    seen = np.zeros(len(z), bool)
    for label, bucket, value in rows:
        at, x = np.append(bucket, BUCKETS), np.append(value, 1.0)
        w = weights(z[at], n[at], rates, at == BUCKETS)
        gradient = (chance(w @ x) - label) * x * (rates.positive if label else 1.0)
        grown = n[at] + gradient**2
        z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / rates.alpha * w
        n[at] = grown
        seen[at] = True
    return State(z, n), seen


def chance(logit: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, pair and spaced pair of each text."""
    found = words.words_of(data, offsets, words.ALNUM)
    whose = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
    spaced = words.mix(words.mix(found.hash[:-2]) - found.hash[2:])
    texts, buckets = [whose], [_buckets(words.mix(found.hash))]
    for gap, hashes in ((1, words.ngrams(found.hash, 2)), (2, spaced)):
        inside = whose[:-gap] == whose[gap:]
        texts.append(whose[:-gap][inside])
        buckets.append(_buckets(hashes[inside]))
    return np.concatenate(texts), np.concatenate(buckets)


def scores(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Chance of each text; ``weight`` ends with the bias."""
    text, bucket = occurrences(data, offsets)
    size = len(offsets) - 1
    total = np.bincount(text, weight[bucket], minlength=size)
    count = np.maximum(np.bincount(text, minlength=size), 1)
    return chance(total / np.sqrt(count) + weight[-1])


def counts(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, how often each occurs) of each text."""
    text, bucket = occurrences(data, offsets)
    key, times = np.unique(text * BUCKETS + bucket, return_counts=True)
    first = np.searchsorted(key, np.arange(len(offsets)) * BUCKETS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append((key[a:b] % BUCKETS, times[a:b]))
    return out


def values(times: np.ndarray) -> np.ndarray:
    """Counts over the square root of their sum."""
    return times / np.sqrt(max(int(times.sum()), 1))


def _narrow(times: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return times.astype(np.min_scalar_type(int(times.max(initial=0)))).tobytes()


def _wide(data: bytes | np.ndarray, n: int) -> np.ndarray:
    """``n`` counts as they were before ``_narrow``."""
    raw = np.frombuffer(data, np.uint8)
    return raw.view(f"u{max(len(raw) // max(n, 1), 1)}").astype(np.int64)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _drawn(share: float, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(_SHARES)) < int(min(share, 1.0) * _SHARES)


def draw(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` distinct (doc_id, text, label) of rows that are not held out.

    Ids are drawn before their texts are read; if they stand for more than
    ``max_rows`` rows still, rows are drawn by id and text.
    """
    known = labels.where("toxic is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label"))
    known = common.stored(known.where(~held_out()).distinct(), "toxicity-labels")
    # The draw bounds this table to about max_rows short rows.
    picked = F.broadcast(known.where(_drawn(max_rows / max(known.count(), 1), "doc_id")))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.select("doc_id").join(picked, "doc_id").count()
    return texts.join(picked, "doc_id").where(_drawn(max_rows / max(rows, 1), "doc_id", "text")).distinct()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.select(["shard", "draw", "label"])
        for row, data, offsets in words.text_groups(batch.column("text")):
            found = counts(data, offsets)
            buckets = pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary())
            times = pa.array([_narrow(t) for _, t in found], pa.binary())
            own = kept.slice(row, len(found))
            yield pa.RecordBatch.from_arrays([*own.columns, buckets, times], ["shard", "draw", "label", "buckets", "times"])


def _packed(table: pa.Table) -> pa.Table:
    """A shard's rows in the order of their draw as one row, so that later passes read it without a shuffle."""
    table = table.sort_by([("draw", "ascending"), ("label", "ascending")])
    sizes = np.array([len(b.as_buffer()) // 4 for b in table.column("buckets")], np.int64)
    times = [_wide(t.as_buffer(), n) for t, n in zip(table.column("times"), sizes.tolist(), strict=True)]
    joined = {"buckets": b"".join(table.column("buckets").to_pylist()), "times": _narrow(np.concatenate(times))}
    labels = table.column("label").to_numpy().astype(np.int8)
    shard = table.column("shard")[0].as_py()
    row = {"labels": labels.tobytes(), "sizes": sizes.tobytes(), **joined}
    return pa.table({"shard": pa.array([shard], pa.int32()), **{c: pa.array([v], pa.binary()) for c, v in row.items()}})


def training_shards(drawn: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = 29) -> DataFrame:
    """The features of all drawn rows, a stored row per shard; a shard has ``shard_rows`` rows and ``SHARD_BYTES`` of text on average at most."""
    dealt = common.stored(drawn.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text", "label")), "toxicity-drawn")
    rows, size = dealt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-rows // shard_rows), -(-size // SHARD_BYTES))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int"))
    features_of = dealt.select("shard", "draw", "label", "text").mapInArrow(_rows, ROW_SCHEMA)
    packed = features_of.groupBy("shard").applyInArrow(_packed, SHARD_SCHEMA)
    path = new_path(drawn.sparkSession, "toxicity-shards")
    # A file per shard keeps Spark from reading many of them into one batch.
    packed.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    return drawn.sparkSession.read.schema(SHARD_SCHEMA).parquet(path)


def _changes(batches: Iterator[pa.RecordBatch], state: State, rates: Rates) -> Iterator[pa.RecordBatch]:
    """What the passes of each shard change in the state."""
    for batch in batches:
        for i in range(len(batch)):
            read = lambda name, kind, i=i: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
            labels, sizes = read("labels", np.int8).tolist(), read("sizes", np.int64)
            times = _wide(read("times", np.uint8), int(sizes.sum())).astype(np.int32)
            buckets, times = (np.split(part, np.cumsum(sizes)[:-1]) for part in (read("buckets", np.int32), times))
            now, seen = state, np.zeros(len(state.z), bool)
            for _ in range(PASSES):
                now, once = learn(now, zip(labels, buckets, map(values, times), strict=True), rates)
                seen |= once
            changed = {"z": (now.z - state.z).astype(np.float32), "n": (now.n - state.n).astype(np.float32), "seen": np.packbits(seen)}
            yield pa.record_batch({c: pa.array([v.tobytes()], pa.binary()) for c, v in changed.items()})


def fit(shards: DataFrame, rates: Rates = RATES, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of all coordinates after ``rounds`` rounds over stored shards.

    The driver receives about eight bytes a coordinate from each shard; the bound on drawn rows bounds the shards.
    """
    state = empty_state()
    for _ in range(rounds):
        start = state
        changes = shards.mapInArrow(lambda batches: _changes(batches, start, rates), CHANGE_SCHEMA)
        z, n, seen = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1, np.int64)
        for row in changes.collect():
            z += np.frombuffer(row["z"], np.float32)
            n += np.frombuffer(row["n"], np.float32)
            seen += np.unpackbits(np.frombuffer(row["seen"], np.uint8), count=BUCKETS + 1)
        state = State(start.z + z / np.maximum(seen, 1), start.n + n / np.maximum(seen, 1))
    return weights(state.z, state.n, rates, np.arange(BUCKETS + 1) == BUCKETS)


def _score(batches: Iterator[pa.RecordBatch], at: np.ndarray, kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    weight = np.zeros(BUCKETS + 1)
    weight[at] = kept
    for batch in batches:
        own = batch.select(["doc_id", "held_out"])
        for row, data, offsets in words.text_groups(batch.column("text")):
            score = pa.array(scores(data, offsets, weight))
            yield pa.RecordBatch.from_arrays([*own.slice(row, len(score)).columns, score], ["doc_id", "held_out", "score"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``labels`` has (doc_id, toxic)."""
    shards = training_shards(draw(docs, labels, max_rows))
    weight = fit(shards) if not shards.isEmpty() else np.zeros(BUCKETS + 1)
    at = np.flatnonzero(weight)
    kept = weight[at]
    texts = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    scored = texts.mapInArrow(lambda batches: _score(batches, at, kept), SCORE_SCHEMA)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
