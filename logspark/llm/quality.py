"""Operator 4: a quality score for every text from random Fourier features.

Each whole text gives a short vector of statistics: shares of kinds of characters,
lengths and variety of words, repeated lines and word runs.  Random cosines of the
scaled vector approximate a Gaussian kernel.  A ridge score on them needs only the sums
of products over the labelled rows, which tasks add up per fold, so that the same sums
give the final weights and, leaving one fold out at a time, unbiased scores of the
labelled rows.  Isotonic regression of the labels on those scores turns scores into
chances between 0 and 1.

At most about ``max_rows`` labelled rows are used, drawn by a hash of their id; all
texts are scored.  Null and empty texts have the statistics of a text without characters and
are scored like others.  Rows with a null id count as held out.  Without any labelled row
every score is 0.5.  Repeated labels of an id each count.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logspark.llm import common, words
from logspark.llm.line_dedup import line_hashes

FOURIER = 256
FOLDS = 4
RIDGE = 1.0
MAX_ROWS = 200_000
PARTS = 16
STATISTICS_SCHEMA = "doc_id long, statistics array<float>"
SUMS_SCHEMA = "fold int, sums binary"
_MARKS = ".,;:!?|*$%&#@<>(){}[]=+-_/\\'\"~^"


def _kinds() -> tuple[np.ndarray, int]:
    """A class for each byte: letters by case, digits, blanks, line ends, each mark, the rest."""
    kind = np.zeros(256, np.int64)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A] = 1, 2, 3
    kind[0x20], kind[0x0A], kind[0x80:] = 4, 5, 6
    for n, mark in enumerate(_MARKS, 7):
        kind[ord(mark)] = n
    return kind, 7 + len(_MARKS)


KIND, KINDS = _kinds()


def _kind_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    counts = np.zeros(texts * KINDS, np.int64)
    for a in range(0, len(data), words.SLICE):
        piece = data[a : a + words.SLICE]
        t0, t1 = np.searchsorted(offsets, [a, a + len(piece) - 1], "right") - 1
        sizes = np.diff(np.clip(offsets[t0 : t1 + 2], a, a + len(piece)))
        key = np.repeat(np.arange(len(sizes)) * KINDS, sizes) + KIND[piece]
        counts[t0 * KINDS : (t1 + 1) * KINDS] += np.bincount(key, minlength=len(sizes) * KINDS)
    return counts.reshape(texts, KINDS)


def _repeats(values: np.ndarray, first: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's values ``first[i]:first[i+1] - less``: the share seen before in it, and of the commonest value."""
    again, most = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), (first[1:] - less).tolist(), strict=True)):
        if b > a:
            own = np.sort(values[a:b])
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            again[i] = 1 - (len(edges) - 1) / (b - a)
            most[i] = np.diff(edges).max() / (b - a)
    return again, most


def _echoes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of words equal to the word before, per text."""
    same = np.append(False, values[1:] == values[:-1]).astype(float)
    same[first[:-1][first[:-1] < len(values)]] = 0
    total = np.append(0, np.cumsum(same))
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text."""
    size = np.diff(offsets)
    counts = _kind_counts(data, offsets)
    found = words.words_of(data, offsets, words.SPACED)
    n_words = np.diff(found.first)
    runs = words.ngrams(found.hash, 3)
    lines, line_words, line_first = line_hashes(data, offsets)
    again_word, most_word = _repeats(found.hash, found.first)
    again_run, most_run = _repeats(runs, found.first, less=2)
    again_line, _ = _repeats(lines, line_first)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 6], 1)
    solid = size - counts[:, 4] - counts[:, 5]
    blank_lines = np.add.reduceat((line_words == 0).astype(float), line_first[:-1]) if len(size) else size
    n_lines = np.diff(line_first)
    per_word = np.maximum(n_words, 1)
    return np.column_stack(
        [
            np.sqrt(counts[:, 1:] / np.maximum(size, 1)[:, None]),
            counts[:, 1] / letters,
            np.log1p(size),
            np.log1p(n_words),
            np.minimum(solid / per_word, 40),
            np.log1p(n_words / np.maximum(n_lines, 1)),
            again_word,
            np.sqrt(_echoes(found.hash, found.first)),
            np.sqrt(most_word),
            again_run,
            np.sqrt(most_run),
            again_line,
            blank_lines / np.maximum(n_lines, 1),
            np.sqrt(counts[:, 7:].sum(1) / per_word),
        ]
    ).astype(np.float32)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in words.text_groups(batch.column("text")):
            table = statistics(data, offsets)
            at = pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1])
            held = pa.ListArray.from_arrays(at, pa.array(table.ravel()))
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(row, len(table)), "statistics": held})


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every text."""
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(_statistics, STATISTICS_SCHEMA)


class Model(NamedTuple):
    """What scoring needs; ``folds`` holds the weights that leave one fold out."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    folds: np.ndarray
    at: np.ndarray
    chance: np.ndarray

    def features(self, table: np.ndarray) -> np.ndarray:
        scaled = np.clip((table - self.mean) / self.scale, -8, 8)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / self.directions.shape[1])
        return np.hstack([np.ones((len(table), 1)), scaled, waves])

    def score(self, table: np.ndarray) -> np.ndarray:
        return np.interp(self.features(table) @ self.weights, self.at, self.chance)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if not len(batch):
            continue
        x = model.features(_matrix(batch.column("statistics")))
        rows = np.hstack([x, batch.column("label").to_numpy(zero_copy_only=False)[:, None].astype(float)])
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        for f in np.unique(fold):
            own = rows[fold == f]
            total[int(f)] = total.get(int(f), 0) + own.T @ own
    for f, matrix in total.items():
        yield pa.record_batch({"fold": pa.array([f], pa.int32()), "sums": pa.array([matrix.tobytes()], pa.binary())})


def _left_out(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            x = model.features(_matrix(batch.column("statistics")))
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.einsum("ij,ij->i", x, model.folds[fold])
            yield pa.record_batch({"raw": pa.array(raw), "label": batch.column("label")})


def _solve(sums: np.ndarray) -> np.ndarray:
    gram = sums[:-1, :-1] + RIDGE * np.eye(len(sums) - 1)
    gram[0, 0] -= RIDGE
    return np.linalg.lstsq(gram, sums[:-1, -1], rcond=None)[0]


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit of the labels: mean raw score and mean label of each pooled block."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(raw[order].tolist(), label[order].tolist(), strict=True):
        blocks.append([x, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x1, y1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x1, blocks[-1][1] + y1, blocks[-1][2] + n1]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, seed: int = 11) -> Model | None:
    """Fit on rows (doc_id, statistics, label 0 or 1); None if there are none.

    The driver receives scaling sums, ``FOLDS`` matrices and at most about
    ``max_rows`` pairs of score and label, whatever the size of the corpus.
    """
    total = labelled.count()
    if not total:
        return None
    share = min(1.0, max_rows / total)
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = picked.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(FOLDS)).cast("int"))
    picked = common.stored(picked.repartition(PARTS, "doc_id"), "quality-rows")
    columns = picked.select(F.posexplode("statistics").alias("at", "value")).groupBy("at")
    scale = {r["at"]: r for r in columns.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).collect()}
    if not scale:
        return None
    mean = np.array([scale[i]["mean"] for i in range(len(scale))])
    sd = np.array([max(scale[i]["sd"], 1e-3) for i in range(len(scale))])
    source = np.random.default_rng(seed)
    directions = source.normal(size=(len(mean), FOURIER)) / np.sqrt(len(mean))
    phases = source.uniform(0, 2 * np.pi, FOURIER)
    none = np.zeros(0)
    model = Model(mean, sd, directions, phases, none, none, none, none)
    summed = picked.mapInArrow(lambda batches: _sums(batches, model), SUMS_SCHEMA)
    width = 2 + len(mean) + FOURIER
    sums = np.zeros((FOLDS, width, width))
    for row in summed.toLocalIterator():
        sums[row["fold"]] += np.frombuffer(row["sums"]).reshape(width, width)
    whole = sums.sum(0)
    model = model._replace(weights=_solve(whole), folds=np.stack([_solve(whole - s) for s in sums]))
    left_out = picked.mapInArrow(lambda batches: _left_out(batches, model), "raw double, label int").toPandas()
    at, chance = isotonic(left_out["raw"].to_numpy(), left_out["label"].to_numpy(float))
    return model._replace(at=at, chance=chance)


def _score(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            table = _matrix(batch.column("statistics"))
            score = model.score(table) if model else np.full(len(table), 0.5)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score)})


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _append_score(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for _, data, offsets in words.text_groups(batch.column("text")):
            table = statistics(data, offsets)
            scores.append(model.score(table) if model else np.full(len(table), 0.5))
        if scores:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, "quality_score"])


def with_score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``quality_score`` added to each row; nothing is joined or shuffled."""
    schema = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])
    return docs.mapInArrow(lambda batches: _append_score(batches, model), schema)


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, Model | None]:
    """(stored statistics of every text, model); rows that are held out are never learnt from."""
    table = common.stored(text_statistics(docs).withColumn("held_out", held_out()), "statistics")
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    labelled = table.where(~F.col("held_out")).join(known, "doc_id").select("doc_id", "statistics", "label")
    return table, fit(labelled, max_rows)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    ``labels`` has (doc_id, quality).
    """
    table, model = fit_on(docs, labels, max_rows)
    scored = table.mapInArrow(lambda batches: _score(batches, model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
