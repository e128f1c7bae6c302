"""A stored index over line windows, and retrieval that skips blocks of windows.

``BLOCK_WINDOWS`` neighbouring windows of a file are one row of the index: a sorted dictionary of their
terms with the windows that hold each, the vector counts by bucket, and per bucket
the largest weight that any window of the block has.  From dictionary and largest weights alone follows
the most that a window of the block can score for a question.  A question is first answered from its most
promising block; the k-th score found there leaves out every block that cannot reach it.

Each line is cut into tokens once, when the index is built.  Questions and windows never meet as rows:
a batch of questions meets a block, and at most ``k`` windows a question leave.
Scores, order and ties are those of ``retrieval.retrieve``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import question_tokens
from logspark.functions.vectors import bucket_counts, squared_norm
from logspark.operators.retrieval import window_shapes
from logspark.operators.scale import cut, new_path, unsized

BLOCK_WINDOWS = 256
QUESTIONS_A_BATCH = 256
DIM = fixed.VECTOR_DIM
BLOCK = ["file_id", "block"]
_SLACK = 1e-9  # covers the rounding of a bound; a wider one only looks at more blocks
_PLACE = "stride long, window long, total long, first_chunk long"
_TERMS = "terms array<string>, term_first array<int>, term_windows array<int>"
_VECTORS = "norm2 array<long>, bucket_first array<int>, bucket_windows array<int>, bucket_n array<long>, bucket_max array<double>"


# --- building ------------------------------------------------------------------------


def _bucket(token: str) -> int:
    return int.from_bytes(sha1(token.encode()).digest()[:4], "big") % DIM


def _pairs(line: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``line``, window) of every entry, once for each window of its line."""
    first, last = low[line], high[line]
    twice = np.flatnonzero(last > first)
    return np.concatenate([np.arange(len(line)), twice]), np.concatenate([first, last[twice]])


def _lists(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _starts(table: pa.Table) -> np.ndarray:
    """Where a block begins, in lines ordered by block."""
    if not len(table):
        return np.zeros(0, np.int64)
    other = np.ones(len(table), bool)
    columns = [table.column(c).combine_chunks() for c in BLOCK]
    other[1:] = np.any([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns], axis=0)
    return np.flatnonzero(other)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(line, number) of every term, the terms in order, and the buckets of all terms with their count per term.

    A run of letters never leaves the term around it, so a text's buckets are those of its terms.
    """
    term_re, vector_re = re.compile(fixed.RETRIEVAL_TOKEN), re.compile(fixed.VECTOR_TOKEN)
    found = [term_re.findall(x or "") for x in texts]
    line = np.repeat(np.arange(len(found)), [len(x) for x in found])
    coded = pa.array([t for x in found for t in x], pa.string()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    terms = coded.dictionary.take(pa.array(order))
    known: dict[str, int] = {}
    buckets = []
    for term in terms.to_pylist():
        own = vector_re.findall(term)
        for token in own:
            if token not in known:
                known[token] = _bucket(token)
        buckets.append([known[token] for token in own])
    flat = np.fromiter((x for own in buckets for x in own), np.int64)
    return line, rank[coded.indices.to_numpy()], terms, flat, np.array([len(x) for x in buckets], np.int64)


def _build(table: pa.Table) -> pa.RecordBatch:
    """The index rows of whole blocks from their lines, which are ordered by block."""
    starts = _starts(table)
    n_blocks, n_lines = len(starts), np.diff(np.append(starts, len(table)))
    of = np.repeat(np.arange(n_blocks), n_lines)
    stride, window, last_chunk, block, line_no = (table.column(c).to_numpy() for c in ("stride", "window", "last_chunk", "block", "line_no"))
    first_chunk = block * BLOCK_WINDOWS
    size = np.minimum(BLOCK_WINDOWS, last_chunk + 1 - first_chunk)
    at = line_no - 1
    low = np.maximum(np.maximum(-(-(at - window + 1) // stride), 0) - first_chunk, 0)
    high = np.minimum(np.minimum(at // stride, last_chunk) - first_chunk, size - 1)

    line, rank, order, flat, n_flat = _tokens(table.column("text").to_pylist())
    entry, where = _pairs(line, low, high)
    n_terms = max(len(order), 1)
    held = np.unique((of[line[entry]] * n_terms + rank[entry]) * BLOCK_WINDOWS + where)
    pair, first = np.unique(held // BLOCK_WINDOWS, return_index=True)
    held_by, terms_by = (np.bincount(x // n_terms, minlength=n_blocks) for x in (held // BLOCK_WINDOWS, pair))
    term_first = np.zeros(len(pair) + n_blocks, np.int64)
    term_first[np.arange(len(pair)) + pair // n_terms] = first - (np.cumsum(held_by) - held_by)[pair // n_terms]
    term_first[np.cumsum(terms_by) + np.arange(n_blocks)] = held_by

    begins, times = (np.cumsum(n_flat) - n_flat)[rank], n_flat[rank]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    counted, counted_line = flat[np.repeat(begins, times) + within], np.repeat(line, times)
    entry, where = _pairs(counted_line, low, high)
    key, n = np.unique((of[counted_line[entry]] * DIM + counted[entry]) * BLOCK_WINDOWS + where, return_counts=True)
    bucket, where = key // BLOCK_WINDOWS, key % BLOCK_WINDOWS
    windows_by = size[starts]
    at_window = (np.cumsum(windows_by) - windows_by)[bucket // DIM] + where
    norm2 = np.zeros(int(windows_by.sum()), np.int64)
    np.add.at(norm2, at_window, n * n)
    largest = np.zeros(n_blocks * DIM)
    np.maximum.at(largest, bucket, n / np.sqrt(np.maximum(norm2, 1))[at_window])
    entries_by = np.bincount(bucket // DIM, minlength=n_blocks)
    bucket_first = np.searchsorted(bucket, np.arange(n_blocks)[:, None] * DIM + np.arange(DIM + 1)) - (np.cumsum(entries_by) - entries_by)[:, None]

    own = pa.array(starts)
    columns = {c: table.column(c).combine_chunks().take(own) for c in ("file_id", "block", "stride", "window", "total")} | {
        "first_chunk": pa.array(first_chunk[starts]),
        "terms": _lists(order.take(pa.array(pair % n_terms)), terms_by),
        "term_first": _lists(term_first.astype(np.int32), terms_by + 1),
        "term_windows": _lists((held % BLOCK_WINDOWS).astype(np.int32), held_by),
        "norm2": _lists(norm2, windows_by),
        "bucket_first": _lists(bucket_first.ravel().astype(np.int32), np.full(n_blocks, DIM + 1)),
        "bucket_windows": _lists(where.astype(np.int32), entries_by),
        "bucket_n": _lists(n.astype(np.int64), entries_by),
        "bucket_max": _lists(largest, np.full(n_blocks, DIM)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _build_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of ordered lines, many blocks at once; the last block of a batch waits for the rest of its lines."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        starts = _starts(table)
        whole = int(starts[-1]) if len(starts) else 0
        if whole:
            yield _build(table.slice(0, whole))
        waiting = table.slice(whole)
    if waiting is not None and len(waiting):
        yield _build(waiting)


def index_blocks(lines: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """One row per file and block of windows, in their order.

    A block has a bounded number of lines, so a long file is many tasks' work.  The lines are ordered, not
    the index, so that no block is built for a sample of the order or as a group of its own.
    """
    shapes = window_shapes(lines, max_chunks)
    at = F.col("line_no") - 1
    low = F.greatest(F.lit(0), F.ceil((at - F.col("window") + 1) / F.col("stride")).cast("long"))
    high = F.least(F.col("last_chunk"), F.floor(at / F.col("stride")))
    # A line lies in at most two windows unless ``max_chunks`` widened them, so in at most two blocks.
    blocks = F.array_distinct(F.transform(F.array(low, high), lambda c: F.floor(c / BLOCK_WINDOWS)))
    placed = lines.join(unsized(shapes), "file_id").where(low <= high)
    placed = placed.select("file_id", "line_no", F.lower("raw").alias("text"), "stride", "window", "total", "last_chunk", F.explode(blocks).alias("block"))
    kind = dict(lines.dtypes)["file_id"]
    schema = f"file_id {kind}, block long, {_PLACE}, {_TERMS}, {_VECTORS}"
    return placed.repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(_build_all, schema)


def write_index(lines: DataFrame, path: str | None = None, max_chunks: int | None = None) -> str:
    """Store the index in order of file and block, so that a question's file is found by the files' minima and maxima."""
    path = path or new_path(lines.sparkSession, "window-index")
    index_blocks(lines, max_chunks).write.mode("overwrite").parquet(path)
    return path


# --- searching -----------------------------------------------------------------------


def _matching(terms: list[str], token: str) -> list[tuple[int, int]]:
    """Runs of the dictionary whose terms begin with the token or begin it; both have two letters at least."""
    a = bisect_left(terms, token)
    runs = [(a, bisect_left(terms, token + "\U0010ffff", a))]
    for n in range(2, len(token)):
        at = bisect_left(terms, token[:n])
        if at < len(terms) and terms[at] == token[:n]:
            runs.append((at, at + 1))
    return [run for run in runs if run[1] > run[0]]


def _array(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _bounds(batches: Iterator[pa.RecordBatch], min_score: float) -> Iterator[pa.RecordBatch]:
    """(question, file, block, bound) of every question that may find something in a block."""
    for batch in batches:
        out = {"question_id": [], "row": [], "bound": []}
        for i in range(len(batch)):
            terms, largest = batch.column("terms")[i].as_py(), _array(batch.column("bucket_max"), i)
            for q in batch.column("asked")[i].as_py():
                hits = sum(bool(_matching(terms, t)) for t in q["tokens"])
                bound = hits / len(q["tokens"]) if q["tokens"] else 0.0
                if q["norm2"]:
                    bound += fixed.COSINE_WEIGHT * min(1.0, float(largest[q["buckets"]] @ np.array(q["n"], float)) / q["norm2"] ** 0.5)
                if bound + _SLACK >= min_score:
                    for name, value in (("question_id", q["question_id"]), ("row", i), ("bound", bound + _SLACK)):
                        out[name].append(value)
        rows = pa.array(out["row"], pa.int64())
        columns = [pa.array(out["question_id"], batch.schema.field("asked").type.value_type.field("question_id").type)]
        columns += [batch.column(c).take(rows) for c in BLOCK] + [pa.array(out["bound"], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["question_id", *BLOCK, "bound"])


def _scores(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` windows of a block for every question, of scores no lower than the question's floor."""
    for batch in batches:
        out: dict[str, list] = {"question_id": [], "row": [], "chunk_no": [], "score": []}
        for i in range(len(batch)):
            terms, first = batch.column("terms")[i].as_py(), _array(batch.column("term_first"), i)
            held, norm2 = _array(batch.column("term_windows"), i), _array(batch.column("norm2"), i)
            b_first, b_windows, b_n = (_array(batch.column(c), i) for c in ("bucket_first", "bucket_windows", "bucket_n"))
            at = batch.column("first_chunk")[i].as_py()
            for q in batch.column("asked")[i].as_py():
                hits, dot = np.zeros(len(norm2), np.int64), np.zeros(len(norm2), np.int64)
                for token in q["tokens"]:
                    found = np.zeros(len(norm2), bool)
                    for a, b in _matching(terms, token):
                        found[held[first[a] : first[b]]] = True
                    hits += found
                for bucket, n in zip(q["buckets"], q["n"], strict=True):
                    a, b = b_first[bucket], b_first[bucket + 1]
                    dot[b_windows[a:b]] += n * b_n[a:b]
                score = hits / len(q["tokens"]) if q["tokens"] else np.zeros(len(norm2))
                length = np.sqrt((norm2 * q["norm2"]).astype(float))
                score = score + fixed.COSINE_WEIGHT * np.divide(dot, length, out=np.zeros(len(norm2)), where=length > 0)
                strong = np.flatnonzero(score >= q["floor"])
                best = strong[np.lexsort((strong, -score[strong]))[:k]]
                out["question_id"] += [q["question_id"]] * len(best)
                out["row"] += [i] * len(best)
                out["chunk_no"] += (best + at).tolist()
                out["score"] += score[best].tolist()
        rows = pa.array(out["row"], pa.int64())
        columns = [pa.array(out["question_id"], batch.schema.field("asked").type.value_type.field("question_id").type)]
        columns += [batch.column(c).take(rows) for c in ("file_id", "stride", "window", "total")]
        columns += [pa.array(out["chunk_no"], pa.int64()), pa.array(out["score"], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["question_id", "file_id", "stride", "window", "total", "chunk_no", "score"])


def _batched(asked: DataFrame, key: list[str]) -> DataFrame:
    """Questions of each key in batches of about ``QUESTIONS_A_BATCH``: (key, asked)."""
    sizes = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUESTIONS_A_BATCH).alias("batches"))
    dealt = asked.join(unsized(sizes), key).withColumn("batch", F.pmod(F.xxhash64("question_id"), F.col("batches")))
    one = F.struct("question_id", "tokens", "buckets", "n", "norm2", "floor")
    return dealt.groupBy(*key, "batch").agg(F.collect_list(one).alias("asked")).drop("batch")


def _questions(questions: DataFrame, min_score: float) -> DataFrame:
    counts = bucket_counts(F.col("question"))
    asked = questions.select("question_id", "file_id", question_tokens(F.col("question")).alias("tokens"), counts.alias("counts"))
    return asked.select(
        "question_id", "file_id", "tokens", F.col("counts.bucket").alias("buckets"), F.col("counts.n").alias("n"),
        squared_norm(F.col("counts")).alias("norm2"), F.lit(min_score).alias("floor"),
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("chunk_no"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    spark: SparkSession, path: str, questions: DataFrame, k: int = fixed.TOP_CHUNKS, min_score: float = fixed.MIN_RETRIEVAL_SCORE
) -> DataFrame:
    """The best ``k`` windows per question at or above the minimum, as ``retrieval.retrieve`` returns them.

    ``min_score`` must be above 0.
    """
    index = spark.read.parquet(path)
    asked = cut(_questions(questions, min_score), "index-questions")
    files = asked.select("file_id").distinct()
    long_files = index.where("block = 1").select("file_id").join(unsized(files), "file_id", "left_semi")
    kinds = dict(questions.dtypes)
    found_schema = f"question_id {kinds['question_id']}, file_id {kinds['file_id']}, stride long, window long, total long, chunk_no long, score double"

    def scored(pairs: DataFrame, name: str) -> DataFrame:
        met = index.join(unsized(_batched(pairs, BLOCK)), BLOCK)
        return cut(_best(met.mapInArrow(lambda batches: _scores(batches, k), found_schema), k), name)

    short = asked.join(unsized(long_files), "file_id", "left_anti").withColumn("block", F.lit(0).cast("long"))
    in_long = asked.join(unsized(long_files), "file_id", "left_semi")
    summaries = index.select(*BLOCK, "terms", "bucket_max").join(unsized(_batched(in_long, ["file_id"])), "file_id")
    bound_schema = f"question_id {kinds['question_id']}, file_id {kinds['file_id']}, block long, bound double"
    bounds = cut(summaries.mapInArrow(lambda batches: _bounds(batches, min_score), bound_schema), "index-bounds")
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("bound"), "block"))
    promising = bounds.withColumn("turn", turn).where("turn = 1").select("question_id", "block")
    first = scored(short.unionByName(in_long.join(unsized(promising), "question_id")), "index-first")
    weakest = first.where(F.col("rank") == k).select("question_id", F.col("score").alias("weakest"))
    rest = bounds.join(unsized(promising.withColumnRenamed("block", "done")), "question_id").where("block != done")
    rest = rest.join(unsized(weakest), "question_id", "left").where(F.col("bound") >= F.coalesce("weakest", F.lit(min_score)))
    again = in_long.drop("floor").join(unsized(rest.select("question_id", "block", F.coalesce("weakest", F.lit(min_score)).alias("floor"))), "question_id")
    found = first.drop("rank").unionByName(scored(again, "index-rest").drop("rank"))
    start: Column = F.col("chunk_no") * F.col("stride")
    return _best(found, k).select(
        "question_id", "file_id", "chunk_no", "rank", "score", (start + 1).alias("start_line"), F.least(start + F.col("window"), F.col("total")).alias("end_line")
    )
