"""Operator 1: delete passages that a document shares with an earlier one, by aligned lines.

A line counts as the sequence of its words, whatever their case and spacing.  A line
that only one document holds leads nowhere.  Every other line pairs each later holder
with the first one, so a line in a third of all documents gives one pair for each of
them, never all pairs, and no line is too frequent to count.  Lines of fewer than
``min_words`` words may stand together in an earlier document that is the first holder of
none, so the shortest runs of lines with ``min_words`` words are paired in the same way,
at most two for each line.  A pair is aligned with patience
diff: lines that occur once on both sides, in their longest common order, are anchors;
the gaps between them are aligned the same way, and where no line is unique lines with a unique
neighbourhood are taken.  Aligned blocks of at least ``min_words``
words are deleted from the later document, and so are runs of as many words that stand in
the first one but were not aligned, as blocks in another order.  A pair takes time in proportion to its
lines, but for sorting, however often lines repeat.

Documents are ordered by id, nulls last.  Rows with equal id and text are one document
and are treated alike; rows with equal id and other text follow each other by a hash.
Null texts stay null and empty texts empty.  A document whose every line goes keeps an
empty text.  An empty table gives an empty result.  Other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import common, words

MIN_WORDS = 10
DEPTH = 32
LINES_SCHEMA = "id long, version long, lines array<long>, sizes array<int>, runs array<long>"
DELETED_SCHEMA = "id long, version long, deleted array<int>"
_LAST = (1 << 63) - 1
_BASE = 0xD1342543DE82EF95


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each line or 0 if blank, words of each line, first line of each text)."""
    starts = words.word_starts(data, offsets, words.SPACED[1])
    hashes = words.segment_hashes(data, starts, words.SPACED[0])
    ends = np.flatnonzero(data == 0x0A)
    texts = len(offsets) - 1
    first = np.searchsorted(ends, offsets) + np.arange(texts + 1)
    heads = np.sort(np.concatenate([offsets[:-1], ends + 1]), kind="stable")
    line_of = np.searchsorted(heads, starts, "right") - 1
    sizes = np.bincount(line_of, minlength=len(heads))
    place = np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = np.zeros(len(heads), np.uint64)
    if len(starts):
        weighed = words.mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        begins = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1]))
        total[line_of[begins]] = words.mix(np.add.reduceat(weighed, begins)) | np.uint64(1)
    return total.view(np.int64), sizes, first


def run_hashes(lines: np.ndarray, sizes: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of lines, first run of each text).

    The runs are the shortest ones of at least ``min_words`` words that begin or end at each
    line of fewer words.  Blank lines inside count, as in the alignment.  Every line of a
    block that two texts share lies in such a run of that block, or has ``min_words`` words.
    """
    n = len(lines)
    total = np.append(0, np.cumsum(sizes, dtype=np.int64))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    short = np.flatnonzero((lines != 0) & (sizes < min_words))
    end = np.searchsorted(total, total[short] + min_words, "left")
    begin = np.searchsorted(total, total[short + 1] - min_words, "right") - 1
    forward, backward = end <= first[text[short] + 1], begin >= first[text[short]]
    starts = np.concatenate([short[forward], begin[backward]])
    ends = np.concatenate([end[forward], short[backward] + 1])
    # A run is a polynomial in the hashes of its lines; powers of the inverse move it to the text's start.
    power = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)))
    prefix = np.append(np.uint64(0), np.cumsum(lines.view(np.uint64) * power[:n]))
    hashes = words.mix((prefix[ends] - prefix[starts]) * back[starts]) | np.uint64(1)
    found = np.unique(np.stack([text[starts].astype(np.uint64), hashes]), axis=1)
    return found[1].view(np.int64), np.searchsorted(found[0].astype(np.int64), np.arange(len(first)))


def _lines(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in words.text_groups(batch.column("text")):
            hashes, sizes, first = line_hashes(data, offsets)
            runs, first_run = run_hashes(hashes, sizes, first, min_words)
            at = pa.array(first.astype(np.int32))
            yield pa.record_batch(
                {
                    "id": batch.column("id").slice(row, len(offsets) - 1),
                    "version": batch.column("version").slice(row, len(offsets) - 1),
                    "lines": pa.ListArray.from_arrays(at, pa.array(hashes)),
                    "sizes": pa.ListArray.from_arrays(at, pa.array(sizes.astype(np.int32))),
                    "runs": pa.ListArray.from_arrays(pa.array(first_run.astype(np.int32)), pa.array(runs)),
                }
            )


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, of pairs ordered by their first part, whose second parts rise."""
    tails: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, b) in enumerate(pairs):
        pile = bisect_left(tails, b)
        back[n] = tops[pile - 1] if pile else -1
        tails[pile : pile + 1] = [b]
        tops[pile : pile + 1] = [n]
    chain, n = [], tops[-1] if tops else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def _paired(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Places in two ranges of values that occur once in each, and the first with the first, second with the second and so on of all others."""
    in_a, in_b = defaultdict(list), defaultdict(list)
    for places, values, start, end in ((in_a, a, a0, a1), (in_b, b, b0, b1)):
        for i in range(start, end):
            if values[i]:
                places[values[i]].append(i)
    once, several = [], []
    for x, own in in_a.items():
        if x in in_b:
            (once if len(own) == len(in_b[x]) == 1 else several).extend(zip(own, in_b[x], strict=False))
    return once, several


def _in_context(lines: list[int]) -> list[tuple[int, ...] | int]:
    """Each line with its two neighbours; blank lines stay 0."""
    return [x and (before, x, after) for before, x, after in zip([0, *lines], lines, [*lines[1:], 0], strict=False)]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of equal lines in common order; blank lines (0) are never held on to.

    Where no line is unique, lines whose neighbourhood is take their place.  Where that is
    not either, or after ``DEPTH`` gaps inside one another, equal lines are paired in their
    order and what lies between is left as it is, so the time is linear but for sorting.
    """
    found, open_ranges = [], [(0, len(a), 0, len(b), 0)]
    contexts = None
    while open_ranges:
        a0, a1, b0, b1, depth = open_ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1 or depth > DEPTH:
            continue
        once, several = _paired(a, b, a0, a1, b0, b1)
        if several and not once:
            contexts = contexts or (_in_context(a), _in_context(b))
            once, _ = _paired(*contexts, a0, a1, b0, b1)
        anchors = _longest_rising(sorted(once or several))
        below = depth + 1 if once and depth < DEPTH else DEPTH + 1
        for i, j in anchors:
            open_ranges.append((a0, i, b0, j, below))
            found.append((i, j))
            a0, b0 = i + 1, j + 1
        if anchors:
            open_ranges.append((a0, a1, b0, b1, below))
    return sorted(found)


def _runs(lines: list[int], size_of: dict[int, int], min_words: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the shortest runs of ``min_words`` words that begin or end at each line; lines without a size end them."""
    for step in (1, -1):
        for i, x in enumerate(lines):
            total, j = 0, i
            while x and 0 <= j < len(lines) and lines[j] in size_of:
                total += size_of[lines[j]]
                if total >= min_words:
                    yield (i, j + 1) if step == 1 else (j, i + 1)
                    break
                j += step


def _blocks(pairs: list[tuple[int, int]], sizes: list[int], min_words: int) -> set[int]:
    """Second places of the runs of pairs that follow each other on both sides and have ``min_words`` words."""
    gone: set[int] = set()
    block: list[int] = []
    before = None
    for pair in [*pairs, None]:
        if before is None or pair is None or (pair[0] - before[0], pair[1] - before[1]) != (1, 1):
            if sum(sizes[j] for j in block) >= min_words:
                gone.update(block)
            block = []
        if pair is not None:
            block.append(pair[1])
        before = pair
    return gone


def _neighbours(lines: list[int]) -> Iterator[tuple[int, int]]:
    """(begin, end) from each line to the next one across blank lines."""
    begin = None
    for i, x in enumerate(lines):
        if x:
            if begin is not None and i > begin + 1:
                yield begin, i + 1
            begin = i


def shared_lines(first: list[int], later: list[int], sizes: list[int], min_words: int) -> set[int]:
    """Places in ``later`` that lie in blocks of at least ``min_words`` words, aligned or at least in ``first`` as they stand."""
    gone = _blocks(aligned(first, later), sizes, min_words)
    # Blocks in another order, and blocks that repeated lines have led the alignment past.
    if {x for j, x in enumerate(later) if x and j not in gone}.intersection(first):
        size_of = dict(zip(later, sizes, strict=True))
        held = {tuple(first[a:b]) for a, b in _runs(first, size_of, min_words)}
        for a, b in _runs(later, size_of, min_words):
            if tuple(later[a:b]) in held:
                gone.update(range(a, b))
        apart = {tuple(first[a:b]) for a, b in _neighbours(first)}
        for a, b in _neighbours(later):
            if a in gone and b - 1 in gone and tuple(later[a:b]) in apart:
                gone.update(range(a, b))
    return gone


def _align(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, later, sizes = (batch.column(c) for c in ("first_lines", "lines", "sizes"))
        deleted = [sorted(shared_lines(first[i].as_py(), later[i].as_py(), sizes[i].as_py(), min_words)) for i in range(len(batch))]
        yield pa.record_batch(
            {"id": batch.column("id"), "version": batch.column("version"), "deleted": pa.array(deleted, pa.list_(pa.int32()))}
        )


def shared_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, version, deleted): numbers of the lines that go from each document that loses some."""
    hashed = docs.select("id", "version", "text").mapInArrow(lambda batches: _lines(batches, min_words), LINES_SCHEMA).distinct()
    lines = common.stored(hashed, "lines")
    holders = lines.select(F.struct("id", "version").alias("doc"), F.explode(F.array_union("lines", "runs")).alias("line")).where("line != 0")
    firsts = holders.groupBy("line").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = common.stored(firsts, "line-firsts")  # as a table of its own it lets Spark split a frequent line's rows
    pairs = holders.join(firsts, "line").where("doc > first").select("first.*", "doc").distinct()
    pairs = common.stored(pairs.select(F.col("id").alias("first_id"), F.col("version").alias("first_version"), "doc.*"), "line-pairs")
    firsts = lines.select(F.col("id").alias("first_id"), F.col("version").alias("first_version"), F.col("lines").alias("first_lines"))
    both = pairs.join(lines, ["id", "version"]).join(firsts, ["first_id", "first_version"])
    both = both.select("id", "version", "first_lines", "lines", "sizes")
    found = both.mapInArrow(lambda batches: _align(batches, min_words), DELETED_SCHEMA).where("size(deleted) > 0")
    merged = found.select("id", "version", F.explode("deleted").alias("line")).groupBy("id", "version")
    return merged.agg(F.sort_array(F.collect_set("line")).alias("deleted"))


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the shared blocks, plus ``lines_before`` and ``lines_deleted`` (input columns of these names are replaced)."""
    added = ["lines_before", "lines_deleted"]
    frame, back = common.packed(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added]), ("doc_id", "text"))
    keys = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "version": F.xxhash64("text")}
    named = frame.withColumn("text", F.col("text").cast("string")).withColumns(keys)
    deleted = common.stored(shared_blocks(named.select("id", "version", "text"), min_words), "line-deletions")
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda line, i: ~F.array_contains("deleted", i))
    joined = named.join(deleted.hint("merge"), ["id", "version"], "left")
    before = F.when(F.col("text").isNull(), 0).otherwise(F.size(split))
    rest = joined.select(
        "doc_id",
        "row",
        before.alias("before"),
        F.coalesce(F.size("deleted"), F.lit(0)).alias("gone"),
        F.when(F.col("deleted").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
    return rest.select(*back, F.col("before").alias("lines_before"), F.col("gone").alias("lines_deleted"))
