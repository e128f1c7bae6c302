"""Operator 8: licence notices and phrases in whole texts by diagonal voting.

Templates are cut into runs of ``GRAM`` words (shorter ones are one run).  Every run of
those lengths in every text is hashed, and Spark joins the hashes to the template
positions.  A hit votes for a diagonal, its place in the text less its place in the
template.  Votes are counted per diagonal, diagonals at most ``SHIFT`` apart are merged,
so that a notice with a few words added or left out stays one span, and a span is verified if it
covers at least ``COVER`` of the template's words in not much more room.
A phrase is a template that must stand in one piece: each of its hits is a place.

The template table holds a row per template word and is the only thing broadcast.
Null and empty texts have no words and no labels.  Rows with equal or null ids are
separate documents.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm import common, words

GRAM = 3
SHIFT = 2
COVER = 0.8
ROOM = 1.5
HIT_SCHEMA = "row long, at long, gram long"
TEMPLATE_SCHEMA = "gram long, template int, place int, label string, phrase boolean, length int, span int"
ID_GRAM, SIZE_GRAM = 0, 1


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; two values are kept free for the marks of a text."""
    return words.mix(words.ngrams(hashes, n) + np.uint64(n)) | np.uint64(2)


def template_rows(templates: list[Template]) -> list[tuple]:
    rows = [(ID_GRAM, -1, 0, "", False, 0, 0), (SIZE_GRAM, -2, 0, "", False, 0, 0)]
    for number, template in enumerate(templates):
        raw = np.frombuffer(template.text.encode(), np.uint8)
        found = words.words_of(raw, np.array([0, len(raw)]), words.ALNUM).hash
        if not len(found):
            raise ValueError(f"template {template.label!r} has no words")
        n = len(found) if template.phrase else min(GRAM, len(found))
        grams = gram_hashes(found, n).view(np.int64).tolist()
        rows += [(g, number, i, template.label, template.phrase, len(found), n) for i, g in enumerate(grams)]
    return rows


def _grams(batches: Iterator[pa.RecordBatch], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row_ids = batch.column("row").to_numpy()
        doc_ids = batch.column("doc_id")
        for row, data, offsets in words.text_groups(batch.column("text")):
            n = len(offsets) - 1
            found = words.words_of(data, offsets, words.ALNUM)
            own = row_ids[row : row + n]
            size = np.diff(found.first)
            yield _batch(own, doc_ids.slice(row, n), np.full(n, ID_GRAM, np.int64))
            yield _batch(own, pa.array(size), np.full(n, SIZE_GRAM, np.int64))
            whose = np.repeat(np.arange(n), size)
            place = np.arange(len(whose)) - found.first[whose]
            for length in lengths:
                grams = gram_hashes(found.hash, length)
                inside = place[: len(grams)] + length <= size[whose[: len(grams)]]
                yield _batch(own[whose[: len(grams)][inside]], pa.array(place[: len(grams)][inside]), grams[inside].view(np.int64))


def _batch(rows: np.ndarray, at: pa.Array, grams: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"row": pa.array(rows), "at": at, "gram": pa.array(grams)})


def hits(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """All matches of text runs with template runs, and two marks per text (its id and its number of words)."""
    table = template_rows(templates)
    lengths = sorted({span for *_, span in table if span})
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    grams = named.mapInArrow(lambda batches: _grams(batches, lengths), HIT_SCHEMA)
    known = _template_frame(docs.sparkSession, table)
    return grams.join(F.broadcast(known), "gram").drop("gram")


def _template_frame(spark: SparkSession, table: list[tuple]) -> DataFrame:
    return spark.createDataFrame(table, TEMPLATE_SCHEMA)


def spans(found: DataFrame) -> DataFrame:
    """(row, label, first_word, last_word, cover): merged diagonals of templates that are no phrases."""
    votes = found.where("template >= 0 and not phrase").withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("row", "template", "label", "length", "span", "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    by_template = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_template) > SHIFT
    merged = lines.withColumn("span_no", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(by_template))
    whole = merged.groupBy("row", "template", "label", "length", "span", "span_no").agg(
        F.flatten(F.collect_list("places")).alias("places"), F.min("first").alias("first_word"), F.max("last").alias("last_word")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("span") - 1)))))
    last = F.col("last_word") + F.col("span") - 1
    return whole.select("row", "label", "length", "first_word", last.alias("last_word"), (covered / F.col("length")).alias("cover"))


def verified(merged: DataFrame) -> DataFrame:
    room = F.col("last_word") - F.col("first_word") + 1
    return merged.where((F.col("cover") >= COVER) & (room <= F.col("length") * ROOM))


def scan(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """One row per text: its words, places and labels of phrases, all labels, and a score.

    The score is 1 with a phrase, else the largest share of a template that one span covers.
    """
    found = common.stored(hits(docs, templates), "license-hits")
    marks = found.where("template < 0").groupBy("row")
    texts = marks.agg(F.max(F.expr("if(template = -1, at, null)")).alias("doc_id"), F.max(F.expr("if(template = -2, at, null)")).alias("n_words"))
    phrases = found.where("phrase").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"),
        F.min("at").alias("first_word"),
        F.max("at").alias("last_word"),
        F.collect_set("label").alias("base"),
    )
    merged = common.stored(spans(found), "license-spans")
    notices = verified(merged).groupBy("row").agg(F.collect_set("label").alias("own"))
    covers = merged.groupBy("row").agg(F.least(F.max("cover"), F.lit(1.0)).alias("cover"))
    none = F.array().cast("array<string>")
    every = texts.join(phrases, "row", "left").join(notices, "row", "left").join(covers, "row", "left")
    base, own = F.coalesce("base", none), F.coalesce("own", none)
    return every.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
