"""The training-data pipeline over ``documents``: one operator per stage, each on all that the stage before kept.

Rows are documents until the last stage, which returns packed pieces of token ids.
An empty table passes through every stage; null and empty texts are dropped where they
hold nothing to train on (by the mix, which takes no words of them).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import common, line_dedup, minhash, mixing, packing, quality

QUALITY = 0.3
SEQUENCE_TOKENS = 4096
WEIGHTS = (5, 2, 1)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below ``QUALITY``."""
    _, model = quality.fit_on(docs, common.read_table(spark, sf_dir, "labels"))
    frame, back = common.packed(docs, ("text",))
    return quality.with_score(frame, model).where(F.col("quality_score") >= QUALITY).select(back)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete passages that an earlier document holds; a document of which no word is left goes."""
    frame, back = common.packed(docs, ("doc_id", "text", "n_chars"))
    found = line_dedup.deduplicate_lines(frame)
    emptied = (F.col("lines_deleted") > 0) & ~F.col("text").rlike(mixing.WORD)
    return found.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(back)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    frame, back = common.packed(docs, ("doc_id",))
    return frame.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents as often as its target asks, shuffled in shards; a document taken twice is two rows."""
    row, back = common.packed_row(docs)
    frame = docs.select("doc_id", "source", mixing.word_count("text").alias("size"), row)
    return mixing.taken_rows(mixing.mix(frame, WEIGHTS, whole=True)).select(back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, sequence and place there."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = common.stored(packing.cut_documents(docs, tokenizer, end_id=1, capacity=SEQUENCE_TOKENS), "pieces")
    places = packing.pack(pieces.select("row", "piece", "length"), SEQUENCE_TOKENS).drop("length")
    return pieces.join(places, ["row", "piece"]).select("doc_id", "piece", "start", "length", "sequence_id", "offset", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", minhash_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Scores, alignment, tokens and the hashed draw have no SQL form; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``, each stored before the next."""
    docs = common.read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
