"""Registered queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import (
    ann_forest,
    common,
    embedding_dedup,
    hilbert,
    importance,
    lexical,
    license_scan,
    license_texts,
    line_dedup,
    minhash,
    mixing,
    packing,
    quality,
    records,
    toxicity,
)
from logspark.llm.oracle import ORACLES  # noqa: F401
from logspark.operators.scale import new_path

SEQUENCE_TOKENS = 4096


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate_lines(docs)


def op2_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector among all others."""
    rows = common.read_table(spark, sf_dir, "embeddings")
    return ann_forest.search(rows, F.col("vec_id") % 50 == 0, k=5)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of at least 0.95."""
    return embedding_dedup.near_duplicates(common.read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learnt from the labels that are not held out."""
    return quality.quality_scores(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text as token records, read the files back through the index."""
    folder = new_path(spark, "records")
    docs = common.read_table(spark, sf_dir, "documents")
    index = records.write_records(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return records.read_records(index, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight equal runs of a Hilbert curve over source, language, length and id."""
    docs = common.read_table(spark, sf_dir, "documents")
    placed = hilbert.shard_rows(docs, ["source", "lang", "n_chars", "doc_id"], shards=8)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard_number").alias("shard"),
        F.col("shard_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every text into sequences of at most 4096 tokens."""
    docs = common.read_table(spark, sf_dir, "documents")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = common.stored(packing.cut_documents(docs, tokenizer, end_id=1, capacity=SEQUENCE_TOKENS), "pieces")
    digest = pieces.select("row", "piece", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"))
    packed = packing.pack(digest, SEQUENCE_TOKENS)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.withColumn("length", F.col("length").cast("long")).select(columns)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every text."""
    return license_scan.scan(common.read_table(spark, sf_dir, "documents"), license_texts.TEMPLATES)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all texts at a Jaccard similarity of at least 0.85."""
    return minhash.near_duplicates(common.read_table(spark, sf_dir, "documents"), percent=85)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents with the weights 5, 2 and 1 over their sources."""
    docs = common.read_table(spark, sf_dir, "documents")
    sized = common.stored(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "mix-sizes")
    mixed = mixing.mix(sized, pattern=(5, 2, 1), most=3)
    taken = F.aggregate("mix_taken", F.lit(0).cast("long"), lambda words, one: words + one["words"])
    drawn = [F.col(f"mix_taken.{c}").alias(f"{c}s") for c in ("shard", "block", "place")]
    return mixed.select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"), *drawn
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    docs = common.read_table(spark, sf_dir, "documents")
    return lexical.top_documents(docs, common.read_table(spark, sf_dir, "benchmark"), k=10)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn so that their words are spread as the benchmark's."""
    docs = common.read_table(spark, sf_dir, "documents")
    return importance.resample(docs, common.read_table(spark, sf_dir, "benchmark"), percent=10)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from the labels that are not held out."""
    return toxicity.toxicity_scores(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ann_forest": op2_ann_forest,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality": op4_quality,
    "op5_token_records": op5_token_records,
    "op6_hilbert": op6_hilbert,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_minhash": op9_minhash,
    "op10_mixing": op10_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_importance": op12_importance,
    "op13_toxicity": op13_toxicity,
}
