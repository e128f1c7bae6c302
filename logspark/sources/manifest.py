"""File manifest: size, hash, limits, and identical uploads."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import is_blank
from logspark.operators.scale import cut, join_to_many


def _suffix(filename: Column) -> Column:
    """File extension as the storage suffix, bounded, with a default."""
    name = F.regexp_extract(filename, r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.coalesce(
        F.nullif(F.substring(suffix, 1, fixed.SUFFIX_CHARS), F.lit("")), F.lit(fixed.DEFAULT_SUFFIX)
    )


def manifest_of_texts(texts: DataFrame) -> DataFrame:
    """Manifest rows of pasted texts; ``reason`` is null for accepted ones."""
    size = F.octet_length("content")
    reason = F.when(size > fixed.MAX_PASTE_BYTES, F.lit("too large")).when(
        is_blank(F.col("content")), F.lit("empty")
    )
    return texts.select(
        "file_id",
        "user_id",
        F.substring("filename", 1, fixed.FILENAME_CHARS).alias("filename"),
        _suffix(F.col("filename")).alias("suffix"),
        size.cast("long").alias("size_bytes"),
        F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"),
        F.lit("paste").alias("source"),
        reason.alias("reason"),
    )


def manifest_of_files(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """Manifest rows of uploaded files; content is read only within the size limit.

    The size comes from the file listing, so an oversized file is rejected
    without reading it, and the hash of the others needs the bytes once.  Spark's
    readers pass over empty files, but its listing has them: a listed file
    that is not read is an empty upload.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    within = F.col("length") <= fixed.MAX_UPLOAD_BYTES
    accepted = files.filter(within).withColumn("content_hash", F.sha2("content", 256)).drop("content")
    oversized = files.filter(~within).drop("content").withColumn("content_hash", F.lit(None).cast("string"))
    read = cut(accepted.unionByName(oversized), "manifest")  # the files are opened once, for the rows and to find empty ones
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    reason = F.when(~within, F.lit("too large")).when(F.col("length") == 0, F.lit("empty"))
    rows = read.unionByName(_empty_files(spark, files, read))
    return rows.select(
        F.col("path").alias("file_id"),
        F.lit(user_id).alias("user_id"),
        F.substring(name, 1, fixed.FILENAME_CHARS).alias("filename"),
        _suffix(name).alias("suffix"),
        F.col("length").alias("size_bytes"),
        "content_hash",
        F.lit("upload").alias("source"),
        reason.alias("reason"),
    )


def _empty_files(spark: SparkSession, files: DataFrame, read: DataFrame) -> DataFrame:
    """Rows of the listed files that the reader of ``files`` has passed over: those not in ``read``."""
    # The listing writes local paths with three slashes and escapes, the reader with one and none.
    names = [(re.sub("^file:/+", "file:/", unquote(name)),) for name in files.inputFiles()]
    listed = spark.createDataFrame(names, "path string")
    empty = listed.join(read.select("path"), "path", "left_anti")
    return empty.select(
        "path",
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.lit(0).cast("long").alias("length"),
        F.sha2(F.lit("").cast("binary"), 256).alias("content_hash"),
    )


def split_manifest(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined files."""
    return manifest.filter(F.col("reason").isNull()), manifest.filter(F.col("reason").isNotNull())


def flag_duplicates(manifest: DataFrame, order: str = "file_id") -> DataFrame:
    """Flag uploads whose content the tenant has uploaded before; none is dropped.

    Copies are counted with partial sums; only contents with more than one copy
    are joined back, salted, so a content that makes up a large share of all
    files is not brought together in one task.
    """
    key = ["user_id", "content_hash"]
    copies = (
        manifest.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first_file"))
        .filter(F.col("copies") > 1)
    )
    joined = join_to_many(manifest, copies, key, order, "copies")
    return joined.select(
        *manifest.columns,
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("first_file", order).alias("first_file"),
        (F.coalesce(F.col("first_file") != F.col(order), F.lit(False))).alias("is_duplicate"),
    )
