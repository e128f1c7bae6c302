"""Line sources: log files, pasted texts, and line tables.

A line table has ``file_id, line_no, raw``: every physical line, blanks
included, numbered from 1, so that citations stay right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import is_blank
from logspark.operators.scale import _positions_to_numbers

NEWLINE = r"\r\n|\r|\n"


def text_lines(text: Column) -> Column:
    """Array of the lines of a text; a final newline does not start another line."""
    body = F.regexp_replace(F.make_valid_utf8(text), rf"(?:{NEWLINE})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, NEWLINE))


def lines_of_texts(texts: DataFrame, text: str = "content", key: str = "file_id") -> DataFrame:
    """Explode a table of texts into a line table; other columns are dropped."""
    exploded = texts.select(F.col(key), F.posexplode(text_lines(F.col(text))).alias("_pos", "raw"))
    return exploded.select(key, (F.col("_pos") + 1).cast("long").alias("line_no"), "raw")


def read_small_files(spark: SparkSession, path: str) -> DataFrame:
    """Files up to the upload limit, one row per file, exploded without a shuffle."""
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("content")
    )
    return lines_of_texts(whole)


def read_large_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of any size, read in splits and numbered by a prefix sum over splits.

    Within a split, rows keep file order, so the ascending row id gives the
    position; counts per split give the offset.  No file passes through one task.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.make_valid_utf8("value").alias("raw"),
        F.monotonically_increasing_id().alias("_position"),
    )
    numbered = _positions_to_numbers(rows, ["file_id"], "_block", "_position", "line_no")
    return numbered.select("file_id", "line_no", "raw")


def head_sample(lines: DataFrame, head_lines: int | None = None) -> DataFrame:
    """The non-blank lines of every file, or of its first ``head_lines`` physical lines."""
    whole = counted_lines(lines)
    return whole if head_lines is None else whole.filter(F.col("line_no") <= head_lines)


def counted_lines(lines: DataFrame) -> DataFrame:
    """Blank lines are neither counted nor parsed."""
    return lines.filter(~is_blank(F.col("raw")))
