"""Pages and histories: the reads a user interface makes, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark import fixed


def page_per_key(
    rows: DataFrame, key: str, order: list[Column], limit: int, offset: int = 0
) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of every key, with the key's total.

    The rank filter bounds what each task sends per key; totals are a separate
    partial count, because a window count would move every row.
    """
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = rows.withColumn("position", position).filter(F.col("position") <= offset + limit)
    page = ranked.filter(F.col("position") > offset)
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    return page.join(totals, key)


def run_history_page(runs: DataFrame, files: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest runs of every tenant with the file name; the page is cut before the join."""
    order = [F.desc("created_at"), F.asc("file_id")]
    page = page_per_key(runs, "user_id", order, limit, offset)
    return page.join(files.select("file_id", "filename"), "file_id")


def top_groups_page(
    groups: DataFrame, insights: DataFrame, limit: int = 20, offset: int = 0
) -> DataFrame:
    """Most frequent groups of every run with their insight, if any."""
    order = [F.desc("count"), F.asc("fingerprint")]
    page = page_per_key(groups, "file_id", order, limit, offset)
    return page.join(insights.select("group_id", "payload"), "group_id", "left")


def completed_runs(runs: DataFrame) -> DataFrame:
    """Reports and investigations are only for completed runs."""
    return runs.filter(F.col("status") == "completed")


def of_tenant(rows: DataFrame, user_id) -> DataFrame:
    """Rows of one tenant; the filter reaches the scan and prunes tenant folders."""
    return rows.filter(F.col("user_id") == F.lit(user_id))


def last_turns(messages: DataFrame, n: int = fixed.HISTORY_TURNS) -> DataFrame:
    """The last ``n`` messages of every conversation, with their place in reading order."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = messages.withColumn("_back", newest).filter(F.col("_back") <= n)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return kept.withColumn("position", place).drop("_back")


def conversation_history(messages: DataFrame) -> DataFrame:
    """All messages in conversation and turn order."""
    return messages.orderBy("conv_id", "turn")


def checked_questions(questions: DataFrame) -> DataFrame:
    """Add ``reason`` to questions outside the accepted length; nothing is dropped."""
    length = F.length("question")
    reason = F.when(F.coalesce(length, F.lit(0)) == 0, F.lit("empty question")).when(
        length > fixed.QUESTION_CHARS, F.lit("question too long")
    )
    return questions.withColumn("reason", reason)
