"""Line windows over files and retrieval of the windows that answer a question.

The index is built from lines, never from window texts: a window's terms are
the union of its lines' terms and its vector is the sum of theirs.  Texts are
put together only for the few windows that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import is_blank, question_tokens, retrieval_tokens, scrub
from logspark.functions.vectors import bucket_counts, cosine, squared_norm
from logspark.operators.scale import cut, join_to_many, unsized

CHUNK = ["file_id", "chunk_no"]


# --- windows -----------------------------------------------------------------------


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def window_shapes(lines: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """``file_id, total, stride, window, last_chunk``.

    Windows have one width whatever the length of the file.  Only a caller that names
    ``max_chunks`` gets wider ones, and with them fewer, in files beyond it.
    """
    step = fixed.WINDOW_LINES - fixed.OVERLAP_LINES
    total = F.col("total")
    naive = F.greatest(F.lit(1), F.floor((total - fixed.OVERLAP_LINES) / step))
    wide = F.lit(False) if max_chunks is None else naive > max_chunks
    wider = F.lit(step) if max_chunks is None else F.greatest(F.lit(step), F.floor(total / max_chunks)).cast("long")
    shaped = (
        lines.groupBy("file_id")
        .agg(F.max("line_no").alias("total"))
        .withColumn("stride", F.when(wide, wider).otherwise(F.lit(step)).cast("long"))
        .withColumn(
            "window",
            F.when(wide, F.col("stride") + fixed.OVERLAP_LINES)
            .otherwise(F.lit(fixed.WINDOW_LINES))
            .cast("long"),
        )
    )
    last = F.greatest(F.lit(0), _ceil_div(total - F.col("window"), F.col("stride")))
    return shaped.withColumn("last_chunk", last)


def windowed_lines(lines: DataFrame, shapes: DataFrame, line_chars: int | None = None) -> DataFrame:
    """Non-blank lines, whole unless ``line_chars`` cuts them, once per window they belong to.

    A line belongs to at most two windows, found by arithmetic on its number.
    Lines of files that ``shapes`` does not list are left out.
    """
    joined = join_to_many(lines, shapes, ["file_id"], "line_no", "windows")
    at = F.col("line_no") - 1
    low = F.greatest(F.lit(0), _ceil_div(at - F.col("window") + 1, F.col("stride")))
    high = F.least(F.col("last_chunk"), F.floor(at / F.col("stride")))
    numbers = F.when(low <= high, F.sequence(low, high))
    chunk_no = F.explode(numbers).alias("chunk_no")
    text = (F.col("raw") if line_chars is None else F.substring("raw", 1, line_chars)).alias("text")
    placed = joined.select("file_id", "line_no", text, "stride", "window", "total", chunk_no)
    start = F.col("chunk_no") * F.col("stride")
    return placed.filter(~is_blank(F.col("text"))).select(
        *CHUNK,
        "line_no",
        "text",
        (start + 1).alias("start_line"),
        F.least(start + F.col("window"), F.col("total")).alias("end_line"),
    )


def _joined_text() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")


def chunk_texts(windowed: DataFrame) -> DataFrame:
    """One row per window with its range and text; a window holds 40 lines unless ``max_chunks`` widened it."""
    return windowed.groupBy(*CHUNK, "start_line", "end_line").agg(_joined_text().alias("text"))


def line_chunks(lines: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """The windows of every file with range and text."""
    return chunk_texts(windowed_lines(lines, window_shapes(lines, max_chunks)))


# --- index -------------------------------------------------------------------------


def chunk_terms(windowed: DataFrame) -> DataFrame:
    """Distinct terms per window."""
    term = F.explode(retrieval_tokens(F.col("text"))).alias("term")
    return windowed.select(*CHUNK, term).distinct()


def chunk_buckets(windowed: DataFrame) -> DataFrame:
    """Vector counts per window: the sum of the counts of its lines."""
    entry = F.explode(bucket_counts(F.col("text"))).alias("c")
    exploded = windowed.select(*CHUNK, entry).select(*CHUNK, "c.bucket", "c.n")
    return exploded.groupBy(*CHUNK, "bucket").agg(F.sum("n").alias("n"))


# --- matching ------------------------------------------------------------------------


def _term_matches(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """``file_id, token, term`` where one is a prefix of the other, or both are equal.

    Works on the vocabulary of a file, not on its windows.  Related words share
    their first two letters, so other terms are dropped by an equality join.  A
    longer term is cut to the lengths that tokens with its first letters have; a
    longer token is cut to every length.  Both ways become an equality join.
    """
    vocabulary = terms.select("file_id", "term").distinct()
    lengths = wanted.groupBy("file_id", F.substring("token", 1, 2).alias("head")).agg(
        F.collect_set(F.length("token")).alias("lengths")
    )
    usable = F.filter("lengths", lambda n: n <= F.length("term"))
    heads = (
        vocabulary.withColumn("head", F.substring("term", 1, 2))
        .join(unsized(lengths), ["file_id", "head"])
        .select("file_id", "term", F.explode(usable).alias("n"))
        .select("file_id", "term", F.expr("substring(term, 1, n)").alias("token"))
    )
    longer_terms = heads.join(unsized(wanted), ["file_id", "token"])
    cuts = F.when(F.length("token") > 2, F.sequence(F.lit(2), F.length("token") - 1))
    token_heads = wanted.select("file_id", "token", F.explode(cuts).alias("n")).select(
        "file_id", "token", F.expr("substring(token, 1, n)").alias("term")
    )
    longer_tokens = token_heads.join(unsized(vocabulary), ["file_id", "term"])
    columns = ["file_id", "token", "term"]
    return longer_terms.select(*columns).union(longer_tokens.select(*columns))


def score_chunks(windowed: DataFrame, questions: DataFrame) -> DataFrame:
    """``question_id, file_id, chunk_no, score`` of windows that share anything.

    The score is the share of question tokens a window covers plus half the
    cosine.  A window that shares neither a token nor a vector bucket scores
    zero and is below every threshold, so it is never formed.
    """
    asked = questions.select(
        "question_id",
        "file_id",
        question_tokens(F.col("question")).alias("tokens"),
        bucket_counts(F.col("question")).alias("counts"),
    ).withColumn("question_norm2", squared_norm(F.col("counts")))
    tokens = asked.select("question_id", "file_id", F.explode("tokens").alias("token"))
    terms = cut(chunk_terms(windowed), "chunk_terms")
    matches = _term_matches(terms, tokens.select("file_id", "token").distinct())
    token_chunks = (
        terms.join(unsized(matches), ["file_id", "term"]).select(*CHUNK, "token").distinct()
    )
    zero = F.lit(0).cast("long")
    covered = token_chunks.join(unsized(tokens), ["file_id", "token"]).select(
        "question_id", *CHUNK, F.lit(1).cast("long").alias("hits"), zero.alias("dot")
    )
    buckets = cut(chunk_buckets(windowed), "chunk_buckets")
    question_buckets = asked.select("question_id", "file_id", F.explode("counts").alias("c")).select(
        "question_id", "file_id", "c.bucket", F.col("c.n").alias("question_n")
    )
    products = buckets.join(unsized(question_buckets), ["file_id", "bucket"]).select(
        "question_id", *CHUNK, zero.alias("hits"), (F.col("n") * F.col("question_n")).alias("dot")
    )
    sums = (
        covered.unionByName(products)
        .groupBy("question_id", *CHUNK)
        .agg(F.sum("hits").alias("hits"), F.sum("dot").alias("dot"))
    )
    norms = buckets.groupBy(*CHUNK).agg(F.sum(F.col("n") * F.col("n")).alias("chunk_norm2"))
    sizes = asked.select("question_id", "file_id", F.size("tokens").alias("n_tokens"), "question_norm2")
    joined = sums.join(unsized(norms), CHUNK, "left").join(unsized(sizes), ["question_id", "file_id"])
    coverage = F.when(F.col("n_tokens") > 0, F.col("hits") / F.col("n_tokens")).otherwise(F.lit(0.0))
    likeness = cosine(
        F.col("dot"), F.coalesce("chunk_norm2", F.lit(0)), F.col("question_norm2")
    )
    score = coverage + F.lit(fixed.COSINE_WEIGHT) * likeness
    return joined.select("question_id", *CHUNK, score.alias("score"))


def asked_windows(lines: DataFrame, questions: DataFrame, max_chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Window shapes and windowed lines of the files that have a question."""
    asked = questions.select("file_id").distinct()
    shapes = window_shapes(lines, max_chunks).join(unsized(asked), "file_id", "left_semi")
    return shapes, windowed_lines(lines, shapes)


def retrieve(
    windowed: DataFrame,
    shapes: DataFrame,
    questions: DataFrame,
    k: int = fixed.TOP_CHUNKS,
    min_score: float = fixed.MIN_RETRIEVAL_SCORE,
) -> DataFrame:
    """The best ``k`` windows per question at or above the minimum, ranked."""
    strong = score_chunks(windowed, questions).filter(F.col("score") >= min_score)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("chunk_no"))
    ranked = strong.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    start = F.col("chunk_no") * F.col("stride")
    return ranked.join(unsized(shapes), "file_id").select(
        "question_id",
        *CHUNK,
        "rank",
        "score",
        (start + 1).alias("start_line"),
        F.least(start + F.col("window"), F.col("total")).alias("end_line"),
    )


# --- answers ---------------------------------------------------------------------------


def retrieved_texts(windowed: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Add the text to retrieved windows; other windows are dropped before grouping."""
    needed = retrieved.select(*CHUNK).distinct()
    texts = windowed.join(unsized(needed), CHUNK, "left_semi").groupBy(*CHUNK).agg(_joined_text().alias("text"))
    return retrieved.join(unsized(texts), CHUNK)


def answers(windowed: DataFrame, retrieved: DataFrame, questions: DataFrame, quote_chars: int | None = None) -> DataFrame:
    """Per question: citations, context block and an extractive answer, or a refusal.

    The answer quotes the best window's first line, whole unless ``quote_chars`` cuts it.

    Each question has at most ``k`` retrieved windows, so its row stays small.
    """
    kept = cut(retrieved, "retrieved")  # a few rows per question, read twice below
    shown = retrieved_texts(windowed, kept).withColumn("text", scrub(F.col("text")))
    entry = F.struct("rank", "start_line", "end_line", "text")
    ranked = shown.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    joined = questions.join(unsized(ranked), "question_id", "left")

    def section(c: Column) -> Column:
        header = F.format_string(fixed.CITATION, c["start_line"], c["end_line"])
        return F.concat_ws("\n", header, c["text"])

    body = F.array_join(F.transform("found", section), "\n\n")
    context = F.format_string(
        fixed.CONTEXT_TEXT,
        F.lit(fixed.FENCE_OPEN),
        body,
        F.lit(fixed.FENCE_CLOSE),
        scrub(F.col("question")),
    )
    best = F.get("found", F.lit(0))
    quote = F.substring_index(best["text"], "\n", 1)
    quote = quote if quote_chars is None else F.substring(quote, 1, quote_chars)
    answer = F.format_string(fixed.ANSWER_TEXT, best["start_line"], best["end_line"], quote)
    answered = F.col("found").isNotNull()
    no_citations = F.array().cast("array<struct<start_line:bigint,end_line:bigint>>")
    citations = F.transform(
        "found", lambda c: F.struct(c["start_line"].alias("start_line"), c["end_line"].alias("end_line"))
    )
    return joined.select(
        "question_id",
        "file_id",
        "question",
        answered.alias("answered"),
        F.coalesce(citations, no_citations).alias("citations"),
        F.when(answered, context).alias("context"),
        F.when(answered, answer).otherwise(F.lit(fixed.REFUSAL)).alias("answer"),
    )
