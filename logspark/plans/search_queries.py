"""Registered queries over vectors, windows and questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators import inverted, knn, retrieval, similarity, vector_store
from logspark.operators.scale import new_path, spread
from logspark.plans import inputs


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector of every document as ``bucket:count`` pairs with its squared norm."""
    texts = spread(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    pairs = F.transform("counts", lambda c: F.concat_ws(":", c["bucket"].cast("string"), c["n"].cast("string")))
    return similarity.embed(texts, ["doc_id"], "text").select(
        "doc_id", F.array_join(pairs, " ").alias("vector"), "norm2"
    )


def template_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = similarity.template_index(inputs.enriched_groups(spark, sf_dir))
    return points.select(
        "id", "user_id", "file_id", "level", "severity", "fingerprint",
        F.size("counts").cast("long").alias("buckets"), "norm2",
    )


def similar_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = inputs.enriched_groups(spark, sf_dir)
    return similarity.similar_incidents(groups, groups)


def _embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("long").alias("tenant"),
        F.lit(1).alias("version"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def _upserted_store(spark: SparkSession, sf_dir: str) -> vector_store.VectorStore:
    """Embeddings written twice: even points again, with their vector reversed."""
    points = _embedding_points(spark, sf_dir)
    store = vector_store.VectorStore.create(points, new_path(spark, "vectors"))
    again = points.filter(F.col("id") % 2 == 0)
    store.upsert(again.withColumn("vector", F.reverse("vector")).withColumn("version", F.lit(2)))
    store.upsert(again.filter(F.col("id") % 4 == 0))  # an older version changes nothing
    return store


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored points after the upserts."""
    first = F.element_at("vector", 1).cast("double")
    return _upserted_store(spark, sf_dir).points().select("id", F.col("tenant").cast("int").alias("user_id"), "version", F.round(first, 6).alias("first_value"))


def stored_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest stored points of every tenth embedding, after the upserts."""
    queries = _embedding_points(spark, sf_dir).filter(F.col("id") % 10 == 0)
    found = _upserted_store(spark, sf_dir).search(queries, KNN_LIMIT)
    return found.withColumn("score", F.round("score", 4))


KNN_LIMIT = 5


def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other embeddings of every embedding within its label."""
    points = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("long").alias("tenant"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    found = knn.nearest_neighbours(points, points, KNN_LIMIT, skip_same_id=True)
    return found.withColumn("score", F.round("score", 4))


def _shown_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "file_id", "chunk_no", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the lines of every document."""
    from logspark.sources.lines import lines_of_texts

    return _shown_chunks(retrieval.line_chunks(lines_of_texts(inputs.pasted_texts(spark, sf_dir))))


def line_chunks_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over long files: as many as the file needs."""
    lines = inputs.long_log_lines(spark, sf_dir)
    return _shown_chunks(retrieval.line_chunks(lines))


def _window_index(spark: SparkSession, sf_dir: str) -> str:
    """The stored index over the log lines, built on first use."""
    return inputs.stored_path(spark, sf_dir, "window_index", lambda path: inverted.write_index(inputs.log_lines(spark, sf_dir), path))


def chunk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best windows for six questions about every file."""
    found = inverted.search(spark, _window_index(spark, sf_dir), inputs.questions(spark, sf_dir))
    return found.withColumn("score", F.round("score", 4))


def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, questions = inputs.log_lines(spark, sf_dir), inputs.questions(spark, sf_dir)
    found = inverted.search(spark, _window_index(spark, sf_dir), questions)
    windowed = retrieval.windowed_lines(lines, retrieval.window_shapes(lines))
    cited = F.transform("citations", lambda c: F.concat_ws("-", c["start_line"], c["end_line"]))
    return retrieval.answers(windowed, found, questions).select(
        "question_id",
        "answered",
        F.array_join(cited, ", ").alias("citations"),
        F.sha2("context", 256).alias("context_sha"),
        "answer",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hash_embedding": hash_embedding,
    "template_index": template_index,
    "similar_incidents": similar_incidents,
    "vector_upsert": vector_upsert,
    "vector_knn": vector_knn,
    "stored_vector_search": stored_vector_search,
    "line_chunks": line_chunks,
    "line_chunks_wide": line_chunks_wide,
    "chunk_retrieval": chunk_retrieval,
    "extractive_answers": extractive_answers,
}
