"""Running a stream to a table and reading its final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.operators.scale import cut, new_path


ROWS_PER_FILE = 1_000_000


def files_per_batch(table: DataFrame, batches: int) -> int:
    """Files of about ``ROWS_PER_FILE`` rows that each of ``batches`` micro-batches reads, so that tasks follow the data."""
    return max(1, -(-table.count() // (batches * ROWS_PER_FILE)))


def in_files(table: DataFrame, key: str, files: int, name: str) -> DataFrame:
    """A stored copy whose rows are dealt by a hash, so that every file covers the whole time."""
    return cut(table.repartition(files, F.xxhash64(key)), name)


def in_time_files(table: DataFrame, time: str, ranges: int, name: str, files: int = 1) -> DataFrame:
    """A stored copy in ranges that follow each other in time, written one after another in ``files`` files each."""
    at = F.unix_micros(time)
    cuts = table.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    path = new_path(table.sparkSession, name)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = table.where(at > low) if low is not None else table
        part = part.where(at <= high) if high is not None else part
        part.repartition(files).write.mode("append").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _folder(table: DataFrame) -> str:
    return table.inputFiles()[0].rsplit("/", 1)[0]


def append_marker(table: DataFrame, time: str, days: int) -> None:
    """Add a last row, ``days`` after all others, so that a stream over the table passes its end.

    Its texts are empty and its numbers 0; with it a finished replay moves the watermark as a live stream would.
    """
    end = table.agg(F.max(time)).first()[0]
    moved = F.lit(end).cast("timestamp") + F.expr(f"INTERVAL {days} DAYS")
    other = {kind: "" if kind == "string" else 0 for _, kind in table.dtypes}
    columns = [moved.alias(c) if c == time else F.lit(other[kind]).cast(kind).alias(c) for c, kind in table.dtypes]
    table.sparkSession.range(1).select(columns).write.mode("append").parquet(_folder(table))


def read_table_stream(spark: SparkSession, table: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """Stream the files of a stored table; each micro-batch takes a bounded number."""
    folder = _folder(table)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "update", then=None) -> str:
    """Process everything available; each micro-batch replaces its own folder.

    ``then`` runs after that, to add input, and the stream goes on from its checkpoint.

    A replayed micro-batch has the same id and overwrites the same folder, so
    a crash between write and commit does not store rows twice.
    """
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    def run() -> None:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if then is not None:
        then()
        run()
    return path


def final_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last emitted row of every key; keys may hold structs such as windows."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    emitted = spark.read.parquet(path).withColumn("_rank", F.row_number().over(newest))
    return emitted.filter(F.col("_rank") == 1).drop("_rank", "batch_id")


def all_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row of an append stream."""
    return spark.read.parquet(path).drop("batch_id")
