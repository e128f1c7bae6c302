"""Helpers that keep plans safe at scale: cuts, checked broadcasts, row numbers.

Nothing here looks at the meaning of the data.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
HOT_KEY_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage, readable by every executor.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session inside one
    process, where driver and executors are the same, gets a folder of its own when
    none is set; every other master must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if spark.sparkContext.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="logspark-")
    return _LOCAL_DIRS[spark.sparkContext.applicationId]


_LOCAL_DIRS: dict[str, str] = {}


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/logspark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_cuts(spark: SparkSession) -> None:
    """Delete the tables this application has stored; call it when all results are written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages start from files instead of a long lineage, survive lost
    executors, and still get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows over all cores when the source has fewer splits than that, else leave them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def row_bytes(df: DataFrame) -> int:
    """Bytes of all rows as text, which bounds what a broadcast of them would hold."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def checked_broadcast(df: DataFrame, name: str, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Store a table and mark it for broadcast only when its measured size allows.

    Returns the table and whether it is marked.
    """
    table = cut(df, name)
    if row_bytes(table) <= max_bytes:
        return F.broadcast(table), True
    return table, False


def unsized(df: DataFrame) -> DataFrame:
    """Mark a side whose size Spark cannot know before it runs, so that it is not broadcast on a guess.

    What is exploded or put together from a small stored table is guessed as small as that table, and
    repeated texts take almost no room in its files: rows of many times that size would pass through the driver.
    """
    return df.hint("merge")


def join_to_many(
    many: DataFrame,
    one: DataFrame,
    key: list[str],
    spread_on: str,
    name: str,
    max_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_KEY_ROWS,
    ways: int = 64,
) -> DataFrame:
    """Left join a table with one row per ``key`` onto rows whose keys may be hot.

    A small ``one`` side is broadcast after its bytes are measured.  Beyond that, the
    keys with more than ``hot_rows`` rows are found by a partial count; only their
    rows are salted by ``spread_on``, and only their rows of ``one`` are repeated.
    There are at most (rows / ``hot_rows``) such keys.
    """
    table, small = checked_broadcast(one, name, max_bytes)
    if small:
        return many.join(table, key, "left")
    counts = many.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = cut(counts.select(*key, F.lit(ways).alias("_ways")), f"{name}_hot")
    marked = many.join(F.broadcast(hot), key, "left").withColumn("_ways", F.coalesce("_ways", F.lit(1)))
    salted = marked.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.col("_ways")).cast("int")).drop("_ways")
    repeated = table.join(F.broadcast(hot), key, "left")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))
    return salted.join(repeated.withColumn("_salt", salts).drop("_ways"), [*key, "_salt"], "left").drop("_salt")


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """1-based row numbers per group without sending a group to one task.

    Rows are range-partitioned by group and order, so a large group spans many
    partitions.  Each (group, partition) then has a count, the running sum of
    those counts is the offset of the partition inside the group, and the row
    number is offset plus position.  ``order`` must be close to unique.
    """
    keys = [*group, *order]
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_position", F.monotonically_increasing_id())
    )
    placed = cut(ranged, "numbered").withColumn("_part", F.shiftright("_position", 33))
    return _positions_to_numbers(placed, group, "_part", "_position", name).drop("_part", "_position")


def _positions_to_numbers(
    rows: DataFrame, group: list[str], part: str, position: str, name: str
) -> DataFrame:
    """Turn positions that ascend within (group, part) into numbers within group."""
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*group, part)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(position).alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    numbered = join_to_many(rows, offsets, [*group, part], position, "offsets")
    number = F.col("_before") + F.col(position) - F.col("_first") + 1
    return numbered.withColumn(name, number).drop("_before", "_first")
