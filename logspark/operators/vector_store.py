"""A stored table of dense unit vectors, cut into cells: searched by angle bounds, upserted cell by cell.

A cell is a partition of the table: the points nearest to one of some fixed pivots.  Beside it lie
the least and greatest angle of its points to the pivot (``radii``) and, in buckets of a hash, the cell
and version of every id (``ids``).  A search reads the cells that may hold a better
point than those already found.  An upsert reads and replaces the cells that its points leave or
enter and the buckets of its ids; the files of all others stay as they are.

Replaying an upsert gives the same table, and so does one that broke off between the tables.
One writer at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.operators import knn
from logspark.operators.scale import cut, unsized

ROWS_A_BUCKET = 1_000_000
LEAST_BUCKETS = 16
KEY = ["tenant", "id"]


def _newest(points: DataFrame) -> DataFrame:
    """The last version of each point; equal versions are settled by a hash of the vector."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("version"), F.desc(F.xxhash64("vector")))
    return points.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


class VectorStore:
    """Points (tenant, id, version, vector) in ``path``; vectors have length 1, tenants and ids are numbers or strings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()
        # As many rows as cells, which ``knn.MOST_PIVOTS`` bounds.
        self.pivots = np.array([r["vector"] for r in rows])
        self.buckets = rows[0]["buckets"]

    @classmethod
    def create(cls, points: DataFrame, path: str, cells: int | None = None) -> VectorStore:
        """Store ``points`` in as many cells as the square root of their number."""
        spark = points.sparkSession
        first = cut(_newest(points), "store-points")
        n = first.count()
        cells = cells or min(knn.MOST_PIVOTS, max(knn.LEAST_PIVOTS, round(n**0.5)))
        buckets = max(LEAST_BUCKETS, -(-n // ROWS_A_BUCKET))
        pivots = [(i, [float(x) for x in v], buckets) for i, v in enumerate(knn._pivots(first, cells))]
        spark.createDataFrame(pivots, "cell int, vector array<double>, buckets long").write.mode("overwrite").parquet(f"{path}/pivots")
        store = cls(spark, path)
        placed = cut(knn.with_cells(first, store.pivots), "store-placed")
        store._replace(placed, store._located(placed))
        return store

    def points(self) -> DataFrame:
        return self._table("points").where("id is not null")

    def upsert(self, new: DataFrame) -> int:
        """Write points; a stored point of a later version stays.  Returns the number of cells that were replaced."""
        newest = cut(knn.with_cells(_newest(new), self.pivots), "store-new")
        buckets = knn.distinct_values(newest.select(self._bucket().alias("bucket")), "bucket")
        known = self._table("ids").where(F.col("bucket").isin(buckets))
        old = known.select(*KEY, F.col("version").alias("old_version"), F.col("cell").alias("old_cell"))
        met = newest.join(old, KEY, "left").where("old_version is null or old_version <= version")
        accepted = cut(met, "store-accepted")
        cells = knn.distinct_values(accepted.select(F.explode(F.array_compact(F.array("cell", "old_cell"))).alias("cell")), "cell")
        if not cells:
            return 0
        entering = accepted.drop("old_version", "old_cell")
        staying = self._table("points").where(F.col("cell").isin(cells) & F.col("id").isNotNull()).join(entering, KEY, "left_anti")
        content = cut(staying.unionByName(entering), "store-cells")
        kept_ids = known.join(entering, KEY, "left_anti").unionByName(self._located(entering))
        self._replace(content, cut(kept_ids, "store-ids"), cells)
        return len(cells)

    def search(self, queries: DataFrame, k: int, skip_same_id: bool = False, block_rows: int | None = None) -> DataFrame:
        """``tenant, query_id, match_id, score, rank``: the exact ``k`` nearest points of each query (tenant, id, vector).

        Only cells that hold a query, or may hold a point nearer than the ``k``-th found there, are read.
        """
        placed = knn.with_cells(queries.select("id", "tenant", "vector").where("tenant is not null"), self.pivots)
        asked = cut(placed, "store-queries")
        sizes = self.points().groupBy(*knn.CELL).agg(F.count(F.lit(1)).alias("n"))
        cells = self._table("radii").select("tenant", "cell", "nearest", "farthest").join(unsized(sizes), knn.CELL)
        read = lambda some: self.points().where(F.col("cell").isin(some))
        return knn.search_cells(asked, read, cells, self.pivots, k, skip_same_id, block_rows)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.buckets)).cast("int")

    def _located(self, placed: DataFrame) -> DataFrame:
        return placed.select(*KEY, "version", "cell", self._bucket().alias("bucket"))

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _replace(self, content: DataFrame, ids: DataFrame, cells: list[int] | None = None) -> None:
        """Overwrite the partitions that ``content`` and ``ids`` have rows of, and those of ``cells``."""
        radii = content.groupBy("tenant", "cell").agg(F.min("angle").alias("nearest"), F.max("angle").alias("farthest"))
        self._overwrite(_with_marks(content, cells), "points", "cell")
        self._overwrite(_with_marks(radii, cells), "radii", "cell")
        self._overwrite(ids, "ids", "bucket")

    def _overwrite(self, rows: DataFrame, name: str, partition: str) -> None:
        # The rebalance hint gives each partition few files and splits large ones.
        writer = rows.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(partition).parquet(f"{self.path}/{name}")


def _with_marks(rows: DataFrame, cells: list[int] | None) -> DataFrame:
    """Add a row of nulls to every replaced cell, so that one that lost all its points is overwritten too."""
    if not cells:
        return rows
    marks = rows.sparkSession.createDataFrame([(c,) for c in cells], "cell int")
    return rows.unionByName(marks, allowMissingColumns=True)
