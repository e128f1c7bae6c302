"""A stored insight cache that answers a batch of groups without reading all of it.

Files are in order of tenant and fingerprint, their row groups are small, and each
carries a Bloom filter of its fingerprints.  A lookup of a batch with few keys names them in the filter that Spark hands
to the Parquet reader, so a row group is read only if its range and its Bloom filter allow one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.enrichment import CACHE_KEY, latest_cached

ROW_GROUP_BYTES = 8 << 20
NAMED_KEYS = 1000


def write_cache(cache: DataFrame, path: str, batch_id: str = "one", row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Store insights (``user_id, fingerprint, payload, model, prompt_version, created_at, group_id``); a replay replaces its batch."""
    order = [*CACHE_KEY, "created_at"]
    ordered = cache.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ordered.write.mode("overwrite").option("parquet.block.size", str(row_group_bytes))
    # Row groups hold up to 100 rows by default before their size is looked at.
    writer = writer.option("parquet.page.size.row.check.min", "10").option("parquet.page.size.row.check.max", "1000")
    writer.option("parquet.bloom.filter.enabled#fingerprint", "true").parquet(f"{path}/batch_id={batch_id}")


def _any_of(tests: list[Column]) -> Column:
    """A balanced tree of alternatives, as a long chain would be deep."""
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def cached_rows(spark: SparkSession, path: str, keys: DataFrame, named_keys: int = NAMED_KEYS) -> DataFrame:
    """Stored insights of the keys (``user_id, fingerprint``), older versions included.

    Up to ``named_keys`` distinct keys are named one by one; a larger batch is joined.
    """
    stored = spark.read.parquet(path)
    wanted = keys.select(*CACHE_KEY).distinct()
    few = wanted.limit(named_keys + 1).collect()
    if not few:
        return stored.limit(0)
    if len(few) > named_keys:
        return stored.join(wanted, CACHE_KEY, "left_semi")
    by_tenant: dict[object, list[Column]] = {}
    for key in few:
        by_tenant.setdefault(key["user_id"], []).append(F.col("fingerprint") == key["fingerprint"])
    return stored.where(_any_of([(F.col("user_id") == tenant) & _any_of(tests) for tenant, tests in by_tenant.items()]))


def with_stored_cache(groups: DataFrame, path: str, prompt_version: str | None = None) -> DataFrame:
    """As ``enrichment.with_cache``, from a stored cache: ``cached_payload`` is null on a miss."""
    hits = latest_cached(cached_rows(groups.sparkSession, path, groups))
    if prompt_version is not None:
        hits = hits.filter(F.col("cached_version") == prompt_version)
    return groups.join(hits, CACHE_KEY, "left")
