"""Reads that touch little of a large store: cached insights by fingerprint, cited lines by number."""

import hashlib
import random
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logspark.operators import enrichment
from logspark.operators.scale import new_path
from logspark.sources import insight_cache, line_ranges
from logspark.sources import lines as line_source


def cache_table(spark, n):
    key = F.sha2(F.col("id").cast("string"), 256)
    payload = F.lit(None).cast(enrichment.INSIGHT_PAYLOAD).alias("payload")
    return spark.range(n).select(
        (F.col("id") % 7).alias("user_id"), key.alias("fingerprint"), payload, F.concat(F.lit("model-"), "id").alias("model"),
        F.lit("v1").alias("prompt_version"), F.lit(datetime(2026, 3, 1)).alias("created_at"), F.col("id").cast("string").alias("group_id"),
    )


def scanned(frame):
    """Rows that left the file scan of a finished query."""
    frame.collect()
    plan, rows = frame._jdf.queryExecution().executedPlan(), 0
    leaves = (plan.finalPhysicalPlan() if plan.nodeName().startswith("Adaptive") else plan).collectLeaves()
    for i in range(leaves.size()):
        rows += leaves.apply(i).metrics().apply("numOutputRows").value()
    return rows


def test_a_small_batch_skips_most_row_groups(spark):
    path = new_path(spark, "cache")
    insight_cache.write_cache(cache_table(spark, 60_000), path, row_group_bytes=60_000)
    files = [f for f in Path(path.removeprefix("file:")).rglob("*.parquet")]
    groups = sum(pq.ParquetFile(f).num_row_groups for f in files)
    assert groups > 50
    ids = random.Random(1).sample(range(60_000), 20) + [70_000 + i for i in range(80)]
    keys = spark.createDataFrame([(i % 7, hashlib.sha256(str(i).encode()).hexdigest()) for i in ids], "user_id long, fingerprint string")
    found = insight_cache.cached_rows(spark, path, keys)
    assert sorted(r["group_id"] for r in found.collect()) == sorted(str(i) for i in ids if i < 60_000)
    assert scanned(found) < 0.6 * 60_000
    joined = insight_cache.cached_rows(spark, path, keys, named_keys=10)
    assert sorted(map(str, joined.select(found.columns).collect())) == sorted(map(str, found.collect()))
    assert insight_cache.cached_rows(spark, path, keys.limit(0)).count() == 0


def test_bloom_filters_spare_row_groups_whose_range_fits(spark):
    path = new_path(spark, "cache")
    # One tenant, and every row group spans all fingerprints: only the Bloom filter can tell.
    rows = cache_table(spark, 30_000).withColumn("user_id", F.lit(1).cast("long")).coalesce(1)
    writer = rows.write.option("parquet.block.size", "60000").option("parquet.page.size.row.check.min", "10").option("parquet.page.size.row.check.max", "1000")
    writer.option("parquet.bloom.filter.enabled#fingerprint", "true").parquet(path)
    keys = spark.createDataFrame([(1, hashlib.sha256(b"123").hexdigest()), (1, "f" * 64)], "user_id long, fingerprint string")
    found = insight_cache.cached_rows(spark, path, keys)
    assert found.count() == 1 and scanned(found) < 0.3 * 30_000


def test_stored_cache_equals_the_plain_one(spark):
    path = new_path(spark, "cache")
    cache = cache_table(spark, 500)
    newer = cache.where("group_id < 100").withColumn("created_at", F.lit(datetime(2026, 3, 2))).withColumn("prompt_version", F.lit("v2"))
    insight_cache.write_cache(cache, path)
    for _ in range(2):
        insight_cache.write_cache(newer, path, "two")
    groups = cache_table(spark, 800).where("group_id % 3 = 0").select("user_id", "fingerprint", F.concat(F.lit("g"), "group_id").alias("group_id"))
    for version in (None, "v1"):
        plain = enrichment.with_cache(groups, cache.unionByName(newer), version)
        stored = insight_cache.with_stored_cache(groups, path, version)
        assert sorted(map(str, stored.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.fixture(scope="module")
def log_folder(spark):
    folder = Path(new_path(spark, "files").removeprefix("file:"))
    folder.mkdir(parents=True)
    rng = random.Random(3)
    lines = [f"line {i} " + "x" * rng.choice([0, 0, 10, 300]) for i in range(1, 20_001)]
    (folder / "long.log").write_bytes("\n".join(lines).encode() + b"\n")
    (folder / "crlf.log").write_bytes(b"a\r\n\r\nb \xff\nlast")
    (folder / "blank.log").write_bytes(b"\n\n")
    return folder


def test_lines_by_number_equal_a_whole_read(spark, log_folder):
    for every, split in ((100, 1 << 16), (7, 1000), (1, 64 << 20)):
        index = new_path(spark, "marks")
        line_ranges.write_line_index(spark, str(log_folder), index, every, split)
        whole = line_source.read_small_files(spark, str(log_folder))
        for name, ranges in {"long": [(1, 1), (95, 140), (19_990, 20_100), (300, 299)], "crlf": [(1, 9), (4, 4)], "blank": [(1, 5)]}.items():
            file_id = f"file:{log_folder}/{name}.log"
            own = {r["line_no"]: r["raw"] for r in whole.where(F.col("file_id").endswith(f"{name}.log")).collect()}
            for first, last in ranges:
                found = line_ranges.read_lines(spark, index, file_id, first, last).orderBy("line_no").collect()
                assert [(r["line_no"], r["raw"]) for r in found] == [(n, own[n]) for n in sorted(own) if first <= n <= last]


def test_a_citation_reads_one_short_range(spark, log_folder):
    index = new_path(spark, "marks")
    line_ranges.write_line_index(spark, str(log_folder), index, 100, 1 << 16)
    reader = line_ranges.LineReader(index)
    file_id = f"file:{log_folder}/long.log"
    filters = [line_ranges.EqualTo(("file_id",), file_id), line_ranges.GreaterThanOrEqual(("line_no",), 15_010), line_ranges.LessThan(("line_no",), 15_050)]
    assert list(reader.pushFilters(filters)) == filters
    (part,) = reader.partitions()
    assert part.first_line == 15_001 and part.end - part.start < 100 * 320
    assert sum(batch.num_rows for batch in reader.read(part)) == 100
    with pytest.raises(ValueError, match="name one file"):
        line_ranges.LineReader(index).partitions()
