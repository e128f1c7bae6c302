"""The stored window index against scoring every window."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from logspark.operators import inverted, retrieval

ASKED = ["why did the payment time out?", "disk quota on volume", "is the", "gateway gate", "zebra", "heartbeat 12"]


def log_table(spark):
    rng = random.Random(2)
    words = ["payment", "timeouts", "gateway", "disk", "quota", "volume", "heartbeat", "ok", "seq", "pool", "pay"]

    def line(i):
        if i % 97 == 0:
            return "   "
        rare = " ERROR payment timeout Gateway" if i in (43, 9000, 15_500) else ""
        return " ".join(rng.choices(words[4:], k=4)) + f" {i % 50}" + rare

    rows = [(1, i, line(i)) for i in range(1, 18_001)] + [(2, i, line(i)) for i in range(1, 90)] + [(3, 1, "disk"), (4, 1, "")]
    return spark.createDataFrame(rows, "file_id long, line_no long, raw string")


def test_index_equals_scoring_every_window(spark):
    lines = log_table(spark)
    rows = [(10 * f + n, f, q) for f in (1, 2, 3, 4, 99) for n, q in enumerate(ASKED)]
    questions = spark.createDataFrame(rows, "question_id long, file_id long, question string")
    path = inverted.write_index(lines)
    found = inverted.search(spark, path, questions)
    shapes, windowed = retrieval.asked_windows(lines, questions)
    expected = retrieval.retrieve(windowed, shapes, questions)
    key = lambda frame: sorted(map(tuple, frame.select(sorted(expected.columns)).collect()))
    assert key(found) == key(expected) and expected.count() > 30
    assert spark.read.parquet(path).where("file_id = 1").count() == 3


def test_many_questions_of_one_file(spark):
    lines = log_table(spark).where("file_id = 2")
    questions = spark.range(600).select(F.col("id").alias("question_id"), F.lit(2).cast("long").alias("file_id"), F.lit("disk quota").alias("question"))
    found = inverted.search(spark, inverted.write_index(lines), questions)
    ranked = found.groupBy("question_id").agg(F.max("rank").alias("n")).groupBy("n").count().collect()
    assert len(ranked) == 1 and ranked[0]["count"] == 600


def test_bounds_are_never_too_low_and_leave_blocks_out(spark):
    lines = log_table(spark).where("file_id = 1")
    questions = spark.createDataFrame([(n, 1, q) for n, q in enumerate(ASKED)], "question_id long, file_id long, question string")
    asked = inverted._questions(questions, 0.2)
    index = spark.read.parquet(inverted.write_index(lines))
    met = index.join(inverted._batched(asked, ["file_id"]), "file_id").toArrow().combine_chunks()
    bounds = {(r["question_id"], r["block"]): r["bound"] for batch in inverted._bounds(met.to_batches(), 0.2) for r in batch.to_pylist()}
    scores = pa.Table.from_batches(list(inverted._scores(met.to_batches(), 1000))).to_pylist()
    assert scores and all(r["score"] <= bounds[r["question_id"], r["chunk_no"] // inverted.BLOCK_WINDOWS] for r in scores)
    assert not any(q == 4 for q, _ in bounds)


def test_a_line_is_indexed_by_prefixes_both_ways():
    terms = sorted(["time", "timeout", "timeouts", "ti", "tip", "zz"])
    run = lambda token: sorted({terms[i] for a, b in inverted._matching(terms, token) for i in range(a, b)})
    assert run("timeout") == ["ti", "time", "timeout", "timeouts"]
    assert run("ti") == ["ti", "time", "timeout", "timeouts", "tip"] and run("xx") == []


def test_blocks_are_built_once_and_many_at_a_time(spark):
    """The order of the index used to build every block twice, each as a group of its own."""
    short = spark.range(400).select((F.col("id") % 100 + 10).alias("file_id"), (F.floor(F.col("id") / 100) + 1).alias("line_no"), F.lit("ab12cd disk").alias("raw"))
    lines = log_table(spark).unionByName(short)
    blocks = inverted.index_blocks(lines)
    assert "FlatMapGroups" not in blocks._jdf.queryExecution().toString()
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RepartitionByExpression")
    at_once = [r for batch in inverted._build_all(lines_in_order(lines, 7)) for r in batch.to_pylist()]
    one_batch = [r for batch in inverted._build_all(lines_in_order(lines, 1 << 20)) for r in batch.to_pylist()]
    assert at_once == one_batch and len(at_once) == blocks.count() == 106
    by_block = {(r["file_id"], r["block"]): r for r in at_once}
    assert by_block[10, 0]["terms"] == ["ab12cd", "disk"] and by_block[10, 0]["norm2"] != [0]
    assert by_block[4, 0]["terms"] == [] and by_block[4, 0]["term_first"] == [0]


def test_a_line_without_text_has_no_terms():
    line, rank, terms, buckets, n_buckets = inverted._tokens([None, "disk 7a disk", ""])
    assert line.tolist() == [1, 1, 1] and [terms[i].as_py() for i in rank] == ["disk", "7a", "disk"]
    assert len(buckets) == 1 and n_buckets.tolist() == [0, 1]
    assert inverted._tokens([None])[0].tolist() == []


def lines_in_order(lines, rows):
    shapes = retrieval.window_shapes(lines)
    at, n = F.col("line_no") - 1, inverted.BLOCK_WINDOWS
    low = F.greatest(F.lit(0), F.ceil((at - F.col("window") + 1) / F.col("stride")).cast("long"))
    high = F.least(F.col("last_chunk"), F.floor(at / F.col("stride")))
    blocks = F.array_distinct(F.transform(F.array(low, high), lambda c: F.floor(c / n)))
    placed = lines.join(shapes, "file_id").select("*", F.lower("raw").alias("text"), F.explode(blocks).alias("block"))
    return placed.orderBy("file_id", "block", "line_no").toArrow().combine_chunks().to_batches(max_chunksize=rows)
