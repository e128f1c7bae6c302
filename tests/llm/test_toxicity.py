"""Held-out results, the learning rule, and odd rows of the toxicity scores."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from logspark.llm import queries, toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_op13_held_out_results(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op13_toxicity(spark, SF_DIR).collect()}
    assert len(rows) == docs.count()
    for doc_id, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["toxic"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()]
    held = [(t, r["predicted"]) for t, r in held if r["held_out"]]
    assert np.mean([p for t, p in held if t == 1]) > 0.7
    assert np.mean([p for t, p in held if t == 0]) < 0.01


def plain_ftrl(rows, rates, passes):
    z, n = {}, {}

    def weight(i):
        limit = 0.0 if i == toxicity.BUCKETS else rates.l1
        past = z.get(i, 0.0)
        if abs(past) <= limit:
            return 0.0
        return -(past - math.copysign(limit, past)) / ((rates.beta + math.sqrt(n.get(i, 0.0))) / rates.alpha + rates.l2)

    for label, bucket, value in rows * passes:
        pairs = [*zip(bucket.tolist(), value.tolist(), strict=True), (toxicity.BUCKETS, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + math.exp(-max(-60, min(60, sum(w[i] * x for i, x in pairs)))))
        for i, x in pairs:
            g = (p - label) * x * (rates.positive if label else 1)
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / rates.alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_learning_rule_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    rates = toxicity.Rates(l1=0.05, l2=0.1)
    rows = []
    for i in range(60):
        bucket = np.unique(rng.integers(0, 50, 8)).astype(np.int32)
        rows.append((int(7 in bucket), bucket, rng.integers(1, 9 if i else 300, len(bucket))))
    table = [(0, i, label, bytearray(b.tobytes()), bytearray(toxicity._narrow(t))) for i, (label, b, t) in enumerate(rows)]
    rows = [(label, b, toxicity.values(t)) for label, b, t in rows]
    frame = spark.createDataFrame(table, toxicity.ROW_SCHEMA).groupBy("shard").applyInArrow(toxicity._packed, toxicity.SHARD_SCHEMA)
    found = toxicity.fit(frame, rates, rounds=2)
    expected = plain_ftrl(rows, rates, 2 * toxicity.PASSES)
    assert np.allclose(found[list(expected)], list(expected.values()))
    assert 0 < np.count_nonzero(found[:50]) < 50


def test_features_do_not_depend_on_the_batch():
    texts = ["", "one", "One two three two", "é " * 50_000, "x", "a b a b"]
    raw = [t.encode() for t in texts]
    together = toxicity.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    weight = np.random.default_rng(1).normal(size=toxicity.BUCKETS + 1)
    scores = toxicity.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), weight)
    for text, (bucket, value), score in zip(raw, together, scores, strict=True):
        alone = toxicity.counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert (alone[0] == bucket).all() and (alone[1] == value).all()
        assert math.isclose(score, toxicity.chance(weight[bucket] @ toxicity.values(value) + weight[-1]), rel_tol=1e-9)
    # one two three: three words, two pairs, one spaced pair
    assert together[2][1].sum() == 4 + 3 + 2


def labelled(spark, n=900):
    rows = [(i, f"w{i % 50} {'awful' if i % 3 == 0 else 'plain'} w{i % 41} w{i % 17}", 9) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    return docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))


def test_model_ignores_held_out_labels_and_splits(spark):
    docs, labels = labelled(spark)
    order = lambda frame: sorted(map(tuple, frame.collect()))
    one = order(toxicity.toxicity_scores(docs, labels))
    assert all(r[3] == int(r[0] % 3 == 0) for r in one)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = order(toxicity.toxicity_scores(docs.repartition(7), turned.repartition(3)))
    assert [r[:2] for r in one] == [r[:2] for r in other] and np.allclose([r[2] for r in one], [r[2] for r in other])


def test_draw_is_bounded(spark):
    docs, labels = labelled(spark)
    hot = docs.where("doc_id = 2").crossJoin(spark.range(3000)).withColumn("text", F.concat("text", F.lit(" "), F.col("id").cast("string"))).drop("id")
    drawn = toxicity.draw(docs.union(hot).union(docs), labels, max_rows=200)
    assert drawn.count() == drawn.distinct().count() < 300


def test_odd_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (2, "", 3), (None, "some text", 3), (4, "word " * 200_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(4, None), (None, 1), (2, 1), (2, 1), (4, 0), (1, 0), (1, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [True]
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
