"""Held-out accuracy, calibration and odd rows of the quality classifier."""

import zlib

import numpy as np

from logspark.llm import quality, queries

SF_DIR = "/root/testdata/sf0.01"


def test_op4_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op4_quality(spark, SF_DIR).collect()}
    assert len(rows) == docs.count()
    for doc_id, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["quality"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()]
    held = [(q, r) for q, r in held if r["held_out"]]
    assert np.mean([q == r["predicted"] for q, r in held]) > 0.95
    assert all(r["predicted"] for q, r in held if q == 1)


def test_isotonic_is_the_closest_rising_fit():
    source = np.random.default_rng(1)
    raw, label = source.normal(size=200), (source.uniform(size=200) > 0.4).astype(float)
    at, chance = quality.isotonic(raw, label)
    assert (np.diff(at) > 0).all() and (np.diff(chance) > 0).all()
    y = label[np.argsort(raw)]
    expected = [max(min(np.mean(y[i : j + 1]) for j in range(k, 200)) for i in range(k + 1)) for k in range(200)]
    assert np.allclose(np.unique(expected), chance)


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "AB!! AB!! ab", "x" * 600_000, "one two\n\none two\nthree", "\n", "é ü"]
    raw = [t.encode() for t in texts]
    table = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.isfinite(table).all()
    for text, row in zip(raw, table, strict=True):
        alone = quality.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert np.allclose(alone[0], row)


def test_sums_match_a_direct_ridge(spark):
    source = np.random.default_rng(3)
    x = source.normal(size=(400, 5))
    rows = [(i, [float(v) for v in r], int(r[0] + 0.3 * r[1] ** 2 > 0.2)) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "doc_id long, statistics array<float>, label int")
    model = quality.fit(frame)
    features = model.features(x.astype(np.float32).astype(float))
    y = np.array([r[2] for r in rows], float)
    penalty = quality.RIDGE * np.eye(features.shape[1])
    penalty[0, 0] = 0
    direct = np.linalg.solve(features.T @ features + penalty, features.T @ y)
    assert np.allclose(features @ direct, features @ model.weights, atol=1e-6)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9


def test_odd_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (2, "", 3), (None, "some text", 3), (4, "word " * 200_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(4, None), (None, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [True]
    unlabelled = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
