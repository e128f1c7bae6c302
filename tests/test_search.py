import hashlib
import math
import re
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from logspark.functions.vectors import bucket_counts, squared_norm
from logspark.operators import knn, retrieval, similarity
from logspark.operators.scale import cut


def plain_vector(text):
    vector = {}
    for token in re.findall("[a-z]{2,}", text.lower()):
        bucket = int.from_bytes(hashlib.sha1(token.encode()).digest()[:4], "big") % 256
        vector[bucket] = vector.get(bucket, 0) + 1
    return vector


def plain_cosine(a, b):
    dot = sum(n * b.get(k, 0) for k, n in a.items())
    norms = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return dot / norms if norms else 0.0


def test_vector_counts(spark):
    texts = ["timeout timeout on db db db", "", "Éa x 12", "one two three two one two"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bucket_counts(F.col("t")).alias("c"))
    for row in rows.withColumn("n2", squared_norm(F.col("c"))).collect():
        assert {c.bucket: c.n for c in row.c} == plain_vector(row.t)
        assert row.n2 == sum(n * n for n in plain_vector(row.t).values())


def test_threshold_join_finds_exactly_the_brute_force_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "error", "error", "error", "timeout", "pool", "disk"]
    texts = sorted({" ".join(rng.choice(words, size=rng.integers(1, 7))) for _ in range(120)})
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "user_id int, template string")
    vectors = similarity.embed(rows, ["user_id", "template"], "template")
    for threshold in (0.2, 0.4, 0.8):
        pairs = similarity.similar_pairs(vectors, vectors, "user_id", "template", threshold).collect()
        got = {(r.left_template, r.right_template): r.score for r in pairs}
        assert len(got) == len(pairs)
        expected = {
            (a, b): plain_cosine(plain_vector(a), plain_vector(b))
            for i, a in enumerate(texts) for j, b in enumerate(texts) if i % 2 == j % 2
        }
        expected = {k: s for k, s in expected.items() if s >= threshold}
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def group_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "file_id long, user_id long, group_id string, fingerprint string, template string, severity string, count long",
    )


def test_similar_incidents_exclude_own_run_and_other_tenants(spark):
    groups = group_rows(spark, [
        (1, 1, "a", "f1", "connection timeout to postgres", "high", 4),
        (2, 1, "b", "f2", "disk quota exceeded on volume", "high", 9),
        (3, 1, "c", "f3", "timeout on postgres connection", "high", 3),
        (3, 1, "d", "f4", "postgres connection timeout again", "low", 1),
        (4, 2, "e", "f1", "connection timeout to postgres", "high", 4),
    ])
    today = groups.filter("file_id = 3")
    found = similarity.similar_incidents(today, groups).orderBy("position").collect()
    assert [r.match_group_id for r in found] == ["a"] and found[0].score > 0.4
    assert similarity.similar_incidents(groups.filter("file_id = 4"), groups).count() == 0


def test_similar_groups_survive_many_equal_templates(spark):
    rows = [(i, 1, f"g{i:03d}", "f", "same error text", "high", 1) for i in range(60)]
    rows += [(0, 1, f"own{j}", f"f{j}", "same error text", "high", 1) for j in range(8)]
    groups = group_rows(spark, rows)
    found = similarity.similar_incidents(groups, groups, limit=5)
    per_run = {r.file_id: r["count"] for r in found.groupBy("file_id").count().collect()}
    assert set(per_run.values()) == {5} and len(per_run) == 60
    first = [r.match_group_id for r in found.filter("file_id = 0").orderBy("position").collect()]
    assert first == ["g001", "g002", "g003", "g004", "g005"]


def test_upsert_keeps_the_last_write(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(1, "z", 2)], "id int, v string, version int")
    kept = {r.id: r.v for r in similarity.upsert_points(old, new).collect()}
    assert kept == {1: "z", 2: "y"}


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(180, 12))
    vectors[:60] = vectors[0] + 0.05 * rng.normal(size=(60, 12))  # one crowded cell
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, int(i % 5 == 4), [float(x) for x in v]) for i, v in enumerate(vectors)]
    points = spark.createDataFrame(rows, "id long, tenant long, vector array<double>")
    found = knn.nearest_neighbours(points, points, 4, skip_same_id=True, n_pivots=6, block_rows=16).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.match_id)
    scores = vectors @ vectors.T
    for i, tenant, _ in rows:
        others = [j for j, t, _ in rows if t == tenant and j != i]
        expected = sorted(others, key=lambda j: (-scores[i, j], j))[:4]
        assert got[i] == expected


def line_table(spark, n, text=lambda i: f"line {i}"):
    return spark.createDataFrame([(1, i, text(i)) for i in range(1, n + 1)], "file_id long, line_no long, raw string")


def test_windows_of_100_lines(spark):
    chunks = retrieval.line_chunks(line_table(spark, 100)).orderBy("chunk_no").collect()
    assert [(c.start_line, c.end_line) for c in chunks] == [(1, 40), (31, 70), (61, 100)]
    assert chunks[0].text.split("\n") == [f"line {i}" for i in range(1, 41)]


def test_blank_windows_are_skipped_but_counted(spark):
    lines = line_table(spark, 100, lambda i: "  " if 31 <= i <= 70 else "x" * 600)
    chunks = retrieval.line_chunks(lines).orderBy("chunk_no").collect()
    assert [(c.start_line, c.end_line) for c in chunks] == [(1, 40), (61, 100)]
    assert len(chunks[0].text.split("\n")) == 30 and len(chunks[0].text.split("\n")[0]) == 600
    assert retrieval.line_chunks(line_table(spark, 50, lambda i: "")).count() == 0


def test_a_cap_gives_wider_windows(spark):
    lines = spark.range(1, 200_001).selectExpr("1L as file_id", "id as line_no", "'x' as raw")
    assert retrieval.line_chunks(lines).count() == 6667
    chunks = retrieval.line_chunks(lines, max_chunks=2000)
    stats = chunks.agg(F.count("*"), F.max("end_line"), F.min("start_line")).first()
    assert stats[0] <= 2100 and stats[1] == 200_000 and stats[2] == 1


def brute_scores(chunks, question):
    stop = {"the", "a", "an", "is", "was", "did", "do", "what", "why", "how", "when", "who", "with", "in", "on", "at", "of", "to", "and", "or"}
    tokens = {t for t in re.findall("[a-z0-9]{2,}", question.lower())} - stop
    out = {}
    for c in chunks:
        terms = set(re.findall("[a-z0-9]{2,}", c.text.lower()))
        hits = sum(any(x.startswith(t) or t.startswith(x) for x in terms) for t in tokens)
        out[c.chunk_no] = (hits / len(tokens) if tokens else 0.0) + 0.5 * plain_cosine(plain_vector(question), plain_vector(c.text))
    return out


def test_retrieval_equals_brute_force_and_refuses(spark):
    def text(i):
        return "ERROR payment timeouts at gateway eu-west" if i == 43 else f"heartbeat ok seq {i} pay"

    lines = line_table(spark, 160, text)
    asked = ["why did the payment time out?", "certificate renewal", "is the", "gateway"]
    questions = spark.createDataFrame([(i, 1, q) for i, q in enumerate(asked)], "question_id long, file_id long, question string")
    shapes, windowed = retrieval.asked_windows(lines, questions)
    found = retrieval.retrieve(windowed, shapes, questions)
    chunks = retrieval.line_chunks(lines).collect()
    for i, question in enumerate(asked):
        scores = brute_scores(chunks, question)
        best = sorted((c for c in scores if scores[c] >= 0.2), key=lambda c: (-scores[c], c))[:6]
        rows = found.filter(f"question_id = {i}").orderBy("rank").collect()
        assert [r.chunk_no for r in rows] == best
        assert all(abs(r.score - scores[r.chunk_no]) < 1e-12 for r in rows)
    top = found.filter("question_id = 0 and rank = 1").first()
    assert top.start_line <= 43 <= top.end_line
    answers = {r.question_id: r for r in retrieval.answers(windowed, found, questions).collect()}
    assert not answers[1].answered and answers[1].citations == []
    assert answers[1].answer == "I don't see anything about that in this log."
    assert answers[0].answer.startswith("Based on [lines ") and answers[0].citations[0].start_line == top.start_line
    assert answers[0].context.startswith("Retrieved log excerpts:\n<<<LOG_DATA")


def test_questions_of_one_file_do_not_reach_another(spark):
    lines = line_table(spark, 20, lambda i: "disk full").union(spark.createDataFrame([(2, 1, "disk full")], "file_id long, line_no long, raw string"))
    questions = spark.createDataFrame([(1, 2, "disk")], "question_id long, file_id long, question string")
    shapes, windowed = retrieval.asked_windows(lines, questions)
    assert {r.file_id for r in retrieval.retrieve(windowed, shapes, questions).collect()} == {2}
    assert datetime.now().year > 2000


def test_knn_takes_string_ids(spark):
    rows = [(f"p{i:02}", "t", [math.cos(i / 10), math.sin(i / 10)]) for i in range(30)]
    points = spark.createDataFrame(rows, "id string, tenant string, vector array<double>")
    found = knn.nearest_neighbours(points, points, 2, skip_same_id=True).filter("query_id = 'p10'").collect()
    assert sorted((r["rank"], r["match_id"]) for r in found) == [(1, "p09"), (2, "p11")] or sorted(
        r["match_id"] for r in found
    ) == ["p09", "p11"]


def noted_cuts(monkeypatch, *modules):
    """Rows of every table that a module stores, by its name."""
    sizes = {}

    def noted(df, name):
        table = cut(df, name)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    for module in modules:
        monkeypatch.setattr(module, "cut", noted)
    return sizes


def test_a_query_is_not_copied_for_every_cell(spark, monkeypatch):
    sizes = noted_cuts(monkeypatch, knn)
    vectors = np.random.default_rng(6).normal(size=(200, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, 0, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, tenant long, vector array<double>")
    found = knn.nearest_neighbours(points, points, 3, skip_same_id=True, n_pivots=40, block_rows=64)
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -1)
    assert sorted((r["query_id"], r["rank"], r["match_id"]) for r in found.collect()) == [
        (q, n, int(m)) for q in range(200) for n, m in enumerate(np.argsort(-scores[q])[:3], 1)
    ]
    # Such vectors visit nearly all of the 40 cells; a result has at most a row for each of the 4 blocks and ranks.
    assert max(sizes.values()) <= 200 * 4 * 3


def test_questions_are_not_broadcast_on_a_guess(spark):
    """A small file of files with questions explodes into rows of any number; only measured tables are broadcast."""
    lines = spark.range(200).selectExpr("id % 20 as file_id", "id div 20 + 1 as line_no", "concat('database timeout ', id) as raw")
    files = cut(spark.range(20).withColumnRenamed("id", "file_id"), "files")
    asked = files.select("file_id", F.explode(F.array(F.lit("why did the database time out?"), F.lit("redis"))).alias("question"))
    questions = asked.withColumn("question_id", F.xxhash64("file_id", "question"))
    shapes, windowed = retrieval.asked_windows(lines, questions)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(shapes)
    found = retrieval.retrieve(cut(windowed, "windowed"), cut(shapes, "shapes"), questions)
    assert "Broadcast" not in plan(found)
    answers = retrieval.answers(cut(windowed, "windowed"), found, questions)
    assert "Broadcast" not in plan(answers) and answers.where("answered").count() == 20
