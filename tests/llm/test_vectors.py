"""Vector operators against all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F
from test_minhash import smallest

from logspark.llm import ann_forest, embedding_dedup, queries, vectors

SF_DIR = "/root/testdata/sf0.01"


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def unit_rows(rows):
    """(ids, unit vectors) of the usable rows of one width."""
    x = np.array([v for _, v in rows], np.float64)
    return [i for i, _ in rows], x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def widths(rows):
    kept = [(i, v) for i, v in rows if i is not None and usable(v)]
    return [[(i, v) for i, v in kept if len(v) == w] for w in sorted({len(v) for _, v in kept})]


def brute_links(rows, threshold):
    used, edges, degree = [], [], []
    for own in widths(rows):
        ids, x = unit_rows(own)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        edges += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)]
        degree += zip(ids, linked.sum(1).tolist(), strict=True)
        used += own
    label = smallest(edges, {i for i, _ in degree})
    rest = list(rows)
    for row in used:
        rest.remove(row)
    out = [(i, n, label[i], label[i] == i) for i, n in degree]
    return sorted(out + [(i, 0, label.get(i, i), label.get(i, i) == i) for i, v in rest], key=repr)


def read(spark):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]


def test_op3_matches_all_pairs(spark):
    found = sorted((tuple(r) for r in queries.op3_embedding_dedup(spark, SF_DIR).collect()), key=repr)
    expected = brute_links(read(spark), 0.95)
    assert found == expected


def odd_vectors():
    source = np.random.default_rng(2)
    base = source.normal(size=(30, 16))
    rows = [(i, [float(x) for x in base[i % 30] + source.normal(size=16) * 0.02 * (1 + i % 4)]) for i in range(900)]
    rows += [(1000 + i, [float(x) for x in base[0]]) for i in range(700)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [math.nan] * 16), (2005, [math.inf] + [1.0] * 15)]
    rows += [(2006, [1.0, 2.0]), (None, rows[0][1]), (2007, [float(x) * 1e-30 for x in base[1]])]
    # Two more widths: two equal vectors, near ones, one with nothing near it, one alone.
    return rows + [(2010, [1.0, 2.0]), (2020, [2.0, 4.01]), (2040, [-1.0, 0.5]), (2060, [3.0])]


def test_dedup_of_groups_and_odd_rows(spark):
    rows = odd_vectors()
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rep int")
    found = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame, 0.95).collect()), key=repr)
    assert found == brute_links(rows, 0.95)
    assert embedding_dedup.near_duplicates(frame.limit(0), 0.95).count() == 0


def brute_nearest(rows, is_query, k):
    out = {}
    for own in widths(rows):
        ids, x = unit_rows(own)
        for n, i in enumerate(ids):
            if is_query(i):
                order = sorted((-s, j) for s, j in zip(x @ x[n], ids, strict=True) if j != i)
                out[i] = [(j, -s) for s, j in order[:k]]
    return {i: nearest for i, nearest in out.items() if nearest}


def recall(found, expected):
    hit = total = 0
    for query, nearest in expected.items():
        own = found.get(query, [])
        assert len(own) == len(nearest)
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        last = nearest[-1][1]
        hit += sum(r["score"] >= last - 1e-12 for r in own)
        total += len(nearest)
    return hit / total


def by_query(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_op2_recall(spark):
    rows = read(spark)
    found = by_query(queries.op2_ann_forest(spark, SF_DIR))
    expected = brute_nearest(rows, lambda i: i % 50 == 0, 5)
    assert recall(found, expected) >= 0.9
    unit = dict(zip(*unit_rows(rows), strict=True))
    for query, own in found.items():
        assert all(abs(r["score"] - unit[query] @ unit[r["vec_id"]]) < 1e-12 for r in own)


def test_search_of_groups_and_odd_rows(spark):
    rows = odd_vectors()
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, leaf int")
    found = by_query(ann_forest.search(frame, F.col("vec_id") % 20 == 0, k=5))
    expected = brute_nearest(rows, lambda i: i % 20 == 0, 5)
    assert set(found) == set(expected) and recall(found, expected) >= 0.9
    assert [r["vec_id"] for r in found[2020]] == [2006, 2010, 2040] and 2060 not in found
    # Among hundreds of copies the smallest ids win.
    assert [r["vec_id"] for r in found[1100]] == [1000, 1001, 1002, 1003, 1004]
    few = by_query(ann_forest.search(frame.where("vec_id < 3"), F.lit(True), k=5))
    assert {q: len(r) for q, r in few.items()} == {0: 2, 1: 2, 2: 2}
    assert ann_forest.search(frame.limit(0), F.lit(True), k=5).count() == 0


def test_forest_goes_deeper_than_its_sample():
    source = np.random.default_rng(4)
    unit = vectors.directions(source.normal(size=(4000, 8)))
    forest = ann_forest.fit(unit[:100], rows=4000, trees=3, leaf=4)
    leaves = forest.leaves(unit)
    assert forest.directions.shape[1] == 10 and len(np.unique(leaves[:, 0])) > 300
    for i in range(200, 250):  # rows of the sample may lie exactly on a threshold
        assert set(enumerate(leaves[i].tolist())) <= set(forest.best_leaves(unit[i], probes=3)) | set(forest.best_leaves(unit[i], probes=2000))
        assert forest.best_leaves(unit[i], probes=3)[0] in set(enumerate(leaves[i].tolist()))


def test_recall_holds_where_few_leaves_are_visited(spark):
    unit = vectors.directions(np.random.default_rng(7).normal(size=(6000, 48)))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(unit.tolist())], "vec_id long, embedding array<double>")
    forest = ann_forest.fit(unit, rows=len(unit), leaf=6)
    leaves = forest.leaves(unit).tolist()
    score = unit[::30] @ unit.T
    score[np.arange(200), np.arange(0, 6000, 30)] = -1
    nearest = np.argsort(-score, axis=1)[:, :5]

    def share(probes):
        seen = [set(forest.best_leaves(v, probes)) for v in unit[::30]]
        return np.mean([not seen[q].isdisjoint(enumerate(leaves[j])) for q in range(200) for j in nearest[q]])

    # 384 of 8,192 small leaves are as few as the whole forest has at a hundred thousand rows.
    assert share(384) < 0.9
    probes = ann_forest.measured_probes(frame, F.col("vec_id") % 30 == 0, 5, forest)
    assert 384 < probes < 2048 and share(probes) >= 0.9
