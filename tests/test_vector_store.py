"""The stored vector table against brute force, and which files an upsert replaces."""

from pathlib import Path

import numpy as np

from logspark.operators import knn, vector_store
from logspark.operators.scale import cut, new_path
from logspark.operators.vector_store import VectorStore

SCHEMA = "id string, tenant long, version int, vector array<double>"


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def table(spark, vectors, version=1, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(f"p{i:03}", int(i % 3 == 0), version, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(points, queries, k):
    out = {}
    for q, tenant, vector in queries:
        scored = sorted((-float(np.dot(vector, v)), i) for i, (t, v) in points.items() if t == tenant)
        out[q] = [i for _, i in scored[:k]]
    return out


def found(store, queries, k):
    out = {}
    for r in sorted(store.search(queries, k).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["match_id"])
    return out


def test_search_after_upserts_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = unit(rng.normal(size=(200, 8)))
    vectors[:70] = unit(vectors[0] + 0.05 * rng.normal(size=(70, 8)))
    store = VectorStore.create(table(spark, vectors), new_path(spark, "store"), cells=9)
    points = {f"p{i:03}": (int(i % 3 == 0), v) for i, v in enumerate(vectors)}
    queries = table(spark, unit(rng.normal(size=(25, 8))))
    asked = [(r["id"], r["tenant"], np.array(r["vector"])) for r in queries.collect()]
    assert found(store, queries, 4) == brute(points, asked, 4)

    moved = unit(rng.normal(size=(40, 8)))
    ids = list(range(0, 20)) + list(range(190, 210))
    assert store.upsert(table(spark, moved, 2, ids)) > 1
    points |= {f"p{i:03}": (int(i % 3 == 0), v) for i, v in zip(ids, moved, strict=True)}
    for _ in range(2):
        # Older versions lose, and a replay changes nothing.
        store.upsert(table(spark, unit(rng.normal(size=(5, 8))), 1, range(5)))
        store.upsert(table(spark, moved, 2, ids))
    assert {r["id"]: r["version"] for r in store.points().collect()} == {i: 2 if int(i[1:]) in ids else 1 for i in points}
    again = VectorStore(spark, store.path)
    assert found(again, queries, 4) == brute(points, asked, 4)


def test_an_upsert_replaces_touched_cells_only(spark):
    centres = np.eye(6)
    rng = np.random.default_rng(1)
    vectors = unit(np.repeat(centres, 20, axis=0) + 0.02 * rng.normal(size=(120, 6)))
    store = VectorStore.create(table(spark, vectors), new_path(spark, "store"), cells=12)
    folder = Path(store.path.removeprefix("file:")) / "points"
    files = lambda: {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    before, cell_of = files(), {r["id"]: r["cell"] for r in store.points().collect()}
    replaced = store.upsert(table(spark, vectors[[100]], 2, [7]))
    after, now = files(), {r["id"]: r["cell"] for r in store.points().collect()}
    touched = {cell_of["p007"], now["p007"]}
    assert replaced == len(touched) == 2
    changed = {f.parent.name for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}
    assert changed == {f"cell={c}" for c in touched}


def test_a_cell_that_loses_all_points_is_empty(spark):
    vectors = unit(np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]))
    store = VectorStore.create(table(spark, vectors), new_path(spark, "store"), cells=3)
    store.upsert(table(spark, vectors[[1]], 2, [0]))
    assert sorted((r["id"], r["vector"][1]) for r in store.points().collect()) == [("p000", 1.0), ("p001", 1.0), ("p002", 0.0)]
    assert store.upsert(table(spark, vectors[:0], 2, [])) == 0


def test_a_search_does_not_copy_queries_for_every_cell(spark, monkeypatch):
    sizes = {}

    def noted(df, name):
        stored = cut(df, name)
        sizes[name] = stored.count()
        return stored

    vectors = unit(np.random.default_rng(7).normal(size=(200, 16)))
    store = VectorStore.create(table(spark, vectors), new_path(spark, "store"), cells=30)
    for module in (knn, vector_store):
        monkeypatch.setattr(module, "cut", noted)
    # Matrices of a task hold some rows at a time, whatever the number of cells and points.
    monkeypatch.setattr(knn, "MATRIX", 256, raising=False)
    points = {f"p{i:03}": (int(i % 3 == 0), v) for i, v in enumerate(vectors)}
    queries = table(spark, vectors[:100])
    assert found(store, queries, 2) == brute(points, [(r["id"], r["tenant"], np.array(r["vector"])) for r in queries.collect()], 2)
    assert max(sizes.values()) <= 100 * 2
