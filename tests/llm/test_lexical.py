"""The dual-tree search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from logspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(term for _, c in counted for term in c)
    out = []
    for item_id, text in items:
        asked, scores = Counter(terms(text)), []
        for (doc_id, c), size in zip(counted, sizes, strict=True):
            score = 0
            for term, times in asked.items():
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += times * weight * (10**9 * c[term] // (1000 * c[term] + 8 * (25 + 75 * size * n // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(spark, docs, items, k):
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n long").repartition(5)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return [tuple(r) for r in lexical.top_documents(frame, asked, k).collect()]


def made(seed, documents):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weight, k=rng.choice([0, 3, 20, 80])))) for i in range(documents)]
    docs += [(10_000 + i, docs[i % 5][1]) for i in range(60)]
    items = [(i, ", ".join(rng.choices(vocabulary, k=rng.choice([1, 6, 20])))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("block_terms", [lexical.BLOCK_TERMS, 30])
def test_search_equals_scoring_everything(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical, "SAMPLE", 100)
    docs, items = made(block_terms, 1500 if block_terms > 30 else 300)
    items = items if block_terms > 30 else items[:12]
    assert sorted(found(spark, docs, items, 10)) == sorted(plain_search(docs, items, 10))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!?"), (None, "Alpha beta"), (5, "alpha BETA"), (5, "alpha BETA"), (6, "alpha " * 300_000)]
    items = [(1, "alpha"), (2, None), (3, ""), (4, "nowhere"), (5, "beta beta"), (5, "beta beta"), (None, "beta")]
    expected = plain_search(docs, items, 2)
    assert sorted(map(str, found(spark, docs, items, 2))) == sorted(map(str, expected))
    assert found(spark, [(1, None)], items, 2) == [] == found(spark, docs, [(1, "")], 2)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.top_documents(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_bounds_hold_and_leave_documents_out():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 12, 4000)
    first = np.append(0, np.cumsum(sizes))
    topic = np.repeat(rng.integers(0, 40, 4000), sizes)
    at = topic * 10 + rng.integers(0, 10, first[-1])
    rows = [np.unique(at[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    coordinates = lexical.Sparse(np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows), rng.integers(1, 1000, sum(map(len, rows))))
    tree = lexical.DocumentTree(np.arange(4000), coordinates)
    item = lexical.ItemNode(np.array([0]), np.array([31, 34, 38]), np.array([1, 2, 1]), [])
    scratch = np.zeros(400, np.int64)
    scores = item.times(tree.levels[0], scratch)
    for level in range(1, len(tree.levels)):
        bound = item.times(tree.levels[level], scratch)
        below = np.maximum.reduceat(scores, np.arange(0, len(scores), lexical.FAN**level))
        assert (bound >= below).all()
    best, looked = lexical.Best(1, 5, np.zeros(1, np.int64), 400), []
    add = best.add
    best.add = lambda item_no, ids, got: (looked.append(len(ids)), add(item_no, ids, got))
    lexical.search(item, tree, *tree.top(), best)
    assert best.found[0][0].tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert sum(looked) < 400
