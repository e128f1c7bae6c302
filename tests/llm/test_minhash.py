"""Near duplicates against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from logspark.llm import common, minhash, queries

SF_DIR = "/root/testdata/sf0.001"


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def smallest(links, nodes):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    holders = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders[x].add(n)
    links = []
    for n, (i, s) in enumerate(sets):
        for m in {m for x in s for m in holders[x] if m > n}:
            j, t = sets[m]
            if i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                links.append((i, j))
    label = smallest(links, {i for i, _ in rows if i is not None})
    return sorted(((i, len(s), label.get(i), i is None or label[i] == i) for i, s in sets), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op9_matches_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op9_minhash(spark, SF_DIR)) == brute(rows, 85)


def test_groups_chains_and_odd_rows(spark):
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = [(900, " ".join(base)), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "ONE  two"), (10, "two one")]
    chain = list(base)
    for i in range(40):  # each step changes one word, so the ends of the chain differ
        chain[(i * 7) % 120] = word()
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, " ".join(base[:60] + [word() for _ in range(60)])) for i in range(40)]
    rows += [(3000 + i, " ".join(base)) for i in range(50)] + [(None, " ".join(base)), (3000, " ".join(base))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, band string")
    for percent in (80, 85):
        assert found(minhash.near_duplicates(docs, percent)) == brute(rows, percent)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_shared_counts_match_sets():
    source = np.random.default_rng(1)
    sets = [np.unique(source.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 4000, 6000, 6000)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    found = minhash.shared_counts(sets)
    assert all(found[i, j] == expected[i][j] for i in range(6) for j in range(6) if i != j)


def test_signatures_estimate_jaccard():
    first = np.arange(2000, dtype=np.uint64)
    second = np.arange(300, 2300, dtype=np.uint64)
    circulant = minhash.Circulant(64)
    a, b = circulant.bands_of([first, second])
    assert abs((a == b).mean() - (1700 / 2300) ** minhash.ROWS) < 0.2
    assert (circulant.bands_of([first, first])[0] == a).all()


def test_long_text_equals_its_parts():
    text = "Lorem Ipsum dolor " * 200_000
    (_, sets), = minhash.shingle_sets(pa.array([text]))
    assert len(sets[0]) == 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 100)] + [(7, 7), (900, 901), (901, 900)]
    rows = common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    expected = {**{i: 0 for i in range(201)}, **{500 + i: 500 for i in range(100)}, 900: 900, 901: 900}
    assert {r["node"]: r["component"] for r in rows} == expected
    assert len(rows) == len(expected)


def test_texts_that_share_a_template_do_not_meet(spark):
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(5))
    template = [word() for _ in range(100)]
    # 96 shared shingles of 316 in the union: a similarity of 0.3.
    rows = [(i, " ".join(template + [word() for _ in range(110)])) for i in range(1000)]
    near = rows[17][1].split()
    near[150] = "changed"
    rows += [(5000, rows[3][1].upper()), (5001, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = docs.mapInArrow(lambda batches: minhash._signatures(batches, minhash.bands_for(0.8)), minhash.SIGNATURE_SCHEMA)
    ties = minhash._ties(common.stored(signed, "signed"), 80)
    sizes = common.components(ties, "template").groupBy("component").count().collect()
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in sizes) < 5000
    kept = {r["doc_id"] for r in minhash.near_duplicates(docs, 80).collect() if not r["kept"]}
    assert kept == {5000, 5001}


def test_marks_of_a_pair_at_the_threshold_agree():
    circulant = minhash.Circulant(minhash.bands_for(0.8))
    low = []
    for n in range(200):
        base = minhash.words.mix(np.arange(n * 5000, n * 5000 + 1125, dtype=np.uint64))
        marks = circulant.signed([base[:1000], base[125 : 125 + 1000]])[1]  # 875 of 1,125 shared: 0.78
        low.append(int((marks[0] == marks[1]).sum()))
    assert min(low) >= minhash.least_agreement(0.78) and minhash.least_agreement(0.8) > 0.5 * minhash.MARKS
