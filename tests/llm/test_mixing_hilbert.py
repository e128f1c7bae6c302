"""Mixing targets and shares, Hilbert order and shards."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from logspark.llm import hilbert, mixing, queries
from logspark.operators.scale import new_path

SF_DIR = "/root/testdata/sf0.001"


def plain_targets(sizes, weights, most):
    """Share by weight again and again, a step at a time."""
    target, open_sources, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while left > 1e-9 * (sum(sizes) + 1) and open_sources:
        weight = sum(weights[i] for i in open_sources)
        excess = 0.0
        for i in sorted(open_sources):
            target[i] += left * weights[i] / weight
        for i in sorted(open_sources):
            if target[i] >= most * sizes[i]:
                excess += target[i] - most * sizes[i]
                target[i] = most * sizes[i]
                open_sources.discard(i)
        left = excess
    return target


def spark_targets(spark, sizes, weights, most):
    rows = [(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
    found = mixing.with_targets(spark.createDataFrame(rows, "i int, size long, weight double"), most)
    return [r["target"] for r in found.orderBy("i").collect()]


def test_targets_match_plain_resharing(spark):
    for sizes in ([10, 10, 10], [1, 100, 1000], [0, 5, 500, 1], [7], [0, 0], []):
        weights = [[5, 2, 1][i % 3] for i in range(len(sizes))]
        assert np.allclose(spark_targets(spark, sizes, weights, 3), plain_targets(sizes, weights, 3))


def test_tree_splits_exactly():
    counts = np.array([1000, 1, 0, 250])
    totals = mixing.equal_shards(1251, 7)
    table = mixing.split_blocks(counts, totals, [1])
    assert table.sum(0).tolist() == counts.tolist() and (table >= 0).all()
    assert table.sum(1).tolist() == totals.tolist() and np.ptp(totals) <= 1
    assert (table == mixing.split_blocks(counts, totals, [1])).all()


def check_mix(rows, sizes_of, exact=True):
    by_source = defaultdict(list)
    for r, source in rows:
        by_source[source].append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    goal = plain_targets([sizes_of[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))], 3)
    for name, target in zip(names, goal, strict=True):
        assert abs(by_source[name][0]["target"] - target) < 1e-6
        taken = sum(r["taken"] for r in by_source[name])
        assert abs(taken - target) <= (1 if exact else max(r["size"] for r in by_source[name]))
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes_of[name] for r in by_source[name])


def test_op10_reaches_its_targets(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op10_mixing(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or ""))
        sizes[docs[r["doc_id"]]["source"]] += r["size"]
    check_mix([(r, docs[r["doc_id"]]["source"]) for r in rows], sizes)
    assert sorted(map(str, queries.op10_mixing(spark, SF_DIR).collect())) == sorted(map(str, rows))


def test_mix_of_odd_rows_and_shards(spark):
    rows = [(i, "big", 40 + i % 13, 1) for i in range(3000)] + [(i, "small", 20, 1) for i in range(3)]
    rows += [(1, None, 5, 1), (None, None, 7, 1), (2, "none", 0, 1), (7, "big", 44, 1), (7, "big", 44, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, shard int")
    sizes = Counter()
    for _, source, size, _ in rows:
        sizes[source] += size
    for whole in (False, True):
        mixed = mixing.mix(docs, (5, 2, 1), shards=4, block_words=64, whole=whole)
        assert mixed.columns == [*docs.columns, "mix_source_size", "mix_target", "mix_taken"]
        digest = mixed.select("source", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.expr("aggregate(mix_taken, 0L, (a, b) -> a + b.words)").alias("taken"), "mix_taken").collect()
        assert len(digest) == len(rows)
        check_mix([(r, r["source"]) for r in digest], sizes, exact=not whole)
        if whole:
            assert all(one["words"] == r["size"] for r in digest for one in r["mix_taken"])
    shards = Counter(one["shard"] for r in digest for one in r["mix_taken"])
    assert set(shards) == {0, 1, 2, 3} and max(shards.values()) < 1.2 * min(shards.values())
    assert mixing.taken_rows(mixed.drop("shard")).count() == sum(shards.values())
    assert mixing.mix(docs.limit(0), (5, 2, 1)).count() == 0


def replay(rows, bounds_of, shards, width, whole=False, seed=17):
    """Walk each source's stream a document at a time: (place in rows, pass, words, shard, block) of every taking."""
    out = []
    for quota, bounds, own in bounds_of:
        order = sorted(own, key=lambda n: ((rows[n]["draw"] % (1 << 64)) >> 11, rows[n]["doc_id"] is not None, rows[n]["doc_id"] or 0, rows[n]["size"]))
        at, turn = 0, 0
        while at < quota and any(rows[n]["size"] for n in own):
            for n in order:
                words = max(0, min(rows[n]["size"], quota - at))
                if whole:
                    words = rows[n]["size"] if words * 2 >= rows[n]["size"] else 0
                shard = sum(b <= at // width for b in bounds) - 1
                if words > 0 and shard < shards:
                    out.append((n, turn, words, shard, at // width))
                at += rows[n]["size"]
            turn += 1
    return sorted(out)


def mixing_rows(spark):
    rows = [(i, "big", 40 + i % 13) for i in range(3000)] + [(i, "small", 20) for i in range(3)] + [(i, f"s{i % 7}", i % 90) for i in range(400)]
    rows += [(1, None, 5), (None, None, 7), (2, "none", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_every_taking_equals_a_plain_replay_of_the_streams(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 3)
    docs = mixing_rows(spark)
    key = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))
    drawn = docs.withColumn("key", key).withColumn("draw", F.xxhash64(F.lit(17), "doc_id", "key", "size"))
    totals = drawn.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    table, width = mixing.plan(totals, (5, 2, 1), 3, 4, 64, 17)
    table = {r["key"]: r for r in table.collect()}
    for whole in (False, True):
        mixed = mixing.mix(docs, (5, 2, 1), shards=4, block_words=64, whole=whole).withColumn("key", key)
        found = mixed.withColumn("draw", F.xxhash64(F.lit(17), "doc_id", "key", "size")).collect()
        sources = [(table[k]["quota"], table[k]["bounds"], [n for n, r in enumerate(found) if r["key"] == k]) for k in table]
        taken = sorted((n, t["pass"], t["words"], t["shard"], t["block"]) for n, r in enumerate(found) for t in r["mix_taken"])
        assert width == 64 and taken == replay(found, sources, 4, width, whole)
    blocks = Counter()
    for r in table.values():
        assert r["bounds"][-1] == -(-r["quota"] // width)
        blocks.update({k: b - a for k, (a, b) in enumerate(zip(r["bounds"], r["bounds"][1:], strict=False))})
    assert max(blocks.values()) - min(blocks.values()) <= 1


def test_nothing_is_taken_without_the_tree(spark, monkeypatch):
    docs = mixing_rows(spark)
    monkeypatch.setattr(mixing, "split_blocks", lambda counts, totals, seed: np.zeros((len(totals), len(counts)), np.int64))
    # The tree of a group runs in a worker, which sees the function that is sent along.
    monkeypatch.setattr(mixing, "_split_group", lambda table, of_group, seed: table.select(["key", "source_size", "target", "quota", "buckets"]).append_column("bounds", [[[0] * 5] * len(table)]))
    mixed = mixing.mix(docs, (5, 2, 1), shards=4, block_words=64)
    assert mixed.where("size(mix_taken) > 0").count() == 0


def test_blocks_widen_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    sizes, docs = Counter(), mixing_rows(spark)
    for r in docs.collect():
        sizes[r["source"]] += r["size"]
    digest = mixing.mix(docs, (5, 2, 1), shards=4, block_words=64).select("source", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.expr("aggregate(mix_taken, 0L, (a, b) -> a + b.words)").alias("taken"))
    check_mix([(r, r["source"]) for r in digest.collect()], sizes)


def test_clashing_columns_keep_their_values(spark):
    docs = mixing_rows(spark)
    extra = ["key", "row", "draw", "bucket", "start", "pass", "words", "shard", "place", "position", "part", "mix_words"]
    wide = docs.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in extra])
    plain = mixing.taken_rows(mixing.mix(docs, (5, 2, 1)))
    found = mixing.taken_rows(mixing.mix(wide, (5, 2, 1)))
    assert found.count() == plain.count()
    for c in extra[:-1]:
        assert found.where(~F.col(c).eqNullSafe(F.concat_ws("-", F.lit(c), "doc_id"))).count() == 0


def test_curve_visits_neighbours(spark):
    for dimensions, bits in ((2, 3), (3, 2), (4, 2), (2, 1), (1, 3)):
        cells = list(itertools.product(range(1 << bits), repeat=dimensions))
        frame = spark.createDataFrame([(list(c),) for c in cells], "_cells array<int>")
        for name, sql in hilbert.curve_index("_cells", dimensions, bits):
            frame = frame.withColumn(name, F.expr(sql))
        at = {r["_curve"]: r["_cells"] for r in frame.collect()}
        assert sorted(at) == list(range(len(cells)))
        if dimensions > 1:
            assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def check_shards(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_op6_shards(spark):
    frame = queries.op6_hilbert(spark, SF_DIR)
    assert "Python" not in (plan := frame._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    rows = frame.collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in texts.items())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    check_shards(rows, 8)


def test_shards_of_odd_rows_and_files(spark, tmp_path):
    rows = [(i, f"text {i}", "s" * (i % 5), i * 7 % 100, 1) for i in range(500)]
    rows += [(None, None, None, None, 1), (3, "", "é", 5, 1), (3, "", "é", 5, 1)] + [(9, "same", "hot", 1, 1)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, slot int")
    placed = hilbert.shard_rows(docs, ["source", "n_chars"], shards=8)
    found = placed.select(F.col("shard_number").alias("shard"), F.col("shard_slot").alias("slot")).collect()
    assert len(found) == len(rows)
    check_shards(found, 8)
    hilbert.write_shards(placed, folder := new_path(spark, "shards"))
    assert spark.read.parquet(folder).where("shard_number = 2").count() == sum(r["shard"] == 2 for r in found)
    assert hilbert.shard_rows(docs.limit(0), ["source", "n_chars"], shards=8).count() == 0


def test_strings_count_whole(spark):
    """Sources that begin alike are separated, so a file holds few of them."""
    rows = [(n, None, f"common_crawl_{n % 40:02}", n % 97) for n in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    placed = hilbert.shard_rows(docs, ["source", "n_chars"], shards=16)
    sources = placed.groupBy("shard_number").agg(F.countDistinct("source").alias("n")).collect()
    assert max(r["n"] for r in sources) <= 20
    assert hilbert.bits_for(10**12, 4) > hilbert.bits_for(10**6, 4) == hilbert.LEAST_BITS


def test_clashing_columns_of_shards(spark):
    docs = spark.createDataFrame([(n, f"t{n % 9}", f"s{n % 5}", n % 31) for n in range(300)], "doc_id long, text string, source string, n_chars long")
    extra = ["_range", "_first", "_cells", "_at", "_rows", "_before", "_curve", "_turned", "_gray", "position", "row", "id", "check", "number", "slot", "d0", "step", "value", "shard_slot"]
    wide = docs.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in extra])
    found = hilbert.shard_rows(wide, ["source", "n_chars"], shards=8)
    assert found.columns == [*[c for c in wide.columns if c != "shard_slot"], "shard_number", "shard_slot"]
    for c in extra[:-1]:
        assert found.where(~F.col(c).eqNullSafe(F.concat_ws("-", F.lit(c), "doc_id"))).count() == 0
    plain = hilbert.shard_rows(docs, ["source", "n_chars"], shards=8)
    both = ["doc_id", "shard_number", "shard_slot"]
    assert sorted(map(tuple, found.select(both).collect())) == sorted(map(tuple, plain.select(both).collect()))
