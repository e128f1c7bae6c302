"""Each stage of the pipeline against a plain version on what the stage before kept."""

import re
from collections import Counter

import numpy as np
import test_line_dedup
import test_minhash
import test_mixing_hilbert
import test_tokens
from pyspark.sql import functions as F

import corpus_pipeline
from logspark.llm import common, line_dedup, queries

SF_DIR = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    states = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        states.append(common.stored(stage(spark, states[-1], SF_DIR), f"stage-{number}"))
    for state in states[1:-1]:
        assert state.columns == docs.columns and state.dtypes == docs.dtypes
    rows = [state.collect() for state in states]

    good = {r["doc_id"] for r in queries.op4_quality(spark, SF_DIR).collect() if r["predicted"]}
    assert sorted(map(tuple, rows[1])) == sorted(tuple(r) for r in rows[0] if r["doc_id"] in good)
    assert len(rows[1]) < len(rows[0])

    texts = test_line_dedup.brute([(r["doc_id"], r["text"]) for r in rows[1]], line_dedup.MIN_WORDS)
    before = {r["doc_id"]: r["text"] for r in rows[1]}
    expected = {i: t for i, t in texts.items() if t == before[i] or size(t)}
    assert {r["doc_id"]: r["text"] for r in rows[2]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])

    kept = {i for i, _, _, k in test_minhash.brute([(r["doc_id"], r["text"]) for r in rows[2]], 80) if k}
    assert sorted(map(tuple, rows[3])) == sorted(tuple(r) for r in rows[2] if r["doc_id"] in kept)

    sources = sorted({r["source"] for r in rows[3]})
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in rows[3]:
        sizes[r["source"]] += size(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    for r in rows[4]:
        taken[r["source"]] += size(r["text"])
    goal = test_mixing_hilbert.plain_targets([sizes[s] for s in sources], [[5, 2, 1][i % 3] for i in range(len(sources))], 3)
    assert all(abs(taken[s] - g) <= largest[s] for s, g in zip(sources, goal, strict=True))
    assert {tuple(r) for r in rows[4]} <= {tuple(r) for r in rows[3]}
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 3

    encode = test_tokens.plain("word_bpe_49k.json")
    pieces = Counter()
    for r in rows[4]:
        ids = [*encode(r["text"]), 1]
        pieces.update((r["doc_id"], n, tuple(ids[a : a + 4096])) for n, a in enumerate(range(0, len(ids), 4096)))
    assert Counter((r["doc_id"], r["piece"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows[5]) == pieces
    test_tokens.check_packing(rows[5], 4096)

    again = corpus_pipeline.run(spark, SF_DIR).collect()
    key = lambda r: (r["doc_id"], r["piece"], bytes(r["ids"]))
    assert sorted(map(key, again)) == sorted(map(key, rows[5]))


def test_odd_documents_pass(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words here", "en", None, 15), (4, "some words", "en", "t", 10)]
    for number, picked in enumerate((rows, [])):
        folder = str(tmp_path / str(number))
        spark.createDataFrame(picked, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in found} == ({None, 4} if picked else set())


CLASHING = [
    "size", "shard", "pass", "words", "place", "block", "lines_deleted", "lines_before", "_kept", "kept_id", "quality_score", "_range", "_first", "_cells", "_id",
    "_version", "_deleted", "deleted", "id", "version", "row", "key", "_key", "_quota", "mix_taken", "mix_place", "one", "held", "c0", "start", "draw", "dotted.name",
]


def test_clashing_columns_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    wide = docs.select("*", *[F.concat_ws("-", F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING])
    wide = wide.withColumn("size", F.lit(7))
    plain, kept = docs, wide
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        plain = common.stored(stage(spark, plain, SF_DIR), f"plain-{number}")
        kept = common.stored(stage(spark, kept, SF_DIR), f"wide-{number}")
        assert kept.columns == wide.columns
        assert sorted(map(tuple, kept.select(docs.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert kept.where("size != 7").count() == 0
        for c in CLASHING[1:]:
            assert kept.where(~F.col(f"`{c}`").eqNullSafe(F.concat_ws("-", F.lit(c), F.col("doc_id")))).count() == 0
    pieces = corpus_pipeline.packing_stage(spark, kept, SF_DIR)
    assert pieces.count() == corpus_pipeline.packing_stage(spark, plain, SF_DIR).count()
