"""The importance draw against a plain version, run checksums and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from logspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(found), [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def plain_draw(docs, target, percent, longest, buckets, least):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    own = [(doc_id, *runs(text, longest)) for doc_id, text in docs]
    s = Counter(bucket(r) for _, _, found in own for r in found)
    t = Counter(bucket(r) for text in target for r in runs(text, longest)[1])
    big_s, big_t = s.total(), t.total()
    rows = []
    for doc_id, words, found in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = {id(r): rank for rank, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(str((*r[:4], drawn.get(id(r)))) for r in rows)


def test_draw_equals_a_plain_one(spark):
    texts = [f"Item{i % 9}, runs ON-and on; é{i % 4}è {'word ' * (i % 30)}{i}" for i in range(400)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[40]), (500, None), (501, ""), (502, "a\x00b c 1")]
    docs.append((600, "lo ng " * 200_000))
    target = [texts[5], texts[8], None, "", "runs on on"]
    frame = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_words int").repartition(6)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for longest, buckets in ((1, 10_000), (3, 97)):
        found = importance.resample(frame, wanted, percent=25, longest=longest, buckets=buckets, least_words=5)
        assert sorted(str(tuple(r)) for r in found.collect()) == plain_draw(docs, target, 25, longest, buckets, 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three " * 10)], "doc_id long, text string")
    assert importance.resample(docs.limit(0), docs).count() == 0
    assert [r["rank"] for r in importance.resample(docs, docs.limit(0), percent=100).collect()] == [1]


def test_chained_checksums_are_those_of_joined_words():
    found = [b"one", b"two", b"\xc3\xa9", b"two"]
    counts = importance.run_checksums(found, 3)
    joined = [b" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(5 - n)]
    assert counts == Counter(map(zlib.crc32, joined))
