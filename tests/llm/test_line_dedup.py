"""Line dedup against a plain alignment of all documents with the first holders of their lines."""

import random
import time

import numpy as np

from logspark.llm import line_dedup, queries, words

SF_DIR = "/root/testdata/sf0.001"


def norm(line):
    return tuple(line.translate({c: c + 32 for c in range(65, 91)}).split())


def brute(rows, min_words):
    """Kept texts; documents are compared by words, not by hashes."""
    numbers, firsts = {}, {}
    docs = []
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        keys = [numbers.setdefault(norm(x), 2 * len(numbers) + 1) if norm(x) else 0 for x in lines]
        docs.append((doc_id, text, lines, keys))
    kept = {}
    for n, (doc_id, text, lines, keys) in enumerate(docs):
        gone = set()
        for m in sorted({firsts[k] for k in keys if k in firsts}):
            gone |= line_dedup.shared_lines(docs[m][3], keys, [len(norm(x)) for x in lines], min_words)
        for k in keys:
            if k:
                firsts.setdefault(k, n)
        kept[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
    return kept


def test_op1_matches_plain_alignment(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["text"] for r in queries.op1_line_dedup(spark, SF_DIR).collect()}
    assert found == brute(rows, line_dedup.MIN_WORDS)
    assert found != dict(rows)


def test_alignment_is_common_and_rising():
    pick = random.Random(2)
    for _ in range(300):
        a = [pick.choice([0, 1, 3, 5, 7, 9, 11]) for _ in range(pick.randint(0, 15))]
        b = [pick.choice([0, 1, 3, 5, 7, 9, 11]) for _ in range(pick.randint(0, 15))]
        pairs = line_dedup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert line_dedup.aligned(a, a) == [(i, i) for i in range(len(a))]


def test_moved_and_repeated_blocks_go():
    p, q = [1, 3, 5], [7, 9, 11]
    assert line_dedup.shared_lines([*p, 13, *q], [*q, 15, *p], [5] * 7, 15) == {0, 1, 2, 4, 5, 6}
    assert line_dedup.shared_lines(p, [*p, 15, *p], [5] * 7, 15) == {0, 1, 2, 4, 5, 6}
    assert line_dedup.shared_lines(p, [1, 15, 3, 17, 5], [5] * 5, 6) == set()


def test_line_hashes_see_words_only():
    texts = [b"A b\n\n a  B \nab", b"", b"a b", b"\n"]
    offsets = np.cumsum([0, *map(len, texts)])
    hashes, sizes, first = line_dedup.line_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert first.tolist() == [0, 4, 5, 6, 8] and sizes.tolist() == [2, 0, 2, 1, 0, 2, 0, 0]
    assert hashes[0] == hashes[2] == hashes[5] != hashes[3] and hashes[1] == hashes[4] == hashes[6] == 0
    assert words.SPACED[1][0x20]


def test_copies_and_odd_rows(spark):
    pick = random.Random(4)
    line = lambda n: " ".join("".join(pick.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage, often = "\n".join(line(15) for _ in range(4)), line(12)
    rows = [(i, f"{line(30)}\n{often}\n{line(8)}") for i in range(300)]
    rows += [(1000, passage), (1001, f"{line(9)}\n{passage}\n{line(9)}"), (1002, line(40)), (1003, None), (1004, ""), (1005, "\n\n")]
    rows += [(2000 + i, passage.upper()) for i in range(100)] + [(3000, "short line"), (3001, "short line")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows] + [(None, passage, 5), (1002, rows[302][1], 5)], "doc_id long, text string, line int")
    found = line_dedup.deduplicate_lines(docs).collect()
    assert len(found) == len(rows) + 2
    expected = brute(rows, line_dedup.MIN_WORDS)
    assert {r["doc_id"]: r["text"] for r in found if r["doc_id"] is not None} == expected
    assert [r["text"] for r in found if r["doc_id"] is None] == [""]
    assert expected[1000] == passage and expected[1002] == rows[302][1] and expected[3001] == "short line"
    assert line_dedup.deduplicate_lines(docs.limit(0)).count() == 0


def common_blocks(rows, min_words):
    """Kept lines with words, after the removal of every block that any earlier document holds."""
    docs = [(i, [norm(x) for x in text.split("\n")]) for i, text in sorted(rows)]
    kept = {}
    for n, (i, later) in enumerate(docs):
        gone = set()
        for _, first in docs[:n]:
            for shift in range(-len(first), len(later)):
                block = []
                for j in range(len(later) + 1):
                    if j < len(later) and 0 <= j - shift < len(first) and later[j] == first[j - shift]:
                        block.append(j)
                    else:
                        if sum(len(later[b]) for b in block) >= min_words:
                            gone.update(block)
                        block = []
        kept[i] = [x for j, x in enumerate(later) if x and j not in gone]
    return kept


def test_blocks_of_lines_first_held_elsewhere_go(spark):
    pick = random.Random(6)
    lines = ["", *(" ".join(f"w{n}{k}" for k in range(pick.randint(1, 6))) for n in range(30)), "long " * 11]
    rows = [(i, "\n".join(pick.choices(lines, k=pick.randint(2, 40)))) for i in range(120)]
    rows += [(1001, "a b c d e f g\nx x"), (1002, "h i j k l m n\ny y"), (1003, "1\na b c d e f g\nh i j k l m n"), (1004, "2\nA b c d e f g\nh i j k l m n\n3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [norm(x) for x in r["text"].split("\n") if norm(x)] for r in line_dedup.deduplicate_lines(docs).collect()}
    assert found == common_blocks(rows, line_dedup.MIN_WORDS)
    assert found[1004] == [("2",), ("3",)]


def covered(first, later, sizes, min_words):
    """Lines with words of ``later`` in any run of ``min_words`` words that ``first`` holds, by all pairs of places."""
    gone, match = set(), [0] * (len(first) + 1)
    for j, x in enumerate(later):
        row = [0] * (len(first) + 1)
        for i, y in enumerate(first):
            row[i + 1] = match[i] + 1 if x == y else 0
        match = row
        n = max(row)
        if sum(sizes[j - n + 1 : j + 1]) >= min_words:
            gone.update(k for k in range(j - n + 1, j + 1) if later[k])
    return gone


def test_shared_lines_equal_all_common_runs():
    pick = random.Random(8)
    for _ in range(400):
        values = pick.choice([[0, 1, 3], [0, 1, 3, 5, 7, 9], list(range(1, 60, 2))])
        size_of = {x: 0 if x == 0 else 1 + x % 5 for x in values}
        first, later = ([pick.choice(values) for _ in range(pick.randint(0, 30))] for _ in range(2))
        if pick.random() < 0.5:
            a, b = sorted(pick.choices(range(len(first) + 1), k=2))
            later[pick.randint(0, len(later)) :] = first[a:b] + later[:5]
        sizes = [size_of[x] for x in later]
        gone = line_dedup.shared_lines(first, later, sizes, 10)
        assert {j for j in gone if later[j]} == covered(first, later, sizes, 10)


def test_long_repetitive_documents_take_little_time():
    pick = random.Random(5)
    cases = {
        "three kinds": [pick.choice([1, 3, 5]) for _ in range(40_000)],
        "one kind": [7] * 40_000,
        "table": [x for i in range(13_333) for x in (1, 3, 2 * i + 11)],
        "short cycle": [2 * (i % 97) + 1 for i in range(40_000)],
    }
    for name, lines in cases.items():
        blocks = [lines[20_000:][i : i + 20] for i in range(0, 20_000, 20)]
        for later in (lines[20_000:40_000], lines[19_990:39_990], [x for b in reversed(blocks) for x in b]):
            started = time.process_time()
            line_dedup.shared_lines(lines[:20_000], later, [4] * len(later), 10)
            assert time.process_time() - started < 2, name
