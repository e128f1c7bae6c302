"""Token records and packing against plain tokenisation."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logspark.llm import packing, queries, records, tokens
from logspark.operators.scale import new_path

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    "", None, "  a  b \n c\n\n d", "x  y", "à b é, c ß. d", "<|endoftext|> a <|startoftext|>", "it's he'll  we've",
    "　 z   a", "é a ́b", "a — , b —, c", "don't. 5,000.50 a1.b2", "\x1c a \x1c b", "tab\t x \t y",
    "a\r\nb\r\n c", "日本 語, x", "X!! Y!! a***  b$$$", "x" * 50_000,
]


def plain(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_encode_as_whole_texts(name):
    pick = random.Random(1)
    letters = ["a", "B", "é", " ", "  ", "\n", ".", ",", "!", " ", "1", "ß", "́", "—", "'", "s", "\t", "日", "|", "×", "\x85"]
    texts = ODD + ["".join(pick.choice(letters) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    encode = plain(name)
    for row, ids, bounds in tokens.encode_column(public_tokenizers.path(name), pa.array(texts, pa.string())):
        for i in range(len(bounds) - 1):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encode(texts[row + i]), texts[row + i]


def test_op5_matches_plain_encoding(spark):
    encode = plain("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    expected, start = [], 0
    for doc in docs:
        ids = [*encode(doc["text"]), 0]
        expected.append((doc["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    found = queries.op5_token_records(spark, SF_DIR)
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_records_of_odd_rows(spark):
    rows = [(i, text, "x") for i, text in enumerate(ODD)] + [(None, "no id", "x"), (3, "x  y", "x"), (3, "x  y", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = new_path(spark, "records")
    index = records.write_records(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 0)
    encode = plain("byte_bpe_50k.json")
    found = [(r["doc_id"], tuple(struct.unpack(f"<{r['n_tokens']}I", r["ids"]))) for r in records.read_records(index, folder).collect()]
    assert sorted(found, key=repr) == sorted(((i, (*encode(t), 0)) for i, t, _ in rows), key=repr)
    one = records.read_records(index.where("doc_id = 5"), folder).collect()
    assert [r["doc_id"] for r in one] == [5]
    empty = records.write_records(docs.limit(0), new_path(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert records.read_records(empty, folder).count() == 0


def test_damage_is_seen():
    record = records.frame(b"payload")
    assert records.unframe(record) == b"payload"
    for i in range(len(record)):
        broken = bytearray(record)
        broken[i] ^= 1
        with pytest.raises(records.DamagedRecord):
            records.unframe(bytes(broken))


def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda j: rooms[j])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_op7_matches_plain_encoding(spark):
    encode = plain("word_bpe_49k.json")
    rows = queries.op7_packing(spark, SF_DIR).collect()
    expected = []
    for doc in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = [*encode(doc["text"]), 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected.append((doc["doc_id"], piece, start, len(part), crc(part)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    assert check_packing(rows, 4096) == best_fit([x[3] for x in expected], 4096)


def test_plan_is_best_fit():
    pick = random.Random(5)
    for _ in range(60):
        capacity = pick.randint(1, 40)
        lengths = [pick.randint(1, capacity) for _ in range(pick.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.plan_runs(counts, capacity)
        rows = [
            {"sequence_id": first + s // per, "offset": offset + s % per * length, "length": length}
            for length, rank, n, per, first, offset in runs
            for s in range(n)
        ]
        assert len(rows) == len(lengths)
        assert sum(n for length, _, n, *_ in runs if length == 1) == counts.get(1, 0)
        assert check_packing(rows, capacity) == best_fit(lengths, capacity)


def test_packing_of_odd_rows(spark):
    rows = [(i, text, 1) for i, text in enumerate(ODD)] + [(None, "no id", 1)] + [(3, "same", 1)] * 9000
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    pieces = packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 16).cache()
    packed = packing.pack(pieces, 16)
    found = packed.collect()
    encode = plain("word_bpe_49k.json")
    assert sum(r["length"] for r in found) == sum(len(encode(t)) + 1 for _, t, _ in rows)
    check_packing(found, 16)
    whole = packing.sequences(pieces, packed.drop("ids")).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in found)
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.pack(pieces.limit(0), 16).count() == 0
