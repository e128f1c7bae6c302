"""Licence scan: phrases against a plain search, notices against planted texts."""

import random
import re

from logspark.llm import license_scan, license_texts, queries

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    found = words_of(text)
    places = []
    for t in license_texts.PHRASES:
        phrase = t.text.split()
        places += [(i, t.label) for i in range(len(found)) if found[i : i + len(phrase)] == phrase]
    starts = [i for i, _ in places]
    return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_op8_matches_plain_search(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op8_license_scan(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    seen = set()
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        labels = set(r["labels"].split(",")) - {""}
        seen |= labels
        assert set(r["base_labels"].split(",")) - {""} <= labels and 0 <= r["score"] <= 1
        plain = " ".join(words_of(text))
        for label, phrase in (("apache-2.0", "apache license version 2"), ("mit", "mit license"), ("cc-by-nc", "cc by nc 4"), ("gpl-3.0", "general public license version 3")):
            assert (label in labels) == (phrase in plain), (label, text)
    assert {"apache-2.0", "mit", "cc-by-nc", "gpl-3.0", "reserved"} <= seen


def test_changed_notices_and_odd_rows(spark):
    notice = next(t.text for t in license_texts.NOTICES if t.text.startswith("Permission is hereby"))
    pick = random.Random(1)
    filler = lambda n: " ".join("".join(pick.choice("bcdfgh") for _ in range(5)) for _ in range(n))
    changed = notice.split()
    changed[10:10] = ["really"]
    del changed[20]
    texts = {
        1: f"{filler(30)} {notice.upper()} {filler(9)}",
        2: f"{filler(3)} {' '.join(changed)}",
        3: " ".join(notice.split()[:9]),
        4: filler(500),
        5: "cc-by CC  BY cc by all rights reserved",
        6: "Licensed under the Apache License, Version 2.0. " * 300,
        7: "",
        8: None,
        9: "cc",
        10: "of the software and associated " * 50,
    }
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, "cc by", "x"), (5, texts[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    found = license_scan.scan(docs, license_texts.TEMPLATES).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for i, text in texts.items():
        assert tuple(by_id[i][1:6]) == base(text)
    assert [by_id[i]["labels"] for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)] == ["mit", "mit", "", "", "apache-2.0", "", "", "", ""]
    assert by_id[5]["labels"] == "cc-by,reserved" and by_id[None]["n_base"] == 1
    assert by_id[4]["score"] == 0 and by_id[1]["score"] == 1 and 0 < by_id[3]["score"] < 0.8
    spans = license_scan.verified(license_scan.spans(license_scan.hits(docs.where("doc_id = 1"), license_texts.TEMPLATES))).collect()
    assert [(s["label"], s["first_word"], s["last_word"]) for s in spans] == [("mit", 30, 29 + len(words_of(notice)))]
    assert license_scan.scan(docs.limit(0), license_texts.TEMPLATES).count() == 0
