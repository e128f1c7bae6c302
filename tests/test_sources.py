import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from logspark.operators.scale import cut, join_to_many, new_path, number_rows, shared_dir
from logspark.sources import lines, manifest, sinks


def folder() -> Path:
    return Path(tempfile.mkdtemp(prefix="run-"))


def test_universal_newlines_and_numbering(spark):
    texts = spark.createDataFrame([(1, "a\r\nb\rc\n\nd\n"), (2, ""), (3, "\n"), (4, "x")], "file_id long, content string")
    rows = lines.lines_of_texts(texts).orderBy("file_id", "line_no").collect()
    assert [(r.file_id, r.line_no, r.raw) for r in rows] == [
        (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, ""), (1, 5, "d"), (3, 1, ""), (4, 1, "x"),
    ]
    assert lines.counted_lines(lines.lines_of_texts(texts)).count() == 5


def test_undecodable_bytes_are_replaced(spark):
    path = folder()
    (path / "a.log").write_bytes(b"ok\nbad \xff byte\n")
    rows = lines.read_small_files(spark, str(path)).orderBy("line_no").collect()
    assert [r.raw for r in rows] == ["ok", "bad � byte"]


def test_split_files_are_numbered_like_whole_files(spark):
    path = folder()
    for name, n in (("a.log", 900), ("b.log", 1), ("c.log", 400)):
        (path / name).write_text("".join(f"{name} line {i}\n" if i % 7 else "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        split = lines.read_large_files(spark, str(path))
        assert split.rdd.getNumPartitions() > 3
        left = {(Path(r.file_id).name, r.line_no, r.raw) for r in split.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    right = {(Path(r.file_id).name, r.line_no, r.raw) for r in lines.read_small_files(spark, str(path)).collect()}
    assert left == right and len(left) == 1301


def test_number_rows_with_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(7)).alias("g"), (5000 - F.col("id")).alias("o")
    )
    numbered = number_rows(rows, ["g"], ["o"], "n")
    expected = rows.selectExpr("g", "o", "row_number() over (partition by g order by o) n")
    assert numbered.select("g", "o", "n").exceptAll(expected.selectExpr("g", "o", "cast(n as long) n")).count() == 0
    assert numbered.count() == 5000


def test_join_to_many_is_the_same_with_and_without_broadcast(spark):
    many = spark.range(1000).selectExpr("id % 10 as k", "id")
    one = spark.range(8).selectExpr("id as k", "id * 2 as v")
    small = join_to_many(many, one, ["k"], "id", "t")
    salted = join_to_many(many, one, ["k"], "id", "t", max_bytes=1, hot_rows=50, ways=4)
    assert sorted(small.collect()) == sorted(salted.select(*small.columns).collect())
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()


def test_manifest_limits_and_duplicates(spark):
    big = "x" * (1024 * 1024 + 1)
    texts = spark.createDataFrame(
        [(1, "u", "a.tar.gz", "same"), (2, "u", "b", "same"), (3, "v", ".bashrc", "same"), (4, "u", "c.log", " \n"), (5, "u", "d.log", big)],
        "file_id long, user_id string, filename string, content string",
    )
    rows = manifest.manifest_of_texts(texts)
    accepted, rejected = manifest.split_manifest(rows)
    assert {r.file_id: r.reason for r in rejected.collect()} == {4: "empty", 5: "too large"}
    assert {r.file_id: r.suffix for r in accepted.collect()} == {1: ".gz", 2: ".log", 3: ".log"}
    flags = {r.file_id: r.is_duplicate for r in manifest.flag_duplicates(accepted).collect()}
    assert flags == {1: False, 2: True, 3: False}


def test_uploaded_files_manifest(spark):
    path = folder()
    (path / "a.log").write_text("hello\n")
    (path / "b.log").write_text("")
    (path / "odd name %20=.log").write_text("")
    (path / "odd %41.log").write_text("x")
    rows = {Path(r.file_id).name: r for r in manifest.manifest_of_files(spark, str(path), "u").collect()}
    assert rows["a.log"].size_bytes == 6 and rows["a.log"].reason is None
    assert rows["b.log"].size_bytes == 0 and rows["b.log"].reason == "empty"
    assert rows["odd name %20=.log"].reason == "empty" and rows["odd %41.log"].reason is None
    assert len(rows) == 4


def test_batch_sink_replaces_a_replayed_batch(spark):
    path = str(folder())
    rows = spark.range(10).selectExpr("id", "id % 2 as user_id")
    sinks.write_batch(rows, path, "one")
    sinks.write_batch(rows, path, "one")
    sinks.write_batch(rows, path, "two")
    assert sinks.read_batches(spark, path).count() == 20


def test_cuts_go_to_the_configured_folder(spark):
    stored = cut(spark.range(3), "three")
    assert stored.count() == 3
    assert shared_dir(spark) in stored.inputFiles()[0]
    assert new_path(spark, "a") != new_path(spark, "a")


def test_reports_leave_as_markdown_files(spark):
    path = str(folder())
    parts = spark.createDataFrame([(r, s, q, f"run {r} section {s} part {q}\nend") for r in (1, 2) for s in (2, 1) for q in (1, 0)], "file_id long, section int, seq long, text string")
    sinks.write_report_markdown(parts, path)
    shown = {int(r.file_id): r.markdown for r in sinks.read_report_markdown(spark, path).collect()}
    assert shown[2] == "".join(f"run 2 section {s} part {q}\nend\n" for s in (1, 2) for q in (0, 1)) and len(shown) == 2
    assert len(list(Path(path, "file_id=1").glob("*.txt"))) == 1


def test_text_folders_are_files_as_spark_names_them(spark):
    for long_files in (False, True):
        path = str(folder() / "logs")
        rows = spark.range(3000).selectExpr("id % 3 as f", "id as n", "if(id = 4, null, concat('line ', id)) as t").repartition(7)
        sinks.write_text_folders(rows.union(spark.sql("select null, 1L, 'é'")), path, "f", ["n"], "t", long_files)
        expected = {str(f): "".join(f"line {n}\n" if n != 4 else "\n" for n in range(f, 3000, 3)) for f in range(3)}
        found = {p.parent.name: p.read_text() for p in Path(path).glob("*/*")}
        assert found == {f"f={f}": text for f, text in expected.items()} | {"f=__HIVE_DEFAULT_PARTITION__": "é\n"}
        sinks.write_text_folders(rows.where("f = 1"), path, "f", ["n"], "t", long_files)
        assert [(r.f, r.value) for r in spark.read.text(path, wholetext=True).collect()] == [(1, expected["1"])]


def test_a_long_file_is_not_sorted_in_one_task(spark, monkeypatch):
    """Lines of one file leave through as many sorted pieces as there are tasks."""
    pieces = []
    monkeypatch.setattr(sinks, "cut", lambda df, name: pieces.append(cut(df, name)) or pieces[-1])
    path = str(folder() / "logs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_text_folders(spark.range(4000).selectExpr("1 as f", "id as n", "string(id) as t"), path, "f", ["n"], "t", long_files=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces[0].count() > 1
    assert Path(path, "f=1", "part-0.txt").read_text() == "".join(f"{n}\n" for n in range(4000))
