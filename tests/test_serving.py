from pyspark.sql import functions as F

from logspark.operators import serving


def test_pages_carry_totals(spark):
    rows = spark.range(25).selectExpr("id % 2 as k", "id")
    page = serving.page_per_key(rows, "k", [F.desc("id")], limit=3, offset=2).orderBy("k", "position").collect()
    assert [(r.k, r.id, r.total) for r in page] == [(0, 20, 13), (0, 18, 13), (0, 16, 13), (1, 19, 12), (1, 17, 12), (1, 15, 12)]


def test_last_turns_in_reading_order(spark):
    rows = spark.range(10).selectExpr("1 as conv_id", "id as turn")
    kept = serving.last_turns(rows).orderBy("position").collect()
    assert [r.turn for r in kept] == [4, 5, 6, 7, 8, 9]


def test_questions_are_quarantined_not_dropped(spark):
    rows = spark.createDataFrame([("",), ("ok",), ("x" * 4001,)], "question string")
    assert [r.reason for r in serving.checked_questions(rows).collect()] == ["empty question", None, "question too long"]


def test_tenant_and_status_filters(spark):
    runs = spark.createDataFrame([(1, 5, "completed"), (2, 5, "failed"), (3, 6, "completed")], "file_id int, user_id int, status string")
    assert [r.file_id for r in serving.of_tenant(serving.completed_runs(runs), 5).collect()] == [1]
