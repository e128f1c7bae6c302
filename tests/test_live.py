"""Streams with timers against their batch forms, for several sizes of micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_telemetry import T0, as_result, limiter_rows, request_table, simulate

from logspark.operators import grouping, parsing, ratelimit, telemetry
from logspark.operators.scale import new_path
from logspark.sources.sinks import write_text_folders
from logspark.streaming import groups, ingest, live
from logspark.streaming.runner import all_rows, append_marker, in_files, in_time_files, read_table_stream, run_to_table

BASE = int((T0 - datetime(1970, 1, 1)).total_seconds())
PER_TRIGGER = [1, 2, 8]


def streamed(spark, table, build, per_trigger, mode="append", days=None):
    end = (lambda: append_marker(table, "ts", days=days)) if days else None
    with live.timers(spark):
        return run_to_table(build(read_table_stream(spark, table, per_trigger)), "live", mode, then=end)


def alerting_rows():
    rng = random.Random(5)
    rows = []
    for path in ("/a", "/b"):
        for minute in range(0, 240):
            bad = 20 <= minute < 45 or minute in (70, 71, 150) or (path == "/b" and 100 <= minute < 104)
            rows += [(60 * minute + rng.randint(0, 59), path, 500 if bad else 200, 0.1, "c") for _ in range(rng.randint(0, 3))]
    return rows


@pytest.mark.parametrize("per_trigger", PER_TRIGGER)
def test_alert_transitions_equal_batch_intervals(spark, per_trigger):
    requests = request_table(spark, alerting_rows())
    table = in_time_files(requests, "ts", 8, "alerting")
    rule = live.Rule(live.ERROR_RATIO, 300, 60, 300, 0.5)
    path = streamed(spark, table, lambda s: live.alert_transitions(s, ["route"], rule, "2 minutes"), per_trigger, days=1)
    rows = all_rows(spark, path).where("route != ''")
    closed = {(r.route, r.pending_s, r.at_s - 60, r.peak) for r in rows.where("transition = 'resolved'").collect()}
    batch = telemetry.error_ratio_alerts(requests, 300, 60, 300, 0.5, ["route"]).collect()
    assert closed == {(r.route, r.pending_s, r.until_s, r.peak) for r in batch} and len(closed) >= 2
    firing = {(r.route, r.pending_s, r.at_s) for r in rows.where("transition = 'firing'").collect()}
    assert firing == {(r.route, r.pending_s, r.firing_s) for r in batch}
    every = {(r.route, r.pending_s) for r in rows.where("transition = 'pending'").collect()}
    ended = {(r.route, r.pending_s) for r in rows.where("transition in ('resolved', 'cancelled')").collect()}
    assert every == ended and len(every) > len(firing)


def test_alerts_are_emitted_while_the_stream_runs(spark):
    table = in_time_files(request_table(spark, alerting_rows()), "ts", 8, "alerting")
    rule = live.Rule(live.MEAN_LATENCY, 300, 60, 600, 0.05)
    path = streamed(spark, table, lambda s: live.alert_transitions(s, ["route"], rule, "2 minutes"), 1)
    batches = {r.batch_id: r.transitions for r in spark.read.parquet(path).groupBy("batch_id").agg(F.collect_set("transition").alias("transitions")).collect()}
    # Eight micro-batches hold input; the alert fires in an early one.
    assert min(batches) < 3 and "firing" in batches[min(batches)]


@pytest.mark.parametrize("per_trigger", PER_TRIGGER)
def test_silences_equal_down_gaps(spark, per_trigger):
    rng = random.Random(8)
    rows = [(rng.randint(0, 20_000), "/a", 200, 0.1, f"c{rng.choice([0, 0, 0, 0, 1, 1, 2])}") for _ in range(500)]
    requests = request_table(spark, rows)
    table = in_time_files(requests, "ts", 8, "signs")
    path = streamed(spark, table, lambda s: live.silence_transitions(s, "client_ip", 200, "1 minute"), per_trigger, days=1)
    found = all_rows(spark, path).where("client_ip != ''")
    now = T0 + timedelta(hours=23)
    gaps = telemetry.down_gaps(requests, "client_ip", 200, as_of=now).collect()
    assert sorted((r.client_ip, r.last_seen_us) for r in found.where("transition = 'down'").collect()) == sorted((g.client_ip, g.last_seen_us) for g in gaps)
    back = found.where("transition = 'back'").collect()
    assert sorted((r.client_ip, r.last_seen_us, r.back_us, r.silent_s) for r in back) == sorted((g.client_ip, g.last_seen_us, g.back_us, g.gap_s) for g in gaps if g.back_us is not None)
    assert len(back) > 10


def test_a_source_that_stops_sending_fires_while_others_send(spark):
    rows = [(s, "/a", 200, 0.1, "alive") for s in range(0, 1000, 10)] + [(s, "/a", 200, 0.1, "dies") for s in range(0, 300, 10)]
    table = in_time_files(request_table(spark, rows), "ts", 8, "signs")
    path = streamed(spark, table, lambda s: live.silence_transitions(s, "client_ip", 60, "20 seconds"), 1)
    found = all_rows(spark, path).collect()
    assert [(r.client_ip, r.transition, r.last_seen_us // 1_000_000 - BASE, r.silent_s) for r in found] == [("dies", "down", 290, 60.0)]


@pytest.mark.parametrize("per_trigger", [1, 3])
def test_streaming_rate_limit_in_any_file_order_equals_batch(spark, per_trigger):
    rows = sorted(limiter_rows())
    table = in_files(request_table(spark, rows), "event_id", 5, "hits")
    path = streamed(spark, table, lambda s: live.rate_decisions(s, 3, 20, "10 days"), per_trigger, days=11)
    assert as_result(all_rows(spark, path)) == simulate(rows, 3, 20)


def test_rate_state_of_a_hot_key_is_bounded(spark):
    """A third of all hits on one key, in time order: the state is that of open instants and admitted times."""
    rows = [(i // 3, "/login", 200, 0.1, "hot" if i % 3 == 0 else f"c{i % 500}") for i in range(9000)]
    requests = request_table(spark, rows)
    table = in_time_files(requests, "ts", 6, "hits")
    with live.timers(spark):
        stream = live.rate_decisions(read_table_stream(spark, table, 1), 3, 20, "60 seconds")
        path, sizes = new_path(spark, "hot"), []
        query = stream.writeStream.option("checkpointLocation", new_path(spark, "c")).trigger(availableNow=True)
        query = query.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch_id={n}")).start()
        query.awaitTermination()
        sizes = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    waiting = max(op["numRowsTotal"] for ops in sizes for op in ops)
    assert waiting < 2500
    batch = ratelimit.admitted_hits(requests, 3, 20)
    done = all_rows(spark, path)
    assert done.exceptAll(batch).count() == 0 and 0 < done.count() < batch.count()


def test_live_groups_with_samples_and_expiry_equal_batch(spark, lines_of):
    rng = random.Random(3)
    files = {f: [f"2026-03-01 08:{i // 60 % 60:02d}:{i % 60:02d} ERROR job {rng.choice(['lost', 'late', 'stuck'])} {i}" for i in range(120)] for f in range(3)}
    files[9] = [f"2026-03-01 08:00:00 ERROR hot line {i}" for i in range(2000)]
    parsed = parsing.parse_log(lines_of(files), 2026)
    expected = sorted(map(tuple, grouping.error_groups(parsed).collect()))
    table = in_files(grouping.error_lines(parsed), "line_no", 6, "errors")
    for idle_s, per_trigger in ((86_400, 1), (1, 1), (86_400, 8)):
        path = streamed(spark, table, lambda s, idle_s=idle_s: groups.streaming_sampled_groups(s, idle_s=idle_s), per_trigger, "update")
        assert sorted(map(tuple, groups.finish_sampled_groups(spark, path).collect())) == expected


def test_hot_group_sends_few_rows(spark, lines_of):
    errors = grouping.error_lines(parsing.parse_log(lines_of({1: [f"2026-03-01 08:00:00 ERROR hot line {i}" for i in range(3000)]}), 2026))
    sent = groups.partial_groups(errors.coalesce(1), 2).collect()
    assert len(sent) <= 2 and sum(r["count"] for r in sent) == 3000 and all(len(r["lines"]) == 2 for r in sent)


def test_log_files_that_arrive_in_parts(spark):
    folder = new_path(spark, "arriving")
    parts = {
        ("a", 0): ['{"level": "error", "message": "x 1"}', ""],
        ("a", 1): ['{"level": "error", "message": "x 2"}', '{"level": "error", "message": "y"}', "not json"],
        ("b", 0): ["level=error msg=one time=2026-03-01T08:00:00Z", "level=error msg=two time=2026-03-01T08:00:00Z", "level=info msg=three time=2026-03-01T08:00:00Z"],
        ("c", 1): ["2026-03-01 08:00:00 ERROR only line"],
        ("d", 0): ["", ""],
    }

    def put(step):
        for (name, at), lines in parts.items():
            if at == step:
                spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{folder}/{name}/{step}")

    file_of = F.regexp_extract("path", "/([a-z])/[0-9]/", 1)
    home = new_path(spark, "home")
    stream = ingest.LogFileStream(spark, folder, 2026, head_lines=3, file_of=file_of, home=home)
    put(0)
    stream.run()
    assert {r.file_id for r in stream.lines(waiting=False).collect()} == {"b"}
    put(1)
    again = ingest.LogFileStream(spark, folder, 2026, head_lines=3, file_of=file_of, parts_per_trigger=1, home=home)
    again.run()
    rows = [(name, n, raw) for name in "abcd" for n, raw in enumerate([x for s in (0, 1) for x in parts.get((name, s), [])], 1)]
    table = spark.createDataFrame(rows, "file_id string, line_no long, raw string")
    batch = parsing.parse_lines(parsing.attach_formats(table, parsing.detect_formats(table, head_lines=3)), 2026)
    key = lambda frame: sorted(map(str, frame.select(batch.columns).collect()))
    assert key(again.lines()) == key(batch)
    assert {r.file_id for r in again.lines(waiting=False).collect()} == {"a", "b"}


def test_many_parts_are_listed_in_few_tasks(spark, monkeypatch):
    """Spark would take a task for each of the folders, and again for each of the parts of a micro-batch."""
    folder, parts = new_path(spark, "arriving"), 5 * spark.sparkContext.defaultParallelism + 40
    names = ["spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"]
    before, groups_of_jobs = [spark.conf.get(name) for name in names], {"listing"}
    rows = spark.range(2 * parts).selectExpr("id div 2 as f", "id as n", "concat('2026-03-01 08:00:00 ERROR job ', id, ' lost') as t")
    write_text_folders(rows, folder, "f", ["n"], "t")
    stream = ingest.LogFileStream(spark, folder, 2026, head_lines=1, file_of=F.regexp_extract("path", "f=([0-9]+)", 1))
    batch = stream._batch

    def noted(rows, number):
        groups_of_jobs.update(query.runId for query in spark.streams.active)
        batch(rows, number)

    monkeypatch.setattr(stream, "_batch", noted)
    spark.sparkContext.setJobGroup("listing", "the stream's folder")
    try:
        stream.run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for group in groups_of_jobs for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    assert len(groups_of_jobs) == 2 and 4 * spark.sparkContext.defaultParallelism in tasks and max(tasks) < parts
    assert [spark.conf.get(name) for name in names] == before
    found = stream.lines(waiting=False).selectExpr("cast(file_id as long)", "line_no", "raw")
    assert sorted(map(tuple, found.collect())) == [(i // 2, i % 2 + 1, f"2026-03-01 08:00:00 ERROR job {i} lost") for i in range(2 * parts)]


def state_rows(query):
    return max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"] if op["operatorName"].startswith("transformWithState"))


def run_noted(spark, stream, mode):
    path = new_path(spark, "noted")
    query = stream.writeStream.option("checkpointLocation", new_path(spark, "c")).trigger(availableNow=True).outputMode(mode)
    query = query.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch_id={n}")).start()
    query.awaitTermination()
    return path, query


def test_keys_of_a_bucket_share_a_state(spark, lines_of):
    rows = [(i, f"/p{i % 97}", 200, 0.1, f"c{i % 5}") for i in range(600)]
    table = in_time_files(request_table(spark, rows), "ts", 3, "hits")
    parsed = parsing.parse_log(lines_of({f: [f"2026-03-01 08:00:00 ERROR job of kind{'abcdefghij'[i % 10]} lost" for i in range(40)] for f in range(20)}), 2026)
    errors = in_files(grouping.error_lines(parsed), "line_no", 3, "errors")
    with live.timers(spark):
        path, query = run_noted(spark, live.rate_decisions(read_table_stream(spark, table, 1), 2, 60, "60 seconds", buckets=4), "append")
        assert 0 < state_rows(query) <= 4 * 2  # a state and its timer
        path, query = run_noted(spark, groups.streaming_sampled_groups(read_table_stream(spark, errors, 1), buckets=4), "update")
        assert 0 < state_rows(query) <= 4 * 4
    assert sorted(map(tuple, groups.finish_sampled_groups(spark, path).collect())) == sorted(map(tuple, grouping.error_groups(parsed).collect()))
