from collections import defaultdict, deque
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logspark.operators import ratelimit, telemetry
from logspark.operators.scale import cut
from logspark.streaming import operators as streams
from logspark.streaming.runner import all_rows, final_state, read_table_stream, run_to_table

T0 = datetime(2026, 3, 1)


def request_table(spark, rows):
    """Rows of (second, path, status, duration, client)."""
    full = [(i, T0 + timedelta(seconds=s), "GET", p, st, d, c) for i, (s, p, st, d, c) in enumerate(rows)]
    return spark.createDataFrame(
        full, "event_id long, ts timestamp, method string, path string, status int, duration_s double, client_ip string"
    )


def test_routes_collapse_and_the_scrape_is_absent(spark):
    a, b = "123e4567-e89b-12d3-a456-426614174000", "223e4567-e89b-12d3-a456-426614174000"
    rows = [(0, f"/api/{a}/x/12/13", 200, 0.25, "c"), (1, f"/api/{b}/x/7/8", 200, 0.5, "c"), (2, "/metrics", 200, 1.0, "c")]
    series = telemetry.red_metrics(request_table(spark, rows)).collect()
    assert [(r.route, r.requests, str(r.duration_sum)) for r in series] == [("/api/{id}/x/{id}/{id}", 2, "0.750000")]
    lines = {r.line for r in telemetry.metrics_text(request_table(spark, rows)).collect()}
    assert 'http_requests_total{method="GET",path="/api/{id}/x/{id}/{id}",status="200"} 2' in lines
    assert "# TYPE http_request_duration_seconds_sum counter" in lines


def test_sliding_sums_equal_spark_windows(spark):
    rows = [((i * 37) % 2000, "/a", 500 if i % 3 == 0 else 200, 0.1, "c") for i in range(300)]
    requests = request_table(spark, rows)
    ours = telemetry.request_rate(requests, 300, 60).select("end_s", "requests")
    theirs = requests.groupBy(F.window("ts", "5 minutes", "1 minute")).agg(F.count("*").alias("requests"))
    theirs = theirs.select(F.unix_seconds("window.end").alias("end_s"), "requests")
    assert sorted(ours.collect()) == sorted(theirs.collect())


def test_alert_needs_to_hold(spark):
    rows = [(60 * m, "/a", 500 if 10 <= m < 20 or m == 40 else 200, 0.1, "c") for m in range(60)]
    alerts = telemetry.error_ratio_alerts(request_table(spark, rows), 60, 60, 300, 0.5).collect()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    assert [(a.pending_s - base, a.firing_s - base, a.until_s - base, a.peak) for a in alerts] == [(660, 960, 1200, 1.0)]
    slow = telemetry.latency_alerts(request_table(spark, [(60 * m, "/a", 200, 0.5, "c") for m in range(30)]), 60, 60, 600)
    assert slow.count() == 1


def test_down_gaps_up_to_now(spark):
    rows = [(s, "/a", 200, 0.1, "c") for s in (0, 30, 200)] + [(170, "/a", 200, 0.1, "d")]
    gaps = telemetry.down_gaps(request_table(spark, rows), "client_ip", 60, as_of=T0 + timedelta(seconds=261)).collect()
    assert sorted((g.client_ip, g.back_us is None, g.gap_s) for g in gaps) == [("c", False, 170), ("c", True, 61), ("d", True, 91)]


def test_down_gaps_with_many_rows_per_bucket(spark):
    seconds = [0, 1, 2, 50, 59, 110, 171, 172, 300]
    rows = [(s, "/a", 200, 0.1, "c") for s in seconds] + [(0, "/a", 200, 0.1, "d")]
    gaps = telemetry.down_gaps(request_table(spark, rows), "client_ip", 60).orderBy("last_seen_us").collect()
    assert [(g.client_ip, g.gap_s) for g in gaps] == [("c", 61.0), ("c", 128.0)]


def simulate(rows, times, seconds):
    recent, out = defaultdict(deque), defaultdict(lambda: [0, 0])
    for s, path, _, _, client in sorted(rows):
        window = recent[path, client]
        while window and s - window[0] > seconds:
            window.popleft()
        admitted = len(window) < times
        if admitted:
            window.append(s)
        out[path, client, s][0 if admitted else 1] += 1
    return {k: tuple(v) for k, v in out.items()}


def limiter_rows():
    import random

    rng = random.Random(11)
    rows = []
    for client, gap in (("busy", 1), ("steady", 9), ("rare", 90)):
        second = 0
        for _ in range(150):
            second += rng.randint(0, 2 * gap)
            rows.append((second, "/login", 200, 0.1, client))
    return rows


def as_result(frame):
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    return {(r.path, r.client_ip, r.us // 1_000_000 - base): (r.admitted, r.rejected) for r in frame.collect()}


@pytest.mark.parametrize(("times", "seconds"), [(3, 20), (1, 7), (5, 60)])
def test_rate_limit_equals_a_simulation(spark, times, seconds):
    rows = limiter_rows()
    done = ratelimit.admitted_hits(request_table(spark, rows), times, seconds)
    assert as_result(done) == simulate(rows, times, seconds)


@pytest.mark.parametrize(("times", "seconds", "every"), [(3, 20, 7), (1, 10, 1), (4, 50, 3), (2, 9, 20)])
def test_a_key_that_is_never_silent_is_folded_in_chunks(spark, times, seconds, every):
    import random

    rng = random.Random(every)
    rows = [(s, "/login", 200, 0.1, "hot") for s in range(0, 4000, every) for _ in range(rng.choice([0, 1, 1, 3]))]
    rows += [(s, "/login", 200, 0.1, "calm") for s in range(0, 4000, 500)]
    requests = request_table(spark, rows)
    done = ratelimit.admitted_hits(requests, times, seconds, chunk_instants=60)
    assert as_result(done) == simulate(rows, times, seconds)
    instants = requests.groupBy(*ratelimit.KEY, F.unix_micros("ts").alias("us")).agg(F.count("*").alias("hits"))
    parts = ratelimit._independent_parts(instants, seconds, 60)
    sizes = [r["count"] for r in parts.where("client_ip = 'hot'").groupBy("_part", "_chunk").count().collect()]
    assert max(sizes) <= 60 + seconds + 1 and (len(sizes) > 3)


def test_streaming_red_over_several_batches_equals_batch(spark):
    rows = [((i * 53) % 4000, "/a", 500 if i % 4 == 0 else 200, 0.1, "c") for i in range(400)]
    table = cut(request_table(spark, rows).repartition(5), "red")
    stream = streams.streaming_steps(read_table_stream(spark, table, files_per_trigger=1), ["route"], 60, "1 day")
    state = final_state(spark, run_to_table(stream, "steps"), ["window", "route"])
    streamed = streams.steps_of_state(state, ["route"], 60).select("step", "requests", "errors")
    batch = telemetry.stepped(table, ["route"], 60).select("step", "requests", "errors")
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_redelivered_rows_are_dropped_across_batches(spark):
    rows = [(i, "/a", 200, 0.1, "c") for i in range(50)]
    once = request_table(spark, rows)
    table = cut(once.union(once).repartition(4), "replayed")
    stream = streams.dedup_redelivered(read_table_stream(spark, table, files_per_trigger=1), ["event_id"], watermark="1 day")
    assert all_rows(spark, run_to_table(stream, "dedup", "append")).count() == 50


def test_live_windows_group_errors(spark, lines_of):
    from logspark.operators import parsing

    lines = lines_of({1: ["2026-03-01 08:00:01 ERROR job 1 lost", "2026-03-01 09:30:01 ERROR job 2 lost"]})
    stream = streams.windowed_groups(
        read_table_stream(spark, cut(lines, "live"), files_per_trigger=8), parsing.detect_formats(lines), 2026, "1 hour"
    )
    state = final_state(spark, run_to_table(stream, "live_groups"), ["window", *streams.GROUP_KEYS])
    assert [r["count"] for r in state.collect()] == [1, 1]


def test_keys_of_one_hit_are_decided_in_one_batch():
    """A batch of many short chunks leaves as one batch, not as one for each of them."""
    rows = [(f"/p{i}", "c", us, 1, [] if us < 0 else None) for i in range(500) for us in (-1, 5, 6, 7)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)],
        ["path", "client_ip", "us", "hits", "carry"],
    )
    (found,) = ratelimit._fold([batch], 2, 10)
    assert found.num_rows == 1500 and found.column("admitted").to_pylist() == [1, 1, 0] * 500
    assert found.column("rejected").to_pylist() == [0, 0, 1] * 500
