import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logspark.functions.guards import INSIGHT_PAYLOAD
from logspark.operators import incident, report
from logspark.sources import sinks


@pytest.fixture()
def groups(spark):
    at = lambda m: datetime(2026, 3, 1, 8, m)
    rows = [
        (1, "g1", "f1", "redis down", "high", 2, at(11), at(11), ["l1", "l2", "l3", "l4"]),
        (1, "g2", "f2", "db timeout", "critical", 1200, at(12), at(13), ["d1"]),
        (1, "g3", "f3", "bad gateway", "medium", 3, at(13), at(14), ["b1"]),
        (2, "g4", "f4", "only one", "high", 1, None, None, ["o1"]),
        (3, "g5", "f6", "undated a", "medium", 5, None, None, ["u1"]),
        (3, "g6", "f5", "undated b", "medium", 5, None, None, ["u2"]),
    ]
    frame = spark.createDataFrame(
        rows,
        "file_id long, group_id string, fingerprint string, template string, severity string, count long, "
        "first_seen timestamp, last_seen timestamp, sample_lines array<string>",
    )
    payload = F.when(
        F.col("group_id") == "g2",
        F.from_json(
            F.lit(
                '{"error_type":"Database Connectivity","severity":"critical","root_cause":"cause","possible_reasons":[],'
                '"explanation":"why","suggested_fix":"fix","recommended_commands":[],"confidence":0.9}'
            ),
            INSIGHT_PAYLOAD,
        ),
    )
    return frame.withColumn("payload", payload)


@pytest.fixture()
def runs(spark):
    rows = [(1, "app.log", 12345, 1205, 3), (2, "b.log", 5, 1, 1), (3, "c.log", 9, 10, 2), (4, "clean.log", 9, 0, 0)]
    return spark.createDataFrame(rows, "file_id long, filename string, total_lines long, error_lines long, group_count long")


def test_timeline_order_and_first_failure(groups):
    events = incident.timeline(groups).orderBy("file_id", *incident.timeline_order()).collect()
    assert [e.label for e in events if e.file_id == 1] == ["redis down", "Database Connectivity", "bad gateway"]
    assert [e.group_id for e in events if e.is_first_failure] == ["g1", "g4", "g6"]


def test_causal_check(groups, runs):
    checked = {r.file_id: r for r in incident.investigate(runs, incident.timeline(groups)).collect()}
    assert checked[1].verified and checked[1].confidence == 0.85
    assert checked[1].hypothesis == "redis down was the trigger; the remaining errors are cascade effects."
    assert checked[1].findings == [
        "First observed failure: redis down (2×).",
        "Likely downstream effects, in order: Database Connectivity → bad gateway.",
    ]
    assert not checked[2].verified and checked[2].confidence == 0.6
    assert "is an isolated failure. Insufficient temporal" in checked[2].conclusion
    assert not checked[4].verified and checked[4].confidence == 0.4 and checked[4].event_count == 0
    assert checked[3].verified
    strict = {r.file_id: r for r in incident.investigate(runs, incident.timeline(groups), require_dated=True).collect()}
    assert not strict[3].verified and strict[1].verified


def test_trace_has_three_ordered_steps(groups, runs):
    steps = incident.trace_steps(incident.investigate(runs, incident.timeline(groups)))
    rows = steps.filter("file_id = 1").orderBy("seq").collect()
    assert [(r.seq, r.agent, r.action) for r in rows] == [
        (0, "planner", "plan"), (1, "investigator", "hypothesis"), (2, "verifier", "verify"),
    ]
    assert rows[0].content["event_count"] == "3" and rows[2].content["verified"] == "true"


def test_reports(groups, runs):
    first = {r.file_id: r for r in report.incident_reports(runs, groups, "2026-03-02 00:00 UTC", sample_lines=3, tip_groups=3).collect()}
    text = first[1].markdown
    assert first[1].title == "Incident report — Critical: app.log"
    assert "12,345 lines, 1,205 errors, 3 distinct groups" in text
    assert "The dominant issue is **Database Connectivity** (1200 occurrences): cause" in text
    assert "- Severity spread: 1 critical, 1 high, 1 medium." in text
    assert text.index("### 1. Database Connectivity — critical (1200×)") < text.index("### 2. bad gateway")
    assert "kubectl get pods -n prod  # List pods" in text
    assert "l3\n```" in text and "l4" not in text
    assert "## Prevention\n\n- Address **Database Connectivity**: fix\n" in text
    assert first[4].title.endswith("clean.log (no errors detected)") and "spread: none." in first[4].markdown
    assert "The most frequent issue occurred 1 times: `only one`." in first[2].markdown
    again = {r.file_id: r for r in report.incident_reports(runs, groups, "2026-03-03 00:00 UTC", sample_lines=3, tip_groups=3).collect()}
    assert again[1].report_id == first[1].report_id and again[1].markdown != text


def test_report_files_hold_the_assembled_text(spark, groups, runs):
    path = tempfile.mkdtemp(prefix="run-")
    sinks.write_report_files(runs, groups, "2026-03-02 00:00 UTC", path, sample_lines=3, tip_groups=3)
    expected = report.incident_reports(runs, groups, "2026-03-02 00:00 UTC", sample_lines=3, tip_groups=3).select("file_id", "markdown")
    assert sorted(report.assemble(sinks.read_report_files(spark, path)).collect()) == sorted(expected.collect())


def test_a_trace_takes_further_steps(spark):
    columns = "file_id long, plan array<string>, event_count long, hypothesis string, findings array<string>, verified boolean, confidence double, note string"
    found = spark.createDataFrame([(1, ["q"], 2, "h", ["f"], True, 0.5, "n")], columns)
    review = incident.Step("reviewer", "review", lambda: {"note": F.col("note")})
    steps = incident.trace_steps(found, [*incident.STEPS, review]).orderBy("seq").collect()
    assert [s["agent"] for s in steps] == ["planner", "investigator", "verifier", "reviewer"]
    assert steps[3]["content"] == {"note": "n"}
    assert incident.trace_steps(found, max_steps=2).count() == 2


def test_limits_are_arguments(spark):
    rows = [(1, f"g{i}", f"f{i}", f"template {i}", "high", 9 - i, datetime(2026, 3, 1, 8, i)) for i in range(8)]
    events = spark.createDataFrame(rows, "file_id long, group_id string, fingerprint string, label string, severity string, count long, first_seen timestamp")
    runs = spark.createDataFrame([(1,)], "file_id long")
    whole = incident.investigate(runs, events).first()
    assert len(whole.plan) == 8 and "template 7" in whole.findings[1]
    cut = incident.investigate(runs, events, subjects=5, downstream_labels=2).first()
    assert len(cut.plan) == 5 and "template 2" in cut.findings[1] and "template 3" not in cut.findings[1]
    assert whole.conclusion == cut.conclusion
