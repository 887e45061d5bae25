"""Window statistics on a worked example, and invariants."""

from __future__ import annotations

import json

import pytest

from lumenveil.operators import stats

START = 1_700_000_000.0
SCHEMA = "task_id string, status string, assigned_worker_id string, started_at double, finished_at double, output_duration_seconds double, attempt_count int, progress string"


@pytest.fixture(scope="module")
def tasks(spark):
    rows = [
        ("first", "completed", "worker-01-slot-1", START + 600, START + 1800, 7200.0, 1, json.dumps({"processing_started_at": START + 700, "processing_seconds": 900, "input_bytes": 100, "output_bytes": 80})),
        ("second", "completed", "worker-02-slot-1", START + 1200, START + 4500, 3600.0, 1, json.dumps({"processing_started_at": START + 1500, "processing_seconds": 900})),
        ("failed", "failed", "worker-01-slot-1", START + 2000, START + 2500, None, 2, json.dumps({"processing_seconds": 300})),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_totals(tasks):
    r = stats.totals(tasks, START, START + 7200).first()
    assert (r.completed, r.failed, r.retry_count) == (2, 1, 1)
    assert (r.video_seconds, r.processing_seconds, r.algorithm_realtime) == (10800, 1800, 6)
    assert r.worker_hours_per_video_hour == pytest.approx(1 / 6) and r.success_rate == pytest.approx(2 / 3)
    assert (r.input_bytes, r.output_bytes) == (100, 80)


def test_hours_start_before_the_window(tasks):
    done = [r.asDict() for r in stats.completed_per_bucket(tasks, START, START + 7200).orderBy("bucket").collect()]
    level = [r.asDict() for r in stats.concurrency(tasks, START, START + 7200).orderBy("bucket").collect()]
    assert len(done) == len(level) == 3 and done[0]["bucket"] == int(START // 3600) * 3600
    assert [r["completed"] for r in done] == [1, 1, 0] and [r["peak"] for r in level] == [2, 1, 0]
    assert all(r["peak"] >= r["average"] for r in level)
    seconds = [r.algorithm_seconds for r in stats.algorithm_seconds(tasks, START, START + 7200).collect()]
    assert sum(seconds) == 900 + 900 + 300


def test_servers(tasks):
    rows = [r.asDict() for r in stats.by_server(tasks, START, START + 7200).orderBy("server").collect()]
    assert [(r["server"], r["slots"], r["completed"], r["failed"], r["busy_seconds"]) for r in rows] == [("worker-01", 1, 1, 1, 1200), ("worker-02", 1, 1, 0, 3300)]


def test_an_end_counts_before_a_start_at_the_same_time(spark):
    rows = [("a", "completed", "w", START, START + 100, 1.0, 1, "{}"), ("b", "completed", "w", START + 100, START + 200, 1.0, 1, "{}"), ("c", "processing", "w", START + 50, None, None, 1, "{}")]
    peaks = [r.peak for r in stats.concurrency(spark.createDataFrame(rows, SCHEMA), START, START + 1000).orderBy("bucket").collect()]
    assert peaks == [2]


def test_empty_tables_and_windows(spark, tasks):
    assert stats.totals(tasks.limit(0), START, START + 60).first().success_rate is None
    assert {r.peak for r in stats.concurrency(tasks.limit(0), START, START + 7200).collect()} == {0}
    for end, width in ((START, 3600), (START + 10, 59)):
        with pytest.raises(ValueError):
            stats.bucket_starts(START, end, width)
