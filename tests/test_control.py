"""The task state machine, review leases, workers and capacity planning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenveil import schemas
from lumenveil.operators import audit, control, listing, logs, planner, reviews, workers

NOW = 1_700_000_000.0


def tasks_of(spark, *rows: dict):
    names = [f.name for f in schemas.T.StructType.fromDDL(schemas.TASKS).fields]
    base = {"attempt_count": 1, "max_attempts": 3, "created_at": NOW - 100, "updated_at": NOW - 100, "progress": '{"n": 1}'}
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], schemas.TASKS)


def workers_of(spark, *rows: dict):
    names = [f.name for f in schemas.T.StructType.fromDDL(schemas.WORKERS).fields]
    return spark.createDataFrame([tuple(({"last_seen_at": NOW} | r).get(n) for n in names) for r in rows], schemas.WORKERS)


def by_id(df, column: str = "status", key: str = "task_id") -> dict:
    return {r[key]: r[column] for r in df.collect()}


def test_claims_are_first_in_first_out_and_idempotent(spark):
    tasks = tasks_of(
        spark, {"task_id": "late", "status": "pending", "created_at": 5.0}, {"task_id": "early", "status": "pending", "created_at": 1.0},
        {"task_id": "spent", "status": "pending", "created_at": 0.0, "attempt_count": 3}, {"task_id": "mine", "status": "processing", "assigned_worker_id": "c"},
    )
    found = workers_of(spark, {"worker_id": "a", "status": "ready"}, {"worker_id": "c", "status": "busy", "current_task_id": "mine"}, {"worker_id": "d", "status": "offline"})
    new = control.claims(tasks, found)
    assert {(r.worker_id, r.task_id, r.kind) for r in new.collect()} == {("a", "early", "new"), ("c", "mine", "held")}
    after = {r.task_id: r for r in control.apply_claims(tasks, new, NOW).collect()}
    assert (after["early"].status, after["early"].attempt_count, after["early"].started_at, after["early"].assigned_worker_id) == ("assigned", 2, NOW, "a")
    assert after["mine"].attempt_count == 1 and after["late"].status == "pending"


def test_finish(spark):
    tasks = tasks_of(
        spark, {"task_id": "ok", "status": "uploading", "assigned_worker_id": "w"}, {"task_id": "again", "status": "processing", "assigned_worker_id": "w"},
        {"task_id": "over", "status": "processing", "assigned_worker_id": "w", "attempt_count": 3}, {"task_id": "stop", "status": "cancelling", "assigned_worker_id": "w"},
        {"task_id": "theirs", "status": "processing", "assigned_worker_id": "x"},
    )
    reports = spark.createDataFrame([("ok", "w", True), ("again", "w", False), ("over", "w", False), ("stop", "w", True), ("theirs", "w", True)], "task_id string, worker_id string, ok boolean")
    after = control.finish(tasks, reports, NOW)
    assert by_id(after) == {"ok": "completed", "again": "pending", "over": "failed", "stop": "cancelled", "theirs": "processing"}
    assert by_id(after, "finished_at")["again"] == NOW and by_id(after, "assigned_worker_id")["again"] == "w"


def test_cancel_restart_and_retry(spark):
    tasks = tasks_of(
        spark, {"task_id": "p", "status": "pending"}, {"task_id": "a", "status": "assigned"}, {"task_id": "s", "status": "cancelling"},
        {"task_id": "c", "status": "completed", "output_sha256": "x", "face_annotation": 1, "algorithm": "old"}, {"task_id": "f", "status": "failed", "output_sha256": "x", "assigned_worker_id": "w"},
    )
    every = tasks.select("task_id")
    rows = {r.task_id: r for r in control.cancel(tasks, every, NOW).collect()}
    assert {k: r.new_status for k, r in rows.items()} == {"p": "cancelled", "a": "cancelling", "s": "cancelling", "c": "completed", "f": "failed"}
    assert {k for k, r in rows.items() if r.rejected} == {"c", "f"} and rows["p"].error_message == "cancelled by administrator"
    again = {r.task_id: r for r in control.restart(tasks, every, NOW, algorithm="new", arguments=["-x"]).collect()}
    assert (again["c"].status, again["c"].output_sha256, again["c"].algorithm, again["c"].arguments, again["c"].progress, again["c"].restarted_at) == ("pending", None, "new", ["-x"], "{}", NOW)
    assert again["c"].face_annotation == 1 and again["a"].status == "assigned"
    retried = {r.task_id: r for r in control.retry(tasks, every, NOW).collect()}
    assert (retried["f"].status, retried["f"].attempt_count, retried["f"].output_sha256, retried["f"].assigned_worker_id) == ("pending", 0, "x", None)
    assert retried["c"].status == "completed"
    assert by_id(control.restart_completed(tasks, NOW)) == {"p": "pending", "a": "assigned", "s": "cancelling", "c": "pending", "f": "failed"}
    with pytest.raises(ValueError):
        control.restart(tasks, every, NOW, algorithm="new")


def test_recovery_of_stale_and_orphaned_tasks(spark):
    old = NOW - 1000
    tasks = tasks_of(
        spark, {"task_id": "held", "status": "processing", "assigned_worker_id": "silent"}, {"task_id": "stop", "status": "cancelling", "assigned_worker_id": "quiet"},
        {"task_id": "orphan", "status": "assigned", "assigned_worker_id": "gone", "updated_at": old}, {"task_id": "spent", "status": "assigned", "assigned_worker_id": "gone", "updated_at": old, "attempt_count": 3},
        {"task_id": "young", "status": "assigned", "assigned_worker_id": "gone"}, {"task_id": "fine", "status": "processing", "assigned_worker_id": "here", "updated_at": old},
    )
    found = workers_of(
        spark, {"worker_id": "silent", "status": "busy", "current_task_id": "held", "last_seen_at": old}, {"worker_id": "quiet", "status": "busy", "current_task_id": "stop", "last_seen_at": old},
        {"worker_id": "here", "status": "busy", "current_task_id": "fine"}, {"worker_id": "idle", "status": "ready", "last_seen_at": old},
    )
    recovered, offline = control.recover(tasks, found, NOW, 500)
    assert by_id(recovered, "new_status") == {"held": "pending", "stop": "cancelled", "orphan": "pending", "spent": "failed"}
    assert by_id(offline, key="worker_id") == {"silent": "offline", "quiet": "offline", "idle": "offline"}


def test_purge_only_without_active_tasks(spark):
    assert control.purge(tasks_of(spark, {"task_id": "a", "status": "completed"})).count() == 0
    assert control.purge(tasks_of(spark, {"task_id": "a", "status": "completed"}, {"task_id": "b", "status": "assigned"})).count() == 2


def test_review_leases(spark):
    tasks = tasks_of(spark, *({"task_id": t, "status": "completed", "source_object_key": "k", "finished_at": NOW + i} for i, t in enumerate("ab")), {"task_id": "c", "status": "completed"})
    three = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "reviewer string")
    assert {(r.reviewer, r.task_id) for r in control.review_claims(tasks, three, NOW).collect()} == {("r1", "a"), ("r2", "b")}
    ask = lambda who, *ids: spark.createDataFrame([(i, who, True) for i in ids], "task_id string, reviewer string, has_face boolean")
    held = reviews.claimed(tasks, ask("r1", "a", "c"), NOW)
    assert by_id(held, "face_review_owner") == {"a": "r1", "b": None, "c": None}
    assert by_id(reviews.claimed(held, ask("r2", "a"), NOW + 299), "face_review_owner")["a"] == "r1"
    assert by_id(reviews.claimed(held, ask("r2", "a"), NOW + 300), "face_review_owner")["a"] == "r2"
    assert by_id(reviews.renewed(held, ask("r1", "a"), NOW + 200), "face_review_lease_until")["a"] == NOW + 500
    assert by_id(reviews.renewed(held, ask("r2", "a"), NOW + 200), "face_review_lease_until")["a"] == NOW + 300
    assert by_id(reviews.released(held, ask("r1", "a"), NOW), "face_review_owner")["a"] is None
    done = reviews.annotated(held, ask("r1", "a", "b"), NOW + 1)
    assert by_id(done, "face_annotation") == {"a": 1, "b": None, "c": None} and by_id(done, "face_review_owner")["a"] is None
    assert control.review_queue(held, NOW + 301).count() == 2 and control.review_queue(held, NOW).count() == 1


def test_workers(spark):
    known = workers_of(
        spark, {"worker_id": "a", "token_hash": "1", "status": "busy", "current_task_id": "t"}, {"worker_id": "b", "token_hash": "2", "status": "ready"}, {"worker_id": "c", "token_hash": "3", "status": "busy", "current_task_id": "u"},
    )
    asked = spark.createDataFrame([("a", "1"), ("c", "9"), ("d", "4")], "worker_id string, token_hash string")
    after = workers.provisioned(known, asked, NOW)
    assert by_id(after, key="worker_id") == {"a": "busy", "b": "ready", "c": "offline", "d": "offline"} and by_id(after, "current_task_id", "worker_id")["c"] is None
    beats = spark.createDataFrame([("a", "1", "ready", None), ("b", "wrong", "busy", None), ("c", "3", "busy", "{}")], "worker_id string, token_hash string, status string, capabilities string")
    tasks = tasks_of(spark, {"task_id": "t", "status": "cancelling"}, {"task_id": "u", "status": "processing"})
    assert by_id(workers.heartbeats(known, tasks, beats, NOW), key="worker_id") == {"a": "cancelling", "b": "ready", "c": "busy"}
    assert set(by_id(workers.retired(known, known), key="worker_id")) == {"a", "c"}
    assert by_id(workers.slots_with_tasks(known, tasks), "cancel", "worker_id") == {"a": True, "c": False}


def test_new_tasks_take_defaults(spark):
    asked = spark.createDataFrame([("t1", "s3://x", None, None), ("t2", None, None, None), (None, "s3://y", "own", ["-a"])], "task_id string, source_url string, algorithm string, arguments array<string>")
    rows = {r.source_url: r for r in workers.created(asked, "base", ["-b"], NOW).collect()}
    assert set(rows) == {"s3://x", "s3://y"} and (rows["s3://x"].algorithm, rows["s3://x"].arguments, rows["s3://x"].max_attempts) == ("base", ["-b"], 3)
    assert rows["s3://y"].task_id and rows["s3://y"].arguments == ["-a"]


def test_schema_migration_adds_typed_nulls(spark):
    old = spark.createDataFrame([("t", "pending")], "task_id string, status string")
    new = schemas.migrate(old, schemas.TASKS)
    assert new.schema["source_duration_seconds"].dataType.simpleString() == "double" and set(new.columns) == {f.name for f in schemas.T.StructType.fromDDL(schemas.TASKS).fields}


HOSTS = "name string, status string, capacity int, all_ready boolean, idle_since double, start_requested_at double, stop_requested_at double"


@pytest.mark.parametrize(("needed", "want"), [(4, ["small"]), (7, ["large"]), (20, ["large", "small"]), (0, [])])
def test_hosts_start_for_pending_work(spark, needed, want):
    hosts = spark.createDataFrame([("large", "stopped", 15, False, None, None, None), ("small", "stopped", 6, False, None, None, None)], HOSTS)
    got = planner.actions(hosts, pending=max(1, needed), oldest_age=90, now=NOW, needed=needed)
    assert sorted(r.name for r in got.collect()) == want
    assert planner.actions(hosts, pending=9, oldest_age=10, now=NOW, needed=9).count() == 0


def test_requested_capacity_counts(spark):
    hosts = spark.createDataFrame([("large", "stopped", 15, False, None, NOW - 10, None), ("small", "stopped", 6, False, None, None, None)], HOSTS)
    assert planner.actions(hosts, pending=12, oldest_age=90, now=NOW, needed=12).count() == 0
    assert [r.name for r in planner.actions(hosts, pending=18, oldest_age=90, now=NOW, needed=18).collect()] == ["small"]


def test_idle_hosts_stop_one_at_a_time_above_the_minimum(spark):
    rows = [("a", "running", 4, True, NOW - 4000, None, None), ("b", "running", 4, True, NOW - 5000, None, None), ("c", "running", 4, False, NOW - 9000, None, None), ("d", "running", 4, True, NOW - 9000, None, NOW - 10)]
    hosts = spark.createDataFrame(rows, HOSTS)
    assert [(r.kind, r.name) for r in planner.actions(hosts, pending=0, oldest_age=0, now=NOW, needed=0).collect()] == [("stop", "b")]
    assert planner.actions(hosts, pending=0, oldest_age=0, now=NOW, needed=0, min_hosts=4).count() == 0
    assert planner.actions(hosts, pending=1, oldest_age=0, now=NOW, needed=0).count() == 0


def test_pages_are_clamped(spark):
    tasks = tasks_of(spark, *({"task_id": f"t{k}", "status": "pending", "created_at": float(k)} for k in range(5)))
    assert [r.task_id for r in listing.page(tasks, 99, 2).collect()] == ["t0"] and [r.task_id for r in listing.page(tasks, 0, 2).collect()] == ["t4", "t3"]
    with pytest.raises(ValueError):
        listing.label_filter(["maybe"])


def test_search_escapes_patterns(spark):
    tasks = tasks_of(spark, {"task_id": "a_b", "status": "pending"}, {"task_id": "axb", "status": "pending"}, {"task_id": "50%", "status": "pending"}, {"task_id": "c\\d", "status": "pending"})
    found = lambda text: {r.task_id for r in listing.filtered(tasks, text=text).collect()}
    assert found("A_B") == {"a_b"} and found("%") == {"50%"} and found("\\") == {"c\\d"} and found("PEND") == {"a_b", "axb", "50%", "c\\d"}


def test_logs(spark):
    lines = spark.createDataFrame([(k, "t" if k % 2 else "u", f"line {k}  " if k % 5 else "   ") for k in range(40)], "id bigint, task_id string, line string")
    assert logs.cleaned(lines).filter("line like '% '").count() == 0 and logs.cleaned(lines).count() == 32
    kept = logs.newest(lines, 3).collect()
    assert sorted(r.id for r in kept) == [34, 35, 36, 37, 38, 39]
    assert [r.id for r in logs.tail(lines, "t", 2).collect()] == [37, 39]


def test_audit_updates_only_known_columns(spark):
    rows = spark.createDataFrame([(1, "pending", None), (2, "pending", None)], "id bigint, status string, error string")
    assert by_id(audit.updated(rows, "id", 2, {"status": "ready"}), key="id") == {1: "pending", 2: "ready"}
    with pytest.raises(ValueError):
        audit.updated(rows, "id", 2, {"id": 3})


def test_jobs(spark):
    jobs = spark.createDataFrame([("a", "pending", 0, "old", None)], "path string, status string, attempts int, error string, duration double")
    begun = control.running_jobs(jobs, spark.createDataFrame([("a", 9.0)], "path string, source_duration double"), NOW)
    assert begun.first()[1:4] == ("running", 1, None)
    ended = control.ended_jobs(begun, spark.createDataFrame([("a", False, 2.0, None, "broken")], "path string, ok boolean, duration double, output_duration double, error string"), NOW)
    assert ended.select("status", "error", F.col("duration").cast("int")).first() == ("failed", "broken", 2)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_a_long_queue_with_other_columns(spark, adaptive):
    """Every number once, in order, whatever else the rows hold."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(1_000_000).select(F.xxhash64("id").alias("key"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("extra"))
        got = control.numbered(rows, ["key"], "n")
        least = got.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id")).first()
        assert tuple(least) == (1_000_000, 1, 1_000_000, 1_000_000)
        ahead = got.filter("n % 1000 = 0").select("n", "key").toPandas().sort_values("n")
        assert ahead.key.is_monotonic_increasing
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
