"""Registered queries over workers, reviews, reports, decoders and fusion rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions import boxes, decoding, scalars
from lumenveil.operators import audit, control, fusion, logs, planner, reports, reviews, stats, timeline, workers
from lumenveil.plans.fixtures import view
from lumenveil.plans.queries import END, HOUR, NOW, START, _by_model, r6, rounded
from lumenveil.plans.registry import query
from lumenveil.session import table
from lumenveil.sources import discovery

_ACTIVE = "('assigned', 'downloading', 'processing', 'uploading', 'cancelling')"
_SHA = "sha256(worker_id)"


def _known_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "workers").withColumn("token_hash", F.sha2("worker_id", 256))


# -- workers ----------------------------------------------------------------


@query(f"""
, w AS (SELECT *, last_seen_at % 2 = 0 AND last_seen_at % 3 <> 0 AS ok FROM workers)
SELECT w.worker_id, CASE WHEN NOT ok THEN w.status WHEN t.status = 'cancelling' THEN 'cancelling' ELSE 'ready' END AS status, CAST(CASE WHEN ok THEN {NOW} ELSE last_seen_at END AS DOUBLE) AS last_seen_at
FROM w LEFT JOIN tasks t ON w.current_task_id = t.task_id
""")
def heartbeat_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known_workers(spark, sf_dir)
    token = F.when(F.col("last_seen_at") % 3 == 0, "wrong").otherwise(F.col("token_hash")).alias("token_hash")
    beats = known.filter("last_seen_at % 2 = 0").select("worker_id", token, F.lit("ready").alias("status"), F.lit(None).cast("string").alias("capabilities"))
    return workers.heartbeats(known, view(spark, sf_dir, "tasks"), beats, NOW).select("worker_id", "status", F.col("last_seen_at").cast("double").alias("last_seen_at"))


@query(f"""
, w AS (SELECT worker_id, status, current_task_id, last_seen_at % 4 = 1 AS rotated FROM workers)
SELECT worker_id, CASE WHEN rotated THEN 'offline' ELSE status END AS status, CASE WHEN NOT rotated THEN current_task_id END AS current_task_id, CASE WHEN rotated THEN 'new' ELSE {_SHA} END AS token_hash FROM w
UNION ALL SELECT 'worker-new-slot-0', 'offline', NULL, 'new'
""")
def provision_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known_workers(spark, sf_dir)
    token = F.when(F.col("last_seen_at") % 4 == 1, "new").otherwise(F.col("token_hash")).alias("token_hash")
    asked = known.filter("last_seen_at % 4 < 2").select("worker_id", token)
    asked = asked.unionByName(spark.range(1).select(F.lit("worker-new-slot-0").alias("worker_id"), F.lit("new").alias("token_hash")))
    return workers.provisioned(known, asked, NOW).select("worker_id", "status", "current_task_id", "token_hash")


@query("SELECT worker_id, CASE WHEN last_seen_at % 5 < 2 AND last_seen_at % 5 <> 1 THEN 'ready' ELSE status END AS status FROM workers")
def register_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known_workers(spark, sf_dir)
    token = F.when(F.col("last_seen_at") % 5 == 1, "wrong").otherwise(F.col("token_hash")).alias("token_hash")
    asked = known.filter("last_seen_at % 5 < 2").select("worker_id", token, F.lit("{}").alias("capabilities"))
    return workers.registered(known, asked, NOW).select("worker_id", "status")


@query("SELECT worker_id FROM workers WHERE NOT (current_task_id IS NULL AND status IN ('ready', 'offline') AND last_seen_at % 2 = 0)")
def retire_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = view(spark, sf_dir, "workers")
    return workers.retired(known, known.filter("last_seen_at % 2 = 0")).select("worker_id")


@query("SELECT w.worker_id, w.current_task_id AS task_id, coalesce(t.status = 'cancelling', false) AS cancel FROM workers w LEFT JOIN tasks t ON w.current_task_id = t.task_id WHERE w.current_task_id IS NOT NULL")
def held_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.slots_with_tasks(view(spark, sf_dir, "workers"), view(spark, sf_dir, "tasks"))


@query("""
SELECT key AS task_id, concat('s3://media/', key) AS source_url, CASE WHEN size % 3 = 0 THEN 'fast' ELSE 'base' END AS algorithm, 'pending' AS status, 0 AS attempt_count, 3 AS max_attempts FROM listing WHERE size > 0
""")
def create_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "listing").select(
        F.col("key").alias("task_id"), F.when(F.col("size") > 0, F.concat(F.lit("s3://media/"), F.col("key"))).alias("source_url"), F.when(F.col("size") % 3 == 0, "fast").alias("algorithm")
    )
    return workers.created(asked, "base", ["--no-card"], NOW).select("task_id", "source_url", "algorithm", "status", "attempt_count", "max_attempts")


@query(f"""
SELECT task_id, CASE WHEN ok THEN 'uploading' ELSE status END AS status, CASE WHEN ok THEN '{{"n": 1}}' ELSE progress END AS progress
FROM (SELECT *, coalesce(n % 3 = 0 AND n % 2 = 0 AND assigned_worker_id IS NOT NULL AND status IN {_ACTIVE} AND status <> 'cancelling', false) AS ok FROM tasks)
""")
def progress_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, "tasks")
    owner = F.when(F.col("n") % 2 == 0, F.col("assigned_worker_id")).otherwise("someone").alias("worker_id")
    told = tasks.filter("n % 3 = 0").select("task_id", owner, F.lit("uploading").alias("status"), F.lit('{"n": 1}').alias("progress"))
    return workers.progressed(tasks, told, NOW).select("task_id", "status", "progress")


@query("""
, q AS (SELECT task_id, row_number() OVER (ORDER BY created_at, task_id) AS k FROM tasks WHERE status = 'pending' AND attempt_count < max_attempts), i AS (SELECT count(*) AS n FROM workers WHERE status = 'ready' AND current_task_id IS NULL)
SELECT t.task_id, CASE WHEN k <= i.n THEN 'assigned' ELSE t.status END AS status, CASE WHEN k <= i.n THEN attempt_count + 1 ELSE attempt_count END AS attempt_count FROM tasks t CROSS JOIN i LEFT JOIN q USING (task_id)
""")
def claims_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, "tasks")
    return control.apply_claims(tasks, control.claims(tasks, view(spark, sf_dir, "workers")), NOW).select("task_id", "status", "attempt_count")


@query("SELECT task_id, CASE WHEN status = 'completed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'completed' THEN '{}' ELSE progress END AS progress FROM tasks")
def bulk_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.restart_completed(view(spark, sf_dir, "tasks"), NOW).select("task_id", "status", "progress")


@query(f"SELECT task_id FROM tasks WHERE (SELECT count(*) FILTER (status IN {_ACTIVE}) > 0 FROM tasks)")
def purge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.purge(view(spark, sf_dir, "tasks")).select("task_id")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'changed' ELSE n_name END AS name FROM nation UNION ALL SELECT 100, 'changed'")
def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "n_name as name")
    changes = stored.filter("id % 3 = 0").select("id").unionByName(spark.range(1).selectExpr("100 as id")).withColumn("name", F.lit("changed"))
    return control.upsert(stored, changes, "id")


@query("SELECT p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'success' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 1 END AS attempts, CASE p_partkey % 4 WHEN 2 THEN 'broken' WHEN 3 THEN 'old' END AS error FROM part")
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "part").selectExpr("p_partkey as path", "'pending' as status", "1 as attempts", "'old' as error", "cast(null as double) as duration")
    begun = jobs.filter("path % 4 = 0").select("path", F.lit(1.0).alias("source_duration"))
    ended = jobs.filter("path % 4 in (1, 2)").select("path", (F.col("path") % 4 == 1).alias("ok"), F.lit(2.0).alias("duration"), F.lit(1.0).alias("output_duration"), F.when(F.col("path") % 4 == 2, "broken").alias("error"))
    return control.ended_jobs(control.running_jobs(jobs, begun, NOW), ended, NOW).select("path", "status", "attempts", "error")


# -- reviews ----------------------------------------------------------------

_LIVE = f"coalesce(face_review_owner IS NOT NULL AND face_review_lease_until > {NOW}, false)"


def _owners(tasks: DataFrame) -> DataFrame:
    return tasks.filter("n % 2 = 0 and face_review_owner is not null").select("task_id", F.col("face_review_owner").alias("reviewer"), (F.col("n") % 4 == 0).alias("has_face"))


@query(f"SELECT task_id, CASE WHEN n % 2 = 0 AND status = 'completed' AND {_LIVE} THEN CAST(n % 4 = 0 AS INTEGER) ELSE face_annotation END AS face_annotation, CASE WHEN {_LIVE} AND NOT (n % 2 = 0 AND status = 'completed') THEN face_review_owner END AS owner FROM tasks")
def review_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, "tasks")
    return reviews.annotated(tasks, _owners(tasks), NOW).select("task_id", "face_annotation", F.col("face_review_owner").alias("owner"))


@query(f"SELECT task_id, CASE WHEN {_LIVE} THEN CAST(CASE WHEN n % 2 = 0 THEN {NOW + 300} ELSE face_review_lease_until END AS DOUBLE) END AS lease_until FROM tasks")
def review_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, "tasks")
    return reviews.renewed(tasks, _owners(tasks), NOW).select("task_id", F.col("face_review_lease_until").cast("double").alias("lease_until"))


@query("SELECT task_id, CASE WHEN n % 2 <> 0 THEN face_review_owner END AS owner FROM tasks")
def review_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, "tasks")
    return reviews.released(tasks, _owners(tasks), NOW).select("task_id", F.col("face_review_owner").alias("owner"))


@query(f"SELECT task_id, CASE WHEN n % 5 = 2 AND status = 'completed' AND NOT ({_LIVE} AND face_review_owner <> 'reviewer-1') THEN 'reviewer-1' WHEN {_LIVE} THEN face_review_owner END AS owner FROM tasks")
def review_claims_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, "tasks")
    asked = tasks.filter("n % 5 = 2").select("task_id", F.lit("reviewer-1").alias("reviewer"))
    return reviews.claimed(tasks, asked, NOW).select("task_id", F.col("face_review_owner").alias("owner"))


@query("SELECT r.id FROM reviews r WHERE r.task_id % 3 <> 0")
def review_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "reviews")
    parents = found.filter("task_id % 3 <> 0").select(F.col("task_id").alias("parent"))
    return audit.cascade(found, parents, "task_id", "parent").select("id")


@query("SELECT DISTINCT task_id, CASE task_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'ready' END AS status, CASE task_id % 4 WHEN 1 THEN 'missing' END AS error FROM reviews")
def audit_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = view(spark, sf_dir, "reviews").select("task_id").distinct()
    return reports.synced(projects, projects.filter("task_id % 4 <> 0").withColumn("error", F.when(F.col("task_id") % 4 == 1, "missing")))


# -- reports ----------------------------------------------------------------


@query(f"SELECT count(*) FILTER (status IN {_ACTIVE}) AS active, count(*) FILTER (status = 'pending') AS pending FROM tasks")
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.active_counts(view(spark, sf_dir, "tasks"))


@query("""
SELECT video_id, count(DISTINCT frame_idx) AS frames, count(*) AS instances, count(*) FILTER (det_id % 4 = 0) AS faces, count(*) FILTER (det_id % 4 = 1) AS cards, count(*) FILTER (det_id % 4 = 2) AS pets, count(*) FILTER (det_id % 4 = 3) AS texts FROM detections GROUP BY video_id
""")
def video_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("face", "card", "pet", "text"))), F.col("det_id") % 4 + 1)
    return reports.video_totals(view(spark, sf_dir, "detections").withColumn("kind", kind))


@query("""
, s AS (SELECT event_type AS label, event_id AS "at", event_id * 3 AS calls, event_id * 0.5 AS seconds FROM events)
SELECT label, "at", calls - coalesce(lag(calls) OVER w, 0) AS new_calls, round(CAST(seconds - coalesce(lag(seconds) OVER w, 0) AS DOUBLE), 6) AS new_seconds,
 round(CAST((seconds - coalesce(lag(seconds) OVER w, 0)) * 1000 / nullif(calls - coalesce(lag(calls) OVER w, 0), 0) AS DOUBLE), 6) AS average_ms FROM s WINDOW w AS (PARTITION BY label ORDER BY "at")
""")
def timing_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type as label", "event_id as at", "event_id * 3 as calls", "cast(event_id * 0.5 as double) as seconds")
    return rounded(reports.timing_deltas(rows), "new_seconds", "average_ms")


@query("SELECT count(*) AS scanned, count(*) FILTER (p_size % 3 = 0) AS succeeded, count(*) FILTER (p_size % 3 = 1) AS failed, count(*) FILTER (p_size % 3 = 2) AS skipped FROM part")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_summary(table(spark, sf_dir, "part").selectExpr("case p_size % 3 when 0 then 'succeeded' when 1 then 'failed' else 'skipped' end as outcome"))


@query("""
, j AS (SELECT user_id AS run, event_id AS position, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 17 AS DOUBLE) END AS seconds FROM events)
SELECT run, position, round(coalesce(avg(seconds) OVER (PARTITION BY run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (count(*) OVER (PARTITION BY run) - row_number() OVER (PARTITION BY run ORDER BY position) + 1) / 2, 6) AS eta FROM j
""")
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").selectExpr("user_id as run", "event_id as position", "case when event_id % 3 <> 0 then cast(event_id % 17 as double) end as seconds")
    return reports.remaining_time(jobs, 2, ["run"]).select("run", "position", r6("eta").alias("eta"))


@query("""
, s AS (SELECT user_id AS host, event_id AS "at", event_id * 100 - lag(event_id * 100) OVER w AS total, event_id * 60 + event_id % 7 - lag(event_id * 60 + event_id % 7) OVER w AS idle FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT host, "at", round(100.0 * (total - idle) / total, 6) AS percent FROM s WHERE total IS NOT NULL
""")
def cpu_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").selectExpr("user_id as host", "event_id as at", "event_id * 100 as total", "event_id * 60 + event_id % 7 as idle")
    return rounded(reports.cpu_percent(samples), "percent")


@query("SELECT o_orderkey AS run, CASE WHEN o_orderkey % 5 = 0 THEN 'RUNNING' WHEN o_orderkey % 5 = 1 THEN 'STOPPED' WHEN o_orderkey % 5 = 2 THEN 'COMPLETED' WHEN o_orderkey % 5 = 3 THEN 'FAILED' ELSE 'UNKNOWN' END AS state, o_custkey % 10 > 5 AND o_orderkey % 100 < 30 AS incomplete FROM orders")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    state = reports.run_state(k == 0, k == 1, F.when(k == 2, 0).when(k == 3, 9))
    short = reports.incomplete(F.col("o_orderkey") % 100, F.lit(100), (F.col("o_custkey") % 10).cast("double"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), state.alias("state"), short.alias("incomplete"))


@query("""
, s AS (SELECT l_orderkey AS video_id, count(*) AS segments, sum(CAST(l_linenumber AS DOUBLE)) AS seconds FROM lineitem GROUP BY 1)
SELECT s.video_id, segments, seconds, coalesce(abs(seconds - duration) < 2.0, true) AS lossless FROM s LEFT JOIN (SELECT video_id, CAST(video_id % 30 AS DOUBLE) AS duration FROM video_info) v USING (video_id)
""")
def segment_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as video_id", "l_linenumber as seg_idx", "cast(l_linenumber as double) as seconds")
    videos = view(spark, sf_dir, "video_info").selectExpr("video_id", "cast(video_id % 30 as double) as duration")
    return reports.merges(parts, videos)


@query("""
, l AS (SELECT id, task_id, id * 0.25 AS "at" FROM task_logs), s AS (SELECT *, floor(("at" - min("at") OVER (PARTITION BY task_id)) / 5) AS span FROM l),
p AS (SELECT *, (row_number() OVER (PARTITION BY task_id, span ORDER BY "at", id) - 1) // 20 AS part FROM s), g AS (SELECT task_id, span, part, count(*) AS n, min("at") AS first_at FROM p GROUP BY ALL)
SELECT task_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY span, part) AS INTEGER) AS flush, n, CAST(first_at AS DOUBLE) AS first_at FROM g
""")
def log_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flushes(view(spark, sf_dir, "task_logs").withColumn("at", F.col("id").cast("double") * 0.25))


@query("SELECT id, task_id, string_agg(line, chr(10)) OVER (PARTITION BY task_id ORDER BY id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS tail FROM task_logs")
def log_rolling_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.rolling_tail(view(spark, sf_dir, "task_logs"), 8).select("id", "task_id", "tail")


@query(f"""
, parts AS (SELECT greatest(started_at, {START}.0) AS s, least(coalesce(finished_at, {END}.0), {END}.0) AS e FROM tasks WHERE started_at < {END} AND (finished_at IS NULL OR finished_at > {START})),
steps AS (SELECT s AS t, 1 AS d FROM parts WHERE e > s UNION ALL SELECT e, -1 FROM parts WHERE e > s)
SELECT round((SELECT sum(e - s) FROM parts WHERE e > s) / {END - START}, 6) AS mean_concurrency, (SELECT CAST(max(n) AS BIGINT) FROM (SELECT sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM steps)) AS peak_concurrency
""")
def overall_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.overall(stats.concurrency(view(spark, sf_dir, "tasks"), START, END, HOUR)), "mean_concurrency")


# -- planning ---------------------------------------------------------------


@query("""
, s AS (SELECT user_id AS name, event_id AS "at", event_type <> 'error' AS all_ready FROM events), b AS (SELECT name, max("at") FILTER (NOT all_ready) AS busy FROM s GROUP BY name)
SELECT name, min("at") FILTER (busy IS NULL OR "at" > busy) AS idle_since FROM s JOIN b USING (name) GROUP BY name
""")
def host_idle_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.idle_since(table(spark, sf_dir, "events").selectExpr("user_id as name", "event_id as at", "event_type <> 'error' as all_ready"))


@query("""
, a AS (SELECT n_name AS key, n_regionkey AS value FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE n_regionkey END AS value FROM nation WHERE n_nationkey > 3)
SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value
""")
def state_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    old = nation.filter("n_nationkey < 20").selectExpr("n_name as key", "n_regionkey as value")
    new = nation.filter("n_nationkey > 3").selectExpr("n_name as key", "if(n_nationkey % 5 = 0, -1, n_regionkey) as value")
    return planner.map_differences(old, new)


@query("""
, r AS (SELECT name, capacity, row_number() OVER w AS k, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hosts WHERE status = 'stopped'
 WINDOW w AS (ORDER BY CASE WHEN capacity >= 20 THEN 0 ELSE 1 END, CASE WHEN capacity >= 20 THEN capacity ELSE -capacity END, name))
SELECT 'start' AS kind, name, 'pending work' AS reason FROM r WHERE k <= 2 AND before < 20
""")
def capacity_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = view(spark, sf_dir, "hosts").withColumns({c: F.lit(None).cast("double") for c in ("idle_since", "start_requested_at", "stop_requested_at")}).withColumn("all_ready", F.lit(False))
    return planner.actions(hosts, pending=25, oldest_age=90.0, now=NOW, needed=20)


@query("SELECT o_custkey AS upload_id, count(*) AS parts, min(o_orderkey % 3 + 1) = 1 AND max(o_orderkey % 3 + 1) = count(*) AND count(DISTINCT o_orderkey % 3) = count(*) AND bool_and(o_orderkey % 7 <> 0) AS complete FROM orders GROUP BY o_custkey")
def upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "orders").selectExpr("o_custkey as upload_id", "o_orderkey % 3 + 1 as part_number", "if(o_orderkey % 7 <> 0, 'etag', null) as etag")
    return discovery.complete_upload(parts)


@query("SELECT min(l_orderkey * 10 + l_linenumber) AS pos, l_partkey AS path FROM lineitem GROUP BY l_partkey")
def distinct_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.distinct_inputs(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as pos", "l_partkey as path"))


@query("SELECT s_suppkey AS id, regexp_full_match(ip, '((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])') AS valid, flag IN ('true', '1') AS enabled, concat(ip, '|', coalesce(label, ''), '|', flag) AS fingerprint FROM (SELECT s_suppkey, concat('10.0.', CAST(s_suppkey * 7 % 300 AS VARCHAR), '.', CAST(s_suppkey % 256 AS VARCHAR)) AS ip, CASE s_suppkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '1' ELSE 'off' END AS flag, CASE WHEN s_suppkey % 2 = 0 THEN 'x' END AS label FROM supplier)")
def pool_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    ip = F.concat(F.lit("10.0."), (k * 7 % 300).cast("string"), F.lit("."), (k % 256).cast("string"))
    flag = F.when(k % 3 == 0, "true").when(k % 3 == 1, "1").otherwise("off")
    label = F.when(k % 2 == 0, "x")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), scalars.is_ipv4(ip).alias("valid"), scalars.is_true(flag).alias("enabled"), scalars.fingerprint(ip, label, flag).alias("fingerprint"))


# -- decoders ---------------------------------------------------------------


@query("""
, v AS (SELECT video_id, 64 + video_id % 5 * 32 AS size FROM video_info), a AS (SELECT video_id, size // 32 AS side, unnest(range(size // 32 * (size // 32) * 2)) AS anchor FROM v)
SELECT video_id, anchor, CAST(anchor // 2 % side * 32 AS DOUBLE) AS x, CAST(anchor // 2 // side * 32 AS DOUBLE) AS y FROM a
""")
def anchor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = view(spark, sf_dir, "video_info").select("video_id", (64 + F.col("video_id") % 5 * 32).alias("size"))
    return decoding.anchor_grid(videos, "size", 32).select("video_id", "anchor", "x", "y")


_FIT = "least(640.0 / width, 640.0 / height)"


@query(f"""
, f AS (SELECT video_id, width, height, {_FIT} AS r, (640 - CAST(trunc(width * {_FIT}) AS INTEGER)) // 2 AS l, (640 - CAST(trunc(height * {_FIT}) AS INTEGER)) // 2 AS t, 100.0 + video_id % 50 AS bx, 120.0 + video_id % 40 AS b_y FROM video_info)
SELECT video_id, greatest(0, CAST(trunc((bx - l) / r) AS INTEGER)) AS x1, greatest(0, CAST(trunc((b_y - t) / r) AS INTEGER)) AS y1, least(width, CAST(trunc((bx + 200 - l) / r) AS INTEGER)) AS x2, least(height, CAST(trunc((b_y + 220 - t) / r) AS INTEGER)) AS y2 FROM f
""")
def letterbox_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = 100.0 + F.col("video_id") % 50, 120.0 + F.col("video_id") % 40
    fit = decoding.letterbox(F.col("width"), F.col("height"), 640)
    rows = view(spark, sf_dir, "video_info").withColumn("fit", fit)
    sides = decoding.from_letterbox((x, y, x + 200, y + 220), F.col("fit"), F.col("width"), F.col("height"))
    return rows.select("video_id", *(c.alias(n) for n, c in zip(boxes.SIDES, sides)))


@query("""
, c AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 AS cell, CAST(l_linenumber * 0.1 AS DOUBLE) AS dx, CAST(l_linenumber * 0.05 AS DOUBLE) AS dy, CAST(l_linenumber * 0.25 AS DOUBLE) AS dw, CAST(l_linenumber * 0.125 AS DOUBLE) AS dh, l_discount * 12 AS cls, l_tax * 11 AS obj FROM lineitem)
SELECT l_orderkey AS frame_idx, l_linenumber AS det_id, round((cell % 30 + dx) * 16 - exp(dw) * 8, 5) AS x1, round((cell // 30 + dy) * 16 - exp(dh) * 8, 5) AS y1, round((cell % 30 + dx) * 16 + exp(dw) * 8, 5) AS x2, round((cell // 30 + dy) * 16 + exp(dh) * 8, 5) AS y2,
 round(sqrt(least(1.0, greatest(0.0, cls)) * least(1.0, greatest(0.0, obj))), 5) AS score FROM c
""")
def grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber").cast("double")
    sides = decoding.grid_box(F.col("l_partkey") % 900, F.lit(30), F.lit(16), F.array(k * 0.1, k * 0.05, k * 0.25, k * 0.125))
    score = decoding.grid_score(F.col("l_discount") * 12, F.col("l_tax") * 11)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_idx"), F.col("l_linenumber").alias("det_id"), *(F.round(c, 5).alias(n) for n, c in zip(boxes.SIDES, sides)), F.round(score, 5).alias("score"))


@query("""
, c AS (SELECT p_partkey AS id, CAST(60 + p_size * 4 AS DOUBLE) AS long_side, CAST(40 + p_partkey % 60 * 2 AS DOUBLE) AS short_side, CAST(p_partkey % 10 AS DOUBLE) / 10 AS fill, CAST(p_partkey % 53 AS DOUBLE) AS texture FROM part), d AS (SELECT *, long_side * short_side AS area FROM c)
SELECT id, round_even((1 - abs(long_side / short_side - 1.586) / 0.75) * 0.6 + fill * 0.3 + (1 - least(texture, 46) / 46) * 0.1, 3) AS score FROM d
WHERE area BETWEEN 0.0015 * 1920 * 1080 AND 0.06 * 1920 * 1080 AND long_side / short_side BETWEEN 1.25 AND 2.0 AND fill >= 0.55 AND long_side >= 90 AND texture <= 46
""")
def card_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "cast(60 + p_size * 4 as double) as l", "cast(40 + p_partkey % 60 * 2 as double) as s", "cast(p_partkey % 10 as double) / 10 as fill", "cast(p_partkey % 53 as double) as texture")
    long_side, short_side, fill, texture = (F.col(c) for c in ("l", "s", "fill", "texture"))
    fits = decoding.card_like(long_side * short_side, long_side, short_side, fill, texture, F.lit(1920), F.lit(1080))
    return rows.filter(fits).select("id", decoding.card_score(long_side, short_side, fill, texture).alias("score"))


# -- fusion rules -----------------------------------------------------------

_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_UNION = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER})"
_IOU = f"CASE WHEN {_UNION} > 0 THEN {_INTER} / {_UNION} ELSE 0 END"
_SAME = "a.video_id = b.video_id AND a.frame_idx = b.frame_idx"


@query(f"SELECT video_id, frame_idx, det_id FROM jittered a WHERE model = 'A' AND (score >= 0.45 OR EXISTS (SELECT 1 FROM jittered b WHERE b.model = 'B' AND {_SAME} AND {_IOU} >= 0.25))")
def verified_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.verified(*_by_model(spark, sf_dir)).select("video_id", "frame_idx", "det_id")


@query(f"SELECT video_id, frame_idx, det_id FROM jittered a WHERE model = 'A' AND ((x2 - x1) * (y2 - y1) < 0.05 * 300 * 280 OR EXISTS (SELECT 1 FROM jittered b WHERE b.model = 'B' AND {_SAME} AND {_IOU} >= 0.25))")
def verified_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.verified_by_size(*_by_model(spark, sf_dir), width=300, height=280).select("video_id", "frame_idx", "det_id")


@query(f"""
, r AS (SELECT video_id, frame_idx AS since, x1, y1, x2, y2 FROM jittered WHERE model = 'B' AND score < 0.5)
SELECT a.video_id, a.frame_idx, a.det_id FROM jittered a WHERE model = 'A' AND NOT EXISTS (SELECT 1 FROM r b WHERE a.video_id = b.video_id AND a.frame_idx BETWEEN b.since AND b.since + 5 AND {_IOU} >= 0.3)
""")
def reject_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.withColumn("eye", F.lit(None).cast("string")) for x in _by_model(spark, sf_dir))
    return fusion.outside_cooldown(a, b.filter("score < 0.5"), 0.3).select("video_id", "frame_idx", "det_id")


@query("SELECT video_id, frame_idx, det_id, score < 0.45 OR det_id % 5 * 0.1 >= 0.35 AS uncertain, score - det_id * 0.01 + 0.000001 >= score - 0.02 AS consistent FROM detections")
def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, risk = F.col("score"), F.col("det_id") % 5 * 0.1
    uncertain, consistent = fusion.needs_verification(score, risk, 0.30), fusion.scores_consistent(score, score - F.col("det_id") * 0.01)
    return view(spark, sf_dir, "detections").select("video_id", "frame_idx", "det_id", uncertain.alias("uncertain"), consistent.alias("consistent"))


@query("SELECT video_id, frame_idx, det_id, x1, x2, false AS mirror FROM detections UNION ALL SELECT video_id, frame_idx, det_id, x1 + dx, x2 + dx, true FROM (SELECT *, CASE WHEN (x1 + x2) / 2 < 700 THEN 700 ELSE -700 END AS dx FROM detections)")
def mirrored_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.mirrored(view(spark, sf_dir, "detections"), F.lit(700)).select("video_id", "frame_idx", "det_id", "x1", "x2", "mirror")


@query("""
, p AS (SELECT video_id, frame_idx AS f, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py, greatest(x2 - x1, y2 - y1, 1) AS side FROM jittered WHERE model = 'B'), c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM jittered WHERE model = 'A'),
j AS (SELECT c.video_id, c.frame_idx, c.det_id, f, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) / side AS d FROM c JOIN p ON c.video_id = p.video_id AND p.f BETWEEN c.frame_idx - 50 AND c.frame_idx - 1)
SELECT video_id, frame_idx, det_id, min((f, d))[1] AS pending_frame, round(min((f, d))[2], 6) AS distance FROM j WHERE d <= 2.5 GROUP BY video_id, frame_idx, det_id
""")
def pending_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    confirmed, pending = _by_model(spark, sf_dir)
    return rounded(timeline.confirmations(pending, confirmed, horizon=50), "distance")


@query(f"SELECT a.video_id, a.frame_idx, a.det_id AS det_a, b.det_id AS det_b, round({_INTER} / (greatest((a.x2 - a.x1) * (a.y2 - a.y1), 1) + greatest((b.x2 - b.x1) * (b.y2 - b.y1), 1) - {_INTER}), 6) AS floored, round(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1, 0) / ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1, 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1, 0)), 6) AS inclusive FROM jittered a JOIN jittered b ON {_SAME} AND a.model = 'A' AND b.model = 'B'")
def iou_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.pairs_in_frame(*_by_model(spark, sf_dir), F.lit(True))
    left, right = boxes.box("l_"), boxes.box("r_")
    return found.select(F.col("l_video_id").alias("video_id"), F.col("l_frame_idx").alias("frame_idx"), F.col("l_det_id").alias("det_a"), F.col("r_det_id").alias("det_b"), r6(boxes.iou_floored(left, right)).alias("floored"), r6(boxes.iou_inclusive(left, right)).alias("inclusive"))


#: Shares of a box at which five landmarks lie: (x, y) of eyes, nose and mouth corners;
#: every det_id breaks another condition of the hard test, or none (0 and 1).
_POINTS = (
    ("0.3", "0.35"), ("CASE k WHEN 2 THEN 0.2 WHEN 3 THEN 1.1 ELSE 0.7 END", "CASE k WHEN 6 THEN 0.75 ELSE 0.35 END"),
    ("CASE k WHEN 5 THEN 0.9 ELSE 0.5 END", "CASE k WHEN 4 THEN 0.3 WHEN 1 THEN 0.6 ELSE 0.5 END"), ("0.36", "CASE k WHEN 7 THEN 1.2 ELSE 0.75 END"), ("0.6", "CASE k WHEN 7 THEN 1.2 ELSE 0.75 END"),
)


@query(f"""
, d AS (SELECT *, det_id % 8 AS k, x2 - x1 AS w, y2 - y1 AS h FROM detections), p AS (SELECT *, {', '.join(f"x1 + ({x}) * w AS px{i}, y1 + ({y}) * h AS py{i}" for i, (x, y) in enumerate(_POINTS))} FROM d),
f AS (SELECT *, (py3 + py4) / 2 - (py0 + py1) / 2 AS reach FROM p)
SELECT video_id, frame_idx, det_id, w > 0 AND h > 0 AND px0 < px1 AND px3 < px4 AND (px1 - px0) / w BETWEEN 0.01 AND 0.75 AND (px4 - px3) / w BETWEEN 0.03 AND 0.75 AND reach BETWEEN 0.25 * h AND 0.7 * h AND abs(py1 - py0) <= 0.35 * h AND abs(py4 - py3) <= 0.35 * h
 AND (py2 - (py0 + py1) / 2) / reach BETWEEN 0.02 AND 1.05 AND px2 BETWEEN least(px0, px1, px3, px4) - 0.08 * w AND greatest(px0, px1, px3, px4) + 0.08 * w
 AND {' AND '.join(f"px{i} BETWEEN x1 - 0.15 * w AND x2 + 0.15 * w AND py{i} BETWEEN y1 - 0.15 * h AND y2 + 0.15 * h" for i in range(5))} AS plausible FROM f
""")
def plausible_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "detections").withColumn("k", F.col("det_id") % 8)
    points = F.array(*(F.expr(f"struct(double(x1 + ({x}) * (x2 - x1)) as x, double(y1 + ({y}) * (y2 - y1)) as y)") for x, y in _POINTS))
    return rows.select("video_id", "frame_idx", "det_id", boxes.plausible_landmarks(points, boxes.box()).alias("plausible"))


@query("SELECT video_id, min(x1) AS x1, min(y1) AS y1, max(x1) AS x2, max(y1) AS y2 FROM detections GROUP BY video_id")
def polygon_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    hulls = view(spark, sf_dir, "detections").select("video_id", *(c.alias(n) for n, c in zip(boxes.SIDES, boxes.hull(point))))
    return hulls.groupBy("video_id").agg(*((F.min if n in ("x1", "y1") else F.max)(n).alias(n) for n in boxes.SIDES))


@query(f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, det_id ORDER BY frame_idx, x1, y1, x2, y2) AS k FROM jittered),
step AS (SELECT video_id, det_id, k, frame_idx, x1, y1, x2, y2 FROM r WHERE k = 1 UNION ALL
 SELECT r.video_id, r.det_id, r.k, r.frame_idx, {', '.join(f"round_even(r.{c} * 0.65 + s.{c} * 0.35, 0)" for c in ("x1", "y1", "x2", "y2"))} FROM step s JOIN r ON s.video_id = r.video_id AND s.det_id = r.det_id AND r.k = s.k + 1)
SELECT video_id, det_id, frame_idx, x1, y1, x2, y2 FROM step
""", recursive=True)
def smoothed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.smoothed_tracks(view(spark, sf_dir, "jittered"), ["video_id", "det_id"])
