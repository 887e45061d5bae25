"""Views of the fixture tables as tasks, workers, logs, frames and detections.

Each view is a list of expressions over one base table that Spark and DuckDB both
read, so the two engines see the same rows. ``{epoch}`` is the one expression
that they spell differently: seconds since 1970 of the column ``ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenveil.session import table

_EPOCH = {
    "spark": "unix_micros(cast(ts as timestamp)) / 1e6",
    "duckdb": "epoch_us(ts) / 1e6",
}

#: view -> (base table, expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "base_tasks": (
        "events",
        [
            "event_id as n",
            "concat('task-', lpad(cast(event_id as string), 8, '0')) as task_id",
            "case event_id % 10 when 0 then 'pending' when 1 then 'assigned' when 2 then 'processing' when 3 then 'uploading'"
            " when 4 then 'cancelling' when 5 then 'failed' when 6 then 'cancelled' else 'completed' end as status",
            "{epoch} as created_at",
            "concat('source/inbox/', event_type, '/clip_', cast(event_id as string), case when event_id % 7 = 0 then '.MOV' else '.mp4' end) as source_object_key",
            "concat('https://storage.example/', event_type, '/', cast(user_id as string), '_', cast(event_id as string), '.mp4') as source_url",
            "event_id * 1000 as source_size_bytes",
            "cast(event_id % 4 as int) as attempt_count",
            "3 as max_attempts",
            "case when event_id % 97 = 0 then 'worker-9-slot-b' when event_id % 89 = 0 then cast(null as string)"
            " else concat('worker-', cast(event_id % 5 as string), '-slot-', cast(event_id % 3 as string)) end as owner",
            "case event_id % 5 when 1 then 1 when 2 then 0 end as face_annotation",
            "case when event_id % 11 = 0 then concat('reviewer-', cast(event_id % 3 as string)) end as face_review_owner",
        ],
    ),
    "task_logs": (
        "orders",
        [
            "o_orderkey as id", "concat('task-', lpad(cast(o_custkey % 40 as string), 8, '0')) as task_id",
            "concat('  ', o_orderstatus, ' ', o_orderpriority, case when o_orderkey % 9 = 0 then '' else ' done' end, '   ') as line",
        ],
    ),
    "workers": (
        "supplier",
        [
            "concat('worker-', cast(s_suppkey % 25 as string), '-slot-', cast(cast(floor(s_suppkey / 25) as bigint) as string)) as worker_id",
            "case s_suppkey % 6 when 0 then 'busy' when 1 then 'cancelling' when 2 then 'offline' else 'ready' end as status",
            "case when s_suppkey % 6 < 2 then concat('task-', lpad(cast(s_suppkey * 10 + 1 as string), 8, '0')) end as current_task_id",
            "1700000000 + cast(floor(s_acctbal) as bigint) as last_seen_at",
            "concat('10.0.', cast(s_suppkey % 4 as string), '.', cast(s_suppkey % 25 as string)) as controller_seen_ip",
        ],
    ),
    "hosts": (
        "nation",
        [
            "n_name as name", "concat('10.0.', cast(n_nationkey % 4 as string), '.', cast(n_nationkey as string)) as private_ip",
            "case n_nationkey % 3 when 0 then 'stopped' when 1 then 'running' else 'starting' end as status",
            "cast(1 + n_nationkey * 7 % 16 as int) as capacity",
        ],
    ),
    "listing": (
        "part",
        [
            "concat(case when p_partkey % 13 = 0 then 'source/inbox/masked/masked_' else 'source/inbox/' end, replace(p_name, ' ', '_'), '/clip_', cast(p_partkey as string),"
            " case p_partkey % 5 when 0 then '.MOV' when 1 then '.txt' else '.mp4' end) as key",
            "cast(p_size as bigint) * (p_partkey % 4) as size", "concat('etag-', cast(p_partkey as string)) as etag",
        ],
    ),
    "outputs": (
        "part",
        [
            "concat('outputs/', replace(p_name, ' ', '_'), '/masked_clip_', cast(p_partkey as string), '.mp4') as key", "cast(p_size as bigint) * 100 as size",
            "p_partkey % 3 as keep",
        ],
    ),
    "reviews": (
        "labels",
        [
            "doc_id as id", "doc_id % 50 as task_id", "cast(doc_id * 17 % 900 as int) as frame_number",
            "case when toxic = 1 then 'false_positive' when quality = 0 then 'missed' else 'ok' end as review_type",
        ],
    ),
    "detections": (
        "lineitem",
        [
            "l_orderkey % 50 as video_id", "l_orderkey as frame_idx", "cast(l_linenumber as int) as det_id",
            "case when l_linenumber % 2 = 0 then 'A' else 'B' end as model",
            "cast(l_partkey % 61 * 20 as double) as x1", "cast(l_suppkey % 37 * 18 as double) as y1",
            "cast(l_partkey % 61 * 20 + 20 + l_suppkey % 9 * 16 as double) as x2", "cast(l_suppkey % 37 * 18 + 24 + l_partkey % 7 * 20 as double) as y2",
            "0.2 + l_discount * 7 as score",
        ],
    ),
    "jittered": (
        "lineitem",
        [
            "l_orderkey % 50 as video_id", "l_orderkey as frame_idx", "cast(l_linenumber as int) as det_id",
            "case when l_linenumber % 2 = 0 then 'A' else 'B' end as model",
            "cast((l_orderkey * 131 + cast(floor((l_linenumber + 1) / 2) as bigint) * 311) % 1500 + l_partkey % 9 as double) as x1",
            "cast((l_orderkey * 57 + cast(floor((l_linenumber + 1) / 2) as bigint) * 173) % 900 + l_suppkey % 7 as double) as y1",
            "cast((l_orderkey * 131 + cast(floor((l_linenumber + 1) / 2) as bigint) * 311) % 1500 + 60 + l_suppkey % 11 as double) as x2",
            "cast((l_orderkey * 57 + cast(floor((l_linenumber + 1) / 2) as bigint) * 173) % 900 + 64 + l_partkey % 8 as double) as y2",
            "0.2 + l_discount * 7 as score",
        ],
    ),
    "video_info": (
        "orders",
        [
            "o_orderkey as video_id", "cast(320 + o_orderkey % 30 * 64 as int) as width", "cast(240 + o_custkey % 20 * 36 as int) as height",
            "case o_orderkey % 5 when 0 then '30000/1001' when 1 then '25/1' when 2 then '0/0' when 3 then '60' else 'x' end as fps_text",
            "cast(o_custkey % 4000 as double) / 7 as duration", "o_orderkey % 8000000 as source_bitrate", "cast(o_orderkey % 4 * 90 as int) as rotation",
        ],
    ),
    "visibility": (
        "events",
        [
            "user_id as video_id", "event_id as frame_idx", "event_type <> 'error' as visible", "cast(event_id % 211 as double) as cx", "cast(event_id % 97 as double) as cy",
            "cast(event_id * 7 % 23 as int) as count",
        ],
    ),
    "patches": ("embeddings", ["vec_id", "embedding"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    if name == "tasks":
        return _tasks(view(spark, sf_dir, "base_tasks"))
    base, expressions = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*(x.format(epoch=_EPOCH["spark"]) for x in expressions))


#: Columns of ``tasks`` that build on those of ``base_tasks``, in two steps.
_STARTED = "case when status <> 'pending' then created_at + n % 600 end as started_at"
_DERIVED = [
    "case when status in ('completed', 'failed', 'cancelled') then started_at + 60 + n * 37 % 5400 end as finished_at",
    "case when status not in ('pending') then owner end as assigned_worker_id",
    "case when status = 'completed' and n % 6 <> 0 then cast(n * 13 % 7200 - 60 as double) end as output_duration_seconds",
    "case when n % 8 = 0 then '{}' else concat('{\"processing_seconds\": ', cast(n * 11 % 2400 as string), ', \"processing_started_at\": ',"
    " cast(cast(floor(created_at) as bigint) + n % 700 as string), ', \"input_bytes\": ', cast(n * 100 as string), ', \"output_bytes\": ', cast(n * 80 as string), '}') end as progress",
    "created_at + 900 as updated_at",
    "case when face_review_owner is not null then 1704070000 + n * 251 % 2600000 end as face_review_lease_until",
]


def _tasks(base: DataFrame) -> DataFrame:
    return base.selectExpr("*", _STARTED).selectExpr("*", *_DERIVED).drop("owner")


def with_views(sql: str) -> str:
    """DuckDB SQL with the fixture views it names in front of it."""
    parts = []
    needs_tasks = "tasks" in sql
    for name, (base, expressions) in VIEWS.items():
        if name in sql or (name == "base_tasks" and needs_tasks):
            parts.append(f"{name} AS (SELECT {', '.join(x.format(epoch=_EPOCH['duckdb']) for x in expressions)} FROM {base})")
    if needs_tasks:
        derived = ", ".join(_DERIVED)
        parts.append(f"started_tasks AS (SELECT *, {_STARTED} FROM base_tasks)")
        parts.append(f"tasks AS (SELECT * EXCLUDE (owner), {derived} FROM started_tasks)")
    sql = sql.strip()
    if parts:
        return f"WITH {', '.join(parts)} {sql}"
    return f"WITH {sql[1:].strip()}" if sql.startswith(",") else sql
