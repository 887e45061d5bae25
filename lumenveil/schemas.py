"""Schemas, enumerations and additive migration of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# States and sets of states of tasks, workers and reviews.
TASK_STATES = ("pending", "assigned", "downloading", "processing", "uploading", "cancelling", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("assigned", "downloading", "processing", "uploading", "cancelling")
WORKER_STATES = ("ready", "busy", "cancelling", "offline")
REVIEW_TYPES = ("missed", "false_positive")

# Names and order of the columns.
TASKS = (
    "task_id string, source_url string, source_object_key string, source_size_bytes bigint, source_sha256 string, source_duration_seconds double, "
    "algorithm string, arguments array<string>, output_upload_url string, output_object_key string, status string, attempt_count int, max_attempts int, "
    "assigned_worker_id string, progress string, output_sha256 string, output_duration_seconds double, error_message string, created_at double, "
    "started_at double, restarted_at double, finished_at double, face_annotation int, face_annotated_at double, face_review_owner string, "
    "face_review_lease_until double, updated_at double"
)
WORKERS = (
    "worker_id string, token_hash string, status string, capabilities string, current_task_id string, last_seen_at double, created_at double, updated_at double"
)
TASK_LOGS = (
    "id bigint, task_id string, worker_id string, attempt_count int, created_at double, line string"
)
DETECTIONS = (
    "video_id bigint, frame_idx bigint, det_id int, model string, x1 double, y1 double, x2 double, y2 double, score double, "
    "landmarks array<struct<x: double, y: double>>, eye string"
)
TRACKS = (
    "video_id bigint, frame_idx bigint, track_id int, x1 int, y1 int, x2 int, y2 int, visible boolean, source string"
)
REVIEWS = (
    "id bigint, task_id bigint, frame_number int, timestamp double, review_type string, note string, screenshot_path string, created_at double"
)


def migrate(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with the columns that a schema adds, as typed nulls at the end."""
    schema = T.StructType.fromDDL(ddl)
    missing = [f for f in schema.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
