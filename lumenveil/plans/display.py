"""Registered queries over whole display and export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil import schemas
from lumenveil.operators import display
from lumenveil.plans.fixtures import view
from lumenveil.plans.queries import NOW
from lumenveil.plans.registry import query

_NOW = NOW + 5e6
#: Columns that the fixture tasks lack.
_MORE = {
    "output_object_key": "case when n % 4 = 0 then concat('outputs/', cast(n as string), '.mp4') when n % 4 = 1 then '' end",
    "output_sha256": "case when n % 3 = 0 then sha2(cast(n as string), 256) end", "error_message": "case when n % 10 = 5 then concat('code ', cast(n % 7 as string)) when n % 10 = 6 then '' end",
    "restarted_at": "case when n % 9 = 0 then started_at + 30 end", "arguments": "case when n % 5 > 0 then array('--frame-skip', cast(n % 4 as string)) end", "algorithm": "concat('v', cast(n % 3 as string))",
    "face_annotated_at": "case when n % 5 in (1, 2) then created_at + 100 end", "source_sha256": "case when n % 6 = 1 then sha2(task_id, 256) end", "source_duration_seconds": "cast(n % 100 as double) / 4",
}


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = view(spark, sf_dir, "tasks").selectExpr("*", *(f"{x} as {c}" for c, x in _MORE.items()))
    given = given.withColumn("progress", F.expr("case when n % 8 = 1 then concat(substring(progress, 1, length(progress) - 1), ', \"output_filename\": \"o', cast(n as string), '\"}') else progress end"))
    return schemas.migrate(given, schemas.TASKS)


_DUCK = {c: x.replace("sha2(", "sha256(").replace(", 256)", ")").replace("array('--frame-skip', cast(n % 4 as string))", "['--frame-skip', cast(n % 4 as string)]") for c, x in _MORE.items()}
_WITH = f"""
, w AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _DUCK.items())}, CASE WHEN n % 8 > 0 THEN n * 11 % 2400 END::DOUBLE AS ps, CASE WHEN n % 8 > 0 THEN floor(created_at)::BIGINT + n % 700 END::DOUBLE AS pa, CASE WHEN n % 8 > 0 THEN n * 100 END AS pi, CASE WHEN n % 8 > 0 THEN n * 80 END AS po FROM tasks)
"""


def _secs(x: str) -> str:
    r = f"round_even({x}, 0)::BIGINT"
    return f"CASE WHEN {x} IS NULL THEN '-' WHEN {x} < 60 THEN concat(printf('%.1f', round_even({x}, 1)), 's') WHEN {r} >= 3600 THEN concat({r} // 3600, 'h ', {r} % 3600 // 60, 'm ', {r} % 60, 's') ELSE concat({r} // 60, 'm ', {r} % 60, 's') END"


def _size(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' " + " ".join(f"WHEN {x} >= {1024**k} THEN concat(printf('%.1f', round_even({x} / {1024**k}, 1)), ' {u}')" for k, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB"))) + f" ELSE concat({x}, ' B') END"


def _time(x: str, missing: str) -> str:
    return f"coalesce(strftime(to_timestamp(floor({x})) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC', '{missing}')"


_NAME = "CASE WHEN regexp_matches(coalesce(assigned_worker_id, ''), '^.+-slot-[0-9]+$') THEN regexp_extract(assigned_worker_id, '^(.+)-slot-([0-9]+)$', 1) ELSE coalesce(assigned_worker_id, '') END"
_SLOT = "regexp_extract(coalesce(assigned_worker_id, ''), '^(.+)-slot-([0-9]+)$', 2)"


@query(f"""{_WITH}
SELECT task_id, status, CASE WHEN {_NAME} = '' THEN '-' ELSE {_NAME} END AS worker_name, {_SLOT} AS worker_slot, source_object_key AS source_name, {_size('coalesce(pi, source_size_bytes)')} AS input_size,
 coalesce(nullif(output_object_key, ''), CASE WHEN n % 8 = 1 THEN concat('o', n) END, '-') AS output_name, concat({_size('po')}, ' · ', {_secs('output_duration_seconds')}) AS output_meta, coalesce(output_sha256, '') AS output_hash,
 CASE WHEN ps IS NOT NULL THEN concat('Process: ', {_secs('ps')}) WHEN status IN ('processing', 'uploading', 'cancelling') THEN concat('Process: running ', {_secs(f'greatest({_NOW} - started_at, 0)')}) ELSE 'Process: -' END AS process_label,
 CASE WHEN finished_at IS NOT NULL AND started_at IS NOT NULL THEN concat('Task lifetime: ', {_secs('(finished_at - started_at)')}) ELSE '' END AS lifetime, attempt_count, {_time('created_at', '-')} AS created_at,
 CASE WHEN restarted_at IS NOT NULL THEN 'Restarted' ELSE 'Started' END AS execution_started_label, {_time('coalesce(restarted_at, pa, started_at)', '-')} AS execution_started_at, {_time('finished_at', '-')} AS execution_finished_at,
 CASE WHEN face_annotation = 1 THEN '👍 Face' WHEN face_annotation = 0 THEN '👎 No face' WHEN face_review_owner <> '' AND face_review_lease_until > {_NOW} THEN '👀 Reviewing' ELSE 'Unlabelled' END AS manual_label,
 CASE WHEN face_annotation IS NOT NULL THEN 'labelled' WHEN face_review_owner <> '' AND face_review_lease_until > {_NOW} THEN 'reviewing' ELSE 'unlabelled' END AS manual_label_state, coalesce(nullif(error_message, ''), '-') AS error_message FROM w
""")
def task_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of every task's row in the overview."""
    return display.rows(_tasks(spark, sf_dir), _NOW)


@query(f"""{_WITH}
SELECT task_id, status, source_url, source_object_key, source_size_bytes, source_sha256, source_duration_seconds, algorithm, CASE WHEN n % 5 > 0 THEN concat('["--frame-skip","', n % 4, '"]') ELSE '' END AS arguments, NULL::VARCHAR AS output_upload_url, output_object_key,
 attempt_count, max_attempts, coalesce(assigned_worker_id, '') AS assigned_worker_id, {_NAME} AS worker_name, {_SLOT} AS worker_slot,
 CASE WHEN n % 8 = 0 THEN '{{}}' ELSE concat('{{"input_bytes":', pi, CASE WHEN n % 8 = 1 THEN concat(',"output_bytes":', po, ',"output_filename":"o', n, '"') ELSE concat(',"output_bytes":', po) END, ',"processing_seconds":', ps::BIGINT, ',"processing_started_at":', pa::BIGINT, '}}') END AS progress,
 ps AS processing_seconds, finished_at - started_at AS lifetime_seconds, output_sha256, po AS output_bytes, output_duration_seconds, error_message, {', '.join(f"{_time(c, '')} AS {c}" for c in ('created_at', 'started_at', 'restarted_at', 'finished_at', 'face_annotated_at', 'face_review_lease_until', 'updated_at'))},
 CASE face_annotation WHEN 1 THEN 'Has face' WHEN 0 THEN 'No face' ELSE 'Unlabelled' END AS face_annotation, face_review_owner FROM w
""")
def task_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of every task in the spreadsheet."""
    return display.export(_tasks(spark, sf_dir))
