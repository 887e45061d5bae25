"""Whole display rows and export rows of tasks, as texts that people read.

Progress is a JSON text; numbers in it are read as numbers, whatever is no number
counts as missing. Times are in the session's zone and name it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels that people see.
FACE, NO_FACE, REVIEWING, UNLABELLED = "👍 Face", "👎 No face", "👀 Reviewing", "Unlabelled"
BUSY = ("processing", "uploading", "cancelling")
_NUMBERS = "processing_seconds double, elapsed_seconds double, processing_started_at double, input_bytes double, output_bytes double"


def seconds_text(value: Column) -> Column:
    """``12.5s``, ``3m 4s`` or ``1h 2m 3s``; ``-`` for null."""
    whole = F.bround(value).cast("long")
    h, m, s = (F.floor(whole / 3600).cast("string"), F.floor(whole % 3600 / 60).cast("string"), (whole % 60).cast("string"))
    short = F.concat(m, F.lit("m "), s, F.lit("s"))
    long = F.when(whole >= 3600, F.concat(h, F.lit("h "), short)).otherwise(short)
    return F.when(value.isNull(), "-").when(value < 60, F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit("s"))).otherwise(long)


def size_text(value: Column) -> Column:
    """``12 B`` or ``1.5 MiB``, up to TiB; ``-`` for null."""
    size = value.cast("long")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", F.bround(size / 1024**k, 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size.isNull(), "-").otherwise(out)


def time_text(value: Column, missing: str) -> Column:
    """``2024-01-31 12:00:00 UTC``."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.floor(value)), "yyyy-MM-dd HH:mm:ss z"), F.lit(missing))


def worker_parts(worker: Column) -> tuple[Column, Column]:
    """(name, slot) of a worker id; the whole id and '' where it names no slot."""
    name, slot = (F.regexp_extract(worker, r"^(.+)-slot-([0-9]+)$", k) for k in (1, 2))
    return F.when(slot == "", worker).otherwise(name), slot


def _filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def _label(now: Column, states: tuple[str, str, str, str]) -> Column:
    face, no_face, reviewing, unlabelled = states
    held = F.col("face_annotation").isNull() & (F.col("face_review_owner") != "") & (F.coalesce("face_review_lease_until", F.lit(0.0)) > now)
    return F.when(F.col("face_annotation") == 1, face).when(F.col("face_annotation") == 0, no_face).when(held, reviewing).otherwise(unlabelled)


def rows(tasks: DataFrame, now: float) -> DataFrame:
    """The 19 fields of a task's row in the overview.

    tasks: the columns of ``schemas.TASKS``. A running task shows how long it has run
    until ``now``.
    """
    p = F.from_json("progress", _NUMBERS)
    worker = F.trim(F.coalesce("assigned_worker_id", F.lit("")))
    name, slot = worker_parts(worker)
    processing = F.coalesce(p["processing_seconds"], p["elapsed_seconds"])
    running = F.greatest(F.lit(now) - F.coalesce(p["processing_started_at"], F.col("started_at")), F.lit(0.0))
    running = F.when(F.coalesce(p["processing_started_at"], F.col("started_at")).isNotNull(), running)
    process = F.when(processing.isNotNull(), F.concat(F.lit("Process: "), seconds_text(processing))).when(F.col("status").isin(*BUSY), F.concat(F.lit("Process: running "), seconds_text(running))).otherwise("Process: -")
    again = F.col("restarted_at").isNotNull()
    shown = lambda c: time_text(F.when(c != 0, c), "-")
    return tasks.select(
        "task_id", "status", F.when(name == "", "-").otherwise(name).alias("worker_name"), slot.alias("worker_slot"),
        F.coalesce(_filled(F.col("source_object_key"), F.col("source_url")), F.lit("-")).alias("source_name"),
        size_text(F.coalesce(p["input_bytes"], F.col("source_size_bytes"))).alias("input_size"),
        F.coalesce(_filled(F.col("output_object_key"), F.get_json_object("progress", "$.output_filename")), F.lit("-")).alias("output_name"),
        F.concat(size_text(p["output_bytes"]), F.lit(" · "), seconds_text(F.col("output_duration_seconds"))).alias("output_meta"),
        F.coalesce("output_sha256", F.lit("")).alias("output_hash"), process.alias("process_label"),
        F.coalesce(F.concat(F.lit("Task lifetime: "), F.when(F.col("finished_at").isNotNull() & F.col("started_at").isNotNull(), seconds_text(F.col("finished_at") - F.col("started_at")))), F.lit("")).alias("lifetime"),
        "attempt_count", shown(F.col("created_at")).alias("created_at"), F.when(again, "Restarted").otherwise("Started").alias("execution_started_label"),
        shown(F.when(again, F.col("restarted_at")).otherwise(F.coalesce(p["processing_started_at"], F.col("started_at")))).alias("execution_started_at"), shown(F.col("finished_at")).alias("execution_finished_at"),
        _label(F.lit(now), (FACE, NO_FACE, REVIEWING, UNLABELLED)).alias("manual_label"),
        F.when(F.col("face_annotation").isNotNull(), "labelled").otherwise(_label(F.lit(now), ("labelled", "labelled", "reviewing", "unlabelled"))).alias("manual_label_state"),
        F.coalesce(_filled(F.col("error_message")), F.lit("-")).alias("error_message"),
    )


def export(tasks: DataFrame) -> DataFrame:
    """The 32 columns of a spreadsheet of tasks; JSON is written with sorted keys and no blanks."""
    p = F.from_json("progress", _NUMBERS)
    worker = F.coalesce("assigned_worker_id", F.lit(""))
    name, slot = worker_parts(worker)
    at = lambda c: time_text(F.col(c), "").alias(c)
    label = F.when(F.col("face_annotation") == 1, "Has face").when(F.col("face_annotation") == 0, "No face").otherwise("Unlabelled")
    return tasks.select(
        "task_id", "status", "source_url", "source_object_key", "source_size_bytes", "source_sha256", "source_duration_seconds", "algorithm",
        F.coalesce(F.to_json("arguments"), F.lit("")).alias("arguments"), "output_upload_url", "output_object_key", "attempt_count", "max_attempts",
        worker.alias("assigned_worker_id"), name.alias("worker_name"), slot.alias("worker_slot"), F.coalesce(F.to_json(F.try_parse_json(F.col("progress"))), F.lit("{}")).alias("progress"),
        F.coalesce(p["processing_seconds"], p["elapsed_seconds"]).alias("processing_seconds"), (F.col("finished_at") - F.col("started_at")).alias("lifetime_seconds"),
        "output_sha256", p["output_bytes"].cast("long").alias("output_bytes"), "output_duration_seconds", "error_message", at("created_at"), at("started_at"), at("restarted_at"),
        at("finished_at"), label.alias("face_annotation"), at("face_annotated_at"), "face_review_owner", at("face_review_lease_until"), at("updated_at"),
    )
