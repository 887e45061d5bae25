"""Reports over runs: totals, rates, estimates and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenveil.schemas import ACTIVE

# A result this short of its frames counts as broken, from this length on.
LEAST_SHARE, LEAST_SECONDS = 0.3, 5.0
#: Fixed value: seconds by which merged segments may differ from their source.
MERGE_TOLERANCE = 2.0


def video_totals(instances: DataFrame) -> DataFrame:
    """(video_id, frames, instances, and per kind) of rows video_id, frame_idx, kind."""
    return instances.groupBy("video_id").agg(
        F.countDistinct("frame_idx").alias("frames"), F.count("*").alias("instances"), *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("face", "card", "pet", "text"))
    )


def timing_deltas(snapshots: DataFrame) -> DataFrame:
    """Calls and seconds since the last snapshot (label, at, calls, seconds)."""
    order = Window.partitionBy("label").orderBy("at")
    since = lambda c: F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0))
    delta = snapshots.withColumns({"new_calls": since("calls"), "new_seconds": since("seconds")})
    return delta.withColumn("average_ms", F.try_divide(F.col("new_seconds") * 1000, F.col("new_calls"))).select("label", "at", "new_calls", "new_seconds", "average_ms")


def run_summary(results: DataFrame) -> DataFrame:
    """(scanned, succeeded, failed, skipped) of rows with an outcome."""
    counted = [F.count_if(F.col("outcome") == o).alias(o) for o in ("succeeded", "failed", "skipped")]
    return results.agg(F.count("*").alias("scanned"), *counted)


def remaining_time(jobs: DataFrame, workers: int, keys: list[str]) -> DataFrame:
    """jobs (keys, position, seconds or null) with ``eta``: mean of the finished
    jobs before it, times the jobs left (itself included), over the workers."""
    order = Window.partitionBy(*keys).orderBy("position")
    mean = F.coalesce(F.avg("seconds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1
    return jobs.withColumn("eta", mean * left / workers)


def realtime_factor(media_seconds: Column, run_seconds: Column) -> Column:
    """Media seconds per second of work; null where either is missing or zero."""
    return F.try_divide(F.nullif(media_seconds, F.lit(0.0)), F.nullif(run_seconds, F.lit(0.0)))


def cpu_percent(samples: DataFrame) -> DataFrame:
    """(host, at, percent) between samples of total and idle ticks of a host."""
    order = Window.partitionBy("host").orderBy("at")
    total, idle = (F.col(c) - F.lag(c).over(order) for c in ("total", "idle"))
    return samples.withColumn("percent", F.try_divide(100.0 * (total - idle), total)).filter("percent is not null").select("host", "at", "percent")


def incomplete(processed: Column, expected: Column, seconds: Column) -> Column:
    """Whether a run has to be repeated by another way: far too few frames."""
    return F.coalesce((seconds > LEAST_SECONDS) & (F.try_divide(processed, expected) < LEAST_SHARE), F.lit(False))


def run_state(alive: Column, stopped: Column, exit_code: Column) -> Column:
    """State of a local run, from its process, its stop flag and its exit code."""
    return F.when(alive, "RUNNING").when(stopped, "STOPPED").when(exit_code == 0, "COMPLETED").when(exit_code.isNotNull(), "FAILED").otherwise("UNKNOWN")


def active_counts(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count_if(F.col("status") == "pending").alias("pending"))


def merges(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, segments, seconds, lossless): whether merged segments fit.

    segments: video_id, seg_idx, seconds. A missing duration is taken as fitting.
    """
    merged = segments.groupBy("video_id").agg(F.count("*").alias("segments"), F.sum("seconds").alias("seconds"))
    near = F.abs(F.col("seconds") - F.col("duration")) < MERGE_TOLERANCE
    return merged.join(videos.select("video_id", "duration"), "video_id", "left").select("video_id", "segments", "seconds", F.coalesce(near, F.lit(True)).alias("lossless"))


def synced(projects: DataFrame, found: DataFrame) -> DataFrame:
    """(task_id, status, error): audit tasks after looking for their media."""
    seen = found.select("task_id", "error", F.lit(True).alias("_seen"))
    status = F.when(F.col("_seen").isNull(), "pending").when(F.col("error").isNotNull(), "error").otherwise("ready")
    return projects.select("task_id").join(seen, "task_id", "left").select("task_id", status.alias("status"), "error")


def flushes(lines: DataFrame, most: int = 20, seconds: float = 5.0) -> DataFrame:
    """(task_id, flush, n, first_at): log lines in batches of a task.

    A batch ends with its ``most``-th line or its span of ``seconds``; spans count
    from the task's first line, so batches need no state but the line's place.
    """
    order = Window.partitionBy("task_id").orderBy("at", "id")
    begun = F.min("at").over(Window.partitionBy("task_id"))
    spans = lines.withColumn("_span", F.floor((F.col("at") - begun) / seconds))
    inside = Window.partitionBy("task_id", "_span").orderBy("at", "id")
    placed = spans.withColumn("_part", F.floor((F.row_number().over(inside) - 1) / most))
    grouped = placed.groupBy("task_id", "_span", "_part").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    return grouped.withColumn("flush", F.row_number().over(Window.partitionBy("task_id").orderBy("_span", "_part"))).select("task_id", "flush", "n", "first_at")
