"""Window statistics over task intervals: totals, servers, buckets, concurrency.

A bucket join explodes an interval into the buckets it touches and groups by
bucket, so it is an equi-aggregation whatever the number of intervals. The peak
is a running sum of +1/-1 events. One bucket may hold a large share of all
events, so the running sum has two levels: slices of a bucket are summed on
their own and the sums of the slices before are carried in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenveil.functions.scalars import first_truthy, server_name
from lumenveil.schemas import TERMINAL

#: Slices of a bucket in which concurrency is first summed.
SLICES = 60


def bucket_of(time: Column, width: int) -> Column:
    return (F.floor(time / width) * width).cast("long")


def bucket_starts(start: float, end: float, width: int) -> tuple[int, int]:
    """First bucket and number of buckets of a window; rejects empty windows."""
    if end <= start or width < 60:
        raise ValueError("the window must not be empty and a bucket must hold 60 seconds")
    first = int(start // width) * width
    return first, max(1, int((end - first + width - 1) // width))


def spine(spark: SparkSession, start: float, end: float, width: int) -> DataFrame:
    """(bucket): every bucket of the window."""
    first, n = bucket_starts(start, end, width)
    return spark.range(n).select((F.lit(first) + F.col("id") * width).cast("long").alias("bucket"))


def _number(progress: Column, field: str) -> Column:
    return F.get_json_object(progress, f"$.{field}").try_cast("double")


def in_window(tasks: DataFrame, start: float, end: float) -> DataFrame:
    """Terminal tasks that finished in [start, end)."""
    return tasks.filter((F.col("finished_at") >= start) & (F.col("finished_at") < end) & F.col("status").isin(*TERMINAL))


def totals(tasks: DataFrame, start: float, end: float) -> DataFrame:
    """One row: counts, rates, seconds, bytes and ratios of the window."""
    done = F.col("status") == "completed"
    positive = lambda x: F.sum(F.when(done & (x > 0), x))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    video = first_truthy(F.col("output_duration_seconds"))
    agg = in_window(tasks, start, end).agg(
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.greatest(F.col("attempt_count") - 1, F.lit(0))), F.lit(0)).cast("long").alias("retry_count"),
        zero(positive(video)).alias("video_seconds"), zero(positive(_number(F.col("progress"), "processing_seconds"))).alias("processing_seconds"),
        zero(positive(F.col("finished_at") - F.col("started_at"))).alias("end_to_end_seconds"),
        zero(positive(_number(F.col("progress"), "input_bytes"))).cast("long").alias("input_bytes"),
        zero(positive(_number(F.col("progress"), "output_bytes"))).cast("long").alias("output_bytes"),
    )
    over = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    return agg.withColumns(
        {
            "success_rate": F.try_divide(F.col("completed"), F.nullif(F.col("completed") + F.col("failed"), F.lit(0))),
            "algorithm_realtime": over("video_seconds", "processing_seconds"),
            "calendar_realtime": F.col("video_seconds") / (end - start),
            "worker_hours_per_video_hour": over("processing_seconds", "video_seconds"),
        }
    )


def by_server(tasks: DataFrame, start: float, end: float) -> DataFrame:
    """A row per server: slots seen, counts, sums of completed tasks and ratios."""
    done = F.col("status") == "completed"
    total = lambda x: F.coalesce(F.sum(F.when(done, x)), F.lit(0.0))
    worker = F.col("assigned_worker_id")
    agg = (
        in_window(tasks, start, end)
        .groupBy(server_name(worker).alias("server"))
        .agg(
            F.countDistinct(F.when(worker != "", worker)).alias("slots"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
            total(F.coalesce(F.col("output_duration_seconds"), F.lit(0.0))).alias("video_seconds"), total(_number(F.col("progress"), "processing_seconds")).alias("processing_seconds"),
            total(F.col("finished_at") - F.col("started_at")).alias("busy_seconds"),
        )
    )
    over = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    return agg.withColumns({"algorithm_realtime": over("video_seconds", "processing_seconds"), "busy_realtime": over("video_seconds", "busy_seconds"), "worker_hours_per_video_hour": over("busy_seconds", "video_seconds")})


def completed_per_bucket(tasks: DataFrame, start: float, end: float, width: int = 3600) -> DataFrame:
    """(bucket, completed, failed, video_seconds), zero-filled."""
    done = F.col("status") == "completed"
    counted = (
        in_window(tasks, start, end)
        .groupBy(bucket_of(F.col("finished_at"), width).alias("bucket"))
        .agg(F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(done & (F.col("output_duration_seconds") > 0), F.col("output_duration_seconds"))).alias("video_seconds"))
    )
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return spine(tasks.sparkSession, start, end, width).join(counted, "bucket", "left").select("bucket", zero("completed", 0), zero("failed", 0), zero("video_seconds", 0.0))


def clipped(intervals: DataFrame, start: float, end: float, width: int) -> DataFrame:
    """(bucket, s, e): the parts of intervals (started_at, finished_at) by bucket.

    An open interval ends with the window; empty parts do not occur.
    """
    overlap = intervals.filter((F.col("started_at") < end) & (F.col("finished_at").isNull() | (F.col("finished_at") > start)))
    cut = overlap.select(F.greatest("started_at", F.lit(float(start))).alias("s"), F.least(F.coalesce("finished_at", F.lit(float(end))), F.lit(float(end))).alias("e")).filter("e > s")
    touched = F.sequence(bucket_of(F.col("s"), width), bucket_of(F.col("e") - 1e-6, width), F.lit(width).cast("long"))
    parts = cut.select("s", "e", F.explode(touched).alias("bucket"))
    return parts.select("bucket", F.greatest("s", F.col("bucket").cast("double")).alias("s"), F.least("e", (F.col("bucket") + width).cast("double")).alias("e"))


def algorithm_intervals(tasks: DataFrame, start: float, end: float) -> DataFrame:
    """Intervals of processing: from their stated start, else the task's own."""
    seconds = _number(F.col("progress"), "processing_seconds")
    begun = F.coalesce(_number(F.col("progress"), "processing_started_at"), F.col("started_at"))
    alive = F.least(F.coalesce("finished_at", F.lit(float(end))), F.lit(float(end))) > F.greatest("started_at", F.lit(float(start)))
    return tasks.filter((seconds > 0) & alive).select(begun.alias("started_at"), (begun + seconds).alias("finished_at"))


def concurrency(tasks: DataFrame, start: float, end: float, width: int = 3600) -> DataFrame:
    """(bucket, in_flight_seconds, average, peak) of every bucket.

    At equal times ends count before starts. A bucket's events are summed in
    SLICES parts of its width first; the parts' sums are carried on. Seconds come
    from the same events: a start takes its place in the bucket off, an end adds it.
    """
    parts = clipped(tasks, start, end, width)
    steps = parts.select("bucket", F.inline(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))))
    # Long intervals give many events at the bounds of buckets, which are added up where they are made.
    counted = steps.groupBy("bucket", (F.col("t") - F.col("bucket")).alias("place"), "d").agg(F.sum("d").alias("change"))
    placed = counted.withColumn("slice", F.floor(F.col("place") / (width / SLICES)))
    inside = Window.partitionBy("bucket", "slice").orderBy("place", "d").rowsBetween(Window.unboundedPreceding, 0)
    slices = (
        placed.withColumn("level", F.sum("change").over(inside))
        .groupBy("bucket", "slice")
        .agg(F.max("level").alias("high"), F.sum("change").alias("change"), F.sum(-F.col("change") * F.col("place")).alias("seconds"))
    )
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    levels = slices.withColumn("peak", F.col("high") + F.coalesce(F.sum("change").over(before), F.lit(0)))
    found = levels.groupBy("bucket").agg(F.sum("seconds").alias("in_flight_seconds"), F.greatest(F.max("peak"), F.lit(0)).alias("peak"))
    joined = spine(tasks.sparkSession, start, end, width).join(found, "bucket", "left")
    return joined.select(
        "bucket", F.coalesce("in_flight_seconds", F.lit(0.0)).alias("in_flight_seconds"), (F.coalesce("in_flight_seconds", F.lit(0.0)) / width).alias("average"), F.coalesce("peak", F.lit(0)).cast("long").alias("peak")
    )


def algorithm_seconds(tasks: DataFrame, start: float, end: float, width: int = 3600) -> DataFrame:
    """(bucket, algorithm_seconds), zero-filled."""
    parts = clipped(algorithm_intervals(tasks, start, end), start, end, width).groupBy("bucket").agg(F.sum(F.col("e") - F.col("s")).alias("algorithm_seconds"))
    return spine(tasks.sparkSession, start, end, width).join(parts, "bucket", "left").select("bucket", F.coalesce("algorithm_seconds", F.lit(0.0)).alias("algorithm_seconds"))


def overall(buckets: DataFrame) -> DataFrame:
    """Mean and highest concurrency over all buckets."""
    return buckets.agg(F.avg("average").alias("mean_concurrency"), F.max("peak").alias("peak_concurrency"))


def model_timing(calls: DataFrame) -> DataFrame:
    """(label, seconds) rows as calls, total seconds and mean milliseconds."""
    return calls.groupBy("label").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total_seconds"), (F.avg("seconds") * 1000).alias("average_ms"))
