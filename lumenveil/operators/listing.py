"""Listings: filters, search, pages, orders, histograms and display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenveil.functions import scalars
from lumenveil.schemas import TASK_STATES

SEARCHED = ("task_id", "source_url", "source_object_key", "assigned_worker_id", "status")
LABELS = ("has_face", "no_face", "unlabelled")
MOST_ROWS = 1000


def search(columns: tuple[str, ...], text: str) -> Column:
    """Whether any column contains ``text``; ASCII letters in either case."""
    wanted = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.col(name).cast("string"), F.lit("")).ilike(f"%{wanted}%")
    return found


def label_filter(labels: list[str]) -> Column:
    """Any of has_face, no_face and unlabelled."""
    if unknown := set(labels) - set(LABELS):
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    label = F.col("face_annotation")
    tests = {"has_face": label == 1, "no_face": label == 0, "unlabelled": label.isNull()}
    found = F.lit(False)
    for name in labels:
        found = found | F.coalesce(tests[name], F.lit(False))
    return found


def filtered(tasks: DataFrame, *, statuses: list[str] | None = None, text: str | None = None, labels: list[str] | None = None, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    if statuses:
        tasks = tasks.filter(F.col("status").isin(*statuses))
    if text:
        tasks = tasks.filter(search(columns, text))
    if labels:
        tasks = tasks.filter(label_filter(labels))
    return tasks


def page(tasks: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page, newest first; size within 1..1000, number at most the last page."""
    size = max(1, min(MOST_ROWS, size))
    last = max(1, -(-tasks.count() // size))
    return tasks.orderBy(F.desc("created_at"), F.desc("task_id")).offset((max(1, min(number, last)) - 1) * size).limit(size)


def status_histogram(tasks: DataFrame) -> DataFrame:
    """A row for every task state, zero-filled."""
    states = tasks.sparkSession.createDataFrame([(s,) for s in TASK_STATES], "status string")
    return states.join(tasks.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def oldest(tasks: DataFrame, statuses: list[str]) -> DataFrame:
    return tasks.filter(F.col("status").isin(*statuses)).agg(F.min("created_at").alias("oldest"), F.count("*").alias("n"))


def worker_rank() -> Column:
    """busy, cancelling, ready, others."""
    status = F.col("status")
    return F.when(status == "busy", 0).when(status == "cancelling", 1).when(status == "ready", 2).otherwise(3)


def ordered_workers(workers: DataFrame) -> DataFrame:
    return workers.orderBy(worker_rank(), F.desc("last_seen_at"), "worker_id")


def server_groups(workers: DataFrame) -> DataFrame:
    """A row per server: slots, ready and busy counts, whether any is online."""
    status = F.col("status")
    return workers.groupBy(scalars.base_worker_id(F.col("worker_id")).alias("server")).agg(
        F.count("*").alias("slots"), F.count_if(status == "ready").alias("ready"), F.count_if(status.isin("busy", "cancelling")).alias("busy"),
        F.bool_or(status != "offline").alias("online"), F.max("last_seen_at").alias("last_seen_at"),
        F.array_join(F.array_sort(F.collect_list("worker_id")), ",").alias("worker_ids"),
    )


def worker_histogram(workers: DataFrame) -> DataFrame:
    return workers.groupBy("status").agg(F.count("*").alias("n"))


def slot_overview(hosts_slots: DataFrame, workers: DataFrame) -> DataFrame:
    """Every (server, slots) expanded to slot ids, with the worker found there."""
    ids = hosts_slots.select("server", F.explode(scalars.slots(F.col("slots"))).alias("slot")).withColumn("worker_id", F.concat_ws("-slot-", "server", F.col("slot").cast("string")))
    known = workers.select("worker_id", F.col("status").alias("worker_status"), F.col("current_task_id").isNotNull().alias("holds"))
    return ids.join(known, "worker_id", "left").select("server", "slot", "worker_id", F.coalesce("worker_status", F.lit("missing")).alias("worker_status"), F.coalesce("holds", F.lit(False)).alias("holds"))


def task_view(tasks: DataFrame, now: float, *, largest: str = "TiB") -> DataFrame:
    """Display rows: names, durations, sizes (up to the ``largest`` unit) and labels as text."""
    begun, ended = F.col("started_at"), F.col("finished_at")
    label = F.when(F.col("face_annotation") == 1, "face").when(F.col("face_annotation") == 0, "no face").otherwise("-")
    return tasks.select(
        "task_id", scalars.basename(F.col("source_object_key")).alias("file"), scalars.server_name(F.col("assigned_worker_id")).alias("server"),
        scalars.spoken_duration(F.coalesce(ended, F.lit(now)) - begun).alias("elapsed"), scalars.format_bytes(F.col("source_size_bytes"), largest).alias("size"), label.alias("label"),
        F.concat(F.col("attempt_count").cast("string"), F.lit("/"), F.col("max_attempts").cast("string")).alias("attempts"),
        F.date_format(F.timestamp_seconds(F.floor("created_at")), "yyyy-MM-dd HH:mm:ss").alias("created"),
    )
