"""Workers, new tasks and progress: the other half of the state machine.

Requests come as tables, many at a time; each rule is a join with the stored
rows and a CASE. A request that its guard rejects changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.operators.control import changed
from lumenveil.schemas import ACTIVE

#: Fixed value: states that a progress report may name.
REPORTED = ("downloading", "processing", "uploading")


def _asked(requests: DataFrame, *columns: str) -> DataFrame:
    """One request of each worker, its columns prefixed by ``_``."""
    return requests.dropDuplicates(["worker_id"]).select("worker_id", *(F.col(c).alias(f"_{c}") for c in columns))


def provisioned(workers: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """workers after requests (worker_id, token_hash) of an administrator.

    The same token changes nothing; another one takes the worker offline and its
    task away; an unknown worker is added.
    """
    joined = workers.join(_asked(requests, "token_hash"), "worker_id", "left")
    rotated = F.col("_token_hash").isNotNull() & ~F.col("_token_hash").eqNullSafe(F.col("token_hash"))
    old = changed(joined, rotated, {"token_hash": F.col("_token_hash"), "status": F.lit("offline"), "current_task_id": F.lit(None), "updated_at": F.lit(now)}).drop("_token_hash")
    new = _asked(requests, "token_hash").join(workers.select("worker_id"), "worker_id", "left_anti")
    stamps = (F.lit(now).alias(c) for c in ("last_seen_at", "created_at", "updated_at"))
    return old.unionByName(new.select("worker_id", F.col("_token_hash").alias("token_hash"), F.lit("offline").alias("status"), *stamps).select("*"), allowMissingColumns=True)


def registered(workers: DataFrame, requests: DataFrame, now: float) -> DataFrame:
    """workers after requests (worker_id, token_hash, capabilities): ready if known."""
    joined = workers.join(_asked(requests, "token_hash", "capabilities"), "worker_id", "left")
    known = F.col("_token_hash") == F.col("token_hash")
    values = {"status": F.lit("ready"), "capabilities": F.col("_capabilities"), "last_seen_at": F.lit(now), "updated_at": F.lit(now)}
    return changed(joined, known, values).drop("_token_hash", "_capabilities")


def heartbeats(workers: DataFrame, tasks: DataFrame, beats: DataFrame, now: float) -> DataFrame:
    """workers after beats (worker_id, token_hash, status, capabilities or null).

    A worker whose task is being cancelled is told so whatever it reports.
    """
    stopping = tasks.filter("status = 'cancelling'").select(F.col("task_id").alias("current_task_id"), F.lit(True).alias("_stop"))
    joined = workers.join(_asked(beats, "token_hash", "status", "capabilities"), "worker_id", "left").join(stopping, "current_task_id", "left")
    known = F.col("_token_hash") == F.col("token_hash")
    values = {
        "status": F.when(F.col("_stop"), "cancelling").otherwise(F.col("_status")),
        "capabilities": F.coalesce("_capabilities", "capabilities") if "capabilities" in workers.columns else F.lit(None),
        "last_seen_at": F.lit(now), "updated_at": F.lit(now),
    }
    return changed(joined, known, values).select(workers.columns)


def retired(workers: DataFrame, ids: DataFrame) -> DataFrame:
    """workers without those among ids that are idle; a held task keeps its worker."""
    idle = F.col("current_task_id").isNull() & F.col("status").isin("ready", "offline")
    gone = workers.filter(idle).join(ids.select("worker_id"), "worker_id", "left_semi")
    return workers.join(gone.select("worker_id"), "worker_id", "left_anti")


def created(requests: DataFrame, algorithm: str, arguments: list[str], now: float) -> DataFrame:
    """New pending tasks of requests; algorithm and arguments are the defaults.

    Requests without a source_url are left out; one without a task_id gets one.
    Columns that the requests lack become nulls.
    """
    have = set(requests.columns)
    column = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    return requests.filter(F.col("source_url").isNotNull() & (F.col("source_url") != "")).select(
        F.coalesce(column("task_id"), F.uuid()).alias("task_id"), "source_url", column("source_object_key").alias("source_object_key"),
        column("source_size_bytes", "bigint").alias("source_size_bytes"), F.coalesce(F.nullif(column("algorithm"), F.lit("")), F.lit(algorithm)).alias("algorithm"),
        F.coalesce(column("arguments", "array<string>"), F.array(*map(F.lit, arguments)) if arguments else F.expr("cast(array() as array<string>)")).alias("arguments"),
        F.coalesce(column("output_upload_url"), F.lit("")).alias("output_upload_url"), F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"),
        F.coalesce(column("max_attempts", "int"), F.lit(3)).alias("max_attempts"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def progressed(tasks: DataFrame, reports: DataFrame, now: float) -> DataFrame:
    """tasks after reports (task_id, worker_id, status, progress) of their holders.

    A task that is being cancelled takes no progress.
    """
    told = reports.filter(F.col("status").isin(*REPORTED)).dropDuplicates(["task_id"])
    joined = tasks.join(told.select("task_id", F.col("worker_id").alias("_worker"), F.col("status").alias("_status"), F.col("progress").alias("_progress")), "task_id", "left")
    holds = (F.col("_worker") == F.col("assigned_worker_id")) & F.col("status").isin(*(s for s in ACTIVE if s != "cancelling"))
    return changed(joined, holds, {"status": F.col("_status"), "progress": F.col("_progress"), "updated_at": F.lit(now)}).select(tasks.columns)


def slots_with_tasks(workers: DataFrame, tasks: DataFrame) -> DataFrame:
    """(worker_id, task_id, cancel): what each holder should know about its task."""
    held = workers.filter("current_task_id is not null").select("worker_id", F.col("current_task_id").alias("task_id"))
    return held.join(tasks.select("task_id", F.col("status").alias("_status")), "task_id", "left").select("worker_id", "task_id", F.coalesce(F.col("_status") == "cancelling", F.lit(False)).alias("cancel"))
