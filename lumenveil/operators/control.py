"""Transitions of the task state machine as pure projections.

Each function takes tables and a time and returns the new tables; nothing reads
a clock. An update of some rows is a left join with the few rows that change,
and every rule is a CASE over the old row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenveil.schemas import ACTIVE, TERMINAL
from lumenveil.session import materialize

#: Ranges into which a queue is dealt before it is numbered.
QUEUE_RANGES = 64


def numbered(df: DataFrame, order: list[Column | str], name: str, ranges: int = QUEUE_RANGES) -> DataFrame:
    """Rows numbered from 1 in a total order, without one task seeing all.

    Rows are range-partitioned by the order and written with the number of their
    range: the bounds of ranges are sampled, so a second evaluation could draw
    others. Each range numbers its own rows and the counts of the ranges before,
    one number a range, are added.
    """
    dealt = materialize(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over `ranges` rows
    carried = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return dealt.join(carried, "_range").withColumn(name, F.row_number().over(inside) + F.col("_before")).drop("_range", "_before")


def changed(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """df with ``values`` where ``when`` holds; columns it lacks are passed over."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items() if c in df.columns})


def claimable(tasks: DataFrame) -> DataFrame:
    return tasks.filter((F.col("status") == "pending") & (F.col("attempt_count") < F.col("max_attempts")))


def claims(tasks: DataFrame, workers: DataFrame) -> DataFrame:
    """(worker_id, task_id, kind): what every ready worker gets, first in first out.

    A worker that still holds an active task gets it again (kind ``held``).
    """
    held = workers.join(tasks.filter(F.col("status").isin(*ACTIVE)), (F.col("current_task_id") == F.col("task_id")), "inner").select("worker_id", "task_id", F.lit("held").alias("kind"))
    idle = workers.filter((F.col("status") == "ready") & F.col("current_task_id").isNull()).select("worker_id")
    queue = numbered(claimable(tasks).select("task_id", "created_at"), ["created_at", "task_id"], "n")
    asking = numbered(idle, ["worker_id"], "n")
    return held.unionByName(asking.join(queue, "n").select("worker_id", "task_id", F.lit("new").alias("kind")))


def apply_claims(tasks: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """tasks after the ``new`` claims: assigned, one attempt more, started once."""
    mine = new.filter("kind = 'new'").select("task_id", F.col("worker_id").alias("_worker"))
    got = F.col("_worker").isNotNull()
    return tasks.join(mine, "task_id", "left").withColumns(
        {
            "status": F.when(got, "assigned").otherwise(F.col("status")), "attempt_count": F.when(got, F.col("attempt_count") + 1).otherwise(F.col("attempt_count")),
            "assigned_worker_id": F.coalesce("_worker", "assigned_worker_id"), "started_at": F.when(got, F.coalesce("started_at", F.lit(now))).otherwise(F.col("started_at")),
            "updated_at": F.when(got, F.lit(now)).otherwise(F.col("updated_at")),
        }
    ).drop("_worker")


def finished_status(status: Column, ok: Column, attempts: Column, most: Column) -> Column:
    """Where a task goes when its holder reports the end."""
    return F.when(status == "cancelling", "cancelled").when(ok, "completed").when(attempts < most, "pending").otherwise("failed")


def finish(tasks: DataFrame, reports: DataFrame, now: float) -> DataFrame:
    """tasks after reports (task_id, worker_id, ok) of holders of active tasks.

    finished_at is set even where the task returns to the queue.
    """
    told = reports.select("task_id", F.col("worker_id").alias("_worker"), F.col("ok").alias("_ok"))
    joined = tasks.join(told, "task_id", "left")
    valid = F.coalesce((F.col("_worker") == F.col("assigned_worker_id")) & F.col("status").isin(*ACTIVE), F.lit(False))
    return joined.withColumns(
        {
            "finished_at": F.when(valid, F.lit(now)).otherwise(F.col("finished_at")), "updated_at": F.when(valid, F.lit(now)).otherwise(F.col("updated_at")),
            "status": F.when(valid, finished_status(F.col("status"), F.col("_ok"), F.col("attempt_count"), F.col("max_attempts"))).otherwise(F.col("status")),
        }
    ).drop("_worker", "_ok")


def cancelled_status(status: Column) -> Column:
    """pending is cancelled at once; a held task is asked to stop; null: rejected."""
    return F.when(status == "pending", "cancelled").when(status.isin(*ACTIVE), "cancelling")


def cancel(tasks: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """(task_id, old_status, new_status, rejected, finished_at) of the ids."""
    hit = tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi")
    new = cancelled_status(F.col("status"))
    told = F.when(F.col("status") == "pending", "cancelled by administrator").when(F.col("status").isin(*(s for s in ACTIVE if s != "cancelling")), "cancellation requested by administrator")
    return hit.select(
        "task_id", F.col("status").alias("old_status"), F.coalesce(new, F.col("status")).alias("new_status"), new.isNull().alias("rejected"),
        F.when(F.col("status") == "pending", F.lit(now)).otherwise(F.col("finished_at")).alias("finished_at"), told.alias("error_message"),
    )


def _fresh(now: float) -> dict[str, Column]:
    """Columns of a task that begins anew."""
    empty = {c: F.lit(None) for c in ("assigned_worker_id", "error_message", "started_at", "restarted_at", "finished_at")}
    return empty | {"status": F.lit("pending"), "attempt_count": F.lit(0), "progress": F.lit("{}"), "updated_at": F.lit(now)}


def _marked(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    return tasks.join(ids.select("task_id", F.lit(True).alias("_again")).distinct(), "task_id", "left")


def restart(tasks: DataFrame, ids: DataFrame, now: float, *, algorithm: str | None = None, arguments: list[str] | None = None) -> DataFrame:
    """tasks where terminal ones among ids begin anew, outputs and leases cleared.

    algorithm and arguments may be exchanged, but only together.
    """
    if len({algorithm is None, arguments is None}) == 2:
        raise ValueError("name an algorithm and its arguments, or neither")
    cleared = {c: F.lit(None) for c in ("output_sha256", "output_duration_seconds", "face_review_owner", "face_review_lease_until")}
    values = _fresh(now) | cleared | {"restarted_at": F.lit(now)}
    if algorithm is not None:
        values |= {"algorithm": F.lit(algorithm), "arguments": F.array(*map(F.lit, arguments)) if arguments else F.expr("cast(array() as array<string>)")}
    return changed(_marked(tasks, ids), F.col("_again") & F.col("status").isin(*TERMINAL), values).drop("_again")


def restart_completed(tasks: DataFrame, now: float) -> DataFrame:
    """tasks where all completed ones begin anew; labels stay."""
    return restart(tasks, tasks.filter("status = 'completed'"), now)


def retry(tasks: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """tasks where failed ones among ids are pending again; outputs stay."""
    return changed(_marked(tasks, ids), F.col("_again") & (F.col("status") == "failed"), _fresh(now)).drop("_again")


def orphaned(tasks: DataFrame, workers: DataFrame, now: float, ttl: float) -> DataFrame:
    """Old active tasks whose worker is gone or points elsewhere."""
    held = workers.select(F.col("worker_id").alias("assigned_worker_id"), F.col("current_task_id").alias("_current"), F.lit(True).alias("_known"))
    old = tasks.filter(F.col("status").isin(*ACTIVE) & (F.col("updated_at") < now - ttl))
    joined = old.join(held, "assigned_worker_id", "left")
    return joined.filter(F.col("_known").isNull() | F.col("_current").isNull() | (F.col("_current") != F.col("task_id"))).drop("_known", "_current")


def stale_holders(tasks: DataFrame, workers: DataFrame, now: float, ttl: float) -> DataFrame:
    """Active tasks whose holder has been silent for more than ttl seconds."""
    silent = workers.filter((F.col("last_seen_at") < now - ttl) & F.col("current_task_id").isNotNull()).select(F.col("current_task_id").alias("task_id"))
    return tasks.filter(F.col("status").isin(*ACTIVE)).join(silent.distinct(), "task_id", "left_semi")


def recovered_status(status: Column, attempts: Column, most: Column) -> Column:
    return F.when(status == "cancelling", "cancelled").when(attempts < most, "pending").otherwise("failed")


def recover(tasks: DataFrame, workers: DataFrame, now: float, ttl: float) -> tuple[DataFrame, DataFrame]:
    """(recovered tasks with reason and new_status, workers now offline)."""
    stale = stale_holders(tasks, workers, now, ttl).withColumn("reason", F.lit("stale"))
    orphans = orphaned(tasks, workers, now, ttl).join(stale.select("task_id"), "task_id", "left_anti").withColumn("reason", F.lit("orphan"))
    both = stale.unionByName(orphans)
    offline = workers.filter((F.col("last_seen_at") < now - ttl) & (F.col("status") != "offline")).select("worker_id", F.lit("offline").alias("status"))
    return both.withColumn("new_status", recovered_status(F.col("status"), F.col("attempt_count"), F.col("max_attempts"))), offline


def purge(tasks: DataFrame) -> DataFrame:
    """No task at all if none is active, else all of them."""
    return tasks.join(F.broadcast(tasks.agg((F.count_if(F.col("status").isin(*ACTIVE)) > 0).alias("_keep"))), F.col("_keep")).drop("_keep")


def leases(tasks: DataFrame, now: float) -> DataFrame:
    """tasks with expired review leases cleared."""
    values = {"face_review_owner": F.lit(None), "face_review_lease_until": F.lit(None), "updated_at": F.lit(now)}
    return changed(tasks, F.col("face_review_lease_until") <= now, values)


def review_queue(tasks: DataFrame, now: float) -> DataFrame:
    """Tasks open for review, in the order in which they are handed out."""
    free = leases(tasks, now).filter((F.col("status") == "completed") & F.col("face_annotation").isNull() & F.col("source_object_key").isNotNull() & F.col("face_review_owner").isNull())
    return free.orderBy("finished_at", "created_at", "task_id")


def review_claims(tasks: DataFrame, reviewers: DataFrame, now: float, lease: float = 300.0) -> DataFrame:
    """(reviewer, task_id, lease_until): one open task for each reviewer in turn."""
    queue = numbered(review_queue(tasks, now).select("task_id", "finished_at", "created_at"), ["finished_at", "created_at", "task_id"], "n")
    asking = numbered(reviewers.select("reviewer").distinct(), ["reviewer"], "n")
    return asking.join(queue, "n").select("reviewer", "task_id", F.lit(now + lease).alias("lease_until"))


def review_status(tasks: DataFrame, now: float) -> DataFrame:
    """(task_id, reviewable, label, reviewing, owner, lease_until): a lease counts while it lasts."""
    live = F.coalesce(F.col("face_review_owner").isNotNull() & (F.col("face_review_lease_until") > now), F.lit(False))
    label = F.when(F.col("face_annotation") == 1, "has_face").when(F.col("face_annotation") == 0, "no_face").otherwise("unlabelled")
    return tasks.select(
        "task_id", F.coalesce((F.col("status") == "completed") & (F.col("source_object_key") != ""), F.lit(False)).alias("reviewable"), label.alias("label"), live.alias("reviewing"),
        F.when(live, F.col("face_review_owner")).alias("owner"), F.when(live, F.col("face_review_lease_until")).otherwise(F.lit(0)).cast("double").alias("lease_until"),
    )


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with the rows of changes in place of those with the same key."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def running_jobs(jobs: DataFrame, started: DataFrame, now: float) -> DataFrame:
    """jobs after starts (path, source_duration): one attempt more, no error."""
    joined = jobs.join(started.select("path", F.col("source_duration").alias("_source"), F.lit(True).alias("_begun")), "path", "left")
    values = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "error": F.lit(None), "source_duration": F.col("_source"), "updated_at": F.lit(now)}
    return changed(joined, F.col("_begun"), values).select(jobs.columns)


def ended_jobs(jobs: DataFrame, results: DataFrame, now: float) -> DataFrame:
    """jobs after results (path, ok, duration, output_duration, error)."""
    joined = jobs.join(results.select("path", *(F.col(c).alias(f"_{c}") for c in ("ok", "duration", "output_duration", "error"))), "path", "left")
    values = {"status": F.when(F.col("_ok"), "success").otherwise("failed"), "updated_at": F.lit(now)} | {c: F.col(f"_{c}") for c in ("duration", "output_duration", "error")}
    return changed(joined, F.col("_ok").isNotNull(), values).select(jobs.columns)


def prepared_jobs(files: DataFrame, jobs: DataFrame, *, force: bool = False) -> DataFrame:
    """(path, size, mtime_ns, status, reason) of every file against the stored jobs.

    files: path, size, mtime_ns, output_valid; jobs: path, size, mtime_ns, status.
    """
    stored = jobs.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("status").alias("_status"))
    joined = files.join(stored, "path", "left")
    changed = F.col("_status").isNull() | (F.col("size") != F.col("_size")) | (F.col("mtime_ns") != F.col("_mtime"))
    status = F.when(F.lit(force) | changed, "pending").when(F.col("_status") == "running", "pending").when(F.col("output_valid"), "success").otherwise(F.col("_status"))
    reason = F.when(F.lit(force), "forced").when(F.col("_status").isNull(), "new").when(changed, "changed").when(F.col("_status") == "running", "interrupted").when(F.col("output_valid"), "valid output").otherwise("stored")
    return joined.select("path", "size", "mtime_ns", status.alias("status"), reason.alias("reason"))
