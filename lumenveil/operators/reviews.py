"""Review leases on tasks: claim, renew, release and label, many at a time.

Actions are rows (task_id, reviewer); the first by reviewer wins where several
ask for one task. Expired leases are cleared before every action but a release.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.operators.control import changed, leases

LEASE_SECONDS = 300.0


def _with(tasks: DataFrame, actions: DataFrame, *columns: str) -> DataFrame:
    first = actions.groupBy("task_id").agg(F.min(F.struct("reviewer", *columns)).alias("_action"))
    return tasks.join(first, "task_id", "left").withColumn("_reviewer", F.col("_action.reviewer"))


def claimed(tasks: DataFrame, actions: DataFrame, now: float, lease: float = LEASE_SECONDS) -> DataFrame:
    """tasks where completed, keyed ones that are free or one's own are reserved."""
    joined = _with(leases(tasks, now), actions)
    free = F.col("face_review_owner").isNull() | (F.col("face_review_owner") == F.col("_reviewer"))
    may = F.col("_reviewer").isNotNull() & (F.col("status") == "completed") & (F.coalesce("source_object_key", F.lit("")) != "") & free
    return changed(joined, may, {"face_review_owner": F.col("_reviewer"), "face_review_lease_until": F.lit(now + lease), "updated_at": F.lit(now)}).select(tasks.columns)


def renewed(tasks: DataFrame, actions: DataFrame, now: float, lease: float = LEASE_SECONDS) -> DataFrame:
    """tasks whose live leases are extended by those who hold them."""
    joined = _with(leases(tasks, now), actions)
    return changed(joined, F.col("face_review_owner") == F.col("_reviewer"), {"face_review_lease_until": F.lit(now + lease), "updated_at": F.lit(now)}).select(tasks.columns)


def released(tasks: DataFrame, actions: DataFrame, now: float) -> DataFrame:
    """tasks whose leases are given back by those who hold them."""
    joined = _with(tasks, actions)
    own = F.col("face_review_owner") == F.col("_reviewer")
    return changed(joined, own, {"face_review_owner": F.lit(None), "face_review_lease_until": F.lit(None), "updated_at": F.lit(now)}).select(tasks.columns)


def annotated(tasks: DataFrame, actions: DataFrame, now: float) -> DataFrame:
    """tasks labelled by actions (task_id, reviewer, has_face); the lease ends."""
    joined = _with(leases(tasks, now), actions, "has_face")
    own = (F.col("status") == "completed") & (F.col("face_review_owner") == F.col("_reviewer"))
    values = {
        "face_annotation": F.col("_action.has_face").cast("int"), "face_annotated_at": F.lit(now), "face_review_owner": F.lit(None),
        "face_review_lease_until": F.lit(None), "updated_at": F.lit(now),
    }
    return changed(joined, own, values).select(tasks.columns)
