"""Audit projects: frame reviews and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.operators.control import numbered
from lumenveil.schemas import REVIEW_TYPES

UPDATABLE = ("status", "error", "note", "review_type", "frame_number", "timestamp")
#: What a new review may and must name; its id and time are given to it.
CREATABLE, REQUIRED = ("task_id", "frame_number", "timestamp", "review_type", "note", "screenshot_path"), ("task_id", "review_type")


def counts(reviews: DataFrame) -> DataFrame:
    """(task_id, total, missed, false_positives)."""
    kind = F.col("review_type")
    return reviews.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(kind == "missed").alias("missed"), F.count_if(kind == "false_positive").alias("false_positives"))


def listing(reviews: DataFrame, task_id: int) -> DataFrame:
    return reviews.filter(F.col("task_id") == task_id).orderBy("frame_number", "id")


def updated(rows: DataFrame, key: str, value: object, changes: dict[str, object]) -> DataFrame:
    """rows where those with ``key`` = value take the changes; only known columns."""
    if unknown := set(changes) - set(UPDATABLE):
        raise ValueError(f"not updatable: {sorted(unknown)}")
    hit = F.col(key) == value
    return rows.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent survives."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def created(reviews: DataFrame, requests: DataFrame, tasks: DataFrame, now: float) -> DataFrame:
    """reviews with those of requests added that are right.

    A request names only columns of CREATABLE, all of REQUIRED, a known kind and a
    known task; others are left out, and a request column that may not be named is
    refused. New ids follow the greatest one, in the order of task, frame, kind and
    note.
    """
    if unknown := set(requests.columns) - set(CREATABLE):
        raise ValueError(f"not to be set: {sorted(unknown)}")
    named = requests.select("*", *(F.lit(None).alias(c) for c in CREATABLE if c not in requests.columns))
    right = named.filter(F.col("task_id").isNotNull() & F.col("review_type").isin(*REVIEW_TYPES)).join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    order = ["task_id", "frame_number", "timestamp", "review_type", "note", "screenshot_path"]
    last = reviews.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(right, order, "rank")
    columns = {"id": F.col("rank") + last, "created_at": F.lit(now)}
    fields = [columns.get(f.name, F.col(f.name) if f.name in CREATABLE else F.lit(None)).cast(f.dataType).alias(f.name) for f in reviews.schema.fields]
    return reviews.unionByName(new.select(*fields))
