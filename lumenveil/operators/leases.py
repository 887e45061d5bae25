"""Leases and heartbeats as histories: who holds a task when, who went silent when.

The lease machine is one step function for batch (:func:`history`) and stream
(``lumenveil.streaming.expiry``). A claim succeeds on a free task or one's own, a
renewal and a release only for the holder while the lease lives; a lease ends when
its time is reached. Silence needs no state in batch: a gap between beats of one
worker is a window over its beats.

Defined cases: actions of one time are taken by reviewer, then kind; actions without
a reviewer or of an unknown kind are refused; a repeated action is judged again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenveil.operators.runs import Row, over_sequences

#: Fixed value: seconds of a review lease.
LEASE_SECONDS = 300.0
HISTORY = "task_id string, at double, reviewer string, action string, accepted boolean, owner string, until double"


class Lease:
    """The lease of one task."""

    def __init__(self, seconds: float = LEASE_SECONDS) -> None:
        self.seconds, self.owner, self.until = seconds, None, None

    def to_json(self) -> str:
        return json.dumps([self.owner, self.until])

    def load(self, text: str) -> None:
        self.owner, self.until = json.loads(text)

    def expire(self, now: float) -> bool:
        """Whether a lease ends at ``now``."""
        if self.owner is None or self.until > now:
            return False
        self.owner = self.until = None
        return True

    def step(self, at: float, reviewer: str | None, action: str) -> bool:
        """Whether an action is accepted; the lease after it is in owner and until."""
        self.expire(at)
        own = reviewer is not None and self.owner == reviewer
        if action == "claim" and reviewer is not None and (own or self.owner is None) or action == "renew" and own:
            self.owner, self.until = reviewer, at + self.seconds
            return True
        if action == "release" and own:
            self.owner = self.until = None
            return True
        return False


def acted(lease: Lease, task_id: str, row: Row) -> Row:
    """An action's row of the history."""
    accepted = lease.step(row["at"], row["reviewer"], row["action"])
    return {"task_id": task_id, "at": row["at"], "reviewer": row["reviewer"], "action": row["action"], "accepted": accepted, "owner": lease.owner, "until": lease.until}


def history(actions: DataFrame, seconds: float = LEASE_SECONDS) -> DataFrame:
    """actions (task_id, at, reviewer, action) with their outcome; see HISTORY."""

    class Keyed:
        def __init__(self, key: tuple) -> None:
            self.task_id, self.lease = key[0], Lease(seconds)

    def step(keyed: Keyed, at: float, rows: list[Row]) -> list[Row]:
        return [acted(keyed.lease, keyed.task_id, r) for r in rows]

    return over_sequences(actions.select("task_id", "at", "reviewer", "action"), ["task_id"], "at", ["reviewer", "action"], Keyed, step, HISTORY)


def silences(beats: DataFrame, now: float, ttl: float) -> DataFrame:
    """(worker_id, last_seen, offline_at): each time a worker was silent for more than ttl seconds, up to ``now``."""
    after = F.coalesce(F.lead("at").over(Window.partitionBy("worker_id").orderBy("at")), F.lit(now))
    return beats.select("worker_id", "at").distinct().withColumn("after", after).filter(F.col("after") - F.col("at") > ttl).select("worker_id", F.col("at").alias("last_seen"), (F.col("at") + ttl).alias("offline_at"))
