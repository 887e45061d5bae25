"""State that ends by itself: silent workers, leases, and frames held for later evidence.

All clocks are event time: a watermark of the stream's own times moves them, so a
replayed stream gives the same rows, and a test moves time by sending a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenveil.operators.leases import HISTORY, LEASE_SECONDS, Lease, acted
from lumenveil.operators.timeline import Delayed

_SILENT = "worker_id string, last_seen double, offline_at double"
_FILLED = "video_id bigint, frame_idx bigint, x1 int, y1 int, x2 int, y2 int, source string"


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def _millis(seconds: float) -> int:
    return int(seconds * 1000)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """rows with a watermark on the seconds in ``at``."""
    return rows.withColumn("clock", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("clock", late)


def silences(beats: DataFrame, ttl: float, late: str = "0 seconds") -> DataFrame:
    """Streaming twin of ``leases.silences``: a row once a worker has been silent for ttl seconds.

    beats: (worker_id, at). State is one time a worker, and goes when it has expired.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        if held.hasTimedOut:
            last = held.get[0]
            rows.append({"worker_id": key[0], "last_seen": last, "offline_at": last + ttl})
            held.remove()
        else:
            times = sorted({t for part in parts for t in part["at"]} | ({held.get[0]} if held.exists else set()))
            rows += [{"worker_id": key[0], "last_seen": a, "offline_at": a + ttl} for a, b in zip(times, times[1:]) if b - a > ttl]
            held.update((times[-1],))
            held.setTimeoutTimestamp(max(_millis(times[-1] + ttl) + 1, held.getCurrentWatermarkMs() + 1))
        yield _frame(rows, _SILENT)

    timed = _timed(beats.select("worker_id", "at"), late)
    return timed.groupBy("worker_id").applyInPandasWithState(run, _SILENT, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def lease_history(actions: DataFrame, seconds: float = LEASE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """Streaming twin of ``leases.history``, with a row of action ``expired`` when a lease ends unused.

    Actions must come in order per task, all of one time in one micro-batch.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        lease, rows = Lease(seconds), []
        if held.exists:
            lease.load(held.get[0])
        if held.hasTimedOut:
            owner, until = lease.owner, lease.until
            if owner is not None and lease.expire(until):
                rows.append({"task_id": key[0], "at": until, "reviewer": owner, "action": "expired", "accepted": True, "owner": None, "until": None})
        else:
            given = pd.concat(list(parts)).sort_values(["at", "reviewer", "action"], na_position="first").astype(object)
            for row in given.where(given.notna(), None).to_dict("records"):
                if lease.owner is not None and lease.until <= row["at"]:
                    rows.append({"task_id": key[0], "at": lease.until, "reviewer": lease.owner, "action": "expired", "accepted": True, "owner": None, "until": None})
                rows.append(acted(lease, key[0], row))
        if lease.owner is None:
            if held.exists:
                held.remove()
        else:
            held.update((lease.to_json(),))
            held.setTimeoutTimestamp(max(_millis(lease.until), held.getCurrentWatermarkMs() + 1))
        yield _frame(rows, HISTORY)

    timed = _timed(actions.select("task_id", "at", "reviewer", "action"), late)
    return timed.groupBy("task_id").applyInPandasWithState(run, HISTORY, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def filled(seen: DataFrame, most: int, late: int) -> DataFrame:
    """Streaming twin of ``timeline.filled``: frames are held until no earlier one can come.

    seen: (video_id, frame_idx, x1..y2), null sides where nothing is seen. Frames may
    come in any order, up to ``late`` frames behind the latest; a video's last frames
    stay held until a later one comes.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = Delayed(most, late)
        if held.exists:
            state.load(json.loads(held.get[0]))
        for part in parts:
            for frame, *box in zip(*(part[c].tolist() for c in ("frame_idx", "x1", "y1", "x2", "y2"))):
                state.add(int(frame), None if pd.isna(box[0]) else box)
        rows = [{"video_id": key[0], "frame_idx": f, "x1": b[0], "y1": b[1], "x2": b[2], "y2": b[3], "source": s} for f, b, s in state.settle()]
        held.update((json.dumps(state.dump()),))
        yield _frame(rows, _FILLED)

    return seen.select("video_id", "frame_idx", "x1", "y1", "x2", "y2").groupBy("video_id").applyInPandasWithState(run, _FILLED, "state string", "append", GroupStateTimeout.NoTimeout)
