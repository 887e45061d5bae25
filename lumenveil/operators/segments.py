"""Tracking of one long video on many tasks.

A video is cut into segments that are tracked on their own. Each begins some frames
early, so that its tracker has settled when its own frames begin; in this overlap two
segments see the same frames. A track of one that keeps to the boxes of a track of
the next is the same track: the two that agree in most frames are paired, if neither
agrees more with another. Pairs chain tracks over segments, and every track takes the
name of the first of its chain.

Rows of a video are spread by segment, whatever its length, and chains are followed
by doubling, in as many rounds as the logarithm of the segments. Files of chains are
many times smaller than their rows, so their joins never copy them through the driver.

Defined cases: frames count from 1; frames before that belong to the first segment; a
segment without frames ends its tracks; ties of agreement go to the smaller ids; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenveil.functions import boxes
from lumenveil.operators.runs import Row, over_sequences
from lumenveil.operators.tracking import OUTPUT, SIDES, TrackConfig, Tracks, step_rows
from lumenveil.session import discard, materialize

#: Frames of one segment.
LENGTH = 1500
#: Overlap of two boxes that are held to be the same, and the share of common frames.
SAME, SHARE = 0.5, 0.5
#: Fixed value: the least overlap in frames.
LEAST_OVERLAP = 10
_TRACKED = OUTPUT.replace("video_id bigint, ", "video_id bigint, segment bigint, ")


def overlap_frames(interval: int, grace: int, skip: int = 1) -> int:
    """Frames by which a segment begins early: a detection and its grace, in whole skips."""
    return max(LEAST_OVERLAP, math.ceil((interval + grace) / skip) * skip)


def dealt(frames: DataFrame, length: int, overlap: int) -> DataFrame:
    """frames with ``segment``; those that the next segment sees too stand twice."""
    own = F.greatest(F.floor((F.col("frame_idx") - 1) / length), F.lit(0)).cast("bigint")
    early = F.greatest(F.floor((F.col("frame_idx") - 1 + overlap) / length), F.lit(0)).cast("bigint")
    return frames.withColumn("segment", F.explode(F.sequence(own, early)))


def tracked(fused: DataFrame, length: int, overlap: int, config: TrackConfig | None = None) -> DataFrame:
    """The rows of ``tracking.track`` of each segment on its own, with ``segment``."""

    class Keyed:
        def __init__(self, key: tuple) -> None:
            self.video, self.segment, self.state = *key, Tracks(config)

    def step(keyed: Keyed, frame: int, rows: list[Row]) -> list[Row]:
        return [r | {"segment": keyed.segment} for r in step_rows(keyed.state, keyed.video, frame, rows)]

    rows = dealt(fused.select("video_id", "frame_idx", *SIDES, "source"), length, overlap).select("video_id", "segment", "frame_idx", *SIDES, "source")
    return over_sequences(rows, ["video_id", "segment"], "frame_idx", [F.col(s) for s in (*SIDES, "source")], Keyed, step, _TRACKED)


def _owned(length: int) -> Column:
    return F.col("segment") == F.greatest(F.floor((F.col("frame_idx") - 1) / length), F.lit(0))


def pairs(rows: DataFrame, length: int, same: float = SAME, share: float = SHARE) -> DataFrame:
    """(video_id, segment, track_id, next_id): tracks of a segment and of the next that are the same.

    rows: tracked rows of all segments. Two tracks agree in a frame if their boxes
    overlap by ``same``; they are paired if they agree in ``share`` of the frames that
    the later one has in the overlap, and each agrees most with the other.
    """
    seen = rows.filter("kind = 'track'").select("video_id", "segment", "frame_idx", "track_id", *SIDES)
    owned = seen.filter(_owned(length)).select("video_id", (F.col("segment") + 1).alias("segment"), "frame_idx", F.col("track_id").alias("before_id"), *(F.col(s).alias(f"a_{s}") for s in SIDES))
    early = seen.filter(~_owned(length)).withColumnRenamed("track_id", "next_id")
    iou = boxes.iou(boxes.box("a_"), boxes.box())
    both = owned.join(early, ["video_id", "segment", "frame_idx"]).filter(iou >= same)
    agreed = both.groupBy("video_id", "segment", "before_id", "next_id").agg(F.count("*").alias("frames"))
    had = early.groupBy("video_id", "segment", "next_id").agg(F.count("*").alias("had"))
    agreed = agreed.hint("merge").join(had.hint("merge"), ["video_id", "segment", "next_id"]).filter(F.col("frames") >= share * F.col("had"))

    def first(of: str, other: str) -> Column:
        return F.row_number().over(Window.partitionBy("video_id", "segment", of).orderBy(F.desc("frames"), other))

    best = agreed.withColumns({"of_before": first("before_id", "next_id"), "of_next": first("next_id", "before_id")}).filter("of_before = 1 and of_next = 1")
    return best.select("video_id", (F.col("segment") - 1).alias("segment"), F.col("before_id").alias("track_id"), "next_id")


def chains(links: DataFrame) -> DataFrame:
    """(video_id, segment, track_id, first_segment, first_id) of every track that continues an earlier one."""
    current = materialize(links.select("video_id", (F.col("segment") + 1).alias("segment"), F.col("next_id").alias("track_id"), F.col("segment").alias("first_segment"), F.col("track_id").alias("first_id")), "chains")
    while True:
        onward = current.select("video_id", F.col("segment").alias("first_segment"), F.col("track_id").alias("first_id"), F.col("first_segment").alias("s"), F.col("first_id").alias("i"))
        longer = current.hint("merge").join(onward.hint("merge"), ["video_id", "first_segment", "first_id"], "left")
        after = materialize(longer.select("video_id", "segment", "track_id", F.coalesce("s", "first_segment").alias("first_segment"), F.coalesce("i", "first_id").alias("first_id"), F.col("s").isNotNull().alias("grew")), "chains")
        discard(current)
        grew, current = not after.filter("grew").isEmpty(), after.drop("grew")
        if not grew:
            return current


def stitched(rows: DataFrame, length: int, same: float = SAME, share: float = SHARE) -> DataFrame:
    """Tracked rows of all segments as those of whole videos: track_id and ``track_segment`` name a track."""
    written = materialize(rows, "segment-tracks")  # read for the pairs and for the rows
    names = chains(pairs(written, length, same, share))
    named = written.filter(_owned(length)).hint("merge").join(names.hint("merge"), ["video_id", "segment", "track_id"], "left")
    return named.select(
        "video_id", "frame_idx", F.coalesce("first_segment", "segment").alias("track_segment"), F.coalesce("first_id", "track_id").alias("track_id"), *SIDES, "kind", "since_frame",
    )


def track(fused: DataFrame, *, length: int = LENGTH, overlap: int | None = None, config: TrackConfig | None = None) -> DataFrame:
    """``tracking.track`` with one task a segment: (video_id, frame_idx, track_segment, track_id, x1..y2, kind, since_frame)."""
    config = config or TrackConfig()
    early = overlap_frames(config.interval, config.most_misses) if overlap is None else overlap
    return stitched(tracked(fused, length, early, config), length)
