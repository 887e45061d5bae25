"""Named pipelines: from frames and detections to masked frames in one call.

A pipeline says how detections become the boxes to mask: which detectors must agree,
how boxes are followed and how they are made unreadable. Names are looked up in a
register and are never read as paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.operators import fusion, masking, segments, tracking

SIDES = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Pipeline:
    """boxes: from detections to the boxes (video_id, frame_idx, x1..y2) to mask."""

    name: str
    boxes: Callable[[DataFrame], DataFrame]
    kind: str = "face"
    how: str = "mosaic"


def _best_held(detections: DataFrame) -> DataFrame:
    return tracking.hold(detections, grace=8)


def _all_kept(detections: DataFrame) -> DataFrame:
    return fusion.nms(detections)


def _backfilled(tracks: DataFrame) -> DataFrame:
    """Boxes of every frame of tracks; a backfill stands in all frames since it began."""
    later = F.col("kind") == "backfill"
    frames = F.when(later & (F.col("since_frame") < F.col("frame_idx")), F.sequence("since_frame", F.col("frame_idx") - 1)).when(~later, F.array("frame_idx"))
    return tracks.select("video_id", F.explode(frames).alias("frame_idx"), *SIDES)


def _tracked(detections: DataFrame) -> DataFrame:
    return _backfilled(tracking.track(fusion.dual_consensus(detections)))


def _in_segments(detections: DataFrame) -> DataFrame:
    return _backfilled(segments.track(fusion.dual_consensus(detections)))


REGISTER: dict[str, Pipeline] = {}


def register(pipeline: Pipeline) -> Pipeline:
    """Make a pipeline known; a name stands for one pipeline."""
    if pipeline.name in REGISTER:
        raise ValueError(f"there is a pipeline {pipeline.name!r} already")
    REGISTER[pipeline.name] = pipeline
    return pipeline


for _made in (
    Pipeline("basic", _best_held, how="blur"), Pipeline("every", _all_kept), Pipeline("plus", _tracked), Pipeline("segments", _in_segments), Pipeline("card", _best_held, kind="card", how="blur"),
):
    register(_made)


def named(name: str | None, default: str = "plus") -> Pipeline:
    """The pipeline of a task; an empty name is the default, an unknown one is refused."""
    wanted = (name or "").strip() or default
    if wanted not in REGISTER:
        raise ValueError(f"unknown pipeline {wanted!r}; known are {sorted(REGISTER)}")
    return REGISTER[wanted]


def mask(frames: DataFrame, detections: DataFrame, name: str | None = None) -> DataFrame:
    """frames (video_id, frame_idx, width, height, pixels) with what detections show made unreadable.

    detections: (video_id, frame_idx, det_id, model, x1..y2, score).
    """
    pipeline = named(name)
    return masking.masked(frames, pipeline.boxes(detections), pipeline.kind, pipeline.how)
