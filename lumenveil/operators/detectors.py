"""A register of detector outputs: from raw heads by name to detections.

A detector is what its raw rows look like and how they become boxes in the frame's
pixels. Raw rows hold (video_id, frame_idx, width, height, index, values), values as
the head gives them; decoding, the least score and suppression of overlapping boxes
are Spark expressions and one pass over frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenveil.functions import decoding
from lumenveil.operators import fusion

SIDES = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Detector:
    """decode: (rows' values, index) -> (box in the input's pixels, score); size: the square input's side."""

    name: str
    size: int
    stride: int
    least_score: float
    overlap: float
    decode: Callable[[Column, Column, "Detector"], tuple[tuple[Column, ...], Column]]

    @property
    def columns(self) -> int:
        return self.size // self.stride


def _from_cells(values: Column, index: Column, d: Detector) -> tuple[tuple[Column, ...], Column]:
    """values: class and object scores, then offsets of a cell."""
    box = decoding.grid_box(index, F.lit(d.columns), F.lit(d.stride), F.array(*(F.get(values, k) for k in range(2, 6))))
    return box, decoding.grid_score(F.get(values, 0), F.get(values, 1))


def _from_anchors(values: Column, index: Column, d: Detector) -> tuple[tuple[Column, ...], Column]:
    """values: a score, then distances in strides from one of two anchors of a cell."""
    cell = F.floor(index / 2)
    x, y = cell % d.columns * d.stride, F.floor(cell / d.columns) * d.stride
    return decoding.box_from_distances(x, y, F.array(*(F.get(values, k) * d.stride for k in range(1, 5)))), F.get(values, 0)


def _as_given(values: Column, index: Column, d: Detector) -> tuple[tuple[Column, ...], Column]:
    """values: sides, then a score."""
    return tuple(F.get(values, k) for k in range(4)), F.get(values, 4)


REGISTER: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    """Make a detector known; a name stands for one detector."""
    if detector.name in REGISTER:
        raise ValueError(f"there is a detector {detector.name!r} already")
    REGISTER[detector.name] = detector
    return detector


for _made in (Detector("cells", 320, 16, 0.6, 0.3, _from_cells), Detector("anchors", 640, 32, 0.5, 0.4, _from_anchors), Detector("boxes", 640, 32, 0.25, 0.45, _as_given)):
    register(_made)


def decoded(raw: DataFrame, name: str) -> DataFrame:
    """(video_id, frame_idx, det_id, model, x1..y2, score) of raw rows of a detector, before suppression.

    Boxes are given back from the square input to the frame, in whole pixels.
    """
    if name not in REGISTER:
        raise ValueError(f"unknown detector {name!r}; known are {sorted(REGISTER)}")
    d = REGISTER[name]
    box, score = d.decode(F.col("values"), F.col("index"), d)
    boxed = _once(raw, ("video_id", "frame_idx", "width", "height", F.col("index").cast("int").alias("det_id"), *(c.alias(f"in_{s}") for s, c in zip(SIDES, box)), score.alias("score")))
    boxed = _once(boxed.filter(F.col("score") >= d.least_score), ("*", decoding.letterbox(F.col("width"), F.col("height"), d.size).alias("fit")))
    sides = decoding.from_letterbox(tuple(F.col(f"in_{s}") for s in SIDES), F.col("fit"), F.col("width"), F.col("height"))
    found = _once(boxed, ("video_id", "frame_idx", "det_id", F.lit(name).alias("model"), *(c.cast("double").alias(s) for s, c in zip(SIDES, sides)), "score"))
    return found.filter("x2 > x1 and y2 > y1")


def _once(rows: DataFrame, columns: tuple) -> DataFrame:
    """``rows.select(*columns)``, each row computed once.

    Spark repeats the expressions of a selection in every filter above it, and code
    beyond 8 kB is not compiled but interpreted.
    """
    return rows.select(F.inline(F.array(F.struct(*columns))))


def detections(raw: DataFrame, name: str) -> DataFrame:
    """The boxes of a detector that no better one of their frame overlaps."""
    return fusion.nms(decoded(raw, name), REGISTER[name].overlap if name in REGISTER else 0.4, inclusive=False)
