"""Trackers that detect on key frames and follow by measured motion in between.

Two state machines, stepped frame by frame and used alike in batch
(:func:`followed`) and stream (``lumenveil.streaming``):

* :class:`Targets` follows all boxes of a key frame: detection every ``interval``
  frames and whenever nothing is followed; a key frame that finds nothing keeps the
  old boxes for ``grace`` key frames.
* :class:`Single` follows the best box of a key frame, detects early when the motion
  is badly measured (few points, or a shift of more than half a width), and has two
  ways after a key frame without a find: ``wait`` drops the box until the next key
  frame, ``hold`` keeps it, and looks again at once if there is none.

Each row says where its box comes from: DET detected, TRK followed, GRC held although
its key frame found nothing.

Evidence is a table with one row a detection (kind ``D``: box, score, points to
follow it by) or measured motion (kind ``F``: target, dx, dy, points that were found
again); a frame without evidence is a row of kind null. Defined cases: detections of
equal score are taken by their sides; motion of a target without a box is ignored; a
box without motion stays; frames that are not in the table are no frames.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.operators.runs import Row, over_sequences

# Points by which a box can be followed, of several targets and of one,
# points below which one is detected again, and the shift in widths that has the same effect.
TARGET_POINTS, SINGLE_POINTS, GOOD_POINTS, FAR_SHIFT = 4, 8, 15, 0.5
SIDES = ("x1", "y1", "x2", "y2")
EVIDENCE = "video_id bigint, frame_idx bigint, kind string, target int, x1 int, y1 int, x2 int, y2 int, score double, dx double, dy double, points int"
OUTPUT = "video_id bigint, frame_idx bigint, target int, x1 int, y1 int, x2 int, y2 int, source string"


@dataclass(frozen=True)
class Config:
    """interval: frames between key frames; grace: key frames that may find nothing; on_miss: ``wait`` or ``hold``."""

    interval: int = 10
    grace: int = 3
    cold_start: int = 0
    on_miss: str = "wait"


def _shifted(box: list[int], dx: float, dy: float) -> list[int]:
    return [int(v + d) for v, d in zip(box, (dx, dy, dx, dy))]


class Targets:
    """Several boxes; the state of one video."""

    def __init__(self, config: Config) -> None:
        self.config, self.boxes, self.misses = config, [], 0

    def to_json(self) -> str:
        return json.dumps([self.boxes, self.misses])

    def load(self, text: str) -> None:
        self.boxes, self.misses = json.loads(text)

    def step(self, frame: int, found: list[Row], motion: dict[int, Row]) -> list[tuple[int, list[int], str]]:
        c = self.config
        if (frame - 1) % c.interval == 0 or frame <= c.cold_start or not self.boxes:
            if found:
                self.boxes, self.misses, source = [[r[s] for s in SIDES] for r in found], 0, "DET"
            elif self.boxes and self.misses < c.grace:
                self.misses, source = self.misses + 1, "GRC"
            else:
                self.boxes, self.misses, source = [], 0, "DET"
        else:
            source = "TRK"
            for k, box in enumerate(self.boxes):
                if k in motion and motion[k]["points"] >= TARGET_POINTS:
                    self.boxes[k] = _shifted(box, motion[k]["dx"], motion[k]["dy"])
        return [(k, box, source) for k, box in enumerate(self.boxes)]


class Single:
    """One box; the state of one video."""

    def __init__(self, config: Config) -> None:
        self.config, self.box, self.points, self.due = config, None, 0, 0

    def to_json(self) -> str:
        return json.dumps([self.box, self.points, self.due])

    def load(self, text: str) -> None:
        self.box, self.points, self.due = json.loads(text)

    def step(self, frame: int, found: list[Row], motion: dict[int, Row]) -> list[tuple[int, list[int], str]]:
        c, source = self.config, "TRK"
        wait = c.on_miss == "wait"
        if frame >= self.due if wait else self.box is None or frame % c.interval == 1:
            self.due = frame + c.interval
            if found:
                self.box, self.points, source = [found[0][s] for s in SIDES], found[0]["points"] or 0, "DET"
            elif wait:
                self.box = None
            else:
                source = "GRC"
        elif self.box is not None and self.points >= SINGLE_POINTS and 0 in motion:
            again, dx, dy = (motion[0][k] for k in ("points", "dx", "dy"))
            if again >= SINGLE_POINTS:
                self.box, self.points = _shifted(self.box, dx, dy), again
                width = max(1, self.box[2] - self.box[0])
                if again < GOOD_POINTS or abs(dx) > FAR_SHIFT * width or abs(dy) > FAR_SHIFT * width:
                    self.due = frame + 1
            else:
                self.points, self.due = SINGLE_POINTS, frame + 1  # points are set anew on the box
        return [] if self.box is None else [(0, self.box, source)]


def step_rows(state: Targets | Single, video_id: int, frame: int, rows: list[Row]) -> list[Row]:
    """A frame's evidence, best detections first, as output rows."""
    found = [r for r in rows if r["kind"] == "D"]
    motion = {r["target"]: r for r in rows if r["kind"] == "F"}
    return [{"video_id": video_id, "frame_idx": frame, "target": k, **dict(zip(SIDES, box)), "source": source} for k, box, source in state.step(frame, found, motion)]


def followed(evidence: DataFrame, config: Config, machine: Callable[[Config], Targets | Single] = Targets) -> DataFrame:
    """The boxes of every frame with their source; see OUTPUT."""

    class Keyed:
        def __init__(self, key: tuple) -> None:
            self.video, self.state = key[0], machine(config)

    def step(keyed: Keyed, frame: int, rows: list[Row]) -> list[Row]:
        return step_rows(keyed.state, keyed.video, frame, rows)

    names = [f.split()[0] for f in EVIDENCE.split(", ")]
    return over_sequences(evidence.select(*names), ["video_id"], "frame_idx", ["kind", F.desc_nulls_last("score"), *SIDES, "target"], Keyed, step, OUTPUT)
