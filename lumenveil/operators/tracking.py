"""Multi-object tracking over ordered frames; one step for batch and stream.

``Tracks`` is the state of one video: it is stepped through frames in order and
holds only live tracks, recent unconfirmed boxes and a few counters. Batch runs it
over sorted partitions (:func:`track`), Structured Streaming keeps it as keyed
state (``lumenveil.streaming``); both give the same rows for any batching.

A frame's boxes are read when the schedule asks for a detection: every
``interval`` frames, the first two, after a lost track or an unconfirmed box, and
for some frames after the number of boxes changed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.operators.runs import Row, over_sequences

SIDES = ("x1", "y1", "x2", "y2")
OUTPUT = "video_id bigint, frame_idx bigint, track_id int, x1 int, y1 int, x2 int, y2 int, kind string, since_frame bigint"


@dataclass
class TrackConfig:
    """Fixed values of the tracker; distances in multiples of a box's longer side."""

    interval: int = 5
    burst: int = 5
    horizon: int = 5
    iou: float = 0.2
    gate: float = 1.5
    pending_gate: float = 2.5
    alpha: float = 0.65
    most_misses: int = 3
    visible_misses: int = 2


@dataclass
class Track:
    id: int
    box: list
    misses: int = 0
    hits: int = 1
    last_frame: int = 0
    last_box: list = field(default_factory=list)


def _side(b) -> float:
    return max(b[2] - b[0], b[3] - b[1], 1)


def _distance(a, b) -> float:
    return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) / _side(a)


def _iou(a, b) -> float:
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


class Tracks:
    """The tracker's state for one video."""

    def __init__(self, config: TrackConfig | None = None) -> None:
        self.config = config or TrackConfig()
        self.tracks: list[Track] = []
        self.pending: list[tuple[int, list]] = []
        self.next_id, self.burst, self.count, self.forced = 1, 0, 0, False

    def to_json(self) -> str:
        return json.dumps({"tracks": [asdict(t) for t in self.tracks], "pending": self.pending, "n": [self.next_id, self.burst, self.count, self.forced]})

    @classmethod
    def from_json(cls, text: str, config: TrackConfig | None = None) -> "Tracks":
        state, values = cls(config), json.loads(text)
        state.tracks = [Track(**t) for t in values["tracks"]]
        state.pending = [(f, b) for f, b in values["pending"]]
        state.next_id, state.burst, state.count, state.forced = values["n"]
        return state

    def _affinity(self, track: Track, found: dict) -> float | None:
        """How well a box continues a track; confirmed boxes come first."""
        overlap, gap = _iou(track.box, found["box"]), _distance(track.box, found["box"])
        if overlap >= self.config.iou:
            value = 2 + overlap
        elif gap <= self.config.gate:
            value = 2 - gap / self.config.gate
        else:
            return None
        return value + 4 * found["confirmed"]

    def _near(self, track: Track, boxes: list[dict]) -> Iterator[tuple[int, dict]]:
        """The boxes, with their places, that meet the track's box or lie within its gate, and perhaps a few more."""
        x1, y1, x2, y2 = track.box
        x, y, reach = x1 + x2, y1 + y2, 2 * self.config.gate * _side(track.box) * (1 + 1e-9)
        for j, found in enumerate(boxes):
            a1, b1, a2, b2 = found["box"]
            far = abs(x - a1 - a2) > reach or abs(y - b1 - b2) > reach
            if not far or self.config.iou <= 0 or (a1 < x2 and a2 > x1 and b1 < y2 and b2 > y1):
                yield j, found

    def step(self, frame: int, boxes: list[dict]) -> list[dict]:
        """Advance to ``frame``; boxes: dicts of box and confirmed, in order.

        Returns rows of track_id, box, kind (``track`` or ``backfill``), since_frame.
        """
        c, out = self.config, []
        if (frame - 1) % c.interval == 0 or frame <= 2 or self.forced or self.burst > 0:
            out += self._associate(frame, boxes)
        bursting = self.burst > 0
        self.burst = max(0, self.burst - 1)
        if len(boxes) != self.count and not bursting:
            self.burst = c.burst
        self.count = len(boxes)
        self.pending = [(f, b) for f, b in self.pending if f > frame - c.horizon]
        return out + [{"track_id": t.id, "box": t.box, "kind": "track", "since_frame": None} for t in self.tracks if t.misses <= c.visible_misses]

    def _associate(self, frame: int, boxes: list[dict]) -> list[dict]:
        c, out = self.config, []
        self.forced = False
        offers = sorted(((v, -i, -j) for i, t in enumerate(self.tracks) for j, b in self._near(t, boxes) if (v := self._affinity(t, b)) is not None), reverse=True)
        tracks, used = set(), set()
        for _, i, j in offers:
            if -i in tracks or -j in used:
                continue
            tracks.add(-i)
            used.add(-j)
            track, box = self.tracks[-i], boxes[-j]["box"]
            track.box = [round(c.alpha * new + (1 - c.alpha) * old) for new, old in zip(box, track.box)]
            if 1 < frame - track.last_frame <= c.horizon and track.misses:
                out.append({"track_id": track.id, "box": track.last_box, "kind": "backfill", "since_frame": track.last_frame + 1})
            track.misses, track.hits, track.last_frame, track.last_box = 0, track.hits + 1, frame, track.box
        for i, track in enumerate(self.tracks):
            if i not in tracks:
                track.misses += 1
                self.forced = True
        self.tracks = [t for t in self.tracks if t.misses <= c.most_misses]
        for j, found in enumerate(boxes):
            if j in used:
                continue
            box = [round(v) for v in found["box"]]
            if not found["confirmed"]:
                self.pending.append((frame, box))
                self.forced = True
                continue
            track = Track(self.next_id, box, last_frame=frame, last_box=box)
            self.next_id += 1
            self.tracks.append(track)
            near = [(f, _distance(b, box), b) for f, b in self.pending if f < frame and _distance(b, box) <= c.pending_gate]
            if near:
                first, _, start = min(near)
                out.append({"track_id": track.id, "box": start, "kind": "backfill", "since_frame": first})
                self.pending = [(f, b) for f, b in self.pending if f < first or _distance(b, box) > c.pending_gate]
        return out


def step_rows(state: Tracks, video_id: int, frame: int, rows: list[Row]) -> list[Row]:
    """A frame's rows (x1..y2, source; null sides: no box) as output rows."""
    boxes = [{"box": [r[s] for s in SIDES], "confirmed": r["source"] != "S"} for r in rows if r["x1"] is not None]
    return [{"video_id": video_id, "frame_idx": frame, "track_id": o["track_id"], **{s: int(v) for s, v in zip(SIDES, o["box"])}, "kind": o["kind"], "since_frame": o["since_frame"]} for o in state.step(frame, boxes)]


def track(fused: DataFrame, config: TrackConfig | None = None) -> DataFrame:
    """Tracks of fused boxes (video_id, frame_idx, x1..y2, source).

    A frame without boxes is a row with null sides. Rows of a frame are read in
    the order of their sides.
    """

    class Keyed:
        def __init__(self, key: tuple) -> None:
            self.video, self.state = key[0], Tracks(config)

    def step(keyed: Keyed, frame: int, rows: list[Row]) -> list[Row]:
        return step_rows(keyed.state, keyed.video, frame, rows)

    rows = fused.select("video_id", "frame_idx", *SIDES, "source")
    return over_sequences(rows, ["video_id"], "frame_idx", [F.col(s) for s in (*SIDES, "source")], Keyed, step, OUTPUT)


class Holder:
    """A single-box tracker: from the largest box on it follows the best overlap.

    The last box is held for ``grace`` misses.
    """

    def __init__(self, grace: int) -> None:
        self.grace, self.box, self.misses = grace, None, 0

    def step(self, boxes: list[list]) -> list | None:
        if boxes:
            area = lambda b: max(1, (b[2] - b[0]) * (b[3] - b[1]))
            shared = lambda b: max(0, min(b[2], self.box[2]) - max(b[0], self.box[0])) * max(0, min(b[3], self.box[3]) - max(b[1], self.box[1]))
            overlap = lambda b: shared(b) / (area(b) + area(self.box) - shared(b))
            self.box, self.misses = max(boxes, key=overlap if self.box else area), 0
        elif self.box:
            self.misses += 1
            if self.misses > self.grace:
                self.box = None
        return self.box


def hold(detections: DataFrame, grace: int = 3, *, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """One held box per frame of detections (keys, frame_idx, x1..y2, score)."""

    def step(state: Holder, frame: int, rows: list[Row]) -> list[Row]:
        box = state.step([[r[s] for s in SIDES] for r in rows if r["x1"] is not None])
        return [{k: rows[0][k] for k in keys} | {"frame_idx": frame} | dict(zip(SIDES, box))] if box else []

    fields = ", ".join(f"{k} {detections.schema[k].dataType.simpleString()}" for k in keys)
    schema = fields + ", frame_idx bigint, x1 double, y1 double, x2 double, y2 double"
    rows = detections.select(*keys, "frame_idx", *SIDES, "score")
    return over_sequences(rows, list(keys), "frame_idx", [F.desc_nulls_last("score"), *(F.col(s) for s in SIDES)], lambda key: Holder(grace), step, schema)
