"""Robust motion of boxes from matched points.

Points tracked from a frame to the next and back again tell how a box moves. Points
that do not come back are left out; if too few are left, or their median moves too
far, the motion is not trusted. A similarity (turn, scale, shift) is fitted by
consensus: every two points give one, the one that most points agree with wins, and
it is fitted again to all that agree. Few points are tried exhaustively; of many, a
seeded choice of pairs is. Without consensus the box shifts by the medians.

A box's points are bounded by the grid that made them; rows of a box travel together
to a task, which sees one box at a time.

Defined cases: a lost point has null ends and counts as not come back; points in one
place give no similarity; of equally good pairs the first in the points' order wins;
boxes without a trusted motion give no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lumenveil.operators.runs import Row, over_groups

# Pixels by which a point may miss its origin, points needed, the
# largest shift in box sides, pixels of agreement and points of a consensus.
BACK_PIXELS, LEAST_POINTS, LARGEST_SHIFT, AGREE_PIXELS, LEAST_AGREEING = 2.0, 4, 0.3, 3.0, 3
#: Pairs tried at most, and the seed of the choice among more.
PAIRS, SEED = 5000, 7
POINT = ("px", "py", "qx", "qy", "rx", "ry")
SIDES = ("x1", "y1", "x2", "y2")
_OUTPUT = "video_id bigint, frame_idx bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double, kind string, points int, agreeing int"


def pairs_of(n: int, most: int = PAIRS, seed: int = SEED) -> np.ndarray:
    """[2, k]: all pairs of n points in order, or a seeded choice of ``most`` of them."""
    first, second = np.triu_indices(n, 1)
    if len(first) <= most:
        return np.stack([first, second])
    chosen = np.sort(np.random.default_rng(seed).choice(len(first), most, replace=False))
    return np.stack([first[chosen], second[chosen]])


def fitted(p: np.ndarray, q: np.ndarray) -> tuple[complex, complex] | None:
    """(factor, shift) of the least squares similarity from points p to q, as complex numbers."""
    around_p, around_q = p - p.mean(), q - q.mean()
    size = (np.abs(around_p) ** 2).sum()
    if size == 0:
        return None
    factor = (np.conj(around_p) * around_q).sum() / size
    return factor, q.mean() - factor * p.mean()


def consensus(p: np.ndarray, q: np.ndarray, most_pairs: int = PAIRS) -> np.ndarray | None:
    """Which points agree with the pair that most points agree with."""
    i, j = pairs_of(len(p), most_pairs)
    apart = p[j] - p[i]
    real = apart != 0
    if not real.any():
        return None
    i, factor = i[real], (q[j] - q[i])[real] / apart[real]
    off = np.abs(factor[:, None] * (p[None, :] - p[i][:, None]) + q[i][:, None] - q[None, :])
    agree = off <= AGREE_PIXELS
    return agree[agree.sum(axis=1).argmax()]


def moved(box: list[float], points: list[tuple]) -> tuple[list[float], str, int, int] | None:
    """(box, kind, points, agreeing) after the motion of (px, py, qx, qy, rx, ry); None if not trusted."""
    kept = [x for x in points if None not in x and (x[4] - x[0]) ** 2 + (x[5] - x[1]) ** 2 <= BACK_PIXELS**2]
    if len(kept) < LEAST_POINTS:
        return None
    p, q = (np.array([complex(x[k], x[k + 1]) for x in kept]) for k in (0, 2))
    shift = complex(np.median((q - p).real), np.median((q - p).imag))
    if max(abs(shift.real), abs(shift.imag)) > LARGEST_SHIFT * max(box[2] - box[0], box[3] - box[1]):
        return None
    agree = consensus(p, q)
    if agree is not None and agree.sum() >= LEAST_AGREEING and (found := fitted(p[agree], q[agree])):
        corners = found[0] * np.array([complex(x, y) for x in box[::2] for y in box[1::2]]) + found[1]
        return [corners.real.min(), corners.imag.min(), corners.real.max(), corners.imag.max()], "similarity", len(kept), int(agree.sum())
    return [box[0] + shift.real, box[1] + shift.imag, box[2] + shift.real, box[3] + shift.imag], "shift", len(kept), 0


def moved_boxes(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """(video_id, frame_idx, track_id, x1..y2, kind, points, agreeing) of boxes with a trusted motion.

    boxes: (video_id, frame_idx, track_id, x1..y2); points: (video_id, frame_idx,
    track_id, place, px..ry), p in the box's frame, q in the next, r back again.
    """
    keys = ["video_id", "frame_idx", "track_id"]

    def step(rows: list[Row]) -> list[Row]:
        found = moved([rows[0][c] for c in SIDES], [tuple(r[c] for c in POINT) for r in rows])
        if found is None:
            return []
        box, kind, number, agreeing = found
        return [{k: rows[0][k] for k in keys} | {c: float(v) for c, v in zip(SIDES, box)} | {"kind": kind, "points": number, "agreeing": agreeing}]

    return over_groups(points.select(*keys, "place", *POINT).join(boxes.select(*keys, *SIDES), keys), keys, ["place"], step, _OUTPUT)
