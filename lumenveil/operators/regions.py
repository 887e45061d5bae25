"""Regions of one colour in frames: hue masks, connected components, and a shape filter.

Pixels are classified by hue, saturation and value; runs of marked pixels in a row
are linked to touching runs of the row before (eight neighbours) by union-find, so
work grows with the runs of a frame and not with the square of its size. Frames are
rows, read in Arrow batches; one frame is held at a time.

Defined cases: a grey pixel has hue 0; regions that touch at a corner are one; a
frame without a region gives no row; an unknown colour is refused.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hue from, hue to (of 180), least saturation and least value.
RANGES = {
    "yellow": [(14, 45, 50, 80)], "gold": [(14, 45, 50, 80)], "blue": [(95, 130, 50, 50)], "green": [(45, 85, 50, 50)], "orange": [(10, 24, 60, 100)],
    "red": [(0, 10, 60, 60), (170, 179, 60, 60)],
}
# Black is below a value; white is below a saturation and above a value.
BLACK_VALUE, WHITE_SATURATION, WHITE_VALUE = 60, 45, 195
# Shares of the frame that a region may cover, ratios of its sides, the
# least longer side, the share that it fills of its box, and the aspect of a card.
LEAST_AREA, MOST_AREA, LEAST_RATIO, MOST_RATIO, LEAST_SIDE, CARD = 0.0015, 0.035, 1.15, 2.4, 90, 1.586
_OUTPUT = "video_id bigint, frame_idx bigint, colour string, region int, x1 int, y1 int, x2 int, y2 int, area int"


def hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0 to 179), saturation and value (0 to 255) of BGR pixels, rounded half up."""
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    value = np.maximum(np.maximum(b, g), r)
    spread = value - np.minimum(np.minimum(b, g), r)
    safe = np.maximum(spread, 1)
    sixths = np.where(value == r, g - b, np.where(value == g, b - r + 2 * spread, r - g + 4 * spread))  # of 60 degrees, times spread
    hue = np.where(spread > 0, (2 * 30 * sixths + safe) // (2 * safe), 0) % 180
    saturation = np.where(value > 0, (2 * 255 * spread + value) // (2 * np.maximum(value, 1)), 0)
    return hue, saturation, value


def mask(image: np.ndarray, colour: str) -> np.ndarray:
    """Which pixels have a colour."""
    return marked(*hsv(image), colour)


def marked(hue: np.ndarray, saturation: np.ndarray, value: np.ndarray, colour: str) -> np.ndarray:
    """Which pixels of given hue, saturation and value have a colour."""
    if colour == "black":
        return value < BLACK_VALUE
    if colour == "white":
        return (saturation < WHITE_SATURATION) & (value > WHITE_VALUE)
    found = np.zeros(hue.shape, bool)
    for low, high, least_saturation, least_value in RANGES[colour]:
        found |= (hue >= low) & (hue <= high) & (saturation >= least_saturation) & (value >= least_value)
    return found


def components(marked: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x1, y1, x2, y2, area) of the connected regions, in the order of their first pixels."""
    edges = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first = np.searchsorted(rows, np.arange(marked.shape[0] + 1))
    for y in range(1, marked.shape[0]):
        above, here, behind = int(first[y - 1]), int(first[y]), int(first[y + 1])
        up = above
        for run in range(here, behind):
            while up < here and ends[up] < starts[run]:  # touching at a corner counts
                up += 1
            other = up
            while other < here and starts[other] <= ends[run]:
                a, b = find(other), find(run)
                parent[max(a, b)] = min(a, b)
                other += 1
            up = max(up, other - 1) if other > up else up
    out: dict[int, list[int]] = {}
    for run, (y, s, e) in enumerate(zip(rows.tolist(), starts.tolist(), ends.tolist())):
        box = out.setdefault(find(run), [s, y, e, y + 1, 0])
        box[0], box[2], box[3], box[4] = min(box[0], s), max(box[2], e), max(box[3], y + 1), box[4] + e - s
    return [tuple(b) for b in out.values()]


def regions_of(frames: DataFrame, colours: Sequence[str]) -> DataFrame:
    """(video_id, frame_idx, colour, region, x1..y2, area): connected regions of each colour, numbered by their first pixels.

    Frames pass once, whatever the number of colours.
    """
    for colour in colours:
        if colour not in (*RANGES, "black", "white"):
            raise ValueError(f"unknown colour {colour!r}")
    colours = list(dict.fromkeys(colours))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 6]
        names = ["video_id", "frame_idx", "colour", "region", "x1", "y1", "x2", "y2", "area"]
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                video, frame, width, height, pixels = (batch.column(k)[row].as_py() for k in range(5))
                seen = hsv(np.frombuffer(pixels, np.uint8).reshape(height, width, 3))
                for colour in colours:
                    out += [(video, frame, colour, k, *box) for k, box in enumerate(components(marked(*seen, colour)))]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    return frames.select("video_id", "frame_idx", "width", "height", "pixels").mapInArrow(run, _OUTPUT)


def regions(frames: DataFrame, colour: str) -> DataFrame:
    """(video_id, frame_idx, region, x1..y2, area): connected regions of a colour, numbered by their first pixels."""
    return regions_of(frames, [colour]).drop("colour")


def card_like(found: DataFrame, sizes: DataFrame, least_side: int = LEAST_SIDE) -> DataFrame:
    """Regions of a card's size and shape, with a score. sizes: (video_id, width, height).

    The shape is that of the box around a region.
    """
    w, h, whole = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("width") * F.col("height")
    ratio = F.greatest(w, h) / F.least(w, h)
    kept = found.join(sizes.select("video_id", "width", "height"), "video_id").filter(
        F.col("area").between(LEAST_AREA * whole, MOST_AREA * whole) & ratio.between(LEAST_RATIO, MOST_RATIO) & (F.greatest(w, h) >= least_side)
    )
    score = (1 - F.abs(ratio - CARD) / 0.9) * 0.6 + 0.35
    return kept.select("video_id", "frame_idx", "region", "x1", "y1", "x2", "y2", "area", score.alias("score"))
