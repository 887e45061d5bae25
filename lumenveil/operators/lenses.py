"""Undistortion of fisheye frames by calibrated lens models.

A lens bends a ray at angle t from the axis to the radius t (1 + k1 t^2 + k2 t^4) on
the sensor. For every pixel of the straight image the model tells where to read in
the bent one, between pixels; a straight camera whose field lies between what is full
and what is whole is chosen by ``balance``. Maps depend on the size only and are made
once a worker; frames are read in Arrow batches.

Defined cases: what lies outside the frame is black; a frame at least twice as wide as
high holds two eyes, straightened each on its own; ``downscale`` straightens a smaller
image and enlarges it again; ``crop`` keeps the inner share, in even sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenveil.operators.masking import FRAMES


@dataclass(frozen=True)
class Lens:
    """Focal length in longer sides, two coefficients, and the balance of the field."""

    focal: float
    k1: float
    k2: float
    balance: float


# Lenses by name.
LENSES = {"generic": Lens(0.45, 0.35, 0.08, 0.6), "pico4": Lens(0.44, 0.15, 0.03, 0.45)}

#: Bytes of frames of one size that are straightened at once.
STACKED = 1 << 18


def bent(angle: np.ndarray, lens: Lens) -> np.ndarray:
    """The sensor radius of rays at an angle from the axis."""
    square = angle * angle
    return angle * (1 + lens.k1 * square + lens.k2 * square * square)


def straight_angle(radius: float, lens: Lens) -> float:
    """The angle of a sensor radius, by Newton's method."""
    radius = min(max(radius, -np.pi / 2), np.pi / 2)
    angle = radius
    for _ in range(30):
        square = angle * angle
        slope = 1 + 3 * lens.k1 * square + 5 * lens.k2 * square * square
        angle -= (angle * (1 + lens.k1 * square + lens.k2 * square * square) - radius) / slope
    return angle


def camera(width: int, height: int, lens: Lens) -> tuple[float, float, float]:
    """(focal length, centre x, centre y) of the straight camera, in pixels.

    The mid points of the four edges, straightened, bound the field: the least focal
    length shows all of it, the greatest only what is full.
    """
    focal = max(width, height) * lens.focal
    edges = []
    for x, y in ((width / 2, 0), (width, height / 2), (width / 2, height), (0, height / 2)):
        u, v = (x - width / 2) / focal, (y - height / 2) / focal
        radius = float(np.hypot(u, v))
        scale = np.tan(straight_angle(radius, lens)) / radius if radius > 1e-8 else 1.0
        edges.append((u * scale, v * scale))
    xs, ys = zip(*edges)
    cx, cy = sum(xs) / 4, sum(ys) / 4
    lengths = [width / 2 / (cx - min(xs)), width / 2 / (max(xs) - cx), height / 2 / (cy - min(ys)), height / 2 / (max(ys) - cy)]
    length = lens.balance * min(lengths) + (1 - lens.balance) * max(lengths)
    return float(length), float(width / 2 - cx * length), float(height / 2 - cy * length)


@lru_cache(maxsize=8)
def places(width: int, height: int, lens: Lens) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) in the bent image of every pixel of the straight one."""
    length, cx, cy = camera(width, height, lens)
    focal = max(width, height) * lens.focal
    v, u = np.mgrid[0:height, 0:width]
    x, y = (u - cx) / length, (v - cy) / length
    radius = np.hypot(x, y)
    scale = np.divide(bent(np.arctan(radius), lens), radius, out=np.ones_like(radius), where=radius > 1e-8)
    return focal * x * scale + width / 2, focal * y * scale + height / 2


def read_between(image: np.ndarray, x: np.ndarray, y: np.ndarray, outside: bool = True) -> np.ndarray:
    """The image at (x, y), weighted between its pixels; outside it is black, or its edge goes on."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
        found = image[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)].astype(np.float64)
        return found * inside[..., None] if outside else found

    upper = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    lower = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(upper * (1 - fy) + lower * fy).astype(np.uint8)


def scaled(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image in another size, weighted between its pixels."""
    h, w = image.shape[:2]
    y, x = np.meshgrid((np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5, indexing="ij")
    return read_between(image, x, y, outside=False)


def straightened(image: np.ndarray, lens: Lens, downscale: int = 1, crop: float = 1.0, two_eyes: bool | None = None) -> np.ndarray:
    """A straightened frame; see the module."""
    h, w = image.shape[:2]
    if w >= 2 and (w >= 2 * h if two_eyes is None else two_eyes):
        return np.concatenate([straightened(half, lens, downscale, crop, False) for half in (image[:, : w // 2], image[:, w // 2 :])], axis=1)
    if downscale > 1:
        size = max(2, w // downscale), max(2, h // downscale)
        image = scaled(read_between(scaled(image, *size), *places(*size, lens)), w, h)
    else:
        image = read_between(image, *places(w, h, lens))
    if 0 < crop < 1:
        kept_w, kept_h = int(w * crop) // 2 * 2, int(h * crop) // 2 * 2
        x, y = (w - kept_w) // 2, (h - kept_h) // 2
        image = image[y : y + kept_h, x : x + kept_w]
    return image


def undistorted(frames: DataFrame, lens: str | Lens = "generic", *, strength: float = 1.0, downscale: int = 2, crop: float = 1.0, two_eyes: bool | None = None) -> DataFrame:
    """frames (video_id, frame_idx, width, height, pixels) straightened; strength scales the coefficients."""
    base = LENSES[lens] if isinstance(lens, str) else lens
    used = Lens(base.focal, base.k1 * strength, base.k2 * strength, base.balance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["video_id", "frame_idx", "width", "height", "pixels"]
        for batch in batches:
            alike: dict[tuple[int, int], list[int]] = {}
            for row, size in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())):
                alike.setdefault(size, []).append(row)
            for (height, width), rows in alike.items():
                most = max(1, STACKED // max(1, height * width * 3))
                for at in range(0, len(rows), most):
                    some = batch.take(pa.array(rows[at : at + most], pa.int64()))
                    # the frames' colours are laid side by side as those of one frame
                    stack = np.frombuffer(b"".join(some.column(4).to_pylist()), np.uint8).reshape(-1, height, width, 3)
                    done = straightened(stack.transpose(1, 2, 0, 3).reshape(height, width, -1), used, downscale, crop, two_eyes)
                    h, w = done.shape[:2]
                    made = done.reshape(h, w, -1, 3).transpose(2, 0, 1, 3)
                    sides = [pa.array([v] * len(made), pa.int32()) for v in (w, h)]
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *sides, pa.array([x.tobytes() for x in made], pa.binary())], names=names)

    return frames.select("video_id", "frame_idx", "width", "height", "pixels").mapInArrow(run, FRAMES)
