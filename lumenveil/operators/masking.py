"""Pixel work on frames: mosaic, corruption test, texture and remapping.

Frames are rows (video_id, frame_idx, width, height, pixels) with BGR bytes; the
boxes of a frame are joined on first, as one array per frame, and each Arrow batch
is masked with NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cells across a mosaic's longer side and expansion, by kind.
CELLS = {"face": 8, "card": 10, "pet": 8, "text": 12}
EXPAND = {"face": 0.12, "card": 0.10, "pet": 0.12, "text": 0.05}
FRAMES = "video_id bigint, frame_idx bigint, width int, height int, pixels binary"


def mosaic(frame: np.ndarray, box: tuple[int, int, int, int], cells: int = 8) -> None:
    """Replace a box by the means of at most ``cells`` x ``cells`` tiles, in place."""
    x1, y1, x2, y2 = max(0, box[0]), max(0, box[1]), min(frame.shape[1], box[2]), min(frame.shape[0], box[3])
    if x2 <= x1 or y2 <= y1:
        return
    part = frame[y1:y2, x1:x2].astype(np.float64)
    ys = np.unique(np.linspace(0, y2 - y1, min(cells, y2 - y1) + 1).astype(int))
    xs = np.unique(np.linspace(0, x2 - x1, min(cells, x2 - x1) + 1).astype(int))
    sums = np.add.reduceat(np.add.reduceat(part, ys[:-1], axis=0), xs[:-1], axis=1)
    means = sums / (np.diff(ys)[:, None, None] * np.diff(xs)[None, :, None])
    frame[y1:y2, x1:x2] = np.repeat(np.repeat(np.rint(means), np.diff(ys), axis=0), np.diff(xs), axis=1)


# Standard deviations of the blur under a mosaic by kind, and the widest
# kernel; cells per kind of a blurred mosaic are those above.
BLUR = {"face": 45.0, "card": 45.0, "pet": 45.0, "text": 35.0}
WIDEST_KERNEL, LEAST_BLURRED = 51, 4


def blur(part: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur, axis by axis; edges are mirrored, the kernel is no wider than the part."""
    size = min(int(sigma * 3) | 1, WIDEST_KERNEL, max(part.shape[:2]) | 1)
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at * at) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    out = part.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        if n == 1:
            continue
        places = np.abs((np.arange(n)[:, None] + at) % (2 * n - 2))
        places = np.where(places >= n, 2 * n - 2 - places, places)  # mirrored at both ends
        out = np.moveaxis(np.tensordot(kernel, np.take(np.moveaxis(out, axis, 0), places, axis=0), ([0], [1])), 0, axis)
    return out


def blurred_mosaic(frame: np.ndarray, box: tuple[int, int, int, int], cells: int, sigma: float) -> None:
    """Blur a box, keep one pixel of each tile of ``cells`` x ``cells`` pixels, and enlarge it, in place."""
    x1, y1, x2, y2 = max(0, box[0]), max(0, box[1]), min(frame.shape[1], box[2]), min(frame.shape[0], box[3])
    w, h = x2 - x1, y2 - y1
    if w < LEAST_BLURRED or h < LEAST_BLURRED:
        return
    soft = blur(frame[y1:y2, x1:x2], sigma)

    def between(n: int, tiles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(tiles) + 0.5) * n / tiles - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    (a, b, fy), (c, d, fx) = between(h, max(1, h // cells)), between(w, max(1, w // cells))
    rows = soft[a] * (1 - fy)[:, None, None] + soft[b] * fy[:, None, None]
    small = np.rint(rows[:, c] * (1 - fx)[None, :, None] + rows[:, d] * fx[None, :, None])
    frame[y1:y2, x1:x2] = small[np.arange(h) * len(a) // h][:, np.arange(w) * len(c) // w]


def masked(frames: DataFrame, boxes: DataFrame, kind: str = "face", how: str = "mosaic") -> DataFrame:
    """frames with the boxes (video_id, frame_idx, x1..y2) of each made unreadable.

    how: ``mosaic`` of means, or ``blur`` and mosaic.
    """
    if how not in ("mosaic", "blur"):
        raise ValueError(f"unknown way of masking {how!r}")
    per_frame = boxes.groupBy("video_id", "frame_idx").agg(F.sort_array(F.collect_list(F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))))).alias("boxes"))
    joined = frames.join(per_frame, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", "width", "height", "pixels", "boxes")
    share, cells, sigma = EXPAND[kind], CELLS[kind], BLUR[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                image = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], 3).copy()
                for x1, y1, x2, y2 in row.pop("boxes") or ():
                    dx, dy = int((x2 - x1) * share), int((y2 - y1) * share)
                    wider = int(x1 - dx), int(y1 - dy), int(x2 + dx), int(y2 + dy)
                    if how == "blur":
                        blurred_mosaic(image, wider, cells, sigma)
                    else:
                        mosaic(image, wider, cells)
                out.append(row | {"pixels": image.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("video_id", pa.int64()), ("frame_idx", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    return joined.mapInArrow(run, FRAMES)


def measured(frames: DataFrame, flat: float = 10.0) -> DataFrame:
    """(video_id, frame_idx, std_b, std_g, std_r, corrupt, texture) of each frame.

    corrupt: every channel varies less than ``flat``; texture: standard deviation of
    the grey inner 70 %.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("video_id", pa.int64()), ("frame_idx", pa.int64()), *((f"std_{c}", pa.float64()) for c in "bgr"), ("corrupt", pa.bool_()), ("texture", pa.float64())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                h, w = row["height"], row["width"]
                image = np.frombuffer(row["pixels"], np.uint8).reshape(h, w, 3).astype(np.float64)
                stds = image.reshape(-1, 3).std(axis=0)
                inner = image[int(h * 0.15) : max(int(h * 0.85), 1), int(w * 0.15) : max(int(w * 0.85), 1)] @ [0.114, 0.587, 0.299]
                out.append({"video_id": row["video_id"], "frame_idx": row["frame_idx"], **{f"std_{c}": float(s) for c, s in zip("bgr", stds)}, "corrupt": bool((stds < flat).all()), "texture": float(inner.std())})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return frames.mapInArrow(run, "video_id bigint, frame_idx bigint, std_b double, std_g double, std_r double, corrupt boolean, texture double")


def fisheye_map(width: int, height: int, strength: float = 0.35) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns to read for an undistorted frame (one fixed-size table)."""
    ys, xs = np.mgrid[0:height, 0:width]
    cx, cy, r = (width - 1) / 2, (height - 1) / 2, max(width, height) / 2
    u, v = (xs - cx) / r, (ys - cy) / r
    scale = 1 - strength * (u * u + v * v)
    return np.clip(np.rint(cy + v * scale * r), 0, height - 1).astype(int), np.clip(np.rint(cx + u * scale * r), 0, width - 1).astype(int)


def undistorted(frames: DataFrame, strength: float = 0.35) -> DataFrame:
    """frames remapped eye by eye; a frame twice as wide as high holds two eyes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                image = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], 3)
                eyes = np.split(image, 2, axis=1) if row["width"] >= 2 * row["height"] and row["width"] % 2 == 0 else [image]
                done = []
                for eye in eyes:
                    size = eye.shape[1], eye.shape[0]
                    maps.setdefault(size, fisheye_map(*size, strength))
                    done.append(eye[maps[size]])
                out.append(row | {"pixels": np.concatenate(done, axis=1).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return frames.select("video_id", "frame_idx", "width", "height", "pixels").mapInArrow(run, FRAMES)
