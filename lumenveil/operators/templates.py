"""Template search between detections: crops, normalised correlation, peak quality.

A box of one frame gives a grey template (its inner part); a later frame is searched
around the box. Frames pass once: they are made grey, a third of their bytes, the crops
that are wanted of each are joined to it as one array, and only crops travel on. Spark
takes frames from Python for far smaller than they are, so this join is sorted and
merged: neither side is copied through the driver.

The correlation is exact: sums come from integral images and a Fourier transform that
is rounded to whole numbers, so equal responses are equal numbers.

Defined cases: a template below 8 pixels either way, a region smaller than its
template and a frame that is not there give no row; a constant template or window
has response 0; of equal peaks the first in rows, then columns, is taken. Pixels that are
not 3 bytes for each of width x height fail if a crop of them is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The share that a template leaves out on each side, its least size, the
# search radius in box sides and its least value, when both are halved, and the least
# peak and ratio of peak to the rest.
INSET, LEAST_SIDE = 0.1, 8
RADIUS_SIDES, LEAST_RADIUS = 2.5, 32
HALVE_TEMPLATE, HALVE_REGION = 24, 480
LEAST_PEAK, LEAST_RATIO = 0.92, 2.0
#: Pixels of regions of one size that are searched at once.
STACKED = 1 << 17
#: Weights of blue, green and red in a grey value, of 16384.
GREY = (1868, 9617, 4899)

_CROP = "kind string, x0 int, y0 int, width int, height int, pixels binary"


def grey(image: np.ndarray) -> np.ndarray:
    """The grey values of BGR pixels."""
    b, g, r = (image[..., k].astype(np.int32) * weight for k, weight in enumerate(GREY))
    return ((b + g + r + 8192) >> 14).astype(np.uint8)


def template_rect(box, width: int, height: int) -> tuple[int, int, int, int] | None:
    """The inner part of a box inside a frame: x1, y1, x2, y2."""
    x1, y1, x2, y2 = (int(round(v)) for v in box)
    dx, dy = int((x2 - x1) * INSET), int((y2 - y1) * INSET)
    inner = max(0, x1 + dx), max(0, y1 + dy), min(width, x2 - dx), min(height, y2 - dy)
    return inner if inner[2] - inner[0] >= LEAST_SIDE and inner[3] - inner[1] >= LEAST_SIDE else None


def region_rect(box, width: int, height: int) -> tuple[int, int, int, int] | None:
    """Where a box's template is looked for."""
    inner = template_rect(box, width, height)
    if inner is None:
        return None
    tw, th = inner[2] - inner[0], inner[3] - inner[1]
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    radius = int(min(max(RADIUS_SIDES * max(box[2] - box[0], box[3] - box[1]), LEAST_RADIUS), width, height))
    x1, y1 = int(max(0, cx - radius - tw / 2)), int(max(0, cy - radius - th / 2))
    x2, y2 = int(min(width, cx + radius + tw / 2)), int(min(height, cy + radius + th / 2))
    return (x1, y1, x2, y2) if x2 - x1 >= tw and y2 - y1 >= th else None


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image made smaller; each pixel is the mean of the area that it covers."""

    def weights(old: int, new: int) -> np.ndarray:
        ends = np.arange(new + 1) * (old / new)
        share = np.minimum(ends[1:, None], np.arange(1, old + 1)) - np.maximum(ends[:-1, None], np.arange(old))
        return np.clip(share, 0, None) * (new / old)

    return np.rint(weights(image.shape[0], height) @ image.astype(np.float64) @ weights(image.shape[1], width).T).astype(np.uint8)


def responses(regions: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Normalised correlation of each centred template with every window of its region.

    regions: [n, height, width], or one region; templates likewise.
    """
    th, tw = templates.shape[-2:]
    size = regions.shape[-2:]
    n, image, small = th * tw, regions.astype(np.int64), templates.astype(np.int64)
    rows, columns = size[0] - th + 1, size[1] - tw + 1

    def windows(values: np.ndarray) -> np.ndarray:
        total = np.zeros((*values.shape[:-2], size[0] + 1, size[1] + 1), np.int64)
        total[..., 1:, 1:] = values.cumsum(-2).cumsum(-1)
        return total[..., th:, tw:] - total[..., :-th, tw:] - total[..., th:, :-tw] + total[..., :-th, :-tw]

    flipped = np.fft.rfft2(small[..., ::-1, ::-1], size)
    both = np.fft.irfft2(np.fft.rfft2(image) * flipped, size)[..., th - 1 :, tw - 1 :][..., :rows, :columns]
    sums, squares = windows(image), windows(image * image)
    total, power = (x.sum((-2, -1), keepdims=True) for x in (small, small * small))
    above = n * np.rint(both).astype(np.int64) - total * sums
    spread = (n * squares - sums * sums).astype(np.float64) * (n * power - total**2).astype(np.float64)
    return np.divide(above, np.sqrt(spread), out=np.zeros(spread.shape), where=spread > 0)


def located(regions: np.ndarray, templates: np.ndarray) -> list[tuple[float, float, float, float]]:
    """(x, y, peak, ratio) of each: the centre of the best window in the region, and its quality.

    regions and templates: [n, height, width], all of a size.
    """
    down = 2 if templates.shape[2] >= HALVE_TEMPLATE and regions.shape[2] >= HALVE_REGION else 1
    if down > 1:
        regions = np.stack([resized(x, x.shape[1] // 2, x.shape[0] // 2) for x in regions])
        templates = np.stack([resized(x, max(LEAST_SIDE, x.shape[1] // 2), max(LEAST_SIDE, x.shape[0] // 2)) for x in templates])
    if regions.shape[1] < templates.shape[1] or regions.shape[2] < templates.shape[2]:
        return [(0.0, 0.0, 0.0, 0.0)] * len(regions)
    found = responses(regions, templates).reshape(len(regions), -1)
    y, x = np.divmod(found.argmax(axis=1), regions.shape[2] - templates.shape[2] + 1)
    peak = found.max(axis=1)
    ratio = (peak - found.mean(axis=1)) / (found.std(axis=1) + 1e-6)
    return list(zip(((x + templates.shape[2] / 2) * down).tolist(), ((y + templates.shape[1] / 2) * down).tolist(), peak.tolist(), ratio.tolist()))


def greyed(frames: DataFrame) -> DataFrame:
    """frames (video_id, frame_idx, width, height, pixels) with one grey byte a pixel; null where pixels do not have that size."""
    fits = F.length("pixels") == F.col("width").cast("bigint") * F.col("height") * 3
    sized = frames.select("video_id", "frame_idx", "width", "height", F.when(fits, F.col("pixels")).alias("pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [grey(np.frombuffer(p.as_buffer(), np.uint8).reshape(-1, 3)).tobytes() if p.is_valid else None for p in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.binary())], names=batch.schema.names)

    return sized.mapInArrow(run, sized.schema)


def crops(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """(video_id, frame_idx, origin, track_id, kind, x0, y0, width, height, pixels): grey crops.

    wanted: (video_id, frame_idx, origin, track_id, kind, x1..y2) with kind
    ``template`` (of the box) or ``region`` (around it). origin: the frame of the box.
    """
    one = F.struct("origin", "track_id", "kind", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    asked = wanted.groupBy("video_id", "frame_idx").agg(F.collect_list(one).alias("asked"))
    joined = greyed(frames).hint("merge").join(asked.hint("merge"), ["video_id", "frame_idx"]).select("video_id", "frame_idx", "width", "height", "pixels", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("video_id", pa.int64()), ("frame_idx", pa.int64()), ("origin", pa.int64()), ("track_id", pa.int64()), ("kind", pa.string())]
        fields = pa.schema([*kinds, *((c, pa.int32()) for c in ("x0", "y0", "width", "height")), ("pixels", pa.binary())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["pixels"] is None:
                    raise ValueError(f"frame {row['frame_idx']} of video {row['video_id']}: pixels are not 3 bytes for each of width x height")
                image = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])
                for ask in row["asked"]:
                    box = [ask[c] for c in ("x1", "y1", "x2", "y2")]
                    place = (template_rect if ask["kind"] == "template" else region_rect)(box, row["width"], row["height"])
                    if place is None:
                        continue
                    x1, y1, x2, y2 = place
                    out.append({"video_id": row["video_id"], "frame_idx": row["frame_idx"], "origin": ask["origin"], "track_id": ask["track_id"], "kind": ask["kind"], "x0": x1, "y0": y1, "width": x2 - x1, "height": y2 - y1, "pixels": image[y1:y2, x1:x2].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return joined.mapInArrow(run, f"video_id bigint, frame_idx bigint, origin bigint, track_id bigint, {_CROP}")


def search(frames: DataFrame, boxes: DataFrame, after: int = 1) -> DataFrame:
    """(video_id, frame_idx, track_id, x, y, peak, ratio, found): boxes looked for ``after`` frames later.

    frames: (video_id, frame_idx, width, height, pixels); boxes: (video_id,
    frame_idx, track_id, x1..y2), one a frame and track. x, y: the centre of the best
    window; found: it is good enough to carry the box there.
    """
    given = boxes.select("video_id", "frame_idx", F.col("frame_idx").alias("origin"), "track_id", "x1", "y1", "x2", "y2")
    wanted = given.withColumn("kind", F.lit("template")).unionByName(given.withColumns({"frame_idx": F.col("origin") + after, "kind": F.lit("region")}))
    cut = F.struct("frame_idx", "x0", "y0", "width", "height", "pixels")
    both = crops(frames, wanted).groupBy("video_id", "origin", "track_id").agg(*(F.first(F.when(F.col("kind") == k, cut), ignorenulls=True).alias(k) for k in ("template", "region")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("video_id", pa.int64()), ("frame_idx", pa.int64()), ("track_id", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "peak", "ratio")), ("found", pa.bool_())])
        for batch in batches:
            out, alike = [], {}
            for row in batch.to_pylist():
                alike.setdefault(tuple(row[k][c] for k in ("template", "region") for c in ("height", "width")), []).append(row)
            for (th, tw, rh, rw), rows in alike.items():
                most = max(1, STACKED // (rh * rw))
                for at in range(0, len(rows), most):
                    some = rows[at : at + most]
                    small, large = (np.frombuffer(b"".join(r[k]["pixels"] for r in some), np.uint8).reshape(-1, *size) for k, size in (("template", (th, tw)), ("region", (rh, rw))))
                    for row, (x, y, peak, ratio) in zip(some, located(large, small)):
                        region, found = row["region"], peak >= LEAST_PEAK and ratio >= LEAST_RATIO
                        out.append({"video_id": row["video_id"], "frame_idx": region["frame_idx"], "track_id": row["track_id"], "x": region["x0"] + x, "y": region["y0"] + y, "peak": peak, "ratio": ratio, "found": found})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    found = both.filter("template is not null and region is not null").select("video_id", "track_id", "template", "region")
    return found.mapInArrow(run, "video_id bigint, frame_idx bigint, track_id bigint, x double, y double, peak double, ratio double, found boolean")


def carried(boxes: DataFrame, hits: DataFrame, after: int = 1) -> DataFrame:
    """boxes moved to where their templates were found; the others are left out."""
    moved = hits.filter("found").select("video_id", (F.col("frame_idx") - after).alias("frame_idx"), "track_id", "x", "y")
    dx, dy = F.col("x") - (F.col("x1") + F.col("x2")) / 2, F.col("y") - (F.col("y1") + F.col("y2")) / 2
    sides = [F.bround(F.col(c) + (dx if c[0] == "x" else dy)).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return boxes.join(moved, ["video_id", "frame_idx", "track_id"]).select("video_id", (F.col("frame_idx") + after).alias("frame_idx"), "track_id", *sides)
