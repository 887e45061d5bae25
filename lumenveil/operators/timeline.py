"""Frame timelines: sampling, segments, gaps, bursts and backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenveil.functions import boxes
from lumenveil.operators.runs import over_sequences

# Horizons of the tracker, in frames, and of the preview sampler.
GAP, BURST, STREAK = 5, 5, 300
HOLD, SCAN, EMPTY_SCAN, COLD = 10, 1, 5, 2
PREVIEW_BUCKETS, PREVIEW_PADDING, PREVIEW_PADDING_SECONDS = 12, 0.125, 2.0


def sampled(frames: DataFrame, k: int) -> DataFrame:
    """Every k-th frame, from the first (frames count from 1)."""
    return frames.filter((F.col("frame_idx") - 1) % k == 0)


def segments(videos: DataFrame, length: float, *, skip: int = 1, interval: int = 5, grace: int = 5, fps: Column | None = None) -> DataFrame:
    """(video_id, seg_idx, start, end, overlap): segments of ``length`` seconds.

    overlap: frames at a segment's start that warm its tracker up; a segment
    begins so much earlier (25 frames a second unless ``fps`` says otherwise). A
    video without a duration is one empty segment.
    """
    overlap = max(10, -(-(interval + grace) // skip) * skip)
    known = F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0))
    rate = F.lit(25.0) if fps is None else fps
    n = F.greatest(F.ceil(known / length), F.lit(1)).cast("int")
    out = videos.select("video_id", known.alias("duration"), rate.alias("fps"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seg_idx"))
    later = F.col("seg_idx") > 0
    start = F.col("seg_idx") * length - F.when(later & (F.col("fps") > 0), overlap / F.col("fps")).otherwise(0.0)
    return out.select("video_id", "seg_idx", F.greatest(start, F.lit(0.0)).alias("start"), F.least((F.col("seg_idx") + 1) * length, F.col("duration")).alias("end"), F.when(later, overlap).otherwise(0).alias("overlap"))


def segment_frames(frames: DataFrame, size: int, overlap: int) -> DataFrame:
    """Frames with the segments they belong to; ``warm_up`` frames are not output."""
    own = F.floor((F.col("frame_idx") - 1) / size)
    following = F.when((F.col("frame_idx") - 1) % size >= size - overlap, own + 1)
    return frames.withColumn("_own", own).withColumn("seg_idx", F.explode(F.array_compact(F.array(own, following)))).withColumn("warm_up", F.col("seg_idx") != F.col("_own")).drop("_own")


def gap_events(visible: DataFrame, most: int = GAP) -> DataFrame:
    """(video_id, start_frame, end_frame, gap): visibility regained within ``most``."""
    seen = visible.filter("visible")
    before = F.lag("frame_idx").over(Window.partitionBy("video_id").orderBy("frame_idx"))
    found = seen.withColumn("start_frame", before).withColumn("gap", F.col("frame_idx") - F.col("start_frame"))
    return found.filter((F.col("gap") > 1) & (F.col("gap") <= most)).select("video_id", "start_frame", F.col("frame_idx").alias("end_frame"), "gap")


def backfilled(events: DataFrame) -> DataFrame:
    """Interpolated boxes of events (start_frame, end_frame, a: box, b: box)."""
    frames = events.filter("end_frame > start_frame").withColumn("frame_idx", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)))
    share = (F.col("frame_idx") - F.col("start_frame")) / (F.col("end_frame") - F.col("start_frame"))
    return frames.withColumns(dict(zip(boxes.SIDES, boxes.interpolated(boxes.of(F.col("a")), boxes.of(F.col("b")), share))))


def filled(seen: DataFrame, most: int = GAP) -> DataFrame:
    """(video_id, frame_idx, x1..y2, source): seen boxes, and boxes between two that are 2 to ``most`` frames apart.

    seen: (video_id, frame_idx, x1..y2), null sides where nothing is seen, one row a
    frame. source: ``seen`` or ``backfill``.
    """
    there = seen.filter("x1 is not null").withColumn("box", F.struct(*boxes.SIDES))
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    spans = there.select("video_id", "frame_idx", "box", F.lag("frame_idx").over(order).alias("start_frame"), F.lag("box").over(order).alias("a"))
    gaps = spans.filter((F.col("frame_idx") - F.col("start_frame")).between(2, most)).select("video_id", "start_frame", F.col("frame_idx").alias("end_frame"), "a", F.col("box").alias("b"))
    between = backfilled(gaps).filter("frame_idx > start_frame").withColumn("source", F.lit("backfill"))
    own = there.select("video_id", "frame_idx", *(F.bround(s).cast("int").alias(s) for s in boxes.SIDES), F.lit("seen").alias("source"))
    return own.unionByName(between.select(own.columns))


class Delayed:
    """Frames held until they are settled, for :func:`filled` of a stream; the state of one video.

    A frame is settled when one ``late`` frames later has come. Held are the frames
    that are not, and the last settled box.
    """

    def __init__(self, most: int = GAP, late: int = GAP) -> None:
        self.most, self.late, self.waiting, self.last = most, late, {}, None

    def dump(self) -> list:
        return [sorted(self.waiting.items()), self.last]

    def load(self, values: list) -> None:
        waiting, self.last = values
        self.waiting = {frame: box for frame, box in waiting}

    def add(self, frame: int, box: list[float] | None) -> None:
        """Evidence of a frame; a box replaces none."""
        self.waiting[frame] = box if box is not None else self.waiting.get(frame)

    def settle(self) -> list[tuple[int, list[int], str]]:
        """(frame, box, source) of the frames that are settled now, in order."""
        out = []
        upto = max(self.waiting, default=0) - self.late
        for frame in sorted(f for f in self.waiting if f <= upto):
            box = self.waiting.pop(frame)
            if box is None:
                continue
            if self.last is not None and 2 <= frame - self.last[0] <= self.most:
                start, a = self.last
                for between in range(start + 1, frame):
                    share = (between - start) / (frame - start)
                    out.append((between, [round(x + (y - x) * share) for x, y in zip(a, box)], "backfill"))
            out.append((frame, [round(x) for x in box], "seen"))
            self.last = (frame, list(box))
        return out


def confirmations(pending: DataFrame, confirmed: DataFrame, *, horizon: int = GAP, distance: float = 2.5) -> DataFrame:
    """For each confirmed box the pending one of the last frames that it confirms.

    The earliest frame, then the nearest centre. Joined by blocks of frames, so it
    is an equi-join however long a video is.
    """
    block = lambda c: F.floor(c / (horizon + 1))
    p = pending.select("video_id", F.col("frame_idx").alias("p_frame"), F.struct(*boxes.SIDES).alias("p_box"), block(F.col("frame_idx")).alias("_block"))
    c = confirmed.select("video_id", "frame_idx", "det_id", *boxes.SIDES, F.explode(F.array(block(F.col("frame_idx")), block(F.col("frame_idx")) - 1)).alias("_block"))
    near = boxes.centre_distance(boxes.of(F.col("p_box")), boxes.box())
    joined = c.join(p, ["video_id", "_block"]).filter(F.col("p_frame").between(F.col("frame_idx") - horizon, F.col("frame_idx") - 1)).withColumn("distance", near).filter(F.col("distance") <= distance)
    best = F.min(F.struct("p_frame", "distance", "p_box")).alias("best")
    return joined.groupBy("video_id", "frame_idx", "det_id").agg(best).select("video_id", "frame_idx", "det_id", F.col("best.p_frame").alias("pending_frame"), F.col("best.distance").alias("distance"))


def bursts(frames: DataFrame, length: int = BURST) -> DataFrame:
    """frames with ``burst``: whether a count changed on one of the last frames."""
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    changed = F.coalesce(F.col("count") != F.lag("count").over(order), F.lit(False))
    return frames.withColumn("_changed", changed.cast("int")).withColumn("burst", F.coalesce(F.max("_changed").over(order.rowsBetween(-length, -1)), F.lit(0)) == 1).drop("_changed")


def miss_streaks(frames: DataFrame) -> DataFrame:
    """frames with ``streak`` (misses in a row) and ``ever_seen`` so far."""
    order = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("visible").cast("int")
    grouped = frames.withColumn("_run", F.sum(hit).over(order)).withColumn("ever_seen", F.max(hit).over(order) == 1)
    inside = Window.partitionBy("video_id", "_run").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return grouped.withColumn("streak", F.sum(1 - hit).over(inside)).drop("_run")


def scene_scans(frames: DataFrame, *, hold: int = HOLD, scan: int = SCAN, empty: int = EMPTY_SCAN, cold: int = COLD) -> DataFrame:
    """(video_id, frame_idx, active, scanned, hold): on which frames detectors run.

    frames: one row (video_id, frame_idx, tracked, found) a frame; found is what a
    detector would report. A scene stays active for ``hold`` frames after its last
    track or finding and is scanned every ``scan`` frames, an empty one every
    ``empty`` frames, and the first ``cold`` frames always. Findings of frames
    that are not scanned are not known, so frames are stepped in order.
    """

    def step(state: dict, frame: int, rows: list[dict]) -> list[dict]:
        row = rows[0]
        held = hold if row["tracked"] else state.get("hold", 0)
        scanned = (frame - 1) % (scan if held else empty) == 0 or frame <= cold
        state["hold"] = hold if scanned and row["found"] else held if row["tracked"] else max(held - 1, 0)
        return [{"video_id": row["video_id"], "frame_idx": frame, "active": held > 0, "scanned": scanned, "hold": state["hold"]}]

    kept = frames.select("video_id", "frame_idx", "tracked", "found")
    names = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = f"video_id {names['video_id']}, frame_idx {names['frame_idx']}, active boolean, scanned boolean, hold int"
    return over_sequences(kept, ["video_id"], "frame_idx", ["tracked", "found"], lambda _: {}, step, schema)


def median_shift(points: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median displacement (dx, dy) of every group."""
    return points.groupBy(*keys).agg(F.median("dx").alias("dx"), F.median("dy").alias("dy"), F.count("*").alias("points"))


def smoothed(boxes_: Column, alpha: float = 0.65) -> Column:
    """Exponential smoothing of an ordered array of boxes, rounded at each step."""
    mix = lambda new, old: F.bround(new * alpha + old * (1 - alpha)).cast("double")
    first = F.get(boxes_, 0)
    return F.aggregate(F.slice(boxes_, 2, F.greatest(F.size(boxes_) - 1, F.lit(0))), first, lambda s, x: F.struct(*(mix(x[k], s[k]).alias(k) for k in boxes.SIDES)))


def smoothed_tracks(detections: DataFrame, keys: list[str], alpha: float = 0.65) -> DataFrame:
    """The boxes of every frame, smoothed along each group of ``keys``: one row each.

    As ``smoothed``, but a group is stepped through with its last box as state.
    """
    names = [*keys, "frame_idx", *boxes.SIDES]
    mix = lambda new, old: None if new is None or old is None else float(round(new * alpha + old * (1 - alpha)))

    def step(state: dict, _: int, rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            now = {k: row[k] for k in boxes.SIDES}
            state["box"] = {k: mix(v, state["box"][k]) for k, v in now.items()} if state else now
            out.append({**row, **state["box"]})
        return out

    rows = detections.select(*names[: len(keys) + 1], *(F.col(k).cast("double").alias(k) for k in boxes.SIDES))
    return over_sequences(rows, keys, "frame_idx", list(boxes.SIDES), lambda _: {}, step, rows.schema)


def preview_buckets(videos: DataFrame, most: int = PREVIEW_BUCKETS) -> DataFrame:
    """(video_id, bucket, low, high): strata of the preview sampler, in seconds."""
    pad = F.least(F.col("duration") * PREVIEW_PADDING, F.lit(PREVIEW_PADDING_SECONDS))
    n = F.least(F.greatest(F.ceil(F.col("duration")), F.lit(1)), F.lit(most)).cast("int")
    spread = videos.withColumns({"_pad": pad, "_n": n}).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = (F.col("duration") - 2 * F.col("_pad")) / F.col("_n")
    return spread.select("video_id", "bucket", (F.col("_pad") + F.col("bucket") * step).alias("low"), (F.col("_pad") + (F.col("bucket") + 1) * step).alias("high"))


def preview_times(buckets: DataFrame, per_bucket: int = 2) -> DataFrame:
    """(video_id, bucket, nth, at): sample times drawn by a hash, the same on every run."""
    digits = 12
    name = F.concat_ws("-", F.col("video_id").cast("string"), F.col("bucket").cast("string"), F.col("nth").cast("string"))
    drawn = F.conv(F.substring(F.md5(name), 1, digits), 16, 10).cast("double") / float(16**digits)
    spread = buckets.select("video_id", "bucket", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(per_bucket - 1))).alias("nth"))
    return spread.select("video_id", "bucket", "nth", (F.col("low") + (F.col("high") - F.col("low")) * drawn).alias("at"))
