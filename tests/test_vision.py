"""Fusion, tracking, timelines and pixels against plain Python and invariants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenveil.functions import boxes, scalars
from lumenveil.operators import detectors, fusion, masking, timeline, tracking
from lumenveil.plans.fixtures import view

DETECTION = "video_id bigint, frame_idx bigint, det_id int, model string, x1 double, y1 double, x2 double, y2 double, score double"


def plain_iou(a, b, extra=0.0):
    w, h = min(a.x2, b.x2) - max(a.x1, b.x1) + extra, min(a.y2, b.y2) - max(a.y1, b.y1) + extra
    both = max(w, 0) * max(h, 0)
    size = lambda r: (r.x2 - r.x1 + extra) * (r.y2 - r.y1 + extra)
    union = size(a) + size(b) - both
    return both / union if union > 0 else 0.0


@pytest.fixture(scope="module")
def detections(spark):
    dice = random.Random(3)
    rows = []
    for video in range(2):
        for frame in range(1, 25):
            for k in range(dice.randint(0, 6)):
                x, y = dice.choice([10, 14, 60, 200]) + dice.randint(0, 5), dice.choice([10, 80]) + dice.randint(0, 5)
                rows.append((video, frame, k, "AB"[k % 2], float(x), float(y), float(x + 40), float(y + 44), round(dice.random(), 2)))
    return spark.createDataFrame(rows, DETECTION)


def frames_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.video_id, r.frame_idx), []).append(r)
    return out


def test_nms_equals_plain_python_and_is_idempotent(detections):
    kept = fusion.nms(detections)
    want = set()
    for (video, frame), rows in frames_of(detections).items():
        for model in "AB":
            chosen = []
            for r in sorted((r for r in rows if r.model == model), key=lambda r: (-r.score, r.det_id)):
                if all(plain_iou(r, c, 1.0) <= 0.4 for c in chosen):
                    chosen.append(r)
            want |= {(video, frame, r.det_id) for r in chosen}
    ids = lambda df: {(r.video_id, r.frame_idx, r.det_id) for r in df.collect()}
    assert ids(kept) == want == ids(fusion.nms(kept))


def test_consensus_uses_a_box_once(detections):
    rows = fusion.dual_consensus(detections).collect()
    for side in ("det_a", "det_b"):
        used = [(r.video_id, r.frame_idx, r[side]) for r in rows if r[side] is not None]
        assert len(used) == len(set(used))
    assert sum((r.det_a is not None) + (r.det_b is not None) for r in rows) == detections.count()
    for r in (r for r in rows if r.source == "D"):
        assert r.iou >= fusion.CONSENSUS_IOU and r.mean_score == pytest.approx((r.score_a + r.score_b) / 2)


def test_leader_clusters_and_stereo(detections, spark):
    rows = fusion.leader_clusters(detections).collect()
    assert sum(r.members for r in rows) == detections.filter("score >= 0.3").count()
    assert all(max(r.scores.values()) == r.score for r in rows)
    costs = spark.createDataFrame([(0, 1, 0, 0, 0.5), (0, 1, 0, 1, 0.1), (0, 1, 1, 1, 0.2), (0, 1, 1, 0, 0.9), (0, 1, 2, 0, None)], "video_id bigint, frame_idx bigint, left_id int, right_id int, cost double")
    assert {(r.left_id, r.right_id) for r in fusion.stereo_pairs(costs).collect()} == {(0, 1), (1, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=4, max_size=4), min_size=2, max_size=2))
def test_iou_is_symmetric(pair):
    a, b = ([min(p[0], p[2]), min(p[1], p[3]), max(p[0], p[2]), max(p[1], p[3])] for p in pair)
    assert tracking._iou(a, b) == tracking._iou(b, a) and 0 <= tracking._iou(a, b) <= 1


def fused_rows(seed: int = 1, frames: int = 60) -> list[tuple]:
    dice, rows = random.Random(seed), []
    for video in range(3):
        for frame in range(1, frames):
            found = [(100 + 2 * frame, "D")] if dice.random() < 0.8 else []
            found += [(700 - 3 * frame, dice.choice("DS"))] if dice.random() < 0.6 else []
            rows += [(video, frame, float(x), 50.0, float(x + 60), 120.0, s) for x, s in found] or [(video, frame, None, None, None, None, None)]
    return rows


FUSED = "video_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, source string"


def test_tracker_follows_and_backfills(spark):
    got = tracking.track(spark.createDataFrame(fused_rows(), FUSED)).collect()
    tracks = [r for r in got if r.kind == "track"]
    assert {r.video_id for r in tracks} == {0, 1, 2} and any(r.kind == "backfill" for r in got)
    per_frame = [(r.video_id, r.frame_idx, r.track_id) for r in tracks]
    assert len(per_frame) == len(set(per_frame))
    assert all(r.since_frame < r.frame_idx for r in got if r.kind == "backfill")
    assert max(r.track_id for r in tracks if r.video_id == 0) < 12


def test_a_state_survives_its_text():
    state, twin = tracking.Tracks(), tracking.Tracks()
    for frame in range(1, 40):
        found = [{"box": [frame * 2, 10, frame * 2 + 50, 70], "confirmed": frame % 3 > 0}] if frame % 7 else []
        assert state.step(frame, found) == twin.step(frame, found)
        twin = tracking.Tracks.from_json(twin.to_json())


@pytest.mark.parametrize("cuts", [[20], [1, 2, 3, 30], [59]])
def test_stream_equals_batch(spark, tmp_path, cuts):
    from lumenveil.streaming import queries as streams

    rows = fused_rows(2)
    want = sorted(map(str, tracking.track(spark.createDataFrame(rows, FUSED)).collect()))
    source, done = tmp_path / "source", tmp_path / "done"
    source.mkdir()
    stream = streams.track_stream(spark.readStream.schema(FUSED).parquet(str(source)))
    for low, high in zip([0, *cuts], [*cuts, 10_000]):
        part = [r for r in rows if low < r[1] <= high]
        if part:
            spark.createDataFrame(part, FUSED).coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.format("parquet").outputMode("append").option("path", str(done)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(done)).select("video_id", "frame_idx", "track_id", "x1", "y1", "x2", "y2", "kind", "since_frame")
    assert sorted(map(str, got.collect())) == want


def test_hold_keeps_a_box_for_its_grace(spark):
    rows = [(0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 50.0, 0.0, 90.0, 40.0, 0.5)] + [(0, f, None, None, None, None, None) for f in range(2, 8)]
    got = tracking.hold(spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, score double"), grace=3).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == [1, 2, 3, 4] and {r.x1 for r in got} == {50.0}


def test_segments_warm_up(spark):
    videos = spark.createDataFrame([(1, 130.0), (2, 10.0), (3, None)], "video_id bigint, duration double")
    got = [(r.video_id, r.seg_idx, r.start, r.end, r.overlap) for r in timeline.segments(videos, 60.0, fps=F.lit(10.0)).orderBy("video_id", "seg_idx").collect()]
    assert got == [(1, 0, 0, 60, 0), (1, 1, 59, 120, 10), (1, 2, 119, 130, 10), (2, 0, 0, 10, 0), (3, 0, 0, 0, 0)]


def test_preview_times_lie_in_their_buckets(spark, sf_dir):
    buckets = timeline.preview_buckets(view(spark, sf_dir, "video_info").limit(200))
    times = timeline.preview_times(buckets).join(buckets, ["video_id", "bucket"])
    assert times.filter("at < low or at > high").count() == 0 and times.count() == 2 * buckets.count()


def test_smoothing_rounds_at_every_step(spark):
    path = [(0.0, 0.0, 10.0, 10.0), (3.0, 3.0, 13.0, 13.0), (10.0, 0.0, 20.0, 10.0)]
    want = list(path[0])
    for b in path[1:]:
        want = [round(0.65 * n + 0.35 * o) for n, o in zip(b, want)]
    got = spark.createDataFrame([(path,)], "p array<struct<x1: double, y1: double, x2: double, y2: double>>").select(timeline.smoothed(F.col("p")).alias("b")).first().b
    assert list(got) == want


def test_mosaic_hides_a_box_and_nothing_else(spark):
    image = np.random.default_rng(0).integers(0, 256, (64, 80, 3), np.uint8)
    frames = spark.createDataFrame([(1, 1, 80, 64, bytearray(image.tobytes())), (1, 2, 80, 64, bytearray(image.tobytes()))], masking.FRAMES)
    found = spark.createDataFrame([(1, 1, 20.0, 16.0, 52.0, 48.0)], "video_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double")
    out = {r.frame_idx: np.frombuffer(r.pixels, np.uint8).reshape(64, 80, 3) for r in masking.masked(frames, found).collect()}
    assert (out[2] == image).all()
    inside = np.zeros((64, 80), bool)
    inside[13:51, 17:55] = True
    assert (out[1][~inside] == image[~inside]).all()
    assert len(np.unique(out[1][13:51, 17:55].reshape(-1, 3), axis=0)) <= 64
    assert abs(out[1][inside].mean() - image[inside].mean()) < 1


def test_frame_measures(spark):
    flat, busy = np.full((20, 20, 3), 90, np.uint8), np.random.default_rng(1).integers(0, 256, (20, 20, 3), np.uint8)
    frames = spark.createDataFrame([(1, k, 20, 20, bytearray(x.tobytes())) for k, x in enumerate((flat, busy))], masking.FRAMES)
    got = {r.frame_idx: r for r in masking.measured(frames).collect()}
    assert got[0].corrupt and got[0].texture < 1e-9 and not got[1].corrupt and got[1].std_b == pytest.approx(busy[..., 0].std())
    wide = np.concatenate([busy, busy], axis=1)
    two = spark.createDataFrame([(1, 1, 40, 20, bytearray(wide.tobytes()))], masking.FRAMES)
    eyes = np.frombuffer(masking.undistorted(two).first().pixels, np.uint8).reshape(20, 40, 3)
    assert (eyes[:, :20] == eyes[:, 20:]).all()


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(scalars.parse_fps(F.lit("30000/1001"))) == pytest.approx(29.97002997) and one(scalars.parse_fps(F.lit("0/0"))) == 25.0
    assert one(scalars.format_duration(F.lit(9))) == "0:09" and one(scalars.format_duration(F.lit(3661))) == "1:01:01" and one(scalars.format_duration(F.lit(-5.5))) == "0:00"
    assert one(scalars.server_name(F.lit("a-slot-b-slot-3"))) == "a-slot-b" and one(scalars.server_name(F.lit("a-slot-b"))) == "a-slot-b" and one(scalars.base_worker_id(F.lit("a-slot-b"))) == "a"
    assert one(scalars.output_key(F.lit("source/inbox/s/s/m.mp4"))) == "outputs/s/s/masked_m.mp4"
    assert one(scalars.xml_escaped(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert [scalars.column_name(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    assert one(scalars.slots(F.lit("1, 3-5,4,99"))) == [1, 3, 4, 5]
    assert one(boxes.correlation(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(5.0), F.lit(5.0)))) == 0.0


def test_every_box_is_smoothed_along_its_track(spark, sf_dir):
    from lumenveil.plans.catalogue import queries

    rows = sorted(view(spark, sf_dir, "jittered").collect(), key=lambda r: (r.video_id, r.det_id, r.frame_idx, r.x1, r.y1, r.x2, r.y2))
    last: dict[tuple, list] = {}
    want = []
    for r in rows:
        now, track = [r.x1, r.y1, r.x2, r.y2], (r.video_id, r.det_id)
        last[track] = [float(round(a * 0.65 + b * (1 - 0.65))) for a, b in zip(now, last[track])] if track in last else now
        want.append((*track, r.frame_idx, *last[track]))
    assert sorted(map(tuple, queries()["smoothed_boxes"](spark, sf_dir).collect())) == sorted(want)


def test_hulls_gather_no_points_of_a_video(spark, sf_dir):
    from lumenveil.plans.catalogue import queries

    assert "collect_" not in queries()["polygon_hulls"](spark, sf_dir)._jdf.queryExecution().toString()


def test_boxes_are_decoded_once(spark):
    """The tests of a box repeat none of the expressions that make it."""
    given = "video_id long, frame_idx long, width int, height int, index int, values array<double>"
    raw = spark.createDataFrame([(1, 2, 640, 480, 3, [10.0, 100.0, 50.0, 160.0, 0.9]), (1, 2, 640, 480, 4, [10.0, 100.0, 5.0, 160.0, 0.9]), (1, 2, 640, 480, 5, [10.0, 100.0, 50.0, 160.0, 0.1])], given)
    found = detectors.decoded(raw, "boxes")
    assert [r.det_id for r in found.collect()] == [3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("least(" in line for line in plan.splitlines() if "Filter" in line)
