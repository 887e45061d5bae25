"""Lenses, blur, regions, pipelines, the tracker and small rules against plain readings."""

from __future__ import annotations

import ipaddress
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenveil import schemas
from lumenveil.functions import scalars
from lumenveil.operators import audit, lenses, masking, pipelines, planner, regions, tracking
from lumenveil.plans import vision

FRAMES = "video_id bigint, frame_idx bigint, width int, height int, pixels binary"


def test_camera_angles_are_those_of_the_model():
    for lens in lenses.LENSES.values():
        for radius in (0.0, 0.1, 0.7, 1.3):
            low, high = 0.0, math.pi / 2
            for _ in range(80):  # by halving
                mid = (low + high) / 2
                low, high = (mid, high) if mid * (1 + lens.k1 * mid**2 + lens.k2 * mid**4) < radius else (low, mid)
            assert abs(lenses.straight_angle(radius, lens) - low) < 1e-9


def test_no_lens_reads_a_centred_frame_and_eyes_are_apart(spark):
    dice = np.random.default_rng(3)
    image = dice.integers(0, 256, (20, 60, 3)).astype(np.uint8)
    flat = lenses.Lens(0.5, 0.0, 0.0, 1.0)
    halves = [lenses.straightened(image[:, k : k + 30], flat, two_eyes=False) for k in (0, 30)]
    assert np.array_equal(lenses.straightened(image, flat), np.concatenate(halves, axis=1))
    frames = spark.createDataFrame([(1, 2, 60, 20, bytearray(image.tobytes()))], FRAMES)
    row = lenses.undistorted(frames, "pico4", downscale=2, crop=0.8).first()
    assert (row.width, row.height, len(row.pixels)) == (48, 16, 48 * 16 * 3)
    same = lenses.scaled(image, 60, 20)
    assert np.array_equal(same, image)


def test_blur_keeps_means_and_mirrors_edges():
    dice = np.random.default_rng(4)
    part = dice.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    size = 9
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * 45.0**2)) / np.exp(-(at**2) / (2 * 45.0**2)).sum()
    want = np.zeros(part.shape)
    mirror = lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k
    for y in range(9):
        for x in range(7):
            want[y, x] = sum(kernel[i] * kernel[j] * part[mirror(y + at[i], 9), mirror(x + at[j], 7)].astype(float) for i in range(size) for j in range(size))
    assert np.allclose(masking.blur(part, 45.0), want)
    frame = np.full((40, 40, 3), 77, np.uint8)
    masking.blurred_mosaic(frame, (-5, 3, 22, 30), 8, 45.0)
    assert (frame == 77).all()
    small = dice.integers(0, 256, (10, 10, 3)).astype(np.uint8)
    before = small.copy()
    masking.blurred_mosaic(small, (1, 1, 4, 9), 8, 45.0)
    assert np.array_equal(small, before)  # too narrow
    masking.blurred_mosaic(small, (0, 0, 8, 8), 4, 45.0)
    assert len(np.unique(small[:8, :8].reshape(-1, 3), axis=0)) <= 4


def test_components_equal_flood_fill():
    dice = np.random.default_rng(5)
    for share in (0.2, 0.4, 0.6, 0.9):
        for _ in range(25):
            marked = dice.random((dice.integers(1, 14), dice.integers(1, 14))) < share
            seen, want = np.zeros(marked.shape, bool), []
            for y, x in zip(*np.nonzero(marked)):
                if seen[y, x]:
                    continue
                todo, points = [(y, x)], []
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    points.append((a, b))
                    for c in range(max(0, a - 1), min(marked.shape[0], a + 2)):
                        for d in range(max(0, b - 1), min(marked.shape[1], b + 2)):
                            if marked[c, d] and not seen[c, d]:
                                seen[c, d] = True
                                todo.append((c, d))
                ys, xs = zip(*points)
                want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(points)))
            assert regions.components(marked) == want


def test_a_card_is_found_by_its_colour(spark):
    image = np.full((500, 900, 3), 128, np.uint8)
    image[50:120, 100:211] = (0, 200, 230)  # yellow, as wide as a card
    image[200:290, 10:30] = (0, 200, 230)  # too narrow
    frames = spark.createDataFrame([(1, 0, 900, 500, bytearray(image.tobytes()))], FRAMES)
    found = regions.card_like(regions.regions(frames, "yellow"), frames)
    (card,) = found.collect()
    assert (card.x1, card.y1, card.x2, card.y2, card.area) == (100, 50, 211, 120, 70 * 111) and card.score > 0.94
    with pytest.raises(ValueError, match="unknown colour"):
        regions.regions(frames, "mauve")


def test_one_call_masks_what_the_parts_mask(spark):
    dice = np.random.default_rng(6)
    frames = spark.createDataFrame([(1, f, 64, 48, bytearray(dice.integers(0, 256, 64 * 48 * 3).astype(np.uint8).tobytes())) for f in range(1, 9)], FRAMES)
    rows = [(1, f, k, m, 10.0 + f, 8.0, 34.0 + f, 36.0, 0.9) for f in range(1, 9) if f != 4 for k, m in enumerate("AB")]
    detections = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, det_id int, model string, x1 double, y1 double, x2 double, y2 double, score double").withColumn("eye", F.lit(None).cast("string"))
    plain = {r.frame_idx: bytes(r.pixels) for r in frames.collect()}
    for name in ("basic", "every", "plus", "segments", "card"):
        got = {r.frame_idx: bytes(r.pixels) for r in pipelines.mask(frames, detections, name).collect()}
        parts = masking.masked(frames, pipelines.named(name).boxes(detections), pipelines.named(name).kind, pipelines.named(name).how)
        assert got == {r.frame_idx: bytes(r.pixels) for r in parts.collect()}
        assert all(got[f] != plain[f] for f in (1, 2, 3, 5, 8)), name
        outside = [np.frombuffer(x[5], np.uint8).reshape(48, 64, 3)[:, 56:] for x in (got, plain)]
        assert np.array_equal(*outside)
    assert pipelines.named(" ").name == "plus"
    for wrong in ("../plus", "plus.py"):
        with pytest.raises(ValueError, match="unknown pipeline"):
            pipelines.named(wrong)
    with pytest.raises(ValueError, match="already"):
        pipelines.register(pipelines.REGISTER["plus"])


def test_addresses_as_the_standard_library_reads_them(spark):
    texts = ["10.0.0.1", "256.1.1.1", "::1", "::", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:10.1.2.3", "1:2:3:4:5:6:1.2.3.4", "12345::", "g::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1.2.3", "", "01.2.3.4", "::ffff:300.1.2.3", "fe80::1%"]

    def right(text):
        try:
            return bool(ipaddress.ip_address(text))
        except ValueError:
            return False

    got = {r.t: r.ok for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.is_ip(F.col("t")).alias("ok")).collect()}
    assert got == {t: right(t) for t in texts}


def test_a_pool_refuses_doubles(spark):
    rows = [(1, 1, "10.0.0.1=3"), (1, 2, "10.0.0.1=4"), (2, 3, "10.0.0.1=5"), (1, 4, "not-an-ip=3"), (1, 5, "10.0.0.2=17"), (1, 6, "10.0.0.3"), (1, 7, "::1=2"), (1, 8, "10.0.0.2=16")]
    got = {r.place: r.problem for r in planner.configured(spark.createDataFrame(rows, "pool int, place int, entry string")).collect()}
    assert got == {1: None, 2: "duplicate", 3: None, 4: "invalid", 5: "slots", 6: "invalid", 7: None, 8: None}


def test_reviews_are_created_with_known_columns_only(spark):
    reviews = spark.createDataFrame([(7, 1, 3, 0.1, "missed", "", None, 1.0)], schemas.REVIEWS)
    tasks = spark.createDataFrame([(1,), (2,)], "task_id bigint")
    requests = spark.createDataFrame([(2, 9, "missed", "b"), (1, 5, "false_positive", None), (3, 1, "missed", None), (1, 1, "odd", None), (None, 1, "missed", None)], "task_id bigint, frame_number int, review_type string, note string")
    got = sorted((r.id, r.task_id, r.frame_number, r.review_type, r.created_at) for r in audit.created(reviews, requests, tasks, 50.0).collect())
    assert got == [(7, 1, 3, "missed", 1.0), (8, 1, 5, "false_positive", 50.0), (9, 2, 9, "missed", 50.0)]
    with pytest.raises(ValueError, match="not to be set"):
        audit.created(reviews, requests.withColumn("id", F.lit(1)), tasks, 1.0)


# -- a second tracker, written from the rule --------------------------------------

def second_tracker(frames: list[tuple[int, list[tuple[list[float], bool]]]]) -> set[tuple]:
    """(frame, track, box, kind, since): frame by frame, all pairs tried again for every match."""
    tracks, pending, out = [], [], set()
    next_id, burst, before, asked = 1, 0, 0, False
    side = lambda b: max(b[2] - b[0], b[3] - b[1], 1)

    def gap(a, b):
        return math.dist(((a[0] + a[2]) / 2, (a[1] + a[3]) / 2), ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)) / side(a)

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = w * h if w > 0 and h > 0 else 0
        total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / total if total > 0 else 0

    for frame, boxes in frames:
        if asked or burst or frame <= 2 or frame % 5 == 1:
            asked, free_tracks, free_boxes = False, dict(enumerate(tracks)), dict(enumerate(boxes))
            while True:
                best = None
                for i in sorted(free_tracks):
                    for j in sorted(free_boxes):
                        box, sure = free_boxes[j]
                        o, g = overlap(tracks[i]["box"], box), gap(tracks[i]["box"], box)
                        if o < 0.2 and g > 1.5:
                            continue
                        worth = (2 + o if o >= 0.2 else 2 - g / 1.5) + (4 if sure else 0)
                        if best is None or worth > best[0]:
                            best = (worth, i, j)
                if best is None:
                    break
                track, (box, _) = free_tracks.pop(best[1]), free_boxes.pop(best[2])
                track["box"] = [round(0.65 * n + (1 - 0.65) * o) for n, o in zip(box, track["box"])]
                if track["missed"] and 2 <= frame - track["seen"] <= 5:
                    out.add((frame, track["id"], tuple(track["seen_box"]), "backfill", track["seen"] + 1))
                track |= {"missed": 0, "seen": frame, "seen_box": track["box"]}
            for i in free_tracks:
                tracks[i]["missed"] += 1
                asked = True
            tracks = [t for t in tracks if t["missed"] <= 3]
            for j in sorted(free_boxes):
                box, sure = [round(v) for v in free_boxes[j][0]], free_boxes[j][1]
                if not sure:
                    pending.append((frame, box))
                    asked = True
                    continue
                tracks.append({"id": next_id, "box": box, "missed": 0, "seen": frame, "seen_box": box})
                near = sorted((f, gap(b, box), b) for f, b in pending if f < frame and gap(b, box) <= 2.5)
                if near:
                    out.add((frame, next_id, tuple(near[0][2]), "backfill", near[0][0]))
                    pending = [(f, b) for f, b in pending if f < near[0][0] or gap(b, box) > 2.5]
                next_id += 1
        was = burst
        burst = max(0, burst - 1)
        if len(boxes) != before and not was:
            burst = 5
        before = len(boxes)
        pending = [(f, b) for f, b in pending if f > frame - 5]
        out |= {(frame, t["id"], tuple(t["box"]), "track", None) for t in tracks if t["missed"] <= 2}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tracks_equal_those_of_a_second_tracker(spark, seed):
    dice = random.Random(seed)
    rows, frames = [], []
    ways = [[dice.uniform(0, 900), dice.uniform(0, 500), dice.uniform(-9, 9), dice.uniform(-6, 6)] for _ in range(5)]
    for frame in range(1, 121):
        found = []
        for way in ways:
            way[0] += way[2]
            way[1] += way[3]
            if dice.random() < 0.8:
                x, y = way[0] + dice.uniform(-4, 4), way[1] + dice.uniform(-4, 4)
                found.append(([round(v, 2) for v in (x, y, x + 50, y + 64)], dice.random() < 0.7))
        found.sort(key=lambda b: (b[0], "AB" if b[1] else "S"))
        frames.append((frame, found))
        rows += [(1, frame, *box, "AB" if sure else "S") for box, sure in found] or [(1, frame, None, None, None, None, "AB")]
    fused = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, source string")
    got = {(r.frame_idx, r.track_id, (r.x1, r.y1, r.x2, r.y2), r.kind, r.since_frame) for r in tracking.track(fused).collect()}
    want = second_tracker(frames)
    assert got == want and {k for *_, k, _ in want} == {"track", "backfill"}


def test_detectors_are_known_by_name(spark):
    from lumenveil.operators import detectors

    raw = spark.createDataFrame([(1, 2, 640, 640, k, v) for k, v in enumerate([[10.0, 20.0, 110.0, 220.0, 0.9], [12.0, 22.0, 112.0, 222.0, 0.8], [300.0, 300.0, 400.0, 700.0, 0.5], [1.0, 1.0, 9.0, 9.0, 0.1]])], "video_id bigint, frame_idx bigint, width int, height int, index int, values array<double>")
    got = sorted((r.det_id, r.x1, r.y2, r.model) for r in detectors.detections(raw, "boxes").collect())
    assert got == [(0, 10.0, 220.0, "boxes"), (2, 300.0, 640.0, "boxes")]
    with pytest.raises(ValueError, match="unknown detector"):
        detectors.decoded(raw, "other")
    with pytest.raises(ValueError, match="already"):
        detectors.register(detectors.REGISTER["boxes"])


def test_colours_of_frames_in_one_pass(spark):
    pixels = np.random.default_rng(3).integers(0, 256, (4, 9, 12, 3), dtype=np.uint8)
    pixels[:, 2:5, 3:8] = (255, 255, 255)
    frames = spark.createDataFrame([(1, k, 12, 9, bytearray(p.tobytes())) for k, p in enumerate(pixels)], "video_id long, frame_idx long, width int, height int, pixels binary")
    colours = ["white", "black", "red", "white"]
    together = regions.regions_of(frames, colours)
    plain = [(1, f, c, k, *b) for f, p in enumerate(pixels) for c in set(colours) for k, b in enumerate(regions.components(regions.mask(p, c)))]
    assert sorted(map(tuple, together.collect())) == sorted(plain) and plain
    assert together._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_frames_of_several_sizes_are_straightened_as_alone(spark):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for h, w in [(12, 16), (8, 20), (12, 16), (9, 10), (8, 20)]]
    frames = spark.createDataFrame([(k, 0, i.shape[1], i.shape[0], bytearray(i.tobytes())) for k, i in enumerate(images)], "video_id long, frame_idx long, width int, height int, pixels binary").coalesce(1)
    got = {r.video_id: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3) for r in lenses.undistorted(frames, "pico4", crop=0.8).collect()}
    for k, image in enumerate(images):
        assert np.array_equal(got[k], lenses.straightened(image, lenses.LENSES["pico4"], 2, 0.8))


def test_pixel_queries_make_the_frames_of_their_sql(duck):
    keys = np.array([1, 4, 97, 5_400_000])
    given = ", ".join(f"({k}::BIGINT)" for k in keys)
    want = duck.execute(f"SELECT c, f, y, x, {vision._VALUE} FROM (VALUES {given}) k(c), range(2) a(f), range({vision._W}) b(x), range({vision._H}) d(y) ORDER BY 1, 2, 3, 4").fetchall()
    assert vision._textured(keys)[..., 0].ravel().tolist() == [r[-1] for r in want]
    want = duck.execute(f"SELECT c, y, x, ch, {vision._COLOURED} FROM (VALUES {given}) k(c), range({vision._CW}) b(x), range({vision._CH}) d(y), range(3) e(ch) ORDER BY 1, 2, 3, 4").fetchall()
    assert vision._patches(keys).ravel().tolist() == [r[-1] for r in want]
