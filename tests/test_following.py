"""Template search, motion, key frames and segments against plain readings, and streams against batch."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenveil.operators import keyframes, leases, motion, segments, templates, timeline, tracking
from lumenveil.plans import vision
from lumenveil.streaming import expiry
from lumenveil.streaming import queries as streams

FRAMES = "video_id bigint, frame_idx bigint, width int, height int, pixels binary"
BOXES = "video_id bigint, frame_idx bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double"


# -- templates ------------------------------------------------------------

def slow_responses(region, template):
    th, tw = template.shape
    out = np.zeros((region.shape[0] - th + 1, region.shape[1] - tw + 1))
    t = template - template.mean()
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            w = region[y : y + th, x : x + tw] - region[y : y + th, x : x + tw].mean()
            size = np.sqrt((t * t).sum() * (w * w).sum())
            out[y, x] = (t * w).sum() / size if size > 1e-9 else 0
    return out


def test_responses_equal_plain_correlation():
    dice = np.random.default_rng(1)
    for th, tw, h, w in [(8, 8, 8, 8), (8, 11, 20, 31), (15, 9, 40, 22)]:
        region, template = dice.integers(0, 256, (h, w)).astype(np.uint8), dice.integers(0, 256, (th, tw)).astype(np.uint8)
        region[: th // 2 + 1] = 7  # partly flat
        assert np.allclose(templates.responses(region, template), slow_responses(region, template), atol=1e-9)
    assert (templates.responses(np.full((20, 20), 9, np.uint8), np.full((8, 8), 9, np.uint8)) == 0).all()


def _frame(image: np.ndarray) -> bytes:
    return np.repeat(image[:, :, None], 3, axis=2).tobytes()


@pytest.mark.parametrize("size,box,shift", [((120, 90), (30, 20, 60, 52), (17, -9)), ((700, 300), (300, 100, 380, 190), (40, 22))])
def test_a_moved_patch_is_found(spark, size, box, shift):
    dice = np.random.default_rng(2)
    w, h = size
    grain = 4 if w < 480 else 16  # large regions are halved
    coarse = dice.integers(0, 256, (h // grain + 2, w // grain + 2))
    first = np.kron(coarse, np.ones((grain, grain)))[:h, :w].astype(np.uint8)
    second = np.roll(first, (shift[1], shift[0]), axis=(0, 1))
    other = dice.integers(0, 256, (h, w)).astype(np.uint8)
    frames = spark.createDataFrame([(1, 5, w, h, bytearray(_frame(first))), (1, 6, w, h, bytearray(_frame(second))), (2, 5, w, h, bytearray(_frame(first))), (2, 6, w, h, bytearray(_frame(other)))], FRAMES)
    given = spark.createDataFrame([(v, 5, 3, *map(float, box)) for v in (1, 2, 9)] + [(1, 5, 4, 1.0, 1.0, 8.0, 8.0)], BOXES)
    hits = {(r.video_id, r.track_id): r for r in templates.search(frames, given).collect()}
    assert set(hits) == {(1, 3), (2, 3)} and not hits[2, 3].found
    hit = hits[1, 3]
    assert hit.found and hit.frame_idx == 6
    assert abs(hit.x - (box[0] + box[2]) / 2 - shift[0]) <= 1.5 and abs(hit.y - (box[1] + box[3]) / 2 - shift[1]) <= 1.5
    (moved,) = templates.carried(given, templates.search(frames, given)).collect()
    assert (moved.video_id, moved.frame_idx) == (1, 6) and abs(moved.x1 - box[0] - shift[0]) <= 2


def test_resized_keeps_means():
    image = np.arange(35 * 21).reshape(35, 21) % 251
    assert np.array_equal(templates.resized(image[:34, :20].astype(np.uint8), 10, 17), np.rint(image[:34, :20].reshape(17, 2, 10, 2).mean(axis=(1, 3))))
    assert templates.resized(image.astype(np.uint8), 10, 17).shape == (17, 10)


# -- motion -----------------------------------------------------------------

def test_consensus_of_many_points_survives_strays(spark):
    dice = np.random.default_rng(4)
    p = dice.uniform(0, 100, (150, 2))
    factor, shift = 1.03 * np.exp(0.05j), complex(4, -3)
    q = factor * (p[:, 0] + 1j * p[:, 1]) + shift
    rows = [(1, 0, 1, k, *map(float, p[k]), float(q[k].real), float(q[k].imag), *map(float, p[k])) for k in range(150)]
    for k in range(0, 60):  # two fifths astray
        rows[k] = (*rows[k][:6], rows[k][6] + float(dice.uniform(5, 40)), rows[k][7] - float(dice.uniform(5, 40)), *rows[k][8:])
    rows += [(2, 0, 1, k, 5.0, 5.0, 6.0, 7.0, 5.0, 5.0) for k in range(6)]  # all in one place
    rows += [(3, 0, 1, k, 5.0 * k, 5.0, 5.0 * k + 90, 7.0, 5.0 * k, 5.0) for k in range(6)]  # too far
    rows += [(4, 0, 1, k, 5.0 * k, 5.0, None if k < 3 else 5.0 * k, None if k < 3 else 5.0, 5.0 * k + (9 if k == 5 else 0), 5.0) for k in range(6)]  # too few
    points = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, track_id bigint, place int, px double, py double, qx double, qy double, rx double, ry double")
    given = spark.createDataFrame([(v, 0, 1, 0.0, 0.0, 100.0, 100.0) for v in range(1, 6)], BOXES)
    got = {r.video_id: r for r in motion.moved_boxes(given, points).collect()}
    assert set(got) == {1, 2}
    corners = factor * np.array([0, 100, 100j, 100 + 100j]) + shift
    assert np.allclose([got[1].x1, got[1].y1, got[1].x2, got[1].y2], [corners.real.min(), corners.imag.min(), corners.real.max(), corners.imag.max()], atol=1e-6)
    assert (got[1].kind, got[1].agreeing >= 90) == ("similarity", True)
    assert (got[2].kind, got[2].x1, got[2].y2) == ("shift", 1.0, 102.0)


# -- key frames --------------------------------------------------------------

def evidence_rows(videos: int = 3, frames: int = 80) -> list[tuple]:
    dice = random.Random(6)
    rows = []
    for video in range(videos):
        for frame in range(1, frames + 1):
            rows.append((video, frame, *[None] * 10))
            for k in range(dice.choice([0, 0, 1, 2])):
                x = dice.randrange(100)
                rows.append((video, frame, "D", None, x, 10, x + 40, 60, dice.choice([0.5, 0.5, 0.7]), None, None, dice.randrange(25)))
            for k in range(dice.choice([0, 1, 2])):
                rows.append((video, frame, "F", k, None, None, None, None, None, dice.uniform(-30, 30), dice.uniform(-5, 5), dice.randrange(25)))
    return rows


@pytest.mark.parametrize("machine,config", [(keyframes.Targets, keyframes.Config(7, 2, cold_start=2)), (keyframes.Single, keyframes.Config(6)), (keyframes.Single, keyframes.Config(6, on_miss="hold"))])
def test_keyframe_stream_equals_batch(spark, tmp_path, machine, config):
    rows = evidence_rows()
    batch = keyframes.followed(spark.createDataFrame(rows, keyframes.EVIDENCE), config, machine)
    want = sorted(map(str, batch.collect()))
    assert {"DET", "TRK"} <= {r.source for r in batch.collect()}
    source, done = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    stream = streams.keyframe_stream(spark.readStream.schema(keyframes.EVIDENCE).parquet(str(source)), config, machine)
    for low, high in [(0, 13), (13, 14), (14, 1000)]:
        spark.createDataFrame([r for r in rows if low < r[1] <= high], keyframes.EVIDENCE).coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.format("parquet").outputMode("append").option("path", str(done)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    names = [f.split()[0] for f in keyframes.OUTPUT.split(", ")]
    assert sorted(map(str, spark.read.parquet(str(done)).select(names).collect())) == want


def test_a_target_is_held_for_its_grace():
    state = keyframes.Targets(keyframes.Config(interval=2, grace=1))
    box = {"x1": 1, "y1": 2, "x2": 30, "y2": 40}
    told = [state.step(f, [box] if f == 1 else [], {0: {"points": 9 if f == 2 else 3, "dx": -1.5, "dy": 1.9}}) for f in range(1, 7)]
    assert [[x[2] for x in t] for t in told] == [["DET"], ["TRK"], ["GRC"], ["TRK"], [], []]
    assert told[1][0][1] == [0, 3, 28, 41] and told[3][0][1] == [0, 3, 28, 41]


# -- segments ------------------------------------------------------------------

def moving(frames: int, videos: int = 1) -> list[tuple]:
    """Three objects far apart on slow ways, one of which is gone for a while."""
    rows = []
    for video in range(videos):
        for frame in range(1, frames + 1):
            for k in range(3):
                if k == 2 and frame // 700 % 2:
                    continue
                x, y = 100 + 400 * k + frame // 9 % 50, 100 + (frame // 5 % 30)
                rows.append((video, frame, float(x), float(y), float(x + 60), float(y + 80), "AB"))
    return rows


FUSED = "video_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, source string"


def named(rows, key) -> set[tuple]:
    """Rows with tracks named by where they first appear."""
    first: dict = {}
    out = set()
    for r in sorted(rows, key=lambda r: (r.video_id, r.frame_idx, r.x1, r.kind)):
        first.setdefault((r.video_id, *key(r)), (r.frame_idx, r.x1))
        out.add((r.video_id, r.frame_idx, first[r.video_id, *key(r)], r.x1, r.y1, r.x2, r.y2, r.kind, r.since_frame))
    return out


@pytest.mark.parametrize("length", [300, 1000])
def test_segments_give_the_tracks_of_one_pass(spark, length):
    fused = spark.createDataFrame(moving(3000, 2), FUSED)
    whole = tracking.track(fused).collect()
    parts = segments.track(fused, length=length).collect()
    assert named(parts, lambda r: (r.track_segment, r.track_id)) == named(whole, lambda r: (r.track_id,))
    assert len({(r.video_id, r.track_segment, r.track_id) for r in parts}) == len({(r.video_id, r.track_id) for r in whole})


def test_a_long_video_is_spread(spark):
    fused = spark.range(1, 200_001).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame_idx"), *(F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (10.0, 10.0, 60.0, 80.0))), F.lit("AB").alias("source"))
    dealt = segments.dealt(fused, 1500, 10).groupBy("segment").agg(F.count("*").alias("n"))
    assert dealt.agg(F.max("n")).first()[0] <= 1510 and dealt.count() == 134
    tracks = segments.track(fused.filter("frame_idx <= 30000")).select("track_segment", "track_id").distinct().collect()
    assert len(tracks) == 1


def test_segments_of_an_empty_table(spark):
    assert segments.track(spark.createDataFrame([], FUSED)).count() == 0


# -- state that ends by itself ---------------------------------------------------

def run_stream(stream, source, tmp_path, parts, schema, spark) -> list:
    done = str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.format("parquet").outputMode("append").option("path", done).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(done).collect()


def test_silent_workers_of_a_stream_equal_batch(spark, tmp_path):
    schema, source = "worker_id string, at double", tmp_path / "in"
    source.mkdir()
    parts = [[("a", 1000.0), ("b", 1000.0)], [("a", 1020.0), ("c", 1030.0)], [("a", 1200.0)], [("a", 1210.0), ("b", 1215.0)], [("z", 5000.0)], [("z", 5001.0)]]
    stream = expiry.silences(spark.readStream.schema(schema).parquet(str(source)), 60.0)
    got = sorted((r.worker_id, r.last_seen, r.offline_at) for r in run_stream(stream, source, tmp_path, parts, schema, spark))
    beats = spark.createDataFrame([r for p in parts for r in p], schema)
    want = sorted((r.worker_id, r.last_seen, r.offline_at) for r in leases.silences(beats, 5001.0, 60.0).collect())
    assert got == want and len(want) == 5


def test_leases_of_a_stream_equal_batch_and_expire(spark, tmp_path):
    schema, source = "task_id string, at double, reviewer string, action string", tmp_path / "in"
    source.mkdir()
    parts = [
        [("t", 1000.0, "a", "claim"), ("t", 1010.0, "b", "claim"), ("u", 1000.0, "b", "claim")], [("t", 1200.0, "a", "renew"), ("t", 1201.0, "b", "renew")],
        [("t", 1499.0, "b", "claim"), ("t", 1500.0, "b", "claim")], [("t", 1510.0, "b", "release"), ("t", 1511.0, None, "claim"), ("u", 1512.0, "a", "steal")], [("z", 9000.0, "a", "claim")], [("z", 9001.0, "a", "renew")],
    ]
    stream = expiry.lease_history(spark.readStream.schema(schema).parquet(str(source)))
    got = run_stream(stream, source, tmp_path, parts, schema, spark)
    want = leases.history(spark.createDataFrame([r for p in parts for r in p], schema))
    plain = lambda rows: sorted(str((r.task_id, r.at, r.reviewer, r.action, r.accepted, r.owner, r.until)) for r in rows)
    assert plain(r for r in got if r.action != "expired") == plain(want.collect())
    assert sorted((r.task_id, r.at, r.reviewer) for r in got if r.action == "expired") == [("t", 1500.0, "a"), ("u", 1300.0, "b")]
    outcome = {(r.task_id, r.at, r.reviewer): r.accepted for r in want.collect()}
    assert [outcome[k] for k in (("t", 1010.0, "b"), ("t", 1200.0, "a"), ("t", 1499.0, "b"), ("t", 1500.0, "b"), ("t", 1511.0, None))] == [False, True, False, True, False]


def test_late_frames_are_filled_as_in_batch(spark, tmp_path):
    schema, source = "video_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double", tmp_path / "in"
    source.mkdir()
    dice = random.Random(9)
    rows = []
    for video in range(2):
        for frame in range(1, 121):
            x = dice.uniform(0, 50) if dice.random() < 0.5 else None
            rows.append((video, frame, x, *([x and v for v in (2.5, x + 40, 61.0)] if x is not None else [None] * 3)))
    order = sorted(rows, key=lambda r: r[1] + dice.uniform(0, 8))
    cuts = [0, 37, 38, 90, 160, len(order)]
    parts = [order[a:b] for a, b in zip(cuts, cuts[1:])] + [[(v, 1000, None, None, None, None) for v in range(2)]]
    stream = expiry.filled(spark.readStream.schema(schema).parquet(str(source)), 4, 10)
    got = run_stream(stream, source, tmp_path, parts, schema, spark)
    want = timeline.filled(spark.createDataFrame(rows, schema), 4).collect()
    plain = lambda rows: sorted((r.video_id, r.frame_idx, r.x1, r.y1, r.x2, r.y2, r.source) for r in rows)
    assert plain(got) == plain(want) and {r.source for r in want} == {"seen", "backfill"}


def test_bad_rows_go_to_quarantine_and_repeats_are_known(spark, tmp_path):
    source, target, bad = tmp_path / "in", str(tmp_path / "tasks"), str(tmp_path / "bad")
    source.mkdir()
    (source / "1.json").write_text('{"task_id": "a", "n": 1}\n{"task_id": "b", "n"\n{"n": 3}\n{"task_id": "a", "n": 4}\n')
    start = lambda every=None: streams.ingest(streams.listed_stream(spark, str(source), "task_id string, n int", 1), target, str(tmp_path / "check"), quarantine=bad, every=every)
    start().awaitTermination()
    (source / "2.json").write_text('{"task_id": "b", "n": 2}\n{"task_id": "a", "n": 9}\nnothing\n')
    (source / "3.json").write_text('{"task_id": "c", "n": 2}\n{"task_id": "b", "n": 2}\n')
    query = start("100 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.task_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
    refused = spark.read.json(bad).collect()
    assert len(refused) == 3 and len({r.batch for r in refused}) == 2  # files of one time come in any order


def test_two_threads_keep_their_tables(spark):
    import threading

    from lumenveil.session import materialize, temporary_tables

    gate, found = threading.Barrier(2, timeout=60), {}

    def work(name: str) -> None:
        with temporary_tables(spark):
            first = materialize(spark.range(5), name)
            gate.wait()
            found[name] = materialize(first.selectExpr("id + 1 as id"), name)
        gate.wait()
        found[name] = found[name].count()

    threads = [threading.Thread(target=work, args=(n,)) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {"one": 5, "two": 5}


def test_regions_of_a_size_are_searched_together():
    rng = np.random.default_rng(5)
    large, small = rng.integers(0, 256, (6, 30, 40), dtype=np.uint8), rng.integers(0, 256, (6, 9, 11), dtype=np.uint8)
    small[2], large[3] = 7, 9
    together = templates.located(large, small)
    assert np.allclose(together, [templates.located(a[None], b[None])[0] for a, b in zip(large, small)], atol=1e-12)
    for (x, y, peak, _), a, b in zip(together, large, small):
        plain = slow_responses(a, b)
        row, column = divmod(int(templates.responses(a, b).argmax()), plain.shape[1])
        assert (x, y) == (column + 5.5, row + 4.5) and np.isclose(peak, plain.max(), atol=1e-9)


def test_chains_are_never_broadcast(spark, monkeypatch):
    plans = []
    write = segments.materialize

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(segments, "materialize", written)
    links = spark.createDataFrame([(1, s, 5, 5) for s in range(6)], "video_id long, segment long, track_id int, next_id int")
    found = {(r.segment, r.first_segment) for r in segments.chains(links).collect()}
    assert found == {(s + 1, 0) for s in range(6)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_only_boxes_in_reach_are_weighed(monkeypatch):
    """A box outside a track's gate that does not meet it is passed over."""
    weighed = []
    whole = tracking.Tracks._affinity
    monkeypatch.setattr(tracking.Tracks, "_affinity", lambda self, track, found: weighed.append(found["box"][0]) or whole(self, track, found))
    state = tracking.Tracks()
    state.step(1, [{"box": [0, 0, 10, 10], "confirmed": True}])
    state.step(2, [{"box": [x, 0, x + 10, 10], "confirmed": True} for x in (3, 15, 16, 900)])
    assert weighed == [3, 15]


def test_frames_are_never_broadcast(spark, sf_dir):
    """Spark takes frames from Python for smaller than they are; they are merged with what is asked of them, as grey bytes."""
    hits = vision.template_search(spark, sf_dir)
    assert hits.count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    planned = hits._jdf.queryExecution()
    hits.collect()
    for plan in (planned.sparkPlan().toString(), planned.executedPlan().toString()):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    frames = vision._textures(spark, sf_dir).limit(3)
    for row in templates.greyed(frames).join(frames.withColumnRenamed("pixels", "bytes"), ["video_id", "frame_idx"]).collect():
        assert bytes(row.pixels) == bytes(row.bytes)[::3]  # its channels are equal


def test_odd_pixels_matter_only_where_they_are_wanted(spark):
    image = np.random.default_rng(3).integers(0, 256, (60, 80)).astype(np.uint8)
    good = [(1, f, 80, 60, bytearray(_frame(image))) for f in (5, 6)]
    odd = [(1, 7, 80, 60, None), (1, 8, 80, 60, bytearray(4801)), (1, 9, 80, 60, bytearray(4800))]
    frames = spark.createDataFrame(good + odd, FRAMES)
    given = spark.createDataFrame([(1, 5, 3, 20.0, 10.0, 50.0, 40.0)], BOXES)
    (hit,) = templates.search(frames, given).collect()
    assert hit.found and (hit.frame_idx, hit.x, hit.y) == (6, 35.0, 25.0)
    for after in (2, 3, 4):
        with pytest.raises(Exception, match="pixels are not 3 bytes"):
            templates.search(frames, given, after).collect()
