"""Discovery, idempotent ingestion, table versions, exports and streams."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lumenveil.functions import scalars
from lumenveil.sources import discovery, sinks
from lumenveil.streaming import queries as streams

LISTING = "key string, size bigint, etag string"


def test_listing_reads_no_contents(spark, tmp_path):
    for name in ("nested/clip.MOV", "same.mp4", "masked_external.mp4", "masked/masked_same.mp4", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    found = discovery.media(discovery.listed(spark, str(tmp_path)), suffixes=scalars.BATCH_SUFFIXES)
    assert sorted(r.key.rsplit("/", 1)[1] for r in found.collect()) == ["clip.MOV", "same.mp4"]


def test_candidates_are_the_same_on_a_second_scan(spark):
    listing = spark.createDataFrame([("source/inbox/a.mp4", 123, "etag-a"), ("source/inbox/readme.txt", 3, "t"), ("source/inbox/b.mp4", 0, "b"), ("source/inbox/c.mov", 9, None), ("source/inbox/d.mp4", 5, "d")], LISTING)
    outputs = spark.createDataFrame([("outputs/masked_d.mp4", 2048)], "key string, size bigint")
    first = discovery.candidates(listing, outputs)
    rows = {r.key: r for r in first.collect()}
    assert set(rows) == {"source/inbox/a.mp4", "source/inbox/c.mov"} and rows["source/inbox/a.mp4"].output_key == "outputs/masked_a.mp4"
    assert rows["source/inbox/a.mp4"].task_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "s3://media/source/inbox/a.mp4?version=etag-a"))
    assert discovery.ingested(discovery.candidates(listing, outputs), first).count() == 0
    assert discovery.candidates(listing, outputs, least_output=4096).count() == 3


def test_uploads_are_complete_without_gaps(spark):
    parts = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("gap", 1, "a"), ("gap", 3, "b"), ("tag", 1, None), ("twice", 1, "a"), ("twice", 1, "a")], "upload_id string, part_number int, etag string")
    assert {r.upload_id: r.complete for r in discovery.complete_upload(parts).collect()} == {"u": True, "gap": False, "tag": False, "twice": False}


def test_versions_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_version(spark.range(3), path, 1)
    sinks.write_version(spark.range(5).withColumnRenamed("id", "n"), path, 2)
    assert sinks.read_latest(spark, path).filter("n is not null").count() == 5
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_version(spark.range(1), path, 2)


def test_stream_ingestion_is_idempotent(spark, tmp_path):
    source, target, check = tmp_path / "in", str(tmp_path / "tasks"), str(tmp_path / "check")
    schema = "task_id string, n int"
    for rows in ([("a", 1), ("a", 1), ("b", 2)], [("b", 2), ("c", 3)], []):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        streams.ingest(spark.readStream.schema(schema).json(str(source)), target, check).awaitTermination()
    assert sorted(r.task_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("2024-01-01 00:10:00", "completed"), ("2024-01-01 00:50:00", "completed"), ("2024-01-01 01:05:00", "failed"), ("2024-01-01 09:00:00", "completed")]
    spark.createDataFrame(rows, "finished string, status string").selectExpr("cast(finished as timestamp) as finished", "status").coalesce(1).write.parquet(source)
    counted = streams.completions_per_hour(spark.readStream.schema("finished timestamp, status string").parquet(source))
    out = str(tmp_path / "out")
    counted.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(str(r.hour), r.status, r.n) for r in spark.read.parquet(out).collect()} == {("2024-01-01 00:00:00", "completed", 2), ("2024-01-01 01:00:00", "failed", 1)}


def test_export(spark, sf_dir, tmp_path):
    from lumenveil.plans.fixtures import view

    tasks = view(spark, sf_dir, "tasks")
    sinks.export_csv(tasks, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == tasks.count() and back.columns == sinks.export_rows(tasks).columns


def test_upserts_and_event_log(spark, tmp_path):
    path, log = f"file://{tmp_path}/t", f"file://{tmp_path}/log"
    sinks.write_version(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int"), path, 9)
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "f", 1)], "k int, v string, at int")
    sinks.upsert_version(changes, path, 10, "k", "at")
    assert sorted(map(tuple, sinks.read_latest(spark, path).collect())) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    for event in ("start", "stop"):
        row = spark.range(1).select(scalars.event_line(F.lit(1.5), F.lit(event), F.lit("h"), b=F.lit('x "y" é'), a=F.lit(None).cast("int")).alias("value"))
        sinks.append_events(row, log)
    want = '1970-01-01T00:00:01.500000+00:00 event={} ip=h a=null b="x \\"y\\" é"'
    assert sorted(r.value for r in spark.read.text(log).collect()) == [want.format("start"), want.format("stop")]


def test_frame_folder_round_trip(spark, tmp_path):
    import random

    from lumenveil.sources import frames

    frames.register(spark)
    dice = random.Random(5)
    rows = [(n, "", 3 + n % 2, 2, bytearray(dice.randbytes((3 + n % 2) * 6))) for n in (1, 2, 9, 10, 11, 99_999, 100_000, 123_456)]
    folder = str(tmp_path / "frames")
    given = spark.createDataFrame(rows, frames.SCHEMA)
    for _ in range(2):  # written again, the files are replaced
        given.repartition(3).write.format("frames").mode("append").save(folder)
    (tmp_path / "frames" / "notes.txt").write_text("no frame")
    read = spark.read.format("frames").option("files", 3).load(folder)
    got = [(r.frame_idx, r.width, r.height, bytes(r.pixels)) for r in read.collect()]
    assert got == [(n, w, h, bytes(p)) for n, _, w, h, p in rows]  # partitions are in the order of the numbers
    assert frames.numbered(folder, 9, 11) == [(n, f"{folder}/frame_{n:05d}.ppm") for n in (9, 10, 11)]


def test_frames_out_of_range_are_not_opened(spark, tmp_path):
    from lumenveil.sources import frames

    frames.register(spark)
    for n in range(1, 9):
        (tmp_path / f"clip_{n}.ppm").write_bytes(frames.encoded(1, 1, bytes([n, 2, 3])) if 3 <= n <= 5 else b"broken")
    read = spark.read.format("frames").load(str(tmp_path))
    assert [(r.frame_idx, bytes(r.pixels)) for r in frames.between(spark, str(tmp_path), 3, 5).collect()] == [(n, bytes([n, 2, 3])) for n in (3, 4, 5)]
    assert [r.frame_idx for r in spark.read.format("frames").option("last", 4).option("first", 4).load(str(tmp_path)).collect()] == [4]
    with pytest.raises(Exception, match="clip_1.ppm is no binary PPM"):
        read.collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("frames").load(str(tmp_path / "none")).count() == 0


def test_previews_are_made_once(spark, tmp_path):
    from lumenveil.sources import previews

    path, schema = str(tmp_path / "previews"), "task_id string, output_object_key string, output_sha256 string, finished_at double, source_object_key string, source_sha256 string, created_at double"
    made = []

    def make(videos):
        made.extend(sorted(r.task_id for r in videos.collect()))
        return videos.filter("task_id <> 'empty'").select("task_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("nth"), F.col("fingerprint").alias("of"))

    def videos(sha: str):
        rows = [("a", "out/a", sha, 1.0, "in/a", None, 0.0), ("b", "", None, None, "in/b", "s", 0.5), ("empty", None, None, None, None, None, None), (None, "x", "y", 1.0, "z", "s", 0.0)]
        given = spark.createDataFrame(rows, schema)
        return given.select("task_id", previews.fingerprint(given).alias("fingerprint"))

    assert previews.refresh(videos("1"), path, make, 10.0) == 3
    assert previews.refresh(videos("1"), path, make, 11.0) == 0
    assert previews.refresh(videos("2"), path, make, 12.0) == 1
    assert made == ["a", "b", "empty", "a"]
    got = sorted((r.task_id, r.nth, r.of) for r in previews.current(spark, path).collect())
    assert got == [("a", 1, "output|out/a|2|1.0"), ("a", 2, "output|out/a|2|1.0"), ("b", 1, "input|in/b|s|0.5"), ("b", 2, "input|in/b|s|0.5")]
    assert {r.task_id: r.frames for r in previews.manifest(spark, path).collect()} == {"a": 2, "b": 2, "empty": 0}


def test_a_keyed_table_rewrites_only_what_changes(spark, tmp_path):
    from pathlib import Path

    path, schema = str(tmp_path / "keyed"), "id long, n int, at double"
    rows = {k: (k, k % 7, 0.0) for k in range(200)}
    first = sinks.upsert_keyed(spark.createDataFrame(list(rows.values()), schema), path, 1, "id", "at", buckets=16)
    assert len(first) == 16
    changes = [(5, 100, 1.0), (5, 101, 2.0), (5, 99, 0.5), (1000, 1, 1.0), (None, 3, 1.0)]
    touched = sinks.upsert_keyed(spark.createDataFrame(changes, schema), path, 2, "id", "at", buckets=16)
    assert 1 <= len(touched) <= 2
    rows |= {5: (5, 101, 2.0), 1000: (1000, 1, 1.0)}
    read = lambda: sorted(map(tuple, sinks.read_keyed(spark, path, schema, 16).collect()))
    assert read() == sorted(rows.values())
    assert sorted(p.name for p in Path(f"{path}/rows/v=2").glob("bucket=*")) == sorted(f"bucket={b}" for b in touched)
    assert sinks.upsert_keyed(spark.createDataFrame([(None, 1, 1.0)], schema), path, 3, "id", "at", buckets=16) == []
    with pytest.raises(ValueError, match="not newer"):
        sinks.upsert_keyed(spark.createDataFrame(changes, schema), path, 2, "id", "at", buckets=16)
    # a version of which only the rows were written is not seen, and may be written again
    spark.createDataFrame([(7, 7, 7.0, 3)], f"{schema}, bucket int").write.partitionBy("bucket").parquet(f"{path}/rows/v=3")
    assert read() == sorted(rows.values())
    sinks.upsert_keyed(spark.createDataFrame([(6, 0, 3.0)], schema), path, 3, "id", "at", buckets=16)
    assert read() == sorted((rows | {6: (6, 0, 3.0)}).values())
