"""Structured Streaming: ingestion, tracking and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenveil.operators import keyframes
from lumenveil.operators.tracking import OUTPUT, SIDES, TrackConfig, Tracks, step_rows


def track_stream(fused: DataFrame, config: TrackConfig | None = None) -> DataFrame:
    """Streaming twin of ``tracking.track``; frames must come in order per video.

    A frame's boxes must not be split over micro-batches.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = Tracks.from_json(held.get[0], config) if held.exists else Tracks(config)
        rows = pd.concat(list(parts)).sort_values(["frame_idx", *SIDES, "source"], na_position="first")
        out = []
        for frame, some in rows.groupby("frame_idx", sort=True):
            boxes = some.astype(object).where(some.notna(), None).to_dict("records")
            out += step_rows(state, key[0], int(frame), boxes)
        held.update((state.to_json(),))
        names = [f.split()[0] for f in OUTPUT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"since_frame": "Int64"})

    return fused.select("video_id", "frame_idx", *SIDES, "source").groupBy("video_id").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def completions_per_hour(tasks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Terminal tasks per hour of a stream with ``finished`` timestamps."""
    counted = tasks.withWatermark("finished", late).groupBy(F.window("finished", "1 hour"), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("hour"), "status", "n")


def keyframe_stream(evidence: DataFrame, config: keyframes.Config, machine: Callable[[keyframes.Config], keyframes.Targets | keyframes.Single] = keyframes.Targets) -> DataFrame:
    """Streaming twin of ``keyframes.followed``; frames must come in order per video.

    A frame's evidence must not be split over micro-batches.
    """
    names = [f.split()[0] for f in keyframes.EVIDENCE.split(", ")]
    ascending = ["kind", "score", *keyframes.SIDES, "target"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = machine(config)
        if held.exists:
            state.load(held.get[0])
        rows = pd.concat(list(parts))
        rows = rows.assign(score=-rows["score"]).sort_values(["frame_idx", *ascending]).assign(score=rows["score"])
        out = []
        for frame, some in rows.groupby("frame_idx", sort=True):
            out += keyframes.step_rows(state, key[0], int(frame), some.astype(object).where(some.notna(), None).to_dict("records"))
        held.update((state.to_json(),))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in keyframes.OUTPUT.split(", ")])

    return evidence.select(*names).groupBy("video_id").applyInPandasWithState(run, keyframes.OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def listed_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON rows of a folder as a stream, at most so many files a batch; what cannot be read is kept in ``_bad``."""
    reader = spark.readStream.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE")
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


#: Parts of an ingested table by hash of its key; a batch looks up only the parts that it has keys of.
BUCKETS = 64


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "task_id", *, every: str | None = None, quarantine: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Append rows of new keys to the table at ``target``, batch by batch.

    every: the pause between batches (such as ``10 seconds``); without it all that is
    there is read and the query ends. Rows without a key or with a text in ``_bad``
    go to ``quarantine``, one folder a batch, or are left out if there is none; they
    never stop the query. The table is partitioned by ``bucket``, a hash of the key.
    A batch that is run again writes what it has not written yet.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        bad = F.col(key).isNull() | (F.col("_bad").isNotNull() if "_bad" in rows.columns else F.lit(False))
        rows.persist()
        try:
            if quarantine is not None and not (refused := rows.filter(bad)).isEmpty():
                refused.write.mode("overwrite").json(f"{quarantine}/batch={number}")
            new = rows.filter(~bad).drop("_bad").dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # no more than buckets
            if not touched:
                return
            if _is_table(spark, target):
                known = spark.read.parquet(target).filter(F.col("bucket").isin(touched)).select("bucket", key)
                new = new.join(known, ["bucket", key], "left_anti")
            new.write.mode("append").partitionBy("bucket").parquet(target)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _is_table(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a part of a partitioned table."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(folder) and any(f.isDirectory() and f.getPath().getName().startswith("bucket=") for f in files.listStatus(folder))
