"""Previews of videos that are made once: a manifest beside the data tells what is there.

A video's fingerprint changes with its file. A refresh makes previews only of videos
whose fingerprint is not in the manifest, writes them as one run and then names the
run in the manifest. A run that failed before that leaves rows that nobody names; a
refresh that is repeated writes nothing.

Defined cases: rows without a task id are left out; of equal task ids the greatest
fingerprint counts; a video without previews is in the manifest with number 0 and is
not tried again until it changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "task_id string, fingerprint string, run string, frames bigint, made_at double"


def fingerprint(tasks: DataFrame) -> Column:
    """``file|key|hash|time`` of the output, or of the input where there is no output yet."""
    out = F.col("output_object_key") != ""
    of = lambda o, i: F.coalesce(F.when(out, F.col(o)).otherwise(F.col(i)).cast("string"), F.lit(""))
    return F.concat_ws("|", F.when(out, "output").otherwise("input"), of("output_object_key", "source_object_key"), of("output_sha256", "source_sha256"), of("finished_at", "created_at"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of every video; see MANIFEST."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], MANIFEST)
    entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return entries.groupBy("task_id").agg(F.max_by(F.struct("fingerprint", "run", "frames", "made_at"), F.struct("made_at", "run")).alias("e")).select("task_id", "e.*")


def changed(videos: DataFrame, path: str) -> DataFrame:
    """The videos (task_id, fingerprint, ...) that the manifest does not know as they are."""
    last = videos.filter("task_id is not null").groupBy("task_id").agg(F.max_by(F.struct(*videos.columns), "fingerprint").alias("v")).select("v.*")
    return last.join(manifest(videos.sparkSession, path).select("task_id", "fingerprint"), ["task_id", "fingerprint"], "left_anti")


def refresh(videos: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], now: float) -> int:
    """Make and write the previews of changed videos; how many there were.

    make: from the changed videos to rows with a task_id.
    """
    spark = videos.sparkSession
    run = uuid.uuid4().hex
    todo = changed(videos, path)
    # the list is written first, so that the rows and the manifest speak of the same videos
    todo.write.parquet(f"{path}/asked/run={run}")
    asked = spark.read.parquet(f"{path}/asked/run={run}")
    number = asked.count()
    if number:
        make(asked).write.parquet(f"{path}/frames/run={run}")
        made = spark.read.parquet(f"{path}/frames/run={run}").groupBy("task_id").agg(F.count("*").alias("frames"))
        entries = asked.join(made, "task_id", "left").select("task_id", "fingerprint", F.lit(run).alias("run"), F.coalesce("frames", F.lit(0)).alias("frames"), F.lit(float(now)).alias("made_at"))
        entries.write.mode("append").parquet(f"{path}/manifest")
    return number


def current(spark: SparkSession, path: str) -> DataFrame:
    """The previews that the manifest names: those of each video's newest run."""
    rows = spark.read.parquet(f"{path}/frames")
    return rows.join(manifest(spark, path).select("task_id", "run"), ["task_id", "run"], "left_semi").drop("run")
