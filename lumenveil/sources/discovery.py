"""Discovery of media objects and idempotent ingestion into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions import scalars


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(key, size, modified) of all files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def media(listing: DataFrame, *, suffixes: tuple[str, ...] = scalars.CLUSTER_SUFFIXES, excluding: str | None = None) -> DataFrame:
    """Non-empty media objects that are not outputs themselves."""
    name = scalars.basename(F.col("key"))
    found = listing.filter(scalars.suffix(F.col("key")).isin(*suffixes) & (F.col("size") > 0) & ~name.startswith("masked_"))
    return found.filter(~F.col("key").startswith(excluding)) if excluding else found


def candidates(listing: DataFrame, outputs: DataFrame, *, bucket: str = "media", least_output: int = 0) -> DataFrame:
    """(key, size, output_key, task_id) of media without a finished output.

    task_id names bucket, key and version, so a second scan finds the same ids.
    """
    done = outputs.filter(F.col("size") > least_output).select(F.col("key").alias("output_key")).distinct()
    new = media(listing).withColumn("output_key", scalars.output_key(F.col("key"))).join(done, "output_key", "left_anti")
    name = F.concat_ws("/", F.lit(f"s3://{bucket}"), F.concat(F.col("key"), F.lit("?version="), F.coalesce("etag", F.lit(""))))
    return new.select("key", "size", "output_key", scalars.uuid5_url(name).alias("task_id")).dropDuplicates(["task_id"])


def ingested(found: DataFrame, tasks: DataFrame) -> DataFrame:
    """Candidates that no task stands for yet."""
    return found.join(tasks.select("task_id"), "task_id", "left_anti")


def distinct_inputs(paths: DataFrame) -> DataFrame:
    """(pos, path) without repeats, in the order of first occurrence."""
    return paths.groupBy("path").agg(F.min("pos").alias("pos")).orderBy("pos").select("pos", "path")


def complete_upload(parts: DataFrame) -> DataFrame:
    """(upload_id, parts, complete): whether parts are numbered 1..n with an etag."""
    return parts.groupBy("upload_id").agg(
        F.count("*").alias("parts"),
        ((F.min("part_number") == 1) & (F.max("part_number") == F.count("*")) & (F.countDistinct("part_number") == F.count("*")) & (F.count("etag") == F.count("*"))).alias("complete"),
    )


def upload_plan(objects: DataFrame, *, single: int = 5 << 30, part: int = 64 << 20) -> DataFrame:
    """(key, part_number, offset, length): one part for small objects, parts of ``part`` bytes for larger ones."""
    size = F.col("size")
    number = F.when(size > single, F.ceil(size / part)).otherwise(1)
    length = F.when(size > single, F.lit(part)).otherwise(size)
    placed = objects.select("key", "size", length.cast("long").alias("_most"), F.explode(F.sequence(F.lit(1), number.cast("int"))).alias("part_number"))
    offset = (F.col("part_number") - 1) * F.col("_most")
    return placed.select("key", "part_number", offset.alias("offset"), F.least(F.col("_most"), size - offset).alias("length"))
