"""Sinks: table versions, exports and streaming upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions import scalars


def write_version(df: DataFrame, path: str, version: int, *, partition_by: list[str] | None = None) -> str:
    """Write a table as ``path/v=<version>``; a version is never overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/v={version}")
    return f"{path}/v={version}"


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version below ``path``; only its folder's files are read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in listed if f.isDirectory()]
    latest = max(int(n[2:]) for n in names if n.startswith("v="))
    return spark.read.parquet(f"{path}/v={latest}")


def upsert_version(changes: DataFrame, path: str, version: int, key: str, order: str) -> DataFrame:
    """Write the newest table with ``changes`` applied as ``version`` and return it.

    Of several changes of a key the one of the greatest ``order`` holds; rows of a
    null key in ``changes`` are left out. A version that failed leaves the ones
    before it as they were.
    """
    spark = changes.sparkSession
    now = read_latest(spark, path)
    last = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*now.columns), order).alias("row")).select("row.*")
    kept = now.join(last.select(key), key, "left_anti").select(now.columns)
    return spark.read.parquet(write_version(kept.unionByName(last), path, version))


def append_events(lines: DataFrame, path: str) -> None:
    """Append the one text column of ``lines`` to the event log, a folder of text files."""
    lines.write.mode("append").text(path)


def export_rows(tasks: DataFrame) -> DataFrame:
    """Rows for a spreadsheet: readable times and sizes, nulls as empty texts."""
    at = lambda c: F.coalesce(F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return tasks.select(
        "task_id", "status", F.coalesce("assigned_worker_id", F.lit("")).alias("worker"), scalars.server_name(F.col("assigned_worker_id")).alias("server"),
        F.coalesce("source_object_key", F.lit("")).alias("source"), scalars.output_key(F.col("source_object_key")).alias("output"),
        scalars.format_bytes(F.col("source_size_bytes")).alias("size"), at("created_at").alias("created"), at("started_at").alias("started"), at("finished_at").alias("finished"),
        F.coalesce(scalars.format_duration(F.col("output_duration_seconds")), F.lit("")).alias("duration"),
    )


def export_csv(tasks: DataFrame, path: str) -> None:
    export_rows(tasks).write.mode("overwrite").option("header", True).csv(path)


#: Parts of a keyed table by hash of its key.
BUCKETS = 64


def _newest(spark: SparkSession, path: str, buckets: int) -> dict[int, int]:
    """The version of each part that a keyed table consists of; empty where there is no table."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return {}
    return {r.bucket: r.version for r in read_latest(spark, f"{path}/parts").collect()}  # at most `buckets` rows


def _parts(spark: SparkSession, path: str, versions: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/rows/v={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str, schema, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a table that :func:`upsert_keyed` wrote."""
    return _parts(spark, path, _newest(spark, path, buckets), schema)


def upsert_keyed(changes: DataFrame, path: str, version: int, key: str, order: str, buckets: int = BUCKETS) -> list[int]:
    """Write the parts of a keyed table that ``changes`` touch; their numbers.

    The table is a set of parts by hash of the key; a version writes only the parts
    that it changes and then one small table that names the version of every part, so
    readers see all of a version or nothing. Of several changes of a key the one of
    the greatest ``order`` holds; rows of a null key are left out. A version that is
    written already is refused; one that failed may be written again.
    """
    spark = changes.sparkSession
    versions = _newest(spark, path, buckets)
    if versions and max(versions.values()) >= version:
        raise ValueError(f"version {version} is not newer than {max(versions.values())}")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    last = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("row")).select("row.*")
    touched = sorted(r.bucket for r in last.select(bucket.alias("bucket")).distinct().collect())  # at most `buckets`
    if not touched:
        return []
    now = _parts(spark, path, {b: v for b, v in versions.items() if b in touched}, changes.schema)
    merged = now.join(last.select(key), key, "left_anti").select(changes.columns).unionByName(last)
    merged.withColumn("bucket", bucket).repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={version}")
    named = versions | dict.fromkeys(touched, version)
    write_version(spark.createDataFrame(sorted(named.items()), "bucket int, version long").coalesce(1), f"{path}/parts", version)
    return touched
