"""Session helpers: shared folders, table loading and lineage cuts.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, or to the
checkpoint directory already set on the context. With neither, a local session
uses a folder inside its warehouse, and a cluster is refused: what its folders
share is not known here.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder, shared by driver and executors, for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(f"{warehouse}/_checkpoints")
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage behind the written files, so a lost executor
    costs a re-read instead of a recomputation of everything before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _made.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Lists of the tables written inside each open :func:`temporary_tables`; a thread has its own.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside are deleted at the end, all but the last one."""
    made: list[str] = []
    before = _made.set((*_made.get(), made))
    try:
        yield made
    finally:
        _made.reset(before)
        for path in made[:-1]:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize`."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
