"""Helpers that several operators share: row keys, words, compressed texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows gathered in Python before a batch goes back to the JVM.
FLUSH_ROWS = 20_000


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores in front as no column of rows has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, text binary): text_key tells rows with the same id apart.

    Rows with the same id and text are equal in every respect, so what is found
    for one of them holds for the other.
    """
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))


def compressed(rows: DataFrame) -> DataFrame:
    """The rows with their last column, a binary, compressed by zstd.

    For texts that are shuffled whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([None if x is None else squeeze(x) for x in batch.columns[-1].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def decompressor():
    """A function from a compressed (or null) text to its bytes."""
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    return lambda x: b"" if x is None else grow(x)


def emit(columns: list[list], keys: pa.Array | None, schema: T.StructType) -> pa.RecordBatch:
    """A batch of Python columns; the first holds row numbers into ``keys``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    arrays = [pa.array(x, f.type) for x, f in zip(columns[keys is not None :], list(fields)[keys is not None :])]
    if keys is not None:
        arrays.insert(0, keys.take(pa.array(columns[0], pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, schema=fields)


#: A key of more than one of so many rows is hot; so there are fewer hot keys than this.
HOT_KEYS = 1000
#: Fewest rows of a hot key.
HOT_ROWS = 500


def spread_join(rows: DataFrame, named: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` inner joined with ``named``, the rows of hot keys spread by column ``by``.

    named: a table with one row a key and ``n``, the key's number of rows; n is
    dropped. A hot key holds more than a thousandth of all rows, so fewer than
    HOT_KEYS keys are known to the driver; their rows of ``named`` are copied.
    """
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = [r.hot for r in named.filter(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(F.xxhash64(*keys).alias("hot")).collect()]
    named = named.drop("n")
    if not hot:
        return rows.join(named, keys)
    salts = rows.sparkSession.sparkContext.defaultParallelism * 4
    is_hot = F.xxhash64(*keys).isin(hot)
    left = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int"))
    right = named.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
