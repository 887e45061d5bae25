"""Order-dependent work over sorted runs of rows, in Arrow batches.

``over_groups`` is for small groups (the boxes of a frame): rows are dealt by
the group's keys and sorted, and each partition streams through one Python
function that sees a group at a time - without the cost of a pandas frame per
group. ``over_sequences`` is for long ordered groups (the frames of a video): a
state is carried from frame to frame, so memory does not grow with the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Row = dict
_FLUSH = 8192


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _values(column: pa.Array) -> list:
    """A column as Python values; by NumPy, at a third of the time, where that keeps them as they are."""
    kind = column.type
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[Row]]]:
    """(key values, rows) of every run of equal keys in sorted batches."""
    key, rows = None, []
    for batch in batches:
        names, columns = batch.schema.names, [_values(c) for c in batch.columns]
        places = [names.index(k) for k in keys]
        for now, values in zip(zip(*(columns[k] for k in places)), zip(*columns)):
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(dict(zip(names, values)))
    if rows:
        yield key, rows


def _flushed(rows: Iterator[Row], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) >= _FLUSH:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def over_groups(df: DataFrame, keys: list[str], order: list, step: Callable[[list[Row]], list[Row]], schema: T.StructType | str) -> DataFrame:
    """``step`` of the rows of each group in ``order``; it returns output rows."""
    out = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flushed((row for _, rows in groups_of(batches, keys) for row in step(rows)), to_arrow_schema(out))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def over_sequences(
    df: DataFrame, keys: list[str], frame: str, order: list, start: Callable[[tuple], object], step: Callable[[object, int, list[Row]], list[Row]], schema: T.StructType | str
) -> DataFrame:
    """A state per group of ``keys``, stepped through its frames in order.

    start(key values) makes a state; step(state, frame, rows) changes it and
    returns output rows.
    """
    out = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Row]:
            group, state = None, None
            for key, some in groups_of(batches, [*keys, frame]):
                if key[:-1] != group:
                    group, state = key[:-1], start(key[:-1])
                yield from step(state, key[-1], some)

        yield from _flushed(rows(), to_arrow_schema(out))

    return df.repartition(*keys).sortWithinPartitions(*keys, frame, *order).mapInArrow(run, out)
