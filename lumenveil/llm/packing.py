"""Best-fit packing of tokenised documents into fixed-length sequences.

Two operators:

* :func:`tokenize_pieces` turns texts into token pieces. A document is its
  token ids followed by one end id; only documents longer than the sequence
  length are cut, into full pieces with a possibly shorter first piece.
* :func:`pack` places pieces into sequences with bounded-space online best
  fit. A packer holds at most ``open_bins`` open sequences. They are indexed by
  their free space in one integer used as a bitset: bit ``f`` is set when a
  sequence with ``f`` free tokens is open, so the best fit is the lowest set bit
  at or above the piece's length, and the fullest open sequence - the lowest set
  bit of all - closes first when the limit is passed.

Every shuffle partition runs one packer over a look-ahead buffer of fixed size
(longest first inside a buffer). Sequences that end with too much free space
are taken apart and packed once more over an eighth of the partitions, so the
loss per partition does not add up. Only piece headers move between tasks; the
memory of a task is bounded by the buffer and the open bins.

Defined cases: a null or empty text is the single end id; an added token of the
vocabulary (<|endoftext|>) in a text is its one id, as the tokenizer has it; a very
long text is tokenised whole and then cut; of bins with equal free space the last
one opened is taken; a repeated document id or repeated row yields its own pieces;
an empty table yields no rows; extra columns are ignored unless passed as payload
of ``pack``, which must have no column sequence_id, offset or free.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenveil.session import materialize, shuffle_partitions

SEQUENCE_TOKENS = 1024
END_ID = 2
#: Open sequences per packer and pieces in its look-ahead buffer.
OPEN_BINS = 4096
LOOK_AHEAD = 8192
#: Text bytes tokenised at a time, which bounds a worker's memory.
SLICE_BYTES = 4 << 20


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    """The byte-level BPE named ``vocabulary``, as a tiktoken encoding.

    The ``.tiktoken`` file holds the same vocabulary as the ``.json`` file of the
    same stem and yields the same ids (the tests hold both against each other)
    at several times the speed.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("an added token that takes in or needs what is around it")
    added = {t["content"]: t["id"] for t in tokens}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def _ids(encoding, text: str) -> list[int]:
    """Ids as the tokenizer gives them without adding any: added tokens in the text count."""
    if any(token in text for token in encoding.special_tokens_set):
        return encoding.encode(text, allowed_special="all")
    return encoding.encode_ordinary(text)


def _cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, total, capacity)]


def tokenize_pieces(
    docs: DataFrame,
    *,
    vocabulary: str = "byte_bpe_50k",
    capacity: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token pieces: id_col, piece, start, length, ids (little-endian uint32)."""
    import numpy as np

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            out: list[list] = [[], [], [], [], []]
            held = 0
            for row, text in enumerate(batch.column(1)):
                ids = _ids(encoding, text.as_py() or "")
                ids.append(end_id)
                packed = np.array(ids, "<u4").tobytes()
                for piece, (start, length) in enumerate(_cut(len(ids), capacity)):
                    for column, value in zip(out, (row, piece, start, length, packed[4 * start : 4 * (start + length)])):
                        column.append(value)
                held += len(packed)
                if held > SLICE_BYTES:
                    yield _rows(keys, out)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield _rows(keys, out)

    def _rows(keys: pa.Array, out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())],
            names=[id_col, "piece", "start", "length", "ids"],
        )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class BestFitPacker:
    """Bounded-space online best fit over one stream of piece lengths."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.mask, self.open = 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _pop(self, free: int) -> list:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.open -= 1
        return bin_

    def add(self, item: int, length: int) -> list[list]:
        """Place an item; returns the bins that this closed.

        A bin is a list ``[free, (item, offset), ...]``.
        """
        fits = self.mask >> length
        bin_ = self._pop(length + (fits & -fits).bit_length() - 1) if fits else [self.capacity]
        bin_.append((item, self.capacity - bin_[0]))
        bin_[0] -= length
        if not bin_[0]:
            return [bin_]
        self.by_free[bin_[0]].append(bin_)
        self.mask |= 1 << bin_[0]
        self.open += 1
        return [self.close_fullest()] if self.open > self.limit else []

    def close_fullest(self) -> list:
        return self._pop((self.mask & -self.mask).bit_length() - 1)

    def drain(self) -> list[list]:
        """Close every open bin, the fullest first."""
        return [self.close_fullest() for _ in range(self.open)]

    def kept(self) -> list[list]:
        return [bin_ for stack in self.by_free for bin_ in stack]


def _packer(capacity: int, open_bins: int, look_ahead: int, base: int):
    """A mapInArrow function over rows with a ``length`` column.

    Rows keep their columns and gain sequence_id, offset and free (the tokens
    left free in their sequence). Open bins refer to rows of ``held``, which is
    compacted after every buffer, so closed rows leave memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = base + (TaskContext.get().partitionId() << 32)
        packer, closed_so_far = BestFitPacker(capacity, open_bins), 0
        held: pa.Table | None = None

        def emit(table: pa.Table, bins: list[list], number: int) -> Iterator[pa.RecordBatch]:
            take, sequence, offset, free = [], [], [], []
            for k, bin_ in enumerate(bins):
                for row, place in bin_[1:]:
                    take.append(row)
                    sequence.append(first + number + k)
                    offset.append(place)
                    free.append(bin_[0])
            out = table.take(pa.array(take, pa.int64()))
            for name, values in (("sequence_id", sequence), ("offset", offset), ("free", free)):
                out = out.append_column(name, pa.array(values, pa.int64()))
            yield from out.to_batches()

        def buffers() -> Iterator[pa.Table]:
            part, rows = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, look_ahead):
                    part.append(batch.slice(at, look_ahead))
                    rows += part[-1].num_rows
                    if rows >= look_ahead:
                        yield pa.Table.from_batches(part)
                        part, rows = [], 0
            if rows:
                yield pa.Table.from_batches(part)

        for buffer in buffers():
            before = held.num_rows if held is not None else 0
            table = pa.concat_tables([held, buffer]) if before else buffer
            lengths = buffer.column("length").to_pylist()
            closed: list[list] = []
            for row in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
                closed += packer.add(before + row, lengths[row])
            if closed:
                yield from emit(table, closed, closed_so_far)
                closed_so_far += len(closed)
            keep: list[int] = []
            for bin_ in packer.kept():
                for k in range(1, len(bin_)):
                    keep.append(bin_[k][0])
                    bin_[k] = (len(keep) - 1, bin_[k][1])
            held = table.take(pa.array(keep, pa.int64())).combine_chunks()
        if packer.open:
            yield from emit(held, packer.drain(), closed_so_far)

    return run


def pack(
    pieces: DataFrame,
    *,
    capacity: int = SEQUENCE_TOKENS,
    open_bins: int = OPEN_BINS,
    look_ahead: int = LOOK_AHEAD,
    slack: int | None = None,
    key_cols: tuple[str, ...] = ("doc_id", "piece"),
) -> DataFrame:
    """Place pieces (any columns, among them ``length`` of 1..capacity).

    Returns the given columns plus sequence_id and offset. Rows are dealt in turn,
    which Spark does on sorted rows, and ordered by the hash of ``key_cols``, so a task
    that runs again after a lost executor makes the same placement, and no key or null
    brings many rows to one task. Sequences of the first level with more
    than ``slack`` free tokens (capacity/128 by default) are packed again.
    """
    slack = capacity // 128 if slack is None else slack
    spark = pieces.sparkSession
    spread = max(1, shuffle_partitions(spark) // 8)
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("free", T.LongType())]
    )

    def ordered(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(F.xxhash64(*key_cols), *key_cols, "length")

    level1 = ordered(pieces.repartition(shuffle_partitions(spark))).mapInArrow(_packer(capacity, open_bins, look_ahead, 0), schema)
    level1 = materialize(level1, "packing")
    again = level1.filter(F.col("free") > slack).drop("sequence_id", "offset", "free")
    level2 = ordered(again.repartition(spread)).mapInArrow(_packer(capacity, open_bins, look_ahead, 1 << 62), schema)
    return level1.filter(F.col("free") <= slack).unionByName(level2).drop("free")


def pack_documents(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of all documents with their ids' CRC-32 and their places.

    Columns: id_col, piece, start, length, ids_crc32, sequence_id, offset. The
    ids themselves stay in the tasks that made them; :func:`tokenize_pieces` gives
    them again for the (id, piece) pairs of any sequence.
    """
    pieces = tokenize_pieces(docs, vocabulary=vocabulary, capacity=capacity, id_col=id_col, text_col=text_col)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=capacity, key_cols=(id_col, "piece"))
