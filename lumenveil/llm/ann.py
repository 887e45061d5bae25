"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is stored as the signs of its rotated residual (one bit per
dimension, packed) to the nearest of a few centroids, with two correction
scalars: the residual's norm, and its alignment with the code's direction. For
a query the inner product with the code, divided by the alignment, estimates
the inner product with the residual without bias, and its error is bounded by

    norm * |query| * sqrt(1 - a^2) / a * EPSILON / sqrt(dimensions - 1)

except with a probability that falls as exp(-EPSILON^2 / 2). The k vectors of
best estimate are scored on the original numbers, in double precision, and after
them every vector whose upper bound reaches the least of those scores.

The index covers every row and is written once; only centroids are fitted, on the
SAMPLE_ROWS rows with the least id hashes. Queries are dealt in blocks of bounded
size, and a task holds one block with its k best so far while rows stream past it,
so rows are copied once for every QUERY_VALUES numbers of queries, and a query has
k rows in each of ``parts`` tasks to be merged. The signs are unpacked for the
estimates of a batch: as a product of matrices they cost less than counting bits.

Defined cases: a vector that is null, empty, zero, of another length than most
(ties: the longer), or holds a null or non-finite component takes no part; equal
scores go to the smaller id; rows with a query's own id are not its neighbours;
repeated rows each count, and a repeated query id has one ranking over all its
rows; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenveil.session import materialize

SAMPLE_ROWS = 4096
CENTROIDS = 16
#: Width of the error bound.
EPSILON = 3.0
#: Numbers in a block of queries, and the fewest queries of one.
QUERY_VALUES = 1 << 20
QUERY_ROWS = 256
#: Numbers of the rows that are compared at a time, and queries.
BATCH_VALUES = 1 << 19
QUERY_BATCH = 128
#: Most rows that pass one task.
PART_ROWS = 1 << 20
SEED = 7


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


class OneBitCodes:
    """The fitted part of the index: a rotation and centroids."""

    def __init__(self, sample: np.ndarray, dimensions: int) -> None:
        rng = np.random.default_rng(SEED)
        self.rotation = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0]
        centres = sample[:: max(1, len(sample) // CENTROIDS)][:CENTROIDS].copy() if len(sample) else np.zeros((1, dimensions))
        for _ in range(8 if len(sample) else 0):
            own = self._assign(sample, centres)
            for k in range(len(centres)):
                if (own == k).any():
                    centres[k] = sample[own == k].mean(axis=0)
        self.centres = centres

    @staticmethod
    def _assign(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centroid numbers, packed signs, norms and alignments."""
        own = self._assign(vectors, self.centres)
        rest = (vectors - self.centres[own]) @ self.rotation.T
        norm = np.linalg.norm(rest, axis=1)
        signs = rest > 0
        align = np.where(norm > 0, np.abs(rest).sum(axis=1) / math.sqrt(rest.shape[1]) / np.where(norm > 0, norm, 1), 1.0)
        return own, np.packbits(signs, axis=1), norm, align

    def bounds(self, queries: np.ndarray, own, packed, norm, align) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products [queries, rows] and their error bounds."""
        return self.prepared(own, packed, norm, align)(queries)

    def prepared(self, own, packed, norm, align):
        """A function from queries to their bounds over the rows of a block."""
        d = self.rotation.shape[0]
        signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
        signs *= (norm / align / math.sqrt(d)).astype(np.float32)[:, None]
        width = norm * np.sqrt(np.maximum(0, 1 - align**2)) / align * EPSILON / math.sqrt(max(1, d - 1))
        width = (width + 1e-5 * (norm + np.abs(self.centres).max())).astype(np.float32)

        def bounds(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            estimate = (queries @ self.rotation.T).astype(np.float32) @ signs.T
            estimate += (queries @ self.centres.T).astype(np.float32)[:, own]
            return estimate, np.linalg.norm(queries, axis=1).astype(np.float32)[:, None] * width

        return bounds


def fit(vectors: DataFrame, dimensions: int) -> OneBitCodes:
    """Fit on at most SAMPLE_ROWS rows of (id, vector)."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").collect()
    return OneBitCodes(np.array([r.vector for r in rows], np.float64).reshape(len(rows), dimensions), dimensions)


def encode(vectors: DataFrame, codes: OneBitCodes) -> DataFrame:
    """The index: (id, asks, centre, code, norm, align, vector binary) of every row.

    Vectors are kept as the numbers they were: floats stay floats.
    """
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            own, packed, norm, align = codes.encode(vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(own, pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(norm), pa.array(align), pa.array([x.tobytes() for x in vectors.astype(kind)], pa.binary())],
                names=["id", "asks", "centre", "code", "norm", "align", "vector"],
            )

    return vectors.select("id", "vector", "asks").mapInArrow(run, "id long, asks boolean, centre int, code binary, norm double, align double, vector binary")


def _kind(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["vector"].dataType.elementType == T.FloatType() else "<f8"


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


class Best:
    """A block of queries, each with the k best rows that it has met."""

    def __init__(self, names: np.ndarray, asked: np.ndarray, k: int) -> None:
        self.names, self.asked, self.k = names, asked, k
        self.ids = np.full((len(names), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(names), k), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, bounds) -> None:
        """Take in a batch of rows.

        The k rows of best estimate are scored first; the least of their scores, or
        of those met before, is what every other row's upper bound has to reach.
        """
        for at in range(0, len(self.names), QUERY_BATCH):
            upto = min(at + QUERY_BATCH, len(self.names))
            self._meet(slice(at, upto), ids, vectors, bounds)

    def _meet(self, part: slice, ids: np.ndarray, vectors: np.ndarray, bounds) -> None:
        names, asked, k = self.names[part], self.asked[part], self.k
        estimate, width = bounds(asked)
        estimate[names[:, None] == ids[None, :]] = -np.inf
        least = self.scores[part, -1]
        if len(ids) > k + 1:  # the query itself may be a row
            first = np.argpartition(estimate, len(ids) - k, axis=1)[:, len(ids) - k :]
            found = np.where(np.take_along_axis(estimate, first, 1) > -np.inf, np.einsum("bkd,bd->bk", vectors[first], asked), -np.inf)
            least = np.maximum(least, found.min(axis=1))
        slack = 1e-9 * (1 + np.where(np.isfinite(least), np.abs(least), 0))
        chosen = (estimate + width >= (least - slack)[:, None]) & (estimate > -np.inf)
        for row in np.flatnonzero(chosen.any(axis=1)):
            near, query = np.flatnonzero(chosen[row]), asked[row]
            if len(near) > 4 * k:  # those that rounding cannot lift into the k best go
                rough = vectors[near] @ query
                near = near[rough >= np.partition(rough, len(near) - k)[len(near) - k] - 1e-9 * (1 + np.abs(rough).max())]
            score = np.cumsum(vectors[near] * query, axis=1)[:, -1]  # adds in order, as SQL does
            at = part.start + row
            score, names_ = np.concatenate([self.scores[at], score]), np.concatenate([self.ids[at], ids[near]])
            best = np.lexsort((names_, -score))[:k]
            self.ids[at], self.scores[at] = names_[best], score[best]

    def rows(self) -> pa.RecordBatch:
        kept = self.scores > -np.inf
        names = np.repeat(self.names, kept.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(self.ids[kept], pa.int64()), pa.array(self.scores[kept], pa.float64())], names=["query_id", "vec_id", "score"])


def _search(codes: OneBitCodes, k: int, kind: str):
    """mapInArrow over sorted (pair, side, ...): the queries of a pair, then its rows."""
    at_once = max(QUERY_ROWS, BATCH_VALUES // codes.rotation.shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, queries, best = None, [], None
        for whole in batches:
            marks = whole.column("pair").to_numpy(zero_copy_only=False) * 2 + whole.column("side").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                now, side = divmod(int(marks[lo]), 2)
                if now != pair:
                    if best is not None:
                        yield best.rows()
                    pair, queries, best = now, [], None
                part = whole.slice(lo, hi - lo)
                if side == 0:
                    queries.append((part.column("id").to_numpy(), _matrix(part.column("vector"), kind).astype(np.float64)))
                    continue
                if best is None:
                    if not queries:
                        continue
                    best = Best(np.concatenate([x for x, _ in queries]), np.concatenate([x for _, x in queries]), k)
                for at in range(0, part.num_rows, at_once):
                    rows = part.slice(at, at_once)
                    own, norm, align = (rows.column(c).to_numpy() for c in ("centre", "norm", "align"))
                    best.meet(rows.column("id").to_numpy(), _matrix(rows.column("vector"), kind).astype(np.float64), codes.prepared(own, _matrix(rows.column("code"), np.uint8), norm, align))
        if best is not None:
            yield best.rows()

    return run


def nearest(rows: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query row.

    is_query: a condition over id_col. Nearness is the inner product.
    """
    spark = rows.sparkSession
    vectors = rows.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    lengths = vectors.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    dimensions, n, q = (most.d, most.n, most.q) if most else (1, 0, 0)
    vectors = vectors.filter(F.size("vector") == dimensions)
    codes = fit(vectors, dimensions)
    index = materialize(encode(vectors, codes), "one-bit-index")
    query_blocks = max(1, -(-q // max(QUERY_ROWS, QUERY_VALUES // dimensions)))
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-2 * cores // query_blocks), -(-n // PART_ROWS))
    salt = F.xxhash64("id", F.monotonically_increasing_id())  # of a written table: rows of one id are spread, and alike in every run
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(salt, F.lit(n)).cast("int")
    fields = ["id", "centre", "code", "norm", "align", "vector"]
    passing = index.withColumn("part", dealt(parts)).withColumn("block", every(query_blocks)).withColumn("side", F.lit(1))
    asking = index.filter("asks").withColumn("block", dealt(query_blocks)).withColumn("part", every(parts)).withColumn("side", F.lit(0))
    asking = asking.withColumns({"code": F.lit(None).cast("binary"), "norm": F.lit(0.0), "align": F.lit(0.0)})
    pair = (F.col("block").cast("long") * parts + F.col("part")).alias("pair")
    both = passing.select(pair, "side", *fields).unionByName(asking.select(pair, "side", *fields))
    near = both.repartition(query_blocks * parts, "pair").sortWithinPartitions("pair", "side").mapInArrow(_search(codes, k, _kind(vectors)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same outcome in DuckDB, by brute force.
ORACLE_SQL = """
WITH vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(c.v, q.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
