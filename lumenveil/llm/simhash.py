"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
read as a word of the binary Golay code (23 bits, 4096 codewords, every word
within 3 bits of exactly one codeword). If two fingerprints differ in at most 4
bits, then by the pigeonhole principle either one segment holds no error and
another at most two, or all three hold one or two and at most one of them two.

Codewords within 4 bits of a segment are 1 or 6, and the 6 partition its bits:
words that differ in one bit find each other's nearest codeword among them, and
words that differ in two bits share one. So

* for the first case both sides use a whole segment and another's codewords
  within 4 bits (the stored side only its nearest one, where the remaining
  segment can take the place if that holds two errors), and
* for the second, a fingerprint is stored under its three nearest codewords with
  one of them exchanged for any within 4 bits, and asks for all triples of
  codewords within 4 bits.

Keys hold 33 to 36 bits, so that few unrelated fingerprints meet in them.
Joined fingerprints are verified on all 64 bits. Groups of copies never become
pairs: rows of one key are dealt in blocks of bounded size, and a task returns
a spanning forest of the verified links it has seen.

Defined cases: null or empty text has fingerprint zero and links like any
other; fewer words than a shingle count as one shingle; very long texts are read
whole, their shingles in pieces; repeated rows share their component; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenveil.llm.components import components
from lumenveil.llm.textframe import spread_join
from lumenveil.session import discard, materialize, shuffle_partitions

SHINGLE_WORDS = 4
MAX_BITS = 4
#: (shift, width) of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Most stored, and about as many asking, fingerprints of one key in a block.
BLOCK = 4096
#: Fingerprints whose keys one task makes, and linked ones that a task keeps.
EXPANDED = 50_000
FOREST_NODES = 200_000
#: Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011


# -- fingerprints ---------------------------------------------------------

def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a UTF-8 text, as a signed 64-bit integer."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only; \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, 42)).astype(np.int64))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[shingle_words - 1 :]
    digest, total = xxhash.xxh64_intdigest, len(ends)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 15):
        upto = min(at + (1 << 15), total)
        spans = zip(starts[at:upto].tolist(), ends[at:upto].tolist())
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in spans), "<u8", upto - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_key, fp long) of every row; text_key is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle_words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=[id_col, "text_key", "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(id_col, F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


# -- the Golay code -------------------------------------------------------

def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@functools.lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Syndromes of the upper 12 bits; errors by syndrome, up to each weight.

    Errors up to weight w: (patterns[2048, most], number per syndrome); the first
    is the coset leader, which has weight 3 at most.
    """
    upper = np.array([_remainder(x << 11) for x in range(1 << 12)], np.int64)
    by_syndrome: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            by_syndrome[upper[error >> 11] ^ (error & 0x7FF)].append((weight, error))
    errors = {}
    for most in (3, 4):
        lists = [[e for w, e in x if w <= most] for x in by_syndrome]
        patterns = np.zeros((1 << 11, max(map(len, lists))), np.int64)
        for k, x in enumerate(lists):
            patterns[k, : len(x)] = x
        errors[most] = patterns, np.array(list(map(len, lists)))
    return upper, errors


def codewords(segments: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within ``most`` bits of each segment.

    Returns ([n, k] indices, [n] how many of each row count); nearest first.
    """
    upper, errors = _golay()
    syndrome = upper[segments >> 11] ^ (segments & 0x7FF)
    patterns, number = errors[most]
    return (segments[:, None] ^ patterns[syndrome]) >> 11, number[syndrome]


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    unsigned = fps.view(np.uint64)
    return [((unsigned >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]


def _near(fps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [codewords(x, most) for x in _segments(fps)]


def _exact_keys(fps: np.ndarray, near: list, asking: bool) -> list[list[np.ndarray]]:
    """Keys of one whole segment and another's nearby codewords."""
    keys = []
    for i, raw in enumerate(_segments(fps)):
        for step in (1, 2):
            indices, number = near[(i + step) % 3]
            high = ((1 + 2 * i + step) << 40) | (raw << 12)
            keys.append([h | x[: n if asking or step == 1 else 1] for h, x, n in zip(high, indices, number)])
    return keys


def stored_keys(fps: np.ndarray) -> list[np.ndarray]:
    """The keys under which each fingerprint is stored."""
    near = _near(fps, 4)
    exact = _exact_keys(fps, near, asking=False)
    (a, na), (b, nb), (c, nc) = ((x << (12 * k), n) for k, (x, n) in enumerate(near))
    stored = []
    for row in range(len(fps)):
        x, y, z = a[row, : na[row]], b[row, : nb[row]], c[row, : nc[row]]
        stored.append(np.concatenate([x | y[0] | z[0], x[0] | y[1:] | z[0], x[0] | y[0] | z[1:], *(k[row] for k in exact)]))
    return stored


def asked_keys(fps: np.ndarray) -> list[np.ndarray]:
    """Every key that a fingerprint within four bits may be stored under."""
    near = _near(fps, 4)
    exact = _exact_keys(fps, near, asking=True)
    (a, na), (b, nb), (c, nc) = ((x << (12 * k), n) for k, (x, n) in enumerate(near))
    asked = []
    for row in range(len(fps)):
        all_three = a[row, : na[row], None, None] | b[row, None, : nb[row], None] | c[row, None, None, : nc[row]]
        asked.append(np.concatenate([all_three.ravel(), *(k[row] for k in exact)]))
    return asked


def _keyed(fps: DataFrame, keys) -> DataFrame:
    """(fp, key) for every key that ``keys`` gives the fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                found = keys(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["fp", "keys"])

    return fps.select("fp").mapInArrow(run, "fp long, keys array<long>").select("fp", F.explode("keys").alias("key"))


# -- links ----------------------------------------------------------------

class Forest:
    """Union-find over integers; the root of a tree is its least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _link_blocks(max_bits: int):
    """mapInArrow over (key, part, slice, asks, fp), sorted: verified links.

    Holds the stored fingerprints of one block (at most about BLOCK) and a forest
    of fingerprints that have a link in this task; the forest's edges are handed on
    whenever it has FOREST_NODES of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        block, stored, group = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges() -> pa.RecordBatch:
            pairs = [(x, forest.find(x)) for x in list(forest.parent)]
            a, b = [x for x, r in pairs if x != r], [r for x, r in pairs if x != r]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            key, part, piece, asks, fp = columns
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(piece) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(key)]):
                name = (key[lo], part[lo], piece[lo])
                if name != block:
                    block, stored = name, np.zeros(0, np.int64)
                split = lo + int(np.searchsorted(asks[lo:hi], 1))
                if split > lo:
                    stored = np.concatenate([stored, fp[lo:split]])
                    group = np.arange(len(stored))
                for at in range(split, hi, 512):
                    asking = fp[at : min(at + 512, hi)]
                    near = np.bitwise_count((asking[:, None] ^ stored[None, :]).view(np.uint64)) <= max_bits
                    near &= asking[:, None] != stored[None, :]
                    for a in np.flatnonzero(near.any(axis=1)):  # once to each group that earlier rows have connected
                        groups, first = np.unique(group[near[a]], return_index=True)
                        for b in stored[near[a]][first].tolist():
                            forest.link(int(asking[a]), b)
                        if len(groups) > 1:
                            group[np.isin(group, groups)] = groups[0]
            if len(forest.parent) > FOREST_NODES:
                yield edges()
                forest = Forest()
        yield edges()

    return run


def links(fps: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect all fingerprints at most ``max_bits`` apart.

    fps: a table of distinct fingerprints (column fp). Two fingerprints are connected
    by the result if and only if a chain of differences of at most ``max_bits`` (4 or
    less) connects them.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the three segments hold {MAX_BITS} differing bits at most")
    # A row becomes 200: dealt by a hash of its own into tasks whose number grows with what they give.
    number = max(shuffle_partitions(fps.sparkSession), -(-fps.count() // EXPANDED))
    fps = fps.select("fp").repartition(number, F.xxhash64(F.lit(3), "fp"))
    stored = _keyed(fps, stored_keys)
    sizes = stored.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("one"))
    # Spark takes a table of keys for as small as its fingerprints, which are 200 times fewer, so it must not choose to broadcast it.
    asks = _keyed(fps, asked_keys).hint("merge").join(sizes.hint("merge"), "key").filter("n > 1 or one <> fp")
    asks = materialize(asks.select("key", "n", "fp"), "simhash-asks")
    counts = asks.groupBy("key").agg(F.first("n").alias("n"), F.count("*").alias("asking"))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    slices = F.ceil(F.col("asking") / BLOCK).cast("int")
    salt = lambda of: F.pmod(F.xxhash64("fp"), of).cast("int")
    counts = counts.select("key", parts.alias("parts"), slices.alias("slices"))
    left = stored.join(counts, "key").select(
        "key", salt(F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("asks"), "fp"
    )
    right = asks.join(counts, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt(F.col("slices")).alias("slice"), F.lit(1).alias("asks"), "fp"
    )
    dealt = left.unionByName(right).repartition("key", "part", "slice").sortWithinPartitions("key", "part", "slice", "asks")
    return dealt.mapInArrow(_link_blocks(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_key, fp, component): the least id among the documents reachable.

    Documents are linked when their fingerprints differ in at most ``max_bits``.
    Copies meet in an aggregation by fingerprint first, so the search runs over
    distinct fingerprints however large a group of copies is.
    """
    marked = materialize(fingerprints(docs, shingle_words=shingle_words, id_col=id_col, text_col=text_col), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(links(distinct, max_bits=max_bits)).withColumnRenamed("node", "fp")
    least = materialize(distinct.join(roots, "fp").groupBy("root").agg(F.min("least_id").alias("component")), "simhash-least")
    grouped = roots.join(least, "root").select("fp", "component")
    named = distinct.join(grouped, "fp", "left").select("fp", "n", F.coalesce("component", "least_id").alias("component"))
    named = materialize(named, "simhash-components")
    discard(distinct)
    return spread_join(marked, named, ["fp"], id_col).select(id_col, "text_key", "fp", "component")
