"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case without ASCII punctuation. Every run of
``min_match`` words of a text is a seed, held as a rolling hash; documents and
benchmark items with a common seed meet in a join, and each pair is tiled by
running Karp-Rabin: the longest common run of unmarked words is found by a search
over lengths, each tried by comparing the rolling hashes of that length; all its
places are verified word by word and marked in order, and so on with what is left
unmarked, until nothing of ``min_match`` words remains. So a passage whose
sentences were put in another order is still covered. Coverage is the share of
an item's words inside tiles.

A pair of coverage c shares seeds at c*n/min_match places of an item of n words at
least, so as many of an item's places but one may stay out of the join and no pair
is lost: those with the seeds that most items have.

The benchmark meets the documents' seeds by a broadcast only if its seeds are few
enough to prove a bound, else by a shuffled join. Texts go to the pairs that a
seed has found, items in chunks of bounded size.

Defined cases: null or empty texts match nothing; an item with fewer than
min_match words is covered by documents that hold all its words in a row (seeds of
such lengths are made of the documents only if an item has one); equal
matches go to the first place in the document, then in the item; very long texts
are tiled whole, in memory that grows with the lengths of the document and of the
longest item alone; repeated items and
rows repeat in :func:`contaminations`; a null id is an id like others; an empty
table on either side gives no overlap; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenveil.session import discard, materialize

MIN_MATCH = 5
COVERAGE = 0.5
#: Most seeds of a benchmark that is broadcast: about 100 MB in memory.
BROADCAST_SEEDS = 1_000_000
#: Most items in a row that is tiled.
CHUNK_ITEMS = 64
#: Hashed words that a worker remembers.
_KNOWN_WORDS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_PUNCTUATION = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
_KEYS = ["row_key", "text_key"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def seeds_of(words: list[bytes], widths: tuple[int, ...]) -> np.ndarray:
    """Hashes (long) of all runs of each width that the words hold."""
    numbers = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    found = [np.zeros(0, np.uint64)]
    for width in widths:
        n = len(numbers) - width + 1
        if width < 1 or n < 1:
            continue
        out = np.full(n, width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                out = (out ^ (out >> np.uint64(29))) * np.uint64(_BASE) + numbers[k : k + n]
        found.append(out)
    return np.concatenate(found).view(np.int64)


# -- tiling ---------------------------------------------------------------


class _Runs:
    """Rolling hashes of any length over numbers, of which some are marked."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers, self.free = numbers, numbers >= 0
        n = len(numbers)
        with np.errstate(over="ignore"):
            powers, self.back, self.sums = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
            powers[1:], self.back[1:] = _BASE, pow(_BASE, -1, 1 << 64)
            powers, self.back = np.cumprod(powers), np.cumprod(self.back)
            self.sums[1:] = np.cumsum((numbers.astype(np.uint64) + np.uint64(1)) * powers[:-1])

    def settle(self) -> None:
        """Take note of what has been marked."""
        self.marked = np.concatenate([[0], np.cumsum(~self.free)])

    def places(self, length: int) -> np.ndarray:
        return np.flatnonzero(self.marked[length:] == self.marked[: len(self.marked) - length])

    def hashes(self, places: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[places + length] - self.sums[places]) * self.back[places]

    def longest(self) -> int:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], self.free.view(np.int8), [0]])))
        return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def tiles_of(doc: np.ndarray, item: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of numbers: (doc place, item place, length).

    Negative numbers match nothing. The longest match first; of equal ones the
    first in the document, then in the item.
    """
    a, b, tiles = _Runs(doc), _Runs(item), []
    most = min(a.longest(), b.longest())

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, p = a.places(length), b.places(length)
        x, y = a.hashes(d, length), b.hashes(p, length)
        hit = np.isin(x, y)
        return d[hit], x[hit], p, y

    while most >= m:
        a.settle()
        b.settle()
        low, high = m - 1, most  # the longest length with a common run lies in (low, high], or there is none
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < m:
            break
        d, x, p, y = common(low)
        places: dict[int, list[int]] = {}
        for h, at in zip(y[::-1].tolist(), p[::-1].tolist()):
            places.setdefault(h, []).append(at)
        for at, h in zip(d.tolist(), x.tolist()):
            if not a.free[at : at + low].all():
                continue
            for k in range(len(places[h]) - 1, -1, -1):  # from the first place on
                other = places[h][k]
                if not b.free[other : other + low].all():
                    del places[h][k]
                elif (doc[at : at + low] == item[other : other + low]).all():
                    tiles.append((at, other, low))
                    a.free[at : at + low] = b.free[other : other + low] = False
                    break
        most = low - 1
    return tiles


def overlap(words: list[bytes], item: list[bytes], m: int = MIN_MATCH) -> tuple[int, int]:
    """(tiles, covered words) of an item in a document."""
    if len(item) < m:
        join = lambda x: b" " + b" ".join(x) + b" "
        return (1, len(item)) if item and join(item) in join(words) else (0, 0)
    vocabulary: dict[bytes, int] = {}
    target = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in item], np.int64)
    numbers = np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))
    inside = np.concatenate([[0], np.cumsum(numbers >= 0)])
    full = inside[m:] - inside[:-m] == m if len(words) >= m else np.zeros(0, bool)  # runs of words of the item
    if not full.any():
        return 0, 0
    reach = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(full)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + m, -1)
    kept = np.cumsum(reach[:-1]) > 0
    parts = numbers[kept | np.concatenate([[False], kept[:-1]])].copy()  # every run and the word after it
    ends = ~kept[kept | np.concatenate([[False], kept[:-1]])]
    parts[ends] = -1
    found = tiles_of(parts, target, m)
    return len(found), sum(n for _, _, n in found)


# -- the join -------------------------------------------------------------


def _keys(id_col: str, text_col: str) -> list:
    """Two hashes that tell rows of different id or text apart; null ids count."""
    return [F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("row_key"), F.xxhash64(F.lit(2), F.col(text_col)).alias("text_key")]


def _with_seeds(rows: DataFrame, seeds: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows, whose last column is a text, with array<long> seeds of its words in its place."""
    fields = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [seeds(words_of(x.as_py())) for x in batch.columns[-1]]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*(f.name for f in fields), "seeds"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("seeds", T.ArrayType(T.LongType()))]))


def _short_widths(items: DataFrame, m: int) -> tuple[int, ...]:
    """The numbers of words, below m, that items have: m - 1 values at most."""
    lengths = _with_seeds(items.select("item_text"), lambda words: np.array([min(len(words), m)], np.int64))
    return tuple(sorted(r.n for r in lengths.select(F.explode("seeds").alias("n")).distinct().filter(F.col("n").between(1, m - 1)).collect()))


def _indexed(items: DataFrame, m: int, coverage: float) -> DataFrame:
    """(seed, item): the seeds of each item that the join needs."""
    every = _with_seeds(items.select("item", "item_text"), lambda words: seeds_of(words, (min(m, len(words)),))).select("item", F.size("seeds").alias("places"), F.explode("seeds").alias("seed"))
    weighed = every.groupBy("item", "places", "seed").agg(F.count("*").alias("n"))
    common = weighed.groupBy("seed").agg(F.count("*").alias("items"))
    order = Window.partitionBy("item").orderBy(F.desc("items"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = weighed.join(common, "seed").withColumn("upto", F.sum("n").over(order))
    # an item of n words has n - m + 1 places; as many as this may be passed over
    spare = F.greatest(F.ceil(F.lit(coverage) * (F.col("places") + m - 1) / m) - 1, F.lit(0))
    return upto.filter(F.col("upto") > spare).select("seed", "item")


def _pairs(docs: DataFrame, items: DataFrame, m: int, coverage: float) -> DataFrame:
    """(row_key, text_key, item) of documents and items with a common seed, as a table."""
    seeds = materialize(_indexed(items, m, coverage), "tiling-seeds")
    met = F.broadcast(seeds) if seeds.count() <= BROADCAST_SEEDS else seeds
    widths = (*_short_widths(items, m), m)
    told = _with_seeds(docs, lambda words: np.unique(seeds_of(words, widths))).select(*_KEYS, F.explode("seeds").alias("seed"))
    pairs = materialize(told.join(met, "seed").select(*_KEYS, "item").distinct(), "tiling-pairs")
    discard(seeds)
    return pairs


def overlaps(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, min_match: int = MIN_MATCH, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """(row_key, text_key, item, tiles, covered, coverage) from ``coverage`` on, as a table.

    row_key and text_key name rows of one id and text, item the items of one text.
    """
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.unhex(F.md5(F.col(item_text_col).cast("binary"))).alias("item"), F.col(item_text_col).alias("item_text"))
    items = materialize(items.dropDuplicates(["item"]), "tiling-items")
    texts = docs.filter(F.col(text_col).isNotNull()).select(*_keys(id_col, text_col), F.col(text_col).alias("doc_text"))
    pairs = _pairs(texts, items, min_match, coverage)
    sizes = pairs.groupBy(*_KEYS).agg(F.ceil(F.count("*") / CHUNK_ITEMS).alias("chunks"))
    chunks = (
        pairs.join(sizes, _KEYS).join(items, "item")
        .groupBy(*_KEYS, F.pmod(F.xxhash64("item"), "chunks").alias("chunk"))
        .agg(F.collect_list("item").alias("items"), F.collect_list("item_text").alias("item_texts"))
    )
    chunks = materialize(chunks.drop("chunk"), "tiling-chunks")
    met = texts.join(chunks, _KEYS).select(*_KEYS, "items", "item_texts", "doc_text")
    schema = T.StructType([*(T.StructField(k, T.LongType()) for k in _KEYS), T.StructField("item", T.BinaryType()), T.StructField("tiles", T.IntegerType()), T.StructField("covered", T.IntegerType()), T.StructField("coverage", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_pylist() for k in range(2)]
            out: list[list] = [[], [], [], [], [], []]
            for row in range(batch.num_rows):
                words = words_of(batch.column(4)[row].as_py())
                for item, text in zip(batch.column(2)[row].as_py(), batch.column(3)[row].as_py()):
                    target = words_of(text)
                    number, covered = overlap(words, target, min_match)
                    if number and covered >= coverage * len(target):
                        for column, value in zip(out, (keys[0][row], keys[1][row], item, number, covered, covered / len(target))):
                            column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=schema.names)

    found = materialize(met.mapInArrow(run, schema).distinct(), "tiling-overlaps")
    for table in (items, pairs, chunks):
        discard(table)
    return found


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """(id_col, item_id_col, tiles, covered, coverage) of pairs from ``coverage`` on."""
    found = overlaps(docs, benchmark, id_col=id_col, text_col=text_col, item_text_col=item_text_col, **how)
    names = benchmark.select(F.unhex(F.md5(F.col(item_text_col).cast("binary"))).alias("item"), F.col(item_id_col).alias("item_id"))
    rows = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text_col))
    joined = rows.join(found, _KEYS).join(names, "item")
    return joined.select(F.col("id").alias(id_col), F.col("item_id").alias(item_id_col), "tiles", "covered", "coverage")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that cover no benchmark item from ``coverage`` on."""
    found = overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(*_KEYS).distinct()
    rows = docs.select(F.struct("*").alias("row"), *_keys(id_col, text_col))
    return rows.join(found, _KEYS, "left_anti").select("row.*")
