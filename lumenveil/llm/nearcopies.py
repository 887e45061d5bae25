"""Near copies by Golay keys of SimHash fingerprints, verified on word shingles.

Texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more. Such texts differ in about one bit of ten of a SimHash
over pairs of words, which is more than the four bits that :mod:`simhash` finds
in 64. So candidates come from PRINTS fingerprints of 64 bits: each of their
segments is decoded to the Golay codewords within 4 bits of it, and the codeword
indices of every two segments of a fingerprint make a key. By the pigeonhole
principle, differences that spread over three segments leave two of them with few,
and words that differ in at most two bits share a codeword. Texts with a common
key and fingerprints at most CANDIDATE_BITS apart are candidates.

Candidates are connected into clusters, and inside a cluster every two texts that
are not connected yet are compared by the exact similarity, in blocks of bounded
size. A class is what chains of verified links connect. Copies of one text meet in
an aggregation before all this. Rows of a key that are too many for one block are
dealt in a second pass, block by block, so none is left out.

Defined cases: texts without words are copies of each other; texts of fewer words
than a shingle are one shingle; a null id is in no class; repeated rows share their
class; very long texts are compared whole; equal ids with different texts are told
apart; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenveil.llm.components import components
from lumenveil.llm.simhash import SEGMENTS, Forest, codewords
from lumenveil.llm.textframe import compressed, decompressor, spread_join
from lumenveil.session import discard, materialize, shuffle_partitions

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Words of a feature of the fingerprints, and how many fingerprints of 64 bits a text has.
FEATURE_WORDS = 2
PRINTS = 2
#: Bits of all fingerprints in which candidates differ at most.
CANDIDATE_BITS = 26
#: Fingerprints of one key in a block; texts and words of a cluster in a block.
BLOCK = 2048
BLOCK_TEXTS = 256
BLOCK_WORDS = 1 << 20
#: Linked nodes that a task keeps before it hands on what it has.
FOREST_NODES = 200_000

_TEXT = ["t1", "t2"]
_PRINTS = ["fp0", "fp1"]
_PAIRS = ((0, 1), (0, 2), (1, 2))


# -- texts ----------------------------------------------------------------

def _features(words: list[bytes], n: int, digest) -> list:
    """``digest`` of every run of ``n`` words, of all words if they are fewer."""
    joined = b" ".join(words)
    if len(words) <= n:
        return [digest(joined)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    return [digest(joined[s:e]) for s, e in zip(starts.tolist(), (starts + lengths)[n - 1 :].tolist())]


def prints(text: bytes | None) -> tuple[int, int]:
    """The SimHash fingerprints of a UTF-8 text over its pairs of words."""
    import xxhash

    found = _features((text or b"").lower().split(), FEATURE_WORDS, xxhash.xxh3_128_digest)
    if not found:
        return 0, 0
    ones = np.zeros(64 * PRINTS, np.int64)
    for at in range(0, len(found), 1 << 14):
        part = np.frombuffer(b"".join(found[at : at + (1 << 14)]), np.uint8).reshape(-1, 8 * PRINTS)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    both = np.packbits(2 * ones > len(found), bitorder="little").view("<i8")
    return int(both[0]), int(both[1])


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    return np.unique(np.array(_features((text or b"").lower().split(), n, xxhash.xxh3_64_intdigest), np.uint64))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, t2, fp0, fp1, words) of every row; t1 and t2 tell texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prints(x.as_py()) for x in batch.column(3)]
            words = [len((x.as_py() or b"").split()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x[c] for x in found], pa.int64()) for c in range(2)), pa.array(words, pa.int64())], names=["id", *_TEXT, *_PRINTS, "words"])

    rows = _texts(docs, text_col, F.col(id_col).alias("id"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *(T.StructField(n, T.LongType()) for n in (*_PRINTS, "words"))]))


def _texts(docs: DataFrame, text_col: str, *others) -> DataFrame:
    return docs.select(*others, *text_keys(text_col), F.col(text_col).cast("binary").alias("text"))


def text_keys(text_col: str) -> list:
    """Two hashes, 128 bits together, of a text."""
    return [F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(7), text_col).alias("t2")]


# -- candidates -----------------------------------------------------------

def keys_of(fps: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): the codewords of every two segments of a fingerprint."""
    unsigned = fps.view(np.uint64)
    near = [codewords(((unsigned >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64), 4) for s, w in SEGMENTS]
    rows, keys = [], []
    for k, (i, j) in enumerate(_PAIRS):
        (a, na), (b, nb) = near[i], near[j]
        made = ((3 * tag + k) << 24) | (a[:, :, None] << 12) | b[:, None, :]
        real = (np.arange(a.shape[1])[None, :, None] < na[:, None, None]) & (np.arange(b.shape[1])[None, None, :] < nb[:, None, None])
        rows.append(np.nonzero(real)[0])
        keys.append(made[real])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                fps = [part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)]
                rows, keys = (np.concatenate(x) for x in zip(*(keys_of(f, tag) for tag, f in enumerate(fps))))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(f[rows]) for f in fps)], names=["key", *_PRINTS])

    return nodes.select(*_PRINTS).mapInArrow(run, "key long, fp0 long, fp1 long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints [..., 2]."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


class _Linker:
    """A forest of linked nodes; what it holds is handed on from time to time."""

    def __init__(self) -> None:
        self.forest, self.out = Forest(), []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(map(tuple, a.tolist()), map(tuple, b.tolist())):
            self.forest.link(x, y)
        if len(self.forest.parent) > FOREST_NODES:
            self.settle()

    def settle(self) -> None:
        pairs = [(x, self.forest.find(x)) for x in list(self.forest.parent)]
        self.out += [(*x, *y) for x, y in pairs if x != y]
        self.forest = Forest()

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


_EDGES = "a0 long, a1 long, b0 long, b1 long, key long"


def _edges(found: list[tuple], over: list[tuple]) -> pa.RecordBatch:
    """Links, and rows (fingerprints, key) that are too many for a block."""
    rows = [(*x, None) for x in found] + [(a, b, None, None, k) for k, a, b in over]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["a0", "a1", "b0", "b1", "key"])


def _link_rows(linker: _Linker, key: np.ndarray, fps: np.ndarray) -> None:
    """Links among rows sorted by key, each key with at most BLOCK rows."""
    runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    small = np.ones(len(key), bool)
    for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist()) if (np.diff(runs) > 64).any() else ():
        if hi - lo > 64:
            small[lo:hi] = False
            _link_block(linker, fps[lo:hi], fps[lo:hi])
    key, fps = key[small], fps[small]
    for step in range(1, 64):
        at = np.flatnonzero(key[step:] == key[:-step])
        if not len(at):
            break
        bits = _apart(fps[at], fps[at + step])
        near = at[(bits <= CANDIDATE_BITS) & (bits > 0)]
        linker.link(fps[near], fps[near + step])


def _link_block(linker: _Linker, left: np.ndarray, right: np.ndarray) -> None:
    """Links between two blocks; each row is linked once to each of the left rows' groups."""
    label = np.arange(len(left))
    for row in right:
        bits = _apart(left, row)
        near = np.flatnonzero((bits <= CANDIDATE_BITS) & (bits > 0))
        if not len(near):
            continue
        groups, first = np.unique(label[near], return_index=True)
        linker.link(left[near[first]], np.broadcast_to(row, (len(first), 2)))
        if len(groups) > 1:
            label[np.isin(label, groups)] = groups[0]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (key, fp0, fp1) sorted by key."""
    linker, key, fps, over = _Linker(), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        key, fps = np.concatenate([key, columns[0]]), np.concatenate([fps, np.stack(columns[1:], axis=1)])
        if not len(key):
            continue
        spilled: list[tuple] = []
        if over is not None:  # more rows of a key that is dealt in the second pass
            upto = int(np.searchsorted(key, over, "right"))
            spilled += [(over, *x) for x in fps[:upto].tolist()]
            key, fps = key[upto:], fps[upto:]
            over = over if not len(key) else None
        runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        keep = np.ones(len(key), bool)
        for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist()) if (np.diff(runs) > BLOCK).any() else ():
            if hi - lo > BLOCK:
                spilled += [(int(key[lo]), *x) for x in fps[lo:hi].tolist()]
                keep[lo:hi] = False
                over = int(key[lo]) if hi == len(key) else over
        key, fps = key[keep], fps[keep]
        done = int(np.searchsorted(key, key[-1])) if len(key) and over is None else len(key)  # the last key may go on
        _link_rows(linker, key[:done], fps[:done])
        key, fps = key[done:], fps[done:]
        yield _edges(linker.take(), spilled)
    _link_rows(linker, key, fps)
    linker.settle()
    yield _edges(linker.take(), [])


def _linked_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (key, i, j, side, fp0, fp1), sorted: block i, then block j to meet it."""
    linker, now, left = _Linker(), None, np.zeros((0, 2), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        names, fps = np.stack(columns[:4], axis=1), np.stack(columns[4:], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            name, side = tuple(names[lo, :3].tolist()), names[lo, 3]
            if name != now:
                now, left = name, np.zeros((0, 2), np.int64)
            if side == 0:
                left = np.concatenate([left, fps[lo:hi]])
            else:
                _link_block(linker, left, fps[lo:hi])
        yield _edges(linker.take(), [])
    linker.settle()
    yield _edges(linker.take(), [])


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a0, a1, b0, b1): links that connect the candidates among fingerprints (fp0, fp1)."""
    number = max(shuffle_partitions(nodes.sparkSession), -(-nodes.count() // 50_000))  # a row becomes 200
    keyed = _keyed(nodes.repartition(number, F.xxhash64(F.lit(3), *_PRINTS)))
    found = materialize(keyed.repartition(number, "key").sortWithinPartitions("key").mapInArrow(_linked, _EDGES), "near-edges")
    links = found.filter("key is null").select("a0", "a1", "b0", "b1")
    over = found.filter("key is not null").select("key", F.col("a0").alias("fp0"), F.col("a1").alias("fp1"))
    parts = over.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = over.join(parts, "key").withColumn("part", F.pmod(F.xxhash64(*_PRINTS), "parts").cast("int"))
    left = dealt.select("key", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), *_PRINTS)
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), *_PRINTS)
    order = ["key", "i", "j", "side"]
    second = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions(*order).mapInArrow(_linked_parts, _EDGES)
    return links.unionByName(second.select("a0", "a1", "b0", "b1"))


# -- verification ---------------------------------------------------------

def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[left, right]: how many shingles the sets have in common, by products of 0/1 blocks."""
    both = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    shared = np.intersect1d(*map(np.unique, both))
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    placed = []
    for sets, flat in zip((left, right), both):
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        placed.append((np.repeat(np.arange(len(sets)), list(map(len, sets)))[hit], at[hit]))
    for first in range(0, len(shared), 2048):
        blocks = []
        for (rows, columns), sets in zip(placed, (left, right)):
            part = (columns >= first) & (columns < first + 2048)
            block = np.zeros((len(sets), min(2048, len(shared) - first)), np.float32)
            block[rows[part], columns[part] - first] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def _verified(n: int, similarity: float):
    """mapInArrow over (cluster, i, j, side, t1, text), sorted: links of a block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right = None, [], []
        grow = decompressor()

        def links() -> list[tuple[int, int]]:
            forest, out = Forest(), []
            mine, theirs = [s for _, s in left], [s for _, s in (right or left)]
            sizes = [np.array(list(map(len, x)), np.float32) for x in (mine, theirs)]
            common = common_counts(mine, theirs)
            union = sizes[0][:, None] + sizes[1][None, :] - common
            for a, b in zip(*np.nonzero((common >= similarity * union) | (union == 0))):
                x, y = left[a][0], (right or left)[b][0]
                if x != y and forest.find(x) != forest.find(y):
                    forest.link(x, y)
                    out.append((x, y))
            return out

        def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(2)], names=["a", "b"])

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            sides, ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for row, name in enumerate(names):
                if name != now:
                    if left:
                        yield emit(links())
                    now, left, right = name, [], []
                (right if sides[row] else left).append((ids[row], shingles(grow(batch.column(5)[row].as_py()), n)))
        if left:
            yield emit(links())

    return run


def _verified_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b): links by t1 between texts of one cluster; members: (cluster, least, t1, t2, words)."""
    texts = compressed(_texts(docs, text_col, F.col(id_col).alias("least"))).hint("merge").join(members, ["least", *_TEXT]).dropDuplicates(_TEXT)
    texts = materialize(texts.select("cluster", *_TEXT, "words", "text"), "near-texts")
    sizes = texts.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("words") / BLOCK_WORDS, F.count("*") / BLOCK_TEXTS)).cast("int").alias("parts"))
    dealt = texts.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64(F.lit(5), *_TEXT), "parts").cast("int"))
    left = dealt.select("cluster", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), "t1", "text")
    right = dealt.filter("part > 0").select("cluster", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"), "t1", "text")
    order = ["cluster", "i", "j", "side"]
    both = left.unionByName(right).repartition("cluster", "i", "j").sortWithinPartitions(*order)
    return both.select(*order, "t1", "text").mapInArrow(_verified(shingle_words, similarity), "a long, b long")


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The given rows, one of each class; of a row that is repeated one stays.

    Rows with a null id all stay.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **how)
    keys = ["id", *_TEXT]
    gone = found.filter(F.struct(F.col("id").alias("least"), *_TEXT) != F.col("keeper")).select(*keys).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), *text_keys(text_col)).hint("merge").join(materialize(gone, "near-gone"), keys, "left_anti")
    repeated = materialize(found.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "near-repeated")
    if repeated.isEmpty():
        return rows.select("row.*")
    once = rows.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row"))  # combined before it is shuffled
    return rows.join(repeated, keys, "left_anti").select("row").unionByName(once.select("row")).select("row.*")


def classes(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t1, t2, keeper) of every row with an id, as a table.

    keeper, a struct<least, t1, t2>, is the row of least id (then least text hash)
    of the row's class: of all rows that copies and near copies connect.
    """
    marked = materialize(_marked(docs, id_col, text_col).filter("id is not null"), "near-prints")
    texts = materialize(marked.groupBy(*_TEXT, *_PRINTS).agg(F.min("id").alias("least"), F.first("words").alias("words"), F.count("*").alias("n")), "near-distinct")
    nodes = texts.groupBy(*_PRINTS).agg(F.count("*").alias("texts"))
    nodes = materialize(nodes, "near-nodes")
    name = lambda a, b: F.xxhash64(F.lit(9), a, b)
    roots = components(candidate_links(nodes).select(name("a0", "a1").alias("a"), name("b0", "b1").alias("b")))
    named = nodes.withColumn("node", name(*_PRINTS)).join(roots, "node", "left").filter("root is not null or texts > 1")
    clusters = materialize(named.select(*_PRINTS, F.coalesce("root", "node").alias("cluster")), "near-clusters")
    members = materialize(texts.join(clusters, _PRINTS).select("cluster", "least", "words", *_TEXT), "near-members")
    linked = components(_verified_links(members, docs, id_col, text_col, shingle_words, similarity)).withColumnRenamed("node", "t1")
    joined = texts.join(linked, "t1", "left").withColumn("root", F.coalesce("root", "t1"))
    keepers = materialize(joined.groupBy("root").agg(F.min(F.struct("least", *_TEXT)).alias("keeper")), "near-keepers")
    kept = materialize(joined.join(keepers, "root").select(*_TEXT, "keeper", "n"), "near-kept")
    found = materialize(spread_join(marked.select("id", *_TEXT), kept, _TEXT, "id").select("id", *_TEXT, "keeper"), "near-classes")
    for table in (marked, texts, nodes, clusters, members, keepers, kept):
        discard(table)
    return found
