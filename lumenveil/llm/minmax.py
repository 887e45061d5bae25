"""Near-duplicates found by min-max hashing, confirmed on whole shingle sets.

A permutation of the hash values orders a set's shingles; min-max hashing keeps both
ends of it. The least and the greatest shingle of a union are each equally likely to
be any of its members, so both agree between two sets with the probability of their
Jaccard similarity: half the permutations give the same number of values, and as the
two ends can hardly both be the same shingle, their mean varies less than that of
independent values. Bands of :data:`ROWS` values, each of other permutations, are keys.

With 40 bands of six values a pair of similarity 0.8 misses all keys five times in
a million, one of 0.85 three times in a thousand million. What meets in a key is
confirmed on the full sets:

* Sets that are equal are one node, so copies never meet as pairs.
* Keys that hold the same nodes are one bucket.
* Every node is first held against at most three pivots: the members of its buckets
  that come first in three orders, one by how many others a node meets. That links
  almost all of a group, with three comparisons a node however large the group.
* Buckets whose members are then in one component are done. In the others, the nodes
  outside the bucket's largest component meet all its members, in blocks. So each two
  nodes of a bucket are compared or already linked, and no link is lost.

Defined cases: words are what is between ASCII white space, with A-Z lowered; texts
with fewer words than a shingle have the whole sequence as one; a null, empty or
blank text has an empty set and is linked with nothing; a null id takes no part and
is kept; very long texts are read whole; of rows with the same id both are linked and
kept alike if their texts are; an empty table yields no rows; other columns are
ignored by :func:`near_duplicates` and kept by :func:`without_near_duplicates`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenveil.llm.components import components
from lumenveil.llm.textframe import compressed, decompressor, free_name, spread_join
from lumenveil.session import discard, materialize

SHINGLE_WORDS = 2
#: Least similarity, in hundredths.
PERCENT = 80
#: Bands, values of one band; permutations are half as many as values.
BANDS, ROWS = 40, 6
#: Texts and shingles of one block in the last comparison; comparisons of a pivot in one task.
BLOCK_TEXTS, BLOCK_SHINGLES, STAR_TEXTS = 256, 500_000, 250
#: Bytes of a text whose words are cut at a time, and shingles permuted at a time.
SLICE, PERMUTED = 1 << 20, 2048
BETWEEN = re.compile(rb"[\x20\x09-\x0D]")
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# -- sets and signatures --------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def _word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, cut slice by slice."""
    import xxhash

    out, at, digest = [], 0, xxhash.xxh3_64_intdigest
    while at < len(text):
        space = BETWEEN.search(text, at + SLICE)
        upto = space.start() if space else len(text)
        words = text[at:upto].lower().split()
        out.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        at = upto
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted hashes of the distinct n-word shingles of a UTF-8 text."""
    words = _word_hashes(text or b"")
    if not len(words):
        return words
    width = min(n, len(words))
    hashes = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        hashes = _mixed(hashes * _GOLD + words[k : len(words) - width + 1 + k])
    return np.unique(hashes)


@functools.lru_cache(maxsize=4)
def _permutations(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands: x -> a x + b permutes the 64-bit values."""
    dice = np.random.default_rng(1)
    a, b = dice.integers(0, 1 << 64, (2, number), np.uint64)
    return a | np.uint64(1), b


def signature(shingles: np.ndarray, number: int) -> np.ndarray:
    """The least values under ``number`` permutations, then the greatest ones."""
    a, b = _permutations(number)
    least, most = np.full(number, (1 << 64) - 1, np.uint64), np.zeros(number, np.uint64)
    for at in range(0, len(shingles), PERMUTED):
        values = shingles[at : at + PERMUTED, None] * a + b
        least, most = np.minimum(least, values.min(axis=0)), np.maximum(most, values.max(axis=0))
    return np.concatenate([least, most])


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key a band; the number of the band is part of it."""
    cut, keys = values.reshape(bands, rows), np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = _mixed(keys * _GOLD + cut[:, k])
    return keys


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of two signatures: the share of equal values."""
    return float((a == b).mean())


# -- nodes and buckets ----------------------------------------------------

_PRINT = "s1 long, s2 long, n long, keys array<bigint>"


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, bands: int, rows: int) -> DataFrame:
    """(id, text_key, s1, s2, n, keys): the set's 128-bit hash, size and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(2):
                found = shingle_set(text.as_py(), shingle_words)
                whole = xxhash.xxh3_128_digest(found.tobytes())
                keys = band_keys(signature(found, bands * rows // 2), bands, rows).view(np.int64).tolist() if len(found) else []
                for column, value in zip(out, (int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True), len(found), keys)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], names=["id", "text_key", "s1", "s2", "n", "keys"])

    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:2], *T.StructType.fromDDL(_PRINT)]))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, size, times): nodes that share a key; keys with the same nodes are one.

    size: nodes of the bucket; times: keys that hold just these.
    """
    entries = nodes.select(F.explode("keys").alias("key"), "node", "n")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"mark{seed}") for seed in (1, 2)]
    shared = entries.groupBy("key").agg(F.count("*").alias("size"), *marks).filter("size > 1")
    named = shared.groupBy("size", "mark1", "mark2").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    named = materialize(named.select("key", "size", "times"), "minmax-keys")
    return materialize(entries.join(named, "key"), "minmax-buckets")


def _star_edges(buckets: DataFrame) -> DataFrame:
    """(a, b): at most three pivots a of every node b, each from its buckets."""
    weights = buckets.groupBy("node").agg(F.sum(F.col("size") * F.col("times")).alias("weight"))
    orders = {"first0": (-F.col("weight"), F.col("node")), "first1": (F.xxhash64(F.lit(3), "node"), F.col("node")), "first2": (F.xxhash64(F.lit(4), "node"), F.col("node"))}
    placed = buckets.select("key", "node").join(weights, "node").select("key", "node", *(F.struct(x.alias("o"), y.alias("node")).alias(k) for k, (x, y) in orders.items()))
    pivots = materialize(placed.groupBy("key").agg(*(F.min(k).alias(k) for k in orders)), "minmax-pivots")
    chosen = buckets.select("key", "node").join(pivots, "key").groupBy("node").agg(*(F.min(k).alias(k) for k in orders))
    edges = chosen.select(F.explode(F.array_distinct(F.array(*(F.col(k)["node"] for k in orders)))).alias("a"), F.col("node").alias("b"))
    return materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minmax-edges")


def _texts(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text): the compressed texts of the nodes in buckets."""
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("least.id").alias("id"), F.col("least.text_key").alias("text_key"))
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    found = given.hint("merge").join(materialize(wanted, "minmax-wanted"), ["id", "text_key"]).select("node", "text")
    return materialize(compressed(found).dropDuplicates(["node"]), "minmax-texts")


# -- confirmation ---------------------------------------------------------

class _Block:
    """Sets held for comparison, by an index from shingle to set."""

    def __init__(self, nodes: list[int], roots: list[int], sets: list[np.ndarray]) -> None:
        self.nodes, self.roots, self.sizes = nodes, np.array(roots, np.int64), np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def common(self, other: np.ndarray) -> np.ndarray:
        """How many shingles each set shares with another."""
        first, behind = np.searchsorted(self.flat, other, "left"), np.searchsorted(self.flat, other, "right")
        number = behind - first
        at = np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum())
        return np.bincount(self.owner[at], minlength=len(self.nodes))

    def alike(self, other: np.ndarray, percent: int) -> np.ndarray:
        shared = self.common(other)
        return 100 * shared >= percent * (self.sizes + len(other) - shared)


def _confirmed(n: int, percent: int):
    """mapInArrow over (names..., side, node, root, text), sorted by names and side: links of each part.

    Side 0 is held, side 1 streams past it. Nodes of one root are not compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = decompressor()
        now, held, block, merged = None, [], None, {}

        def root(x: int) -> int:
            while merged.get(x, x) != x:
                merged[x] = x = merged.get(merged[x], merged[x])
            return x

        for batch in batches:
            out: list[tuple[int, int]] = []
            *names, sides, nodes, roots = (c.to_pylist() for c in batch.columns[:-1])
            for row, name in enumerate(zip(*names)):
                if name != now:
                    now, held, block, merged = name, [], None, {}
                shingles = shingle_set(grow(batch.column(batch.num_columns - 1)[row].as_py()), n)
                if sides[row] == 0:
                    held.append((nodes[row], roots[row], shingles))
                    continue
                if not held:
                    continue
                block = block or _Block(*map(list, zip(*held)))
                near = np.flatnonzero(block.alike(shingles, percent) & (block.roots != roots[row]))
                for k in near.tolist():
                    x, y = root(int(block.roots[k])), root(roots[row])
                    if x != y:
                        merged[x] = y
                        out.append((block.nodes[k], nodes[row]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], names=["a", "b"])

    return run


_LINK = "a long, b long"


def _star_links(edges: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are alike; each pivot's rows in parts of bounded size.

    The end with more edges is the pivot, which is held; the other ends stream past.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    ends = materialize(ends, "minmax-degrees")
    of = lambda c: ends.select(F.col("node").alias(c), F.col("degree").alias(f"{c}_degree"))
    turned = edges.join(of("a"), "a").join(of("b"), "b")
    first = F.col("a_degree") >= F.col("b_degree")
    parts = F.ceil(F.when(first, F.col("a_degree")).otherwise(F.col("b_degree")) / STAR_TEXTS).cast("int")
    rays = turned.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("pivot"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), parts.alias("parts"))
    rays = materialize(rays, "minmax-rays")
    streamed = rays.select("pivot", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), "node")
    held = rays.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("pivot").alias("node")).distinct()
    rows = streamed.unionByName(held).join(texts, "node").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "side")
    return rows.select("pivot", "part", "side", "node", F.col("node").alias("root"), "text").mapInArrow(_confirmed(n, percent), _LINK)


def _rest_links(buckets: DataFrame, roots: DataFrame, edges: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links inside buckets that the stars left in several components."""
    rooted = materialize(buckets.select("key", "node", "n", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minmax-rooted")
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.first("size").alias("size"))
    of = parts.groupBy("key").agg(
        F.count("*").alias("roots"), F.first("size").alias("size"), F.max(F.struct("members", "root"))["root"].alias("base"), F.max("members").alias("largest"),
        F.sum("shingles").alias("shingles"), F.min("lo").alias("a"), F.max("hi").alias("b"),
    ).filter("roots > 1")
    of = of.join(edges.withColumn("tested", F.lit(True)), ["a", "b"], "left").filter("size > 2 or tested is null")  # two that have met already
    blocks = lambda share: F.ceil(F.greatest(share / BLOCK_TEXTS, F.col("shingles") * share / F.col("size") / BLOCK_SHINGLES)).cast("int")
    of = materialize(of.select("key", "base", blocks(F.col("size") - F.col("largest")).alias("rows"), blocks(F.col("size")).alias("columns")), "minmax-rest")
    dealt = rooted.join(of, "key")
    place = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "node"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    held = dealt.filter("root <> base").select("key", place(5, "rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), "node", "root")
    streamed = dealt.select("key", every("rows").alias("i"), place(6, "columns").alias("j"), F.lit(1).alias("side"), "node", "root")
    rows = held.unionByName(streamed).join(texts, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return rows.select("key", "i", "j", "side", "node", "root", "text").mapInArrow(_confirmed(n, percent), _LINK)


def near_duplicates(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_shingles, component) of every row, as a table.

    component: the least id of all rows that links connect with the row.
    """
    prints = materialize(_prints(docs, id_col, text_col, shingle_words, bands, rows), "minmax-prints")
    sets = prints.filter("n > 0 and id is not null").groupBy("s1", "s2")
    nodes = sets.agg(F.min(F.struct("id", "text_key")).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "minmax-nodes")
    buckets = _buckets(nodes)
    edges = _star_edges(buckets)
    texts = _texts(docs, nodes, buckets, id_col, text_col)
    links = materialize(_star_links(edges, texts, shingle_words, percent), "minmax-links")
    rest = materialize(_rest_links(buckets, components(links), edges, texts, shingle_words, percent), "minmax-more")
    roots = components(links.unionByName(rest))
    named = nodes.select("node", "s1", "s2", "copies", F.col("least.id").alias("id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "minmax-named")
    least = materialize(named.groupBy("root").agg(F.min("id").alias("component")), "minmax-least")
    of = materialize(named.join(least, "root").select("s1", "s2", F.col("copies").alias("n"), "component"), "minmax-components")
    linked = spread_join(prints.filter("n > 0 and id is not null").select("id", "text_key", F.col("n").alias("n_shingles"), "s1", "s2"), of, ["s1", "s2"], "id")
    alone = prints.filter("n = 0 or id is null").select("id", "text_key", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    found = materialize(linked.select("id", "text_key", "n_shingles", "component").unionByName(alone), "minmax-found")
    for made in (prints, nodes, buckets, edges, texts, links, rest, named, least, of):
        discard(made)
    return found


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The given rows whose id is the least of their component, and those with a null id."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    gone = materialize(found.filter("id <> component").select("id", "text_key").distinct(), "minmax-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    return rows.join(gone, ["id", "text_key"], "left_anti").select("row.*")


#: All pairs that share a shingle, and the least id along links.
ORACLE_SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM cut
), grams AS (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets
), distinct_sets AS (
  SELECT min(doc_id) AS doc_id, list_sort(s) AS sorted FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), kept AS (
  SELECT g.* FROM grams g JOIN distinct_sets USING (doc_id)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM distinct_sets
  UNION
  SELECT e.b, r.root FROM reach r JOIN ways e ON e.a = r.doc_id WHERE r.root < e.b
), least AS (
  SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id
), roots AS (
  SELECT d.sorted, l.root FROM distinct_sets d JOIN least l USING (doc_id)
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, coalesce(r.root, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN roots r ON r.sorted = list_sort(s.s)
"""
