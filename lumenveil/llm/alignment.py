"""Alignment of two tokenizers over a corpus, scored by a cogroup of postings.

Both tokenizers read every text; the byte offsets where tokens of both end cut the
tokens into groups, and tokens whose bytes overlap are linked. A pair of ids counts
in as many documents as hold it linked. Against these corpus-wide counts each
document is rated: how many of its links have the commonest partner of their id
on side A, and how high its links' counts are.

* Very long texts are cut where both tokenizers must cut, at a single space between
  two other characters. That is exact: the first tokenizer's pattern begins a word at
  such a space, and no piece of the second holds a space after another character.
* Documents are dealt in blocks. A block's multiplicities of linked pairs become
  postings, one row for a pair and block, with the numbers of the documents inside
  the block and how often each holds the pair.
* Postings are shuffled by side id (in :data:`SHARDS` shards of ids), and the
  pairs' sums of documents beside them. Sorted by id, a stream brings an id's sums
  first, of which there are no more than the other vocabulary has ids: they give
  the counts and the maximum. Then come the id's postings, which turn into
  contributions to their documents; these are summed by document.

A shard is split by blocks into parts of bounded size, so an id that a third of all
documents hold is spread; only the sums, bounded by the vocabularies, are copied to
each part. Sorting spills; a task holds one id's sums and the totals of a bounded
number of documents.

Defined cases: a null or empty text, or one whose bytes a tokenizer does not give
back (it holds the mark that stands for a space), has no tokens: zeros and an empty
groups_sha256; strings of special tokens are plain text; very long texts are read
whole, part by part; every row is a document, also one that repeats another; rows
with a null id are kept; an empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenveil.llm.packing import _encoding
from lumenveil.session import materialize

SIDE_A, SIDE_B = "byte_bpe_50k", "piece_bpe_32k"
#: Postings and documents of one block (places in a block are 16 bits wide).
BLOCK_POSTINGS, BLOCK_DOCUMENTS = 2_000_000, 65_536
#: Shards of side ids; a document gets at most one contribution from a task.
SHARDS = 16
#: Bytes of postings in one part of a shard.
PART_BYTES = 32 << 20
#: Documents whose totals a task holds before it hands them on.
HELD_DOCUMENTS = 1 << 20
#: Characters after which a very long text is cut.
PART_CHARS = 1 << 18
#: A space between two characters that are no white space: both tokenizers cut here.
CUT = re.compile(r"(?<=\S)(?= \S)")


# -- one text -------------------------------------------------------------

@functools.lru_cache(maxsize=2)
def _pieces(vocabulary: str):
    """(model, bytes of each id) of the sentencepiece vocabulary named."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{vocabulary}.model"))
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a piece holds a space after another character, so texts cannot be cut at spaces")
    return model, [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Aligner:
    """Two tokenizers and the alignment of what they make of a text."""

    def __init__(self, side_a: str = SIDE_A, side_b: str = SIDE_B) -> None:
        self.a = _encoding(side_a)
        self.b, self.bytes_b = _pieces(side_b)
        self.length_a = np.array([self._length(i) for i in range(self.a.n_vocab)], np.int64)
        self.length_b = np.array(list(map(len, self.bytes_b)), np.int64)
        #: [id, ends its group]: the id as it is written there.
        self.written_a, self.written_b = (np.array([[f"{i},", f"{i}{end}"] for i in range(n)], object) for n, end in ((len(self.length_a), "|"), (len(self.length_b), ";")))

    def _length(self, token: int) -> int:
        try:
            return len(self.a.decode_single_token_bytes(token))
        except KeyError:  # an id that the vocabulary leaves free
            return 0

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of a text that begins with a space; None if one does not give it back."""
        a, b = self.a.encode_ordinary(text), self.b.encode(text[1:])
        raw = text.encode()
        if self.a.decode_bytes(a) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int, str]:
        """(linked pairs as a << 32 | b, number of groups, written groups) of two tokenizations.

        Between two neighbouring ends of either side lies one token of each: these
        are the linked ones. Groups end where both sides have an end.
        """
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        cuts = np.union1d(ends_a, ends_b)
        pairs = (a[np.searchsorted(ends_a, cuts)] << 32) | b[np.searchsorted(ends_b, cuts)]
        closes_a, closes_b = (x[np.searchsorted(x, y)] == y for x, y in ((ends_b, ends_a), (ends_a, ends_b)))
        upto_a, upto_b = (np.flatnonzero(x) + 1 for x in (closes_a, closes_b))  # tokens up to the end of each group
        of_a, of_b = (np.cumsum(x) - x for x in (closes_a, closes_b))  # the group of each token
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + np.concatenate([[0], upto_b])[of_a]] = self.written_a[a, closes_a.astype(int)]
        parts[np.arange(len(b)) + upto_a[of_b]] = self.written_b[b, closes_b.astype(int)]
        return pairs, len(upto_a), "".join(parts.tolist())[:-1]

    def document(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, different pairs, how often each is linked)."""
        sums, digest, linked = np.zeros(4, np.int64), hashlib.sha256(), []
        none = np.zeros(0, np.int64)
        for k, part in enumerate(_parts(f" {text}")) if text else ():
            found = self.tokens(part)
            if found is None:
                linked = []
                break
            pairs, groups, written = self.links(*found)
            sums += len(found[0]), len(found[1]), groups, len(pairs)
            digest.update(f"{';' if k else ''}{written}".encode())
            linked.append(np.stack(np.unique(pairs, return_counts=True)))
        if not linked:
            return 0, 0, 0, 0, "", none, none
        pairs, times = linked[0] if len(linked) == 1 else _added(np.concatenate(linked, axis=1))
        return *sums.tolist(), digest.hexdigest(), pairs, times


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about PART_CHARS, cut where both tokenizers must cut."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + PART_CHARS)
        upto = cut.start() if cut else len(text)
        yield text[at:upto]
        at = upto


def _added(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and their numbers, equal pairs added."""
    pairs, at = np.unique(found[0], return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, at, found[1])
    return pairs, times


# -- blocks of documents --------------------------------------------------

_DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "a int, b int, n int, places binary, times binary"


def _postings(pairs: list[np.ndarray], times: list[np.ndarray]) -> list[pa.Array]:
    """Postings of a block whose k-th document has pairs[k], each times[k] times."""
    sizes = np.fromiter(map(len, pairs), np.int64, len(pairs))
    key, often = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, times))
    order = np.argsort(key, kind="stable")
    key, often = key[order], often[order]
    place = np.repeat(np.arange(len(pairs)), sizes)[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)

    def cut(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    firsts = key[cuts[:-1]]
    return [pa.array(firsts >> 32, pa.int32()), pa.array(firsts & 0xFFFFFFFF, pa.int32()), pa.array(np.diff(cuts), pa.int32()), cut(place.astype("<u2")), cut(often.astype("<u4"))]


def _blocks(docs: DataFrame, side_a: str, side_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds, written by the same run: documents (place is set) and postings."""
    from pyspark.sql.pandas.types import to_arrow_schema

    about, posting = (T.StructType.fromDDL(x) for x in (_DOCUMENT, _POSTING))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("id", docs.schema[id_col].dataType), *about, *posting])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fields = to_arrow_schema(schema)
        aligner, block, place, held = Aligner(side_a, side_b), TaskContext.get().partitionId() << 32, 0, 0
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def batch_of(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)

        def documents(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
            columns = dict(zip(["block", "place", *about.names], map(pa.array, zip(*rows))))
            return batch_of(len(rows), columns | {"id": ids})

        def postings() -> pa.RecordBatch:
            found = _postings(pairs, times)
            n = len(found[0])
            return batch_of(n, dict(zip(posting.names, found)) | {"block": pa.array(np.full(n, block))})

        for batch in batches:
            rows, first = [], 0
            for at, text in enumerate(batch.column(1)):
                *told, found, often = aligner.document(text.as_py())
                rows.append((block, place, *told))
                pairs.append(found)
                times.append(often)
                place, held = place + 1, held + len(found)
                if held >= BLOCK_POSTINGS or place == BLOCK_DOCUMENTS:
                    yield documents(rows, batch.column(0).slice(first, len(rows)))
                    yield postings()
                    rows, first, block, place, held, pairs, times = [], at + 1, block + 1, 0, 0, [], []
            if rows:
                yield documents(rows, batch.column(0).slice(first, len(rows)))
        if place:
            yield postings()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# -- the cogroup ----------------------------------------------------------

class _Totals:
    """Contributions to documents, summed for as many as a task may hold."""

    def __init__(self) -> None:
        self.blocks: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, block: int, places: np.ndarray, times: np.ndarray, count: int, best: bool) -> None:
        had = self.blocks.get(block)
        top = int(places[-1]) + 1  # a posting's places ascend
        if had is None or had.shape[1] < top:
            new = np.zeros((2, min(BLOCK_DOCUMENTS, 2 * top)), np.int64)
            if had is not None:
                new[:, : had.shape[1]] = had
                self.size -= had.shape[1]
            had = self.blocks[block] = new
            self.size += new.shape[1]
        if best:
            had[0, places] += times
        had[1, places] += times * count

    def taken(self) -> Iterator[pa.RecordBatch]:
        for block, sums in self.blocks.items():
            at = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at, pa.int32()), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["block", "place", "n_best", "count_sum"])
        self.blocks, self.size = {}, 0


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (a, b, n, block, places, times) sorted by (a, sums before postings)."""
    totals, now, counts, most = _Totals(), None, {}, 0
    for batch in batches:
        a, b, n, block = (batch.column(k).to_pylist() for k in range(4))
        places, times = batch.column(4), batch.column(5)
        for row in range(len(a)):
            if a[row] != now:
                now, counts, most = a[row], {}, 0
            if block[row] is None:
                counts[b[row]] = n[row]
                most = max(most, n[row])
            else:
                count = counts[b[row]]
                totals.add(block[row], np.frombuffer(places[row].as_buffer(), "<u2"), np.frombuffer(times[row].as_buffer(), "<u4").astype(np.int64), count, count == most)
        if totals.size > HELD_DOCUMENTS:
            yield from totals.taken()
    yield from totals.taken()


def _rated(postings: DataFrame) -> DataFrame:
    """(block, place, n_best, count_sum) of every document that has links."""
    sums = materialize(postings.groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("n")), "alignment-sums")
    shard = F.pmod(F.xxhash64("a"), F.lit(SHARDS)).cast("int")
    weighed = postings.groupBy(shard.alias("shard")).agg(F.sum(6 * F.col("n").cast("long") + 24).alias("bytes")).collect()  # SHARDS rows
    parts = {r.shard: max(1, -(-r.bytes // PART_BYTES)) for r in weighed}
    if not parts:
        return postings.sparkSession.createDataFrame([], "block long, place int, n_best long, count_sum long")
    number = F.create_map(*(F.lit(x) for k in sorted(parts) for x in (k, int(parts[k]))))[F.col("shard")]
    dealt = postings.withColumn("shard", shard).select("shard", F.pmod(F.xxhash64("block"), number).cast("int").alias("part"), "a", F.lit(1).alias("kind"), "b", F.col("n").cast("long").alias("n"), "block", "places", "times")
    copied = sums.withColumn("shard", shard).select("shard", F.explode(F.sequence(F.lit(0), number.cast("int") - 1)).alias("part"), "a", F.lit(0).alias("kind"), "b", "n")
    both = dealt.unionByName(copied, allowMissingColumns=True).repartition(max(sum(parts.values()), len(parts)), "shard", "part")
    streams = both.sortWithinPartitions("a", "kind", "part").select("a", "b", "n", "block", "places", "times")
    found = streams.mapInArrow(_contributions, "block long, place int, n_best long, count_sum long")
    return found.groupBy("block", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(docs: DataFrame, *, side_a: str = SIDE_A, side_b: str = SIDE_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    side_a: a byte-level BPE vocabulary; side_b: a sentencepiece model that adds a
    space in front and falls back to bytes; both by their names.
    """
    blocks = materialize(_blocks(docs, side_a, side_b, id_col, text_col), "alignment-blocks")
    told = blocks.filter("place is not null").select("block", "place", F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    rated = _rated(blocks.filter("place is null").select("block", "a", "b", "n", "places", "times"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.join(rated, ["block", "place"], "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def pair_counts(docs: DataFrame, *, side_a: str = SIDE_A, side_b: str = SIDE_B, text_col: str = "text") -> DataFrame:
    """(a, b, n): in how many rows each pair of ids is linked."""
    postings = _blocks(docs.select(text_col), side_a, side_b, text_col, text_col).filter("place is null")
    return postings.groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("n"))
