"""Repeated word spans by compaction of a word-level de Bruijn graph.

The edges of the graph are the windows of ``k`` consecutive words of every
document. Following the bucketed compaction of large genome graphs, edges are
gathered by their minimizer - the least hash among the words' ``m``-grams in the
window - so a run of windows with one minimizer, a *path*, is one row: its
minimizer, a digest of all words it spans, and its source coordinates.

* A minimizer that occurs in one document only has no repeated edge.
* A repeated minimizer whose paths all have one digest does not branch inside.
  Joining each of its occurrences to the one that begins where it ends gives its
  successors. Where all occurrences of one minimizer are followed by a second one
  and all of that one's are preceded by the first, the two are one nonbranching
  path; such links are compacted by joins that double their reach, and a
  compacted path keeps one row an occurrence.
* Where paths branch, each distinct path is expanded once, at the source
  coordinates of one occurrence, into its window digests; the first source of each
  window is found by joining on minimizer and window digest, and neighbouring
  windows with neighbouring sources are one run again.

Every repeated span found so names its source's coordinates. The words there are
read, and the span is removed only if 128 bits of SHA-256 of both are equal.

Defined cases: a null or empty text, or one with fewer than k words, has no
window; a document id that occurs in several rows is no source for itself; a
null id is neither a source nor changed; of several sources of one id any serves;
very long texts give more paths, each of at most k - m + 1 windows; rows that
repeat one id and text get equal results; an empty table yields no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenveil.llm.textframe import FLUSH_ROWS, compressed, decompressor, emit, keyed_texts
from lumenveil.session import materialize, temporary_tables

WINDOW_WORDS = 50
MINIMIZER_WORDS = 12
#: Odd multipliers of the polynomial and of the final mix.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(words: list[bytes], m: int) -> np.ndarray:
    """A 64-bit hash of every ``m`` consecutive words."""
    import xxhash

    one = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    out, length, power, base = None, 0, one, _BASE
    width = 1
    while m:  # joins blocks of 1, 2, 4, ... words
        if m & 1:
            if out is None:
                out, length = power, width
            else:
                n = len(one) - length - width + 1
                with np.errstate(over="ignore"):
                    out = out[:n] * base + power[length : length + n]
                length += width
        m >>= 1
        if m:
            with np.errstate(over="ignore"):
                power = power[: len(power) - width] * base + power[width:]
                base = base * base
            width *= 2
    with np.errstate(over="ignore"):
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return out ^ (out >> np.uint64(29))


def _spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space; where each starts and ends."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def paths_of(words: list[bytes], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Minimizers, first windows, numbers of windows and digests of the paths.

    A run of windows with one minimizer is cut after every k - m + 1 windows.
    """
    import xxhash

    least = _window_minima(_gram_hashes(words, m), k - m + 1)
    edges = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    within = np.arange(len(least)) - np.repeat(edges, np.diff(np.concatenate([edges, [len(least)]])))
    first = np.flatnonzero(within % (k - m + 1) == 0)
    number = np.diff(np.concatenate([first, [len(least)]]))
    joined, starts, ends = _spans(words)
    digest = xxhash.xxh3_64_intdigest
    bodies = [digest(joined[s:e]) for s, e in zip(starts[first].tolist(), ends[first + number + k - 2].tolist())]
    return least[first], first, number, bodies


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def paths(texts: DataFrame, k: int, m: int) -> DataFrame:
    """(id, text_key, minimizer, body, first, number): all paths of all texts."""
    schema = T.StructType(
        [texts.schema["id"], T.StructField("text_key", T.LongType()), T.StructField("minimizer", T.LongType()), T.StructField("body", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("number", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []

            def flush() -> pa.RecordBatch:
                rows = pa.array(np.concatenate([np.full(len(x[1]), x[0]) for x in parts]), pa.int64())
                columns = [pa.array(_signed(np.concatenate([np.asarray(x[c], np.uint64) for x in parts]))) for c in (1, 4)]
                columns += [pa.array(np.concatenate([x[c] for x in parts]), pa.int32()) for c in (2, 3)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names=schema.names)

            held = 0
            for row, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) < k or not batch.column(0)[row].is_valid:
                    continue
                found = paths_of(words, k, m)
                parts.append((row, *found))
                held += len(found[0])
                if held > FLUSH_ROWS:
                    yield flush()
                    parts, held = [], 0
            if parts:
                yield flush()

    return texts.mapInArrow(run, schema)


def _expand(reps: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(minimizer, body, at, window): digests of the windows of path classes.

    reps: (minimizer, body, id, text_key, first, number), one per class.
    """
    wanted = reps.groupBy("id", "text_key").agg(F.collect_list(F.struct("minimizer", "body", "first", "number")).alias("wanted"))
    joined = wanted.join(compressed(texts), ["id", "text_key"]).select("wanted", "text")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("minimizer", "body")] + [T.StructField("at", T.IntegerType()), T.StructField("window", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, grow = xxhash.xxh64_intdigest, decompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for wanted, text in zip(batch.column(0), batch.column(1)):
                joined, starts, ends = _spans(grow(text.as_py()).split())
                starts, ends = starts.tolist(), ends.tolist()
                for path in wanted.as_py():
                    n = path["number"]
                    out[0] += [path["minimizer"]] * n
                    out[1] += [path["body"]] * n
                    out[2] += range(n)
                    out[3] += [digest(joined[starts[i] : ends[i + k - 1]]) for i in range(path["first"], path["first"] + n)]
                if len(out[0]) > FLUSH_ROWS:
                    out[3] = _signed(out[3])
                    yield emit(out, None, schema)
                    out = [[], [], [], []]
            if out[0]:
                out[3] = _signed(out[3])
                yield emit(out, None, schema)

    return joined.mapInArrow(run, schema)


def _unitigs(places: DataFrame) -> DataFrame:
    """(minimizer, number, source): compacted nonbranching paths, by their first minimizer.

    places: (minimizer, id, text_key, first, number, successor), a written table.
    source is the occurrence with the least id. No chain of links is a cycle,
    because the last path of a text has no successor.
    """
    units = places.groupBy("minimizer").agg(
        F.count("*").alias("n"), F.count("successor").alias("followed"), F.min("successor").alias("s0"), F.max("successor").alias("s1"),
        F.max("number").alias("number"), F.min(F.struct("id", "text_key", "first")).alias("source"),
    )
    units = materialize(units, "debruijn-units")
    onward = units.filter("followed = n and s0 = s1").select(F.col("minimizer").alias("head"), F.col("s0").alias("minimizer"), F.col("n").alias("preceded"), F.col("number").alias("offset"))
    # As many occurrences of the pair as of either: out-degree and in-degree are one.
    links = materialize(onward.join(units, "minimizer").filter("preceded = n").select("minimizer", "head", "offset", "number"), "debruijn-links")
    inner = links.select("minimizer")
    starts = links.select(F.col("head").alias("minimizer")).join(inner, "minimizer", "left_anti").select("minimizer", F.col("minimizer").alias("head"), F.lit(0).alias("offset"), F.lit(0).alias("number"), F.lit(True).alias("done"))
    state = materialize(links.withColumn("done", F.lit(False)).unionByName(starts), "debruijn-chains")
    while not (reaching := state.filter("not done")).isEmpty():
        beyond = state.select(F.col("minimizer").alias("head"), F.col("head").alias("farther"), F.col("offset").alias("more"), F.col("done").alias("ends"))
        stepped = reaching.join(beyond, "head").select("minimizer", F.col("farther").alias("head"), (F.col("offset") + F.col("more")).alias("offset"), "number", F.col("ends").alias("done"))
        state = materialize(state.filter("done").unionByName(stepped), "debruijn-chains")
    whole = state.groupBy(F.col("head").alias("minimizer")).agg(F.max(F.col("offset") + F.col("number")).alias("total"))
    heads = units.join(inner, "minimizer", "left_anti").join(whole, "minimizer", "left")
    return heads.select("minimizer", F.coalesce("total", "number").alias("number"), "source")


def _branches(forks: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(minimizer, body, at, number, source): runs of windows of branching paths.

    forks: (minimizer, body, id, text_key, first, number). A run begins at window
    ``at`` of its path; source is where its words begin in the least id.
    """
    classes = forks.groupBy("minimizer", "body").agg(F.min(F.struct("id", "text_key", "first", "number")).alias("source"))
    classes = materialize(classes.select("minimizer", "body", "source.*"), "debruijn-classes")
    windows = materialize(_expand(classes, texts, k).distinct(), "debruijn-windows")  # a row may be there twice
    owned = windows.join(classes, ["minimizer", "body"])
    origin = F.struct("id", "text_key", (F.col("first") + F.col("at")).alias("first"))
    earliest = materialize(owned.groupBy("minimizer", "window").agg(F.min(origin).alias("source")), "debruijn-earliest")
    fates = windows.join(earliest, ["minimizer", "window"]).withColumn("shift", F.col("source.first") - F.col("at"))
    same = ["minimizer", "body", "source.id", "source.text_key", "shift"]
    # A path has at most k - m + 1 windows, so these partitions are small.
    island = F.col("at") - F.row_number().over(Window.partitionBy(*same).orderBy("at"))
    runs = fates.withColumn("island", island).groupBy(*same, "island").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("number"))
    source = F.struct("id", "text_key", (F.col("shift") + F.col("at")).alias("first"))
    return runs.select("minimizer", "body", "at", "number", source.alias("source"))


def _claims(texts: DataFrame, k: int, m: int) -> DataFrame:
    """(id, text_key, first, number, source): runs of windows found in an earlier document."""
    found = materialize(paths(texts, k, m), "debruijn-paths")
    by_minimizer = found.groupBy("minimizer").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.min("body").alias("body0"), F.max("body").alias("body1")
    )
    # Sides of joins on keys that may be hot are written first: a join of plain
    # tables can split the rows of one key among tasks.
    repeated = by_minimizer.filter("least < most").select("minimizer", (F.col("body0") != F.col("body1")).alias("branches"))
    shared = materialize(found.join(materialize(repeated, "debruijn-minimizers"), "minimizer"), "debruijn-shared")

    plain = shared.filter("not branches").select("minimizer", "id", "text_key", "first", "number").distinct()
    after = plain.select("id", "text_key", F.col("first").alias("end"), F.col("minimizer").alias("successor"))
    places = plain.withColumn("end", F.col("first") + F.col("number")).join(after, ["id", "text_key", "end"], "left").drop("end")
    places = materialize(places, "debruijn-places")
    unitigs = materialize(_unitigs(places), "debruijn-unitigs")
    whole = places.drop("number", "successor").join(unitigs, "minimizer").filter("source.id < id")

    forks = shared.filter("branches").drop("branches")
    runs = materialize(_branches(forks, texts, k), "debruijn-runs")
    forked = forks.drop("number").join(runs, ["minimizer", "body"]).filter("source.id < id")
    columns = ["id", "text_key", "first", "number", "source"]
    return whole.select(*columns).unionByName(forked.withColumn("first", F.col("first") + F.col("at")).select(*columns))


def _seal(words: bytes) -> bytes:
    """128 bits of SHA-256 of words that one space joins."""
    return hashlib.sha256(words).digest()[:16]


def _sealed(claims: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(source, number, seal): what the words at the sources' coordinates are."""
    asked = claims.select("source.*", "number").distinct()
    asked = asked.groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "number")).alias("asked"))
    joined = asked.join(compressed(texts), ["id", "text_key"]).select("id", "text_key", "asked.first", "asked.number", "text")
    schema = T.StructType([claims.schema["id"], T.StructField("text_key", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("seal", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = decompressor()
        for batch in batches:
            ids, keys, firsts, numbers, texts = batch.columns
            for row in range(batch.num_rows):
                joined, starts, ends = _spans(grow(texts[row].as_py()).split())
                at, number = firsts[row].values, numbers[row].values
                first = at.to_numpy()
                seals = [_seal(joined[s:e]) for s, e in zip(starts[first].tolist(), ends[first + number.to_numpy() + k - 2].tolist())]
                same = pa.array(np.full(len(seals), row))
                yield pa.RecordBatch.from_arrays([ids.take(same), keys.take(same), at, number, pa.array(seals, pa.binary())], names=schema.names)

    seals = joined.mapInArrow(run, schema).distinct()  # a row may be there twice
    return seals.select(F.struct("id", "text_key", "first").alias("source"), "number", "seal")


def repeated_runs(docs: DataFrame, *, k: int = WINDOW_WORDS, m: int = MINIMIZER_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, first, number, seal): runs of windows seen in an earlier document.

    Every window whose words also form a window of a document with a smaller id
    is in exactly one run; seal tells the words at the run's source.
    """
    texts = keyed_texts(docs, id_col, text_col)
    with temporary_tables(docs.sparkSession):
        claims = materialize(_claims(texts, k, m), "debruijn-claims")
        seals = materialize(_sealed(claims, texts, k), "debruijn-seals")
        return materialize(claims.join(seals, ["source", "number"]).drop("source"), "debruijn-spans")


def without_repeats(docs: DataFrame, *, k: int = WINDOW_WORDS, m: int = MINIMIZER_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept, spans) of every row.

    A run is removed if its words are those at its source's coordinates. kept holds the words outside the repeated windows, joined by one space; spans
    the maximal removed spans as structs of their first word and word count.
    """
    runs = repeated_runs(docs, k=k, m=m, id_col=id_col, text_col=text_col)
    per_text = runs.groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "number", "seal")).alias("runs"))
    texts = compressed(keyed_texts(docs, id_col, text_col))
    joined = texts.join(per_text, ["id", "text_key"], "left").select("id", "text", "runs.first", "runs.number", "runs.seal")
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())])
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(span))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = decompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            for row in range(batch.num_rows):
                text = grow(batch.column(1)[row].as_py())
                words = text.split()
                spans: list[dict] = []
                firsts = batch.column(2)[row]
                kept = words
                if firsts.is_valid and len(firsts):
                    depth = np.zeros(len(words) + 1, np.int64)
                    at = firsts.values.to_numpy()
                    ends = at + batch.column(3)[row].values.to_numpy() + k - 1
                    joined, starts, stops = _spans(words)
                    pairs = zip(starts[at].tolist(), stops[ends - 1].tolist(), batch.column(4)[row].as_py())
                    proven = np.array([_seal(joined[s:e]) == seal for s, e, seal in pairs])
                    np.add.at(depth, at[proven], 1)
                    np.add.at(depth, ends[proven], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans = [{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                for column, value in zip(out, (row, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans)):
                    column.append(value)
                held += len(text)
                if held > 4 << 20:
                    yield emit(out, batch.column(0), schema)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield emit(out, batch.column(0), schema)

    return joined.mapInArrow(run, schema)


#: The same outcome in DuckDB, from every window as a string.
ORACLE_SQL = f"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - {WINDOW_WORDS - 2})) AS first, words FROM texts
), keyed AS (
  SELECT doc_id, first, md5(array_to_string(words[first:first + {WINDOW_WORDS - 1}], ' ')) AS digest FROM windows
), earliest AS (
  SELECT digest, min(doc_id) AS source FROM keyed GROUP BY digest
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, first + {WINDOW_WORDS})) AS place
  FROM keyed JOIN earliest USING (digest) WHERE source < doc_id
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.place) AS text, count(*) AS n
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(len(t.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
