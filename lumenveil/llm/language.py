"""Language identification with error-correcting output codes.

Every language gets a codeword; every bit of the codewords has one binary
classifier over hashed character n-grams (orders 1 to 3) that predicts the bit
from the mean log-odds of a text's n-grams. Decoding adds, for each language,
the exponential losses of the classifiers' margins against its codeword, each
weighted by how often that classifier is right for that language (loss-weighted
decoding), and takes the language with the least sum. A text whose two best
sums are close is flagged as ambiguous.

Up to EXHAUSTIVE languages use the exhaustive code of 2^(n-1) - 1 bits, more a
seeded random code of about 10*log2(n) bits whose rows lie far apart.

The classifiers are fitted on a sample of at most TRAIN_ROWS labelled rows (all, if
there are fewer), those with the least hashes of id and text; n-gram counts are
added up in Spark and only BUCKETS counts per language reach the driver.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and
not ambiguous; without labelled rows everything is ``und``; with one language all
texts with letters get it; very long texts are read whole; repeated rows repeat;
an empty table yields no rows; other columns are kept, and if one has the name of
the result, the result has underscores in front.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenveil.llm.textframe import free_name
from lumenveil.session import discard, materialize

UNDETERMINED = "und"
#: Bound of the training sample, in rows.
TRAIN_ROWS = 8000
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
EXHAUSTIVE = 6
#: A text is ambiguous if the best language's share is less than this above the next.
AMBIGUOUS = 0.05
#: Characters handled at a time, which bounds a worker's memory.
CHARS = 1 << 18


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code points of all planes; 32 for all but letters."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for code in range(sys.maxunicode + 1):
        if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
            table[code] = ord(chr(code).lower()[0])
    return table


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams, in pieces; none for a text without letters.

    A piece begins with the last letters of the one before, of which only n-grams
    that end in the piece count, so where a text is cut makes no difference.
    """
    tail = np.zeros(0, np.uint64)
    for at in range(0, len(text), CHARS):
        points = np.frombuffer(text[at : at + CHARS].encode("utf-32-le", "replace"), np.uint32)
        points = _letters()[points].astype(np.uint64)
        last = tail[-1] if len(tail) else np.uint64(0)
        points = points[np.concatenate([[points[0] != 32 or last != 32], (points[1:] != 32) | (points[:-1] != 32)])]
        held = len(tail)
        points = np.concatenate([tail, points])
        tail = points[-(max(ORDERS) - 1) :]
        if not (points != 32).any():
            continue
        with np.errstate(over="ignore"):
            gram = points
            for order in ORDERS:
                if order > 1:
                    if len(points) < order:
                        break
                    gram = gram[:-1] * np.uint64(0x100000001B3) + points[order - 1 :]
                mixed = (gram + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
                found = (mixed >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int32)
                begin = max(0, held - order + 1)  # n-grams that end before the piece were counted with the last
                yield found[begin:] if order > 1 else found[begin:][points[begin:] != 32]


def code_matrix(n: int) -> np.ndarray:
    """[n, bits] of +1/-1: a codeword per language, distinct rows and columns."""
    if n <= EXHAUSTIVE:
        bits = np.array([[(column >> row) & 1 for column in range(1, 1 << max(0, n - 1))] for row in range(n)], int).reshape(n, -1)
        return 1 - 2 * bits
    rng, best, far = np.random.default_rng(11), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], size=(n, math.ceil(10 * math.log2(n))))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if least > far:
            best, far = code, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  #: [languages, bits]
    odds: np.ndarray  #: [BUCKETS, bits] log-odds of a bucket
    centre: np.ndarray  #: [bits] subtracted from a text's mean log-odds
    scale: np.ndarray  #: [bits] spread of the margins
    weight: np.ndarray  #: [languages, bits]

    def margins(self, text: str) -> np.ndarray | None:
        """Mean log-odds of every bit; None for a text without a letter."""
        total, n = np.zeros(self.odds.shape[1]), 0
        for buckets in ngram_buckets(text):
            total += np.bincount(buckets, minlength=BUCKETS) @ self.odds if len(buckets) > 4 * BUCKETS else self.odds[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return total / n if n else None

    def decode(self, margins: np.ndarray) -> tuple[str, float, float]:
        """Language, its share, and how far that lies above the next one's."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0
        f = np.clip((margins - self.centre) / self.scale, -4, 4)
        loss = (self.weight * np.exp(-self.code * f)).sum(axis=1)
        share = np.exp(-(loss - loss.min()))
        share /= share.sum()
        second, first = np.argsort(share)[-2:]
        return self.languages[first], float(share[first]), float(share[first] - share[second])


def _counts(rows: DataFrame) -> DataFrame:
    """(language, bucket, n) over (language, text): n-gram counts of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for buckets in ngram_buckets(text.as_py() or ""):
                    held.setdefault(language, np.zeros(BUCKETS, np.int64))
                    held[language] += np.bincount(buckets, minlength=BUCKETS)
        for language, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], names=["language", "bucket", "n"])

    return rows.mapInArrow(run, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def _margins(rows: DataFrame, model: LanguageModel) -> list:
    """(language, margins) of every row of the bounded training sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(a, model.margins(b or "")) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            pairs = [(a, m.tolist()) for a, m in pairs if m is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([m for _, m in pairs], pa.list_(pa.float64()))], names=["language", "margins"])

    return rows.mapInArrow(run, "language string, margins array<double>").collect()


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Fit on at most ``train_rows`` rows with a language; None if there are none.

    Rows are chosen by a hash of id and text, so copies of one text do not come
    or go together; the rows with the least hashes are the sample. If there are
    more labelled rows than the bound, repeated rows (same id and text) count once.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n, sample = rows.count(), None
    if n > train_rows:
        draw = F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"), F.xxhash64(text_col)).alias("draw")
        # A threshold first, a quarter and six deviations above the bound: hashes are 64
        # bits wide, so a share of any size has one. Then the bound itself, exactly.
        share = (1.25 * train_rows + 6 * train_rows**0.5 + 20) / n
        drawn = rows.select(draw, F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("draw") < int(-(1 << 63) + min(1.0, share) * ((1 << 64) - 1)))
        drawn = materialize(drawn.dropDuplicates(["draw"]), "language-drawn")
        past = drawn.select("draw").orderBy("draw").offset(train_rows).limit(1).collect()
        sample = drawn
        rows, lang_col, text_col = (drawn.filter(F.col("draw") < past[0].draw) if past else drawn), "lang", "text"
    rows = rows.select(F.col(lang_col).alias("language"), F.col(text_col).alias("text"))
    counted = _counts(rows).collect()
    languages = sorted({r.language for r in counted})
    if not languages:
        return None
    share = np.zeros((len(languages), BUCKETS))
    for r in counted:
        share[languages.index(r.language), r.bucket] = r.n
    share = (share + 0.5) / (share + 0.5).sum(axis=1, keepdims=True)
    code = code_matrix(len(languages))
    odds = np.stack([np.log(share[code[:, b] > 0].mean(axis=0) / share[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])], axis=1) if code.size else np.zeros((BUCKETS, 0))
    bits = code.shape[1]
    model = LanguageModel(languages, code, odds.astype(np.float32), np.zeros(bits), np.ones(bits), np.ones(code.shape))
    if bits:
        seen = _margins(rows, model)
        own = np.array([languages.index(r.language) for r in seen])
        margins = np.array([r.margins for r in seen])
        means = np.stack([margins[own == k].mean(axis=0) if (own == k).any() else np.zeros(bits) for k in range(len(languages))])
        high, low = (np.stack([means[code[:, b] == s, b].mean() for b in range(bits)]) for s in (1, -1))
        model.centre, model.scale = (high + low) / 2, np.maximum((high - low) / 4, 1e-9)
        right = ((margins - model.centre) * code[own]) > 0
        weight = np.stack([right[own == k].mean(axis=0) if (own == k).any() else np.ones(bits) for k in range(len(languages))]) + 1e-6
        model.weight = weight / weight.sum(axis=1, keepdims=True)
    if sample is not None:
        discard(sample)
    return model


def identify(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text", name: str = "language") -> DataFrame:
    """The given rows with ``name`` = struct<lang_pred, score, margin, ambiguous>.

    If the rows have a column of that name, the result's has underscores in front.
    """

    @F.pandas_udf("lang_pred string, score double, margin double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            margins = model.margins(text or "") if model is not None else None
            language, score, margin = (UNDETERMINED, 0.0, 0.0) if margins is None else model.decode(margins)
            rows.append((language, score, margin, margins is not None and margin < AMBIGUOUS))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "ambiguous"])

    return docs.withColumn(free_name(name, docs.columns), predict(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id's digits is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
